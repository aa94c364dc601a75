import hashlib
import math
import random
from pathlib import Path
from urllib.parse import unquote, urlparse
from zlib import crc32

import pyarrow.parquet as pq
import pytest

from feltloom.llm.splitters import exact_splitters, range_of
from feltloom.llm.upsert import apply_changes, client_upsert, layout, read_manifest, write_table

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
NAMES = [c.split()[0] for c in CLIENTS.split(", ")]
VALUES = ["source", "segment", "city", "balance"]
crc = lambda x: crc32(str(x).encode())


def brute(clients, changes):
    """The contract, file by file, in one process."""
    every = 1 + len(clients) // 700
    start = sorted(({**c} for c in clients if c["client_id"] is not None and crc(c["client_id"]) % 7 > 3), key=lambda c: c["client_id"])
    files = [start[i : i + every] for i in range(0, len(start), every)]
    if not files:
        return []
    firsts = [f[0]["client_id"] for f in files]
    best = {}
    low = lambda x: (x is not None, x)
    for c in changes:
        if c["client_id"] is not None:
            rank = tuple(low(c[k]) for k in ["seq", "change_id", "op", *VALUES])
            if c["client_id"] not in best or rank > best[c["client_id"]][0]:
                best[c["client_id"]] = rank, c
    after = [[dict(r) for r in f] for f in files]
    for key, (_, c) in best.items():
        home = max((i for i, f in enumerate(firsts) if f <= key), default=0)
        h = crc(firsts[home]) % 12
        if h > 7:
            continue
        rows = [r for r in after[home] if r["client_id"] == key]
        if c["op"] == "D" or c["change_id"] is not None and crc(c["change_id"]) % 8 < h:
            after[home] = [r for r in after[home] if r["client_id"] != key]
            continue
        if not rows:
            rows = [dict.fromkeys(NAMES) | {"client_id": key}]
            after[home] += rows
        for r in rows:
            r |= {v: c[v] for v in VALUES}
    out = []
    for old, new in zip(files, after):
        new.sort(key=lambda r: r["client_id"])
        if old == new:
            out.append((False, new))
            continue
        n, pieces = len(new), -(-len(new) // every)
        at = 0
        for i in range(pieces):
            size = n // pieces + (1 if i < n % pieces else 0)
            piece, at = new[at : at + size], at + size
            if out and out[-1][0] and len(out[-1][1]) + size <= every:
                out[-1] = (True, out[-1][1] + piece)
            else:
                out.append((True, piece))
    found = []
    for rewritten, rows in out:
        cents = sum(math.floor(100 * r["balance"] + 0.5) if r["balance"] is not None else 0 for r in rows)
        crcs = sum(crc("|".join(r[v] or "" for v in VALUES[:3])) for r in rows)
        ids = hashlib.sha256(",".join(str(r["client_id"]) for r in rows).encode()).hexdigest()
        found.append((rows[0]["client_id"], len(rows), cents, crcs, ids, ",".join(NAMES), rewritten))
    return found


def made(seed, n, spread, changes):
    draw = random.Random(seed)
    text = lambda: draw.choice(["a", "b", "ö", None])
    money = lambda: draw.choice([None, 0.0, -1.005, 12.345, draw.uniform(-1e4, 1e4)])
    ids = draw.sample(range(-spread, spread), n)
    clients = [dict(zip(NAMES, (i, i, text(), None, f"n{i}", None, text(), draw.choice([None, 1]), text(), money()))) for i in ids] + [dict.fromkeys(NAMES)]
    out = []
    for k in range(changes):
        key = draw.choice([None, ids[0], ids[0], draw.choice(ids), draw.choice(ids), draw.randrange(-2 * spread, 2 * spread)])
        out.append({"change_id": draw.choice([k, k, k, None]), "client_id": key, "seq": draw.choice([None, 0, 1, k % 9]), "op": draw.choice("UUUID"), "valid_at": None, **{v: text() for v in VALUES[:3]}, "balance": money()})
    same = [{**c, "seq": 99, **{v: r[v] for v in VALUES}, "client_id": r["client_id"], "op": "U"} for c, r in zip(out, clients[: n // 3])]  # changes that change nothing
    return clients, out + same + out[: changes // 4]


def frames(spark, clients, changes):
    a = spark.createDataFrame([tuple(c[k] for k in NAMES) for c in clients], CLIENTS)
    names = [c.split()[0] for c in CHANGES.split(", ")]
    b = spark.createDataFrame([tuple(c[k] for k in names) for c in changes], CHANGES)
    return a, b


def rows(report):
    return [(r.first_id, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.columns, r.rewritten) for r in sorted(report, key=lambda r: r.first_id)]


@pytest.mark.parametrize("seed, n, spread, n_changes", [(3, 300, 200, 150), (4, 705, 10**9, 3000)])
def test_report_is_the_contract(spark, tmp_path, seed, n, spread, n_changes):
    clients, changes = made(seed, n, spread, n_changes)
    report = client_upsert(*frames(spark, clients, changes), f"file://{tmp_path}/t").collect()
    assert rows(report) == brute(clients, changes)
    there = sorted(p.name for p in Path(tmp_path, "t").iterdir() if p.name[0] not in "._")
    assert there == sorted(r.path.rpartition("/")[2] for r in report)  # no other data files
    for r in report:
        file = pq.read_table(unquote(urlparse(r.path).path))
        assert file.column_names == NAMES and file["client_id"].to_pylist() == sorted(file["client_id"].to_pylist())
        assert len(file) == r.n_rows and file["client_id"][0].as_py() == r.first_id


def test_untouched_files_stay(spark, tmp_path):
    clients, changes = made(6, 705, 2000, 6)
    a, b = frames(spark, clients, changes)
    report = client_upsert(a, b, f"file://{tmp_path}/t").collect()
    assert 0 < sum(r.rewritten for r in report) < 60
    assert {r.path.rpartition("/")[2][:3] for r in report if not r.rewritten} == {"c0-"} and {r.path.rpartition("/")[2][:3] for r in report if r.rewritten} == {"c1-"}


def test_a_second_commit(spark, tmp_path):
    """Files that were joined or cut by one commit are homes of the next."""
    folder = f"file://{tmp_path}/t"
    rows = [(i, f"v{i}") for i in range(0, 200, 2)]
    frame = lambda x: spark.createDataFrame(x, "id long, v string, seq long, op string")
    write_table(spark.createDataFrame(rows, "id long, v string"), "id", 10, folder)
    rule = lambda change, first: (first.isNull(), change["op"] == "D")
    live = dict(rows)
    for commit, changed in enumerate([[(i, None, 0, "D") for i in range(4, 90, 2)] + [(i, "new", 0, "U") for i in range(101, 160)], [(i, "again", 0, "U") for i in range(1, 120, 3)], [(i, None, 0, "D") for i in range(0, 400)]]):
        apply_changes(spark, folder, frame(changed), ["v"], ["seq"], ["op"], rule)
        for key, v, _, op in changed:
            live.pop(key, None) if op == "D" else live.update({key: v})
        table = read_manifest(spark, folder)
        assert table.commits == commit + 1
        names = [f.name for f in table.files]
        assert sorted(names) == sorted(p.name for p in Path(tmp_path, "t").iterdir() if p.name[0] not in "._")
        found = [tuple(x.values()) for n in names for x in pq.read_table(f"{tmp_path}/t/{n}").to_pylist()]
        assert found == sorted(live.items()) and all(pq.read_metadata(f"{tmp_path}/t/{n}").num_rows <= 10 for n in names)


def test_rows_that_repeat_a_key(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    rows = [(i, i, "x") for i in range(30)] + [(7, 100 + i, "x") for i in range(25)]
    write_table(spark.createDataFrame(rows, "id long, other long, v string"), "id", 5, folder)
    changes = spark.createDataFrame([(7, "y", 1, "U"), (8, None, 1, "D"), (9, "x", 1, "U")], "id long, v string, seq long, op string")
    apply_changes(spark, folder, changes, ["v"], ["seq"], ["op"], lambda change, first: (first.isNull(), change["op"] == "D"))
    found = [tuple(x.values()) for f in read_manifest(spark, folder).files for x in pq.read_table(f"{tmp_path}/t/{f.name}").to_pylist()]
    assert sorted(found) == sorted((i, o, "y" if i == 7 else "x") for i, o, _ in rows if i != 8)


def test_empty_tables(spark, tmp_path):
    clients, changes = made(7, 20, 50, 30)
    a, b = frames(spark, clients, changes)
    assert client_upsert(a.limit(0), b, f"file://{tmp_path}/a").collect() == []
    assert rows(client_upsert(a, b.limit(0), f"file://{tmp_path}/b").collect()) == brute(clients, [])
    extra = client_upsert(a.selectExpr("*", "'x' as home", "1 as key", "2 as row", "3 as file_name"), b.selectExpr("*", "'x' as home", "2 as key"), f"file://{tmp_path}/c").collect()
    assert [r[:5] for r in rows(extra)] == [r[:5] for r in brute(clients, changes)]


@pytest.mark.parametrize("keys, every", [([5], 3), (list(range(1000)), 7), ([3] * 50 + [9], 10), ([-(2**63), 2**63 - 1, 0], 1), ([2**63 - 1] * 3, 1), ([], 4)])
def test_splitters(spark, keys, every):
    found = exact_splitters(spark.createDataFrame([(k,) for k in keys], "k long"), every)
    assert found == sorted(keys)[::every]


def test_splitters_of_wide_keys(spark):
    draw = random.Random(4)
    keys = [draw.randrange(-(2**63), 2**63) for _ in range(3000)] + [draw.randrange(10) for _ in range(3000)]
    assert exact_splitters(spark.createDataFrame([(k,) for k in keys], "k long"), 20) == sorted(keys)[::20]
    starts = sorted(keys)[::20]
    placed = spark.createDataFrame([(k,) for k in keys], "k long").select("k", range_of(__import__("pyspark").sql.functions.col("k"), starts).alias("at")).collect()
    assert all(starts[r.at] <= r.k and (r.at + 1 == len(starts) or starts[r.at + 1] > r.k) for r in placed)


def test_layout():
    assert layout([(False, 5), (True, 0), (True, 12), (False, 5), (True, 2), (True, 1), (True, 3)], 5) == [(0, 0, 5, False), (2, 0, 4, True), (2, 4, 4, True), (2, 8, 4, True), (3, 0, 5, False), (4, 0, 3, True), (6, 0, 3, True)]
    assert layout([(True, 11), (True, 1)], 10) == [(0, 0, 6, True), (0, 6, 6, True)]
