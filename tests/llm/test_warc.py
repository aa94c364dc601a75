import base64
import gzip
import hashlib
import io
import random
from collections import Counter
from pathlib import Path

import pytest

from feltloom.llm.warc import archive_report, checked_index, members, page_record, parse_record, read_archive, write_archive

SCHEMA = "page_id long, url string, html string"


def make_pages(seed=5, n=200):
    draw = random.Random(seed)
    bodies = [f"<p>{'x' * k} über {k}</p>" for k in range(n)]
    rows = [(i, f"http://h{i % 7}.example/{i}", draw.choice([draw.choice(bodies), bodies[0], bodies[0], None, ""])) for i in range(n)]
    rows += [(None, "http://no.id/", bodies[3]), (None, None, "only here"), (None, "http://b/", "only here"), (7, "http://again/", rows[7][2]), rows[8], rows[8], (10**12, "http://a b\r\nX: y/", "odd\x00 \r\n\r\nWARC/1.1"), (-5, "http://neg/", bodies[0]), (300, "http://long/", "word " * 200_000)]
    draw.shuffle(rows)
    return rows


def expected(rows):
    payload = lambda r: (r[2] or "").encode()
    order = lambda r: (r[0] is None, r[0] or 0)
    owner, taken, out = {}, set(), Counter()
    for r in sorted(rows, key=order):
        owner.setdefault(payload(r), r[0])
    for r in sorted(rows, key=order):
        data = payload(r)
        first = owner[data] == r[0] and data not in taken
        taken |= {data} if first else set()
        out[(r[0], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else owner[data])] += 1
    return out


def files(folder):
    return {p.name: p.read_bytes() for p in Path(folder).iterdir() if p.name.endswith(".warc.gz")}


def test_report_is_the_contract(spark, tmp_path):
    rows = make_pages()
    frame = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, archive_report(frame, f"file://{tmp_path}/a").collect())) == expected(rows)
    clash = frame.selectExpr("*", "'x' as key", "'y' as digest", "1 as note", "2 as owner", "3 as n")
    assert Counter(map(tuple, archive_report(clash, f"file://{tmp_path}/b").collect())) == expected(rows)


def test_same_files_however_partitioned(spark, tmp_path):
    rows = make_pages()
    a, b = (f"{tmp_path}/{x}" for x in "ab")
    write_archive(spark.createDataFrame(rows, SCHEMA).repartition(1), f"file://{a}", roll=4000, shard_bytes=100_000)
    write_archive(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), f"file://{b}", roll=4000, shard_bytes=100_000)
    assert files(a) == files(b) and len(files(a)) > 8
    assert not Path(a, "_drafts").exists()
    assert all(len(x) < 40_000 for n, x in files(a).items())
    assert Counter(tuple(r)[:5] for r in checked_index(spark, f"file://{a}").collect()) == expected(rows)


def test_records_are_whole_and_sorted(spark, tmp_path):
    rows = make_pages()
    write_archive(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/a", roll=4000, shard_bytes=100_000)
    ids = []
    for name, data in sorted(files(f"{tmp_path}/a").items()):
        text = gzip.decompress(data)  # any reader of gzip can
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and f"WARC-Filename: {name}\r\n".encode() in text
        found = [parse_record(x) for x in members(io.BytesIO(data), 100)]
        ids += [r.fields["WARC-Record-ID"].split(":")[2] for r in found[1:]]
    numbers = [float("inf") if x == "none" else int(x) for x in ids]
    assert numbers == sorted(numbers) and len(ids) == len(rows)
    back = Counter((r.page_id, r.html) for r in read_archive(spark, f"file://{tmp_path}/a", html=True).collect() if r.record_type == "response")
    assert set(back) <= {(r[0], r[2] or "") for r in rows} and set(back.values()) == {1}
    assert {html for _, html in back} == {r[2] or "" for r in rows}


def test_a_page_id_of_a_third_of_all_rows_is_spread(spark, tmp_path):
    rows = [(i, None, f"page {i} " * 50) for i in range(200)] + [(77, None, f"other {i} " * 50) for i in range(100)]
    write_archive(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/a", shard_bytes=10_000)
    counts = Counter(len([0 for m in members(io.BytesIO(x))]) - 1 for x in files(f"{tmp_path}/a").values())
    assert max(counts) < 60
    assert Counter(tuple(r)[:5] for r in checked_index(spark, f"file://{tmp_path}/a").collect()) == expected(rows)


def test_damage_is_found(spark, tmp_path):
    rows = make_pages()
    folder = f"{tmp_path}/a"
    write_archive(spark.createDataFrame(rows, SCHEMA), f"file://{folder}", roll=4000, shard_bytes=100_000)
    name, data = sorted(files(folder).items())[1]
    plain = [gzip.decompress(data)]
    assert plain
    for wrong in (data[:-20], data[: len(data) // 2] + b"\x00" + data[len(data) // 2 + 1 :], data + data):
        Path(folder, f".{name}.crc").unlink(missing_ok=True)
        Path(folder, name).write_bytes(wrong)
        with pytest.raises(Exception, match="does not match|damaged|ends within|Error"):
            checked_index(spark, f"file://{folder}")
    Path(folder, name).write_bytes(data)
    assert checked_index(spark, f"file://{folder}").count() == len(rows)


def test_drafts_of_other_attempts_are_not_read(spark, tmp_path):
    rows = make_pages(n=20)
    write_archive(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/a")
    Path(tmp_path, "a", "pages-99999-00000.warc.gz").write_bytes(b"left by a writer that died")
    assert checked_index(spark, f"file://{tmp_path}/a").count() == len(rows)


def test_empty_table(spark, tmp_path):
    assert archive_report(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/a").collect() == []


def test_headers_cannot_be_forged():
    record = parse_record(page_record(1, "http://a/\r\nWARC-Type: x", b"\r\n\r\n", 0, None, "2024-01-01T00:00:00Z"))
    assert record.kind == "response" and record.fields["WARC-Target-URI"] == "http://a/%0D%0AWARC-Type:%20x"
    assert record.block.endswith(b"\r\n\r\n\r\n\r\n")
