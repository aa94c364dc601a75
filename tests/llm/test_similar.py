import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import near_dedup
from feltloom.llm import similar
from feltloom.llm.similar import parity, prefix, wide_parity

from helpers import SCHEMA, make_documents


def plain_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    sets, parent = [plain_set(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append((r[0] is None, r[0] or 0))
    return Counter(min(g) for g in groups.values())


def kept(frame):
    return Counter((r.doc_id is None, r.doc_id or 0) for r in near_dedup(frame.sparkSession, frame, "").collect())


@pytest.mark.parametrize("few", [1000, 1])
def test_stage_matches_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(similar, "FEW", few)
    draw, rows = random.Random(11), []
    for _ in range(25):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.choice([3, 5, 9, 40, 120]))]
        for _ in range(draw.choice([1, 2, 8])):
            words = list(base)
            for _ in range(draw.randrange(1 + len(words) // 25)):
                words[draw.randrange(len(words))] = f"v{draw.randrange(9)}"
            rows.append((len(rows), " ".join(words), None, None, None))
    passage = " ".join(f"p{i}" for i in range(60))  # common, but no near copies
    rows += [(1000 + i, passage + " " + " ".join(f"q{draw.randrange(10**6)}" for _ in range(40)), None, None, None) for i in range(30)]
    rows += [(None, rows[3][1] + " end", None, None, None)]
    assert kept(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_one_changed_word_is_a_near_copy(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words), None, None, None), (2, " ".join([*words[:50], "changed", *words[51:]]), None, None, None)]
    assert kept(spark.createDataFrame(rows, SCHEMA)) == {(False, 1): 1}


def test_odd_rows_and_extra_columns(spark):
    frame, rows = make_documents(spark)
    got = near_dedup(spark, frame, "")
    assert got.columns == frame.columns and kept(frame) == expected(rows)


def test_prefix_has_a_common_shingle_of_any_similar_pair():
    draw = np.random.default_rng(2)
    common, counts = np.arange(0, 200, 3, dtype=np.int64), draw.integers(2, 9, 67)
    for _ in range(300):
        both = draw.choice(200, draw.integers(4, 60), replace=False)
        k = int(len(both) * 0.1)
        a, b = np.sort(both[k:]).astype(np.int64), np.sort(both[: len(both) - k]).astype(np.int64)
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            assert len(np.intersect1d(prefix(a, common, counts), prefix(b, common, counts)))


def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles():
    draw = np.random.default_rng(3)
    for n in (0, 1, 5, 400, 5000):
        a, b = (np.unique(draw.integers(-(2**63), 2**63, n)) for _ in range(2))
        b = np.unique(np.concatenate([a[: n * 9 // 10], b[: n // 10]]))
        differ = int(np.bitwise_count((parity(a) ^ parity(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_wide_bitmaps_fold_and_bound_as_plain_ones_do(spark):
    draw = np.random.default_rng(4)
    a = np.unique(draw.integers(-(2**63), 2**63, 4300))
    b = a[: 4000]
    assert (len(wide_parity(a)), len(wide_parity(b)), len(wide_parity(b[:1024]))) == (8192 // 64, 4096 // 64, 0)
    sets = [(wide_parity(x).tolist(), wide_parity(y).tolist()) for x, y in ((a, b), (b, a), (a, a))]
    rows = spark.createDataFrame(sets, "x array<long>, y array<long>")
    differ = [r[0] for r in rows.select(similar._differ(similar._narrowed(F.col("x"), F.col("y")), similar._narrowed(F.col("y"), F.col("x")))).collect()]
    assert differ == [int(np.bitwise_count((parity(a, 4096) ^ parity(b, 4096)).view(np.uint64)).sum())] * 2 + [0]


def test_large_sets_match_brute_force(spark):
    draw = random.Random(12)
    passage, rows = [f"p{i}" for i in range(900)], []
    for size in (900, 1100, 1300, 2100, 3000):
        for _ in range(3):
            base = passage + [f"w{draw.randrange(10**6)}" for _ in range(size)]
            for end in (0, size // 20, size // 7, size // 3):
                rows.append((len(rows), " ".join(base[end:]), None, None, None))
    assert kept(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_copies_edited_apart_cost_few_comparisons_a_member(spark, monkeypatch):
    draw, rows, asked = random.Random(13), [], []
    for group in range(2):  # three edits each: near copies of what they were edited from (left out of the second), not of each other
        base = [f"b{group}x{i}" for i in range(150)]
        if not group:
            rows.append((0, " ".join(base), None, None, None))
        for _ in range(60):
            words = list(base)
            for at in draw.sample(range(4, 146, 12), 3):
                words[at] = f"e{len(rows)}x{at}"
            rows.append((len(rows), " ".join(words), None, None, None))
    verified = similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, *rest: (asked.append(pairs.distinct().count()), verified(pairs, *rest))[1])
    assert kept(spark.createDataFrame(rows, SCHEMA)) == expected(rows)
    assert sum(asked) < 5 * len(rows)  # every two of them: 3600


def test_components_grow_by_edges_as_from_all_of_them(spark):
    draw = random.Random(14)
    edges = [sorted(draw.sample(range(40), 2)) for _ in range(24)]
    frame = lambda some: spark.createDataFrame(some, "lo long, hi long").coalesce(1)
    roots = similar.joined(similar.joined(None, frame(edges[:12])), frame(edges[12:]))
    assert sorted(map(tuple, roots.collect())) == sorted(map(tuple, similar.components(frame(edges)).collect()))
