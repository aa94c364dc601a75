import math
import re
from collections import Counter

import xxhash

from feltloom.llm.quality import BUCKETS, PRIOR, quality, trusted_ids

from helpers import SCHEMA, make_documents


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_long(x, seed=42):
    return xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), seed)


def grams(words, buckets):
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    pairs = [signed(hash_long(b, hash_long(a))) for a, b in zip(hashes, hashes[1:])]
    return [h % buckets for h in hashes] + [p % buckets + buckets for p in pairs]


def base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    n, repeat = len(words), len(covered)
    return words, (n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n)


def test_matches_brute_force(spark):
    frame, rows = make_documents(spark)
    rows = [*rows, (900, "a b c d e f a b c d e g\n\nx\nx\n x ### |", None, None, None), (901, "w " * 9, None, None, None), (902, "q q q q q q q q q q", None, None, None)]
    frame = spark.createDataFrame([r[:5] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 60)] + [(None, 1, 0), (5000, 1, 1), (7, None, None), (16, 1, 0), (16, 1, 0)], "doc_id long, quality int, toxic int")
    for buckets, most in ((64, 10), (BUCKETS, 20_000)):
        trusted = {r.trusted_id for r in trusted_ids(labels, most).collect()}
        assert len(trusted) <= most
        raw, target = Counter(), Counter()
        for doc, text, *_ in rows:
            g = grams(base(text)[0], buckets)
            raw.update(g)
            if doc in trusted:
                target.update(g)
        totals = [[sum(n for b, n in c.items() if (b >= buckets) == pair) for c in (raw, target)] for pair in (False, True)]
        ratio = {b: math.log((target[b] + PRIOR) / (n * totals[b >= buckets][1] / totals[b >= buckets][0] + PRIOR)) for b, n in raw.items()}
        got = quality(frame, labels, buckets, most).collect()
        assert len(got) == len(rows)
        expected = Counter()
        for doc, text, *_ in rows:
            words, numbers = base(text)
            g = grams(words, buckets)
            llr = sum(ratio[b] for b in g) / max(1, len(g))
            expected[doc, *numbers, not numbers[-1] and llr >= -0.25, round(llr, 9)] += 1
        assert Counter((*r[:8], round(r.llr, 9)) for r in got) == expected


def test_nothing_to_learn_from(spark):
    frame, rows = make_documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in quality(frame, labels).collect())
    assert quality(spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_native(spark):
    frame, _ = make_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = quality(frame, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
