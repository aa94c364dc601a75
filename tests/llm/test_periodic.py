import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from feltloom.llm.periodic import kept_words, made_periodic, periodic_runs, runs_of, scan

from helpers import SCHEMA, make_documents


def brute(words):
    """Every stretch by its definition: smallest period, long enough, and not extended by a neighbour."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        for start in range(n):
            if start and start - 1 + q < n and words[start - 1] == words[start - 1 + q]:
                continue  # the word before extends it
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start < max(6, 4 * q) or end > n:
                continue
            smallest = next(p for p in range(1, q + 1) if all(words[i] == words[i + p] for i in range(start, end - p)))
            if smallest == q:
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, periodic):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if periodic and doc_id is not None and n and crc32(str(doc_id).encode()) % 10 == 0:
        g = crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    listed, rest = "".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(rest))


def periodic_texts(seed=3):
    draw = random.Random(seed)
    texts = ["a a a a a", "a a a a a a", "a a a a a a b", "x a b a b a b a b y", "a b a b a b a b a", "a a a a a a a a b a a a a a a a a b " * 5]
    for _ in range(60):
        body = [draw.choice("abc") for _ in range(draw.randint(1, 6))] * draw.randint(1, 9)
        texts.append("\n".join([draw.choice("abcd") for _ in range(draw.randint(0, 9))] + body + [draw.choice("abcd") for _ in range(draw.randint(0, 9))]))
    return texts


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=4), st.integers(1, 5))
def test_scan_is_the_definition(texts, times):
    texts = [t * times for t in texts]
    assert runs_of(texts) == [brute(t) for t in texts]


def test_lag_ranges_add_up():
    words = [w for t in periodic_texts() for w in t.split()]
    ids = np.array([ord(w) for w in words], np.int32)
    cut = [r for low in range(1, len(ids), 7) for r in scan(ids, range(low, low + 7))]
    assert sorted(cut, key=lambda r: (r[0], r[2])) == brute(words)


def test_periods_that_divide_count_once():
    assert scan(np.array([1, 2] * 12, np.int32), range(1, 7)) == [(0, 24, 2)]
    assert scan(np.array([1] * 24, np.int32), range(1, 7)) == [(0, 24, 1)]


def test_nested_runs_drop_both_ways():
    words = "a a a a a a b".split() * 4
    runs = brute(words)
    assert [(r[1], r[2]) for r in runs if r[2] == 7] == [(28, 7)] and kept_words(words, runs) == ["a", "b"]


def test_made_periodic():
    for doc_id in range(300):
        words = [f"w{i}" for i in range(doc_id % 41)]
        new = made_periodic(words, doc_id)
        assert len(new) == len(words)
        assert expected(doc_id, " ".join(words), True)[7] == hashlib.sha256(" ".join(kept_words(new, brute(new))).encode()).hexdigest()


def test_whole_table(spark):
    texts = periodic_texts()
    frame, rows = make_documents(spark, [None, "", " ", *texts, *texts[:40], " ".join(["word"] * 300)])
    for periodic in (False, True):
        whole = Counter(expected(doc_id, text, periodic) for doc_id, text, *_ in rows)
        for work in (1 << 29, 60):  # all in place; nearly all dealt out by lags
            assert Counter(map(tuple, periodic_runs(frame, periodic, work).collect())) == whole


def test_empty_table(spark):
    assert periodic_runs(spark.createDataFrame([], SCHEMA), True).collect() == []


def test_a_long_text_in_seconds():
    draw = random.Random(1)
    words = [str(draw.randrange(2000)) for _ in range(30_000)]
    words[5000:5400] = words[5000:5100] * 4
    assert any(start <= 5000 and start + length >= 5400 and q == 100 for start, length, q in runs_of([words])[0])
