import hashlib
import random
import re
from collections import defaultdict

import pytest

from feltloom.llm.exact_dedup import PatriciaTrie, better, exact_dedup

from helpers import SCHEMA, make_documents


def brute(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc))
    return {norm: (min(g)[2], len(g)) for norm, g in groups.items()}


def test_matches_brute_force(spark):
    frame, rows = make_documents(spark)
    got = exact_dedup(frame).collect()
    expected = brute(rows)
    assert len(got) == len(rows)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for doc, text, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        for r in by_doc[doc]:
            assert (r.keep_id, r.group_size) == expected[norm]
            assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
    # one row of each group stays, even where rows are repeated with their id
    assert sum(r.kept for r in got) == len(expected)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("budget", [0, 300, 5000])
def test_trie_spills_by_subtree(budget):
    draw = random.Random(budget)
    trie, expected = PatriciaTrie(budget), {}
    for i in range(3000):
        key = bytes(draw.choices(b"abc", k=draw.randint(0, 9))) * draw.choice([1, 1, 5])
        row = (draw.randint(0, 3), draw.choice([i, i // 2, None]), 1)
        trie.insert(key, row)
        old = expected.get(key)
        expected[key] = row if old is None else (*better(old[:2], row[:2]), old[2] + 1)
    got = list(trie.items())
    assert len(got) == len(expected) and dict(got) == expected


def test_trie_flushes_on_the_map_side(spark):
    frame, rows = make_documents(spark)
    small = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(frame, trie_bytes=1000).collect()}
    assert small == {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(frame).collect()}
