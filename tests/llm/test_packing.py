from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feltloom.llm.packing import combinations, encode, pack, plan, sequences, solve

from helpers import SCHEMA, WORDS, make_documents, make_texts


def check(pieces, rows, sequence):
    """Each id in exactly one piece, sequences gapless and not too long; returns the padding."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {(r[0]): [*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    copies = Counter(r[0] for r in rows)
    covered, filled = Counter(), defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert len(own) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == crc32(np.array(own, "<u4").tobytes())
        covered.update((p.doc_id, i) for i in range(p.start, p.start + p.length))
        filled[p.sequence_id].append((p.offset, p.length))
    assert covered == Counter({(d, i): copies[d] for d in copies for i in range(len(ids[d]))})
    padding = 0
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence
        padding += 0 if at & (at - 1) == 0 else sequence - at
    return padding, sum(len(ids[d]) * n for d, n in copies.items())


@pytest.mark.parametrize(("sequence", "grain"), [(2048, 4), (64, 1), (64, 4)])
def test_packs_everything(spark, sequence, grain):
    frame, rows = make_documents(spark)
    pieces = pack(frame, sequence=sequence, grain=grain).collect()
    padding, total = check(pieces, rows, sequence)
    assert padding < 0.03 * total


def test_one_hot_length(spark):
    texts = ["the same words here again"] * 500 + make_texts(1, 300)
    frame, rows = make_documents(spark, texts)
    padding, total = check(pack(frame, sequence=128, grain=1).collect(), rows, 128)
    assert padding < 0.01 * total


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sequences(spark):
    texts = [t for t in make_texts(3, 40)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in enumerate(texts)]
    pieces = pack(frame, sequence=256)
    found = {r.sequence_id: r.ids for r in sequences(pieces, spark.createDataFrame(ids, "doc_id long, ids array<int>")).collect()}
    for p in pieces.collect():
        assert found[p.sequence_id][p.offset : p.offset + p.length] == dict(ids)[p.doc_id][p.start : p.start + p.length]


def test_combinations_fill_the_window():
    for units in (8, 64, 512):
        assert all(sum(c) == units and min(c) > 0 and list(c) == sorted(c, reverse=True) for c in combinations(units))
        assert len(set(combinations(units))) >= len(combinations(units)) - units * 8


def test_solver_meets_the_optimality_conditions():
    draw = np.random.default_rng(0)
    columns = combinations(16)
    histogram = draw.integers(0, 50, 17)
    histogram[0] = 0
    x = solve(columns, histogram, 5000)
    matrix = np.array([[c.count(u) for c in columns] for u in range(17)], float)
    gradient = matrix.T @ (matrix @ x - histogram)
    assert x.min() >= 0 and gradient.min() > -0.5 and np.abs(gradient * x).max() < 0.5 * max(1, x.max())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=33, max_size=33))
def test_plan_uses_each_piece_once(counts):
    histogram = np.array([0, *counts[1:]])
    chosen, left = plan(histogram)
    used = Counter()
    for combination, repeats in chosen:
        assert sum(combination) <= 32 and repeats > 0
        for u in combination:
            used[u] += repeats
    assert all(used[u] + left[u] == histogram[u] and left[u] >= 0 for u in range(33))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*WORDS, " ", "  ", "\n", "'s", "\t", "<|endoftext|>", "\x1c", "\u0301", "\u017f", "\u00b2"]), max_size=40))
def test_fast_ids_are_the_librarys(parts):
    text = "".join(parts)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert encode("byte_bpe_50k.json", text).tolist() == library.encode(text, add_special_tokens=False).ids
