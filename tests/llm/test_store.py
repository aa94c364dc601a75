import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feltloom.llm.store import MOST, combine_crc32, cuts, cuts_of, digests, merkle_root, read_documents, read_store, store_digests, write_store
from feltloom.llm.tokens import tokenizer

from helpers import SCHEMA, make_documents


def expected(rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found, start = [], 0
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        found.append((doc, start, len(ids), crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return found


def test_round_trip(spark, tmp_path):
    frame, rows = make_documents(spark)
    whole = expected(rows)
    path = f"file://{tmp_path}/store"
    write_store(frame, path)
    assert Counter(map(tuple, digests(spark, path).collect())) == Counter(r[:4] for r in whole)
    assert Counter((r.doc_id, r.start, r.n, tuple(r.ids)) for r in read_documents(spark, path).collect()) == Counter((*r[:3], tuple(r[4])) for r in whole)
    recipes, chunks, manifest = read_store(spark, path)
    stored = [r.digest for r in chunks.collect()]
    assert len(stored) == len(set(stored))  # unique chunks once
    used = {bytes(r.digests[i : i + 32]) for r in recipes.collect() for i in range(0, len(r.digests), 32)}
    assert used == set(map(bytes, stored))
    assert sum(r.ids for r in manifest.collect()) == sum(r[2] for r in whole)


def test_empty_table(spark):
    assert store_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_damaged_chunk_is_found(spark, tmp_path):
    frame, _ = make_documents(spark, ["some text " * 50, "other words"])
    good, bad = f"file://{tmp_path}/good", f"file://{tmp_path}/bad"
    write_store(frame, good)
    packs = spark.read.parquet(f"{good}/packs").selectExpr("* except (payload)", "if(kind = 1, concat(payload, payload), payload) payload")
    packs.write.parquet(f"{bad}/packs")
    spark.read.parquet(f"{good}/manifest").write.parquet(f"{bad}/manifest")
    with pytest.raises(Exception, match="does not match its address"):
        digests(spark, bad).collect()


def test_a_lost_recipe_is_found(spark, tmp_path):
    frame, _ = make_documents(spark)
    good, bad = f"file://{tmp_path}/good", f"file://{tmp_path}/bad"
    write_store(frame, good)
    spark.read.parquet(f"{good}/packs").where("not (kind = 0 and doc_id = 3)").write.parquet(f"{bad}/packs")
    spark.read.parquet(f"{good}/manifest").write.parquet(f"{bad}/manifest")
    with pytest.raises(Exception, match="does not match the manifest"):
        digests(spark, bad).collect()


def test_cuts_follow_content():
    draw = random.Random(2)
    body = [draw.randrange(40_000) for _ in range(20_000)]
    a, b = np.array(body, np.uint16), np.array(body[777:], np.uint16)
    ends_a, ends_b = cuts(a), [e + 777 for e in cuts(b)]
    assert ends_a[-1] == len(a) and max(np.diff([0, *ends_a])) <= MOST
    assert len(set(ends_a) & set(ends_b)) > 0.8 * len(ends_b)
    assert cuts(np.array([2], np.uint16)) == [1]
    assert cuts(np.zeros(5000, np.uint16))[-1] == 5000
    streams = [a, a[:100], b, a[:1], b[:5000]]
    assert cuts_of(np.concatenate(streams), np.cumsum([len(s) for s in streams]).tolist()) == [cuts(s) for s in streams]


@given(st.binary(max_size=200), st.binary(max_size=200))
def test_combined_crc(a, b):
    assert combine_crc32(crc32(a), crc32(b), len(b)) == crc32(a + b)


def test_merkle_root():
    leaves = [bytes([i]) * 32 for i in range(5)]
    roots = {merkle_root(leaves[:i]) for i in range(6)} | {merkle_root(leaves[::-1])}
    assert len(roots) == 7


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aB' sΣ́é1\n\t  東")), max_size=30))
def test_words_encode_like_the_whole(text):
    library = tokenizer("word_bpe_49k.json")
    pieces = text.replace("\n", " ").split(" ")
    assert [i for p in pieces for i in library.encode(p, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids
