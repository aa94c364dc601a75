import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feltloom.llm.byte_bpe import encode_decode
from feltloom.llm.token_counts import token_counts
from feltloom.llm.tokens import PieceCache, safe_split, tokenizer, word_ranks

from helpers import SCHEMA, make_documents


def test_token_counts(spark):
    frame, rows = make_documents(spark)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for doc, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected[doc, len((text or "").encode()), n, n > 1024] += 1
    assert Counter(map(tuple, token_counts(frame).collect())) == expected


def test_byte_bpe_round_trip(spark):
    frame, rows = make_documents(spark)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for doc, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        expected[doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, encode_decode(frame).collect())) == expected


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts(empty).collect() == [] and encode_decode(empty).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab' s.é1\n\t  東\x1c#")), max_size=30))
def test_pieces_encode_like_the_whole(text):
    cut = safe_split(text)
    if cut is not None:
        assert "".join(cut) == text
        library = tokenizer("byte_bpe_50k.json")
        assert [i for p in cut for i in library.encode(p, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aB' ,.é1-")), max_size=6), max_size=8))
def test_cache_values_are_the_librarys(pieces):
    pieces = [*pieces, "<|ENDOFTEXT|>", "<|endoftext|>."]
    encode = lambda xs: [tuple(e.ids) for e in tokenizer("byte_bpe_50k.json").encode_batch(xs, add_special_tokens=False)]
    get = PieceCache(encode, 5).fill(pieces)
    assert [get(p) for p in pieces] == encode(pieces)


ODD = [*"abcdeABtthhsnaaé1²,.'-#", "\u0130", "\u03a3", "\u0301", "\xa0", "\x1c", "\t", "ß", "東", "'s", "'LL", "<|startoftext|>", "<|STARTOFTEXT|>", "ing", "tion", "er", "\u01c5", "\u0345", "\uf8ff", "\x00"]


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=14))
def test_word_ranks_are_the_librarys(parts):
    pieces = ["".join(parts[:7]), "".join(parts[7:]), "", "plain", "Word.", "a.,"]
    raw = word_ranks("word_bpe_49k.json").raw(pieces)
    assert [np.frombuffer(r, "<u2").tolist() for r in raw] == [e.ids for e in tokenizer("word_bpe_49k.json").encode_batch(pieces, add_special_tokens=False)]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*ODD, " ", " ", "\n", "word", "Ünd", ". ", ", ", "..", ".,", "ª"]), max_size=30))
def test_whole_texts_are_the_librarys(parts):
    ranks = word_ranks("word_bpe_49k.json")
    texts = ["".join(parts), "".join(parts[:9]), "", "Plain words, and a stop.\n" + "".join(parts[9:]), " plain  again "]
    got = [np.frombuffer(r, "<u2").tolist() for r in ranks.texts(texts, PieceCache(ranks.raw, 10, cut=False).fill)]
    assert got == [e.ids for e in tokenizer("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)]


def test_cache_generations():
    calls = []
    cache = PieceCache(lambda xs: calls.append(sorted(xs)) or [len(x) for x in xs], entries=3, fixed={"tier": 4})
    draw = random.Random(0)
    for _ in range(50):
        pieces = ["tier"] + ["x" * draw.randint(1, 9) for _ in range(4)]
        get = cache.fill(pieces)
        assert [get(p) for p in pieces] == [len(p) for p in pieces]
        assert len(cache.young) <= 3 + 1 + 5
    assert all("tier" not in c for c in calls)
