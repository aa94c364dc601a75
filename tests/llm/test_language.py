import itertools
import random

import numpy as np

from feltloom.llm.language import Field, Labeller, features, label_documents, label_words, language_id, train

from helpers import SCHEMA, make_documents

VOCABULARY = {"aa": "ton mot lune sole bleu rive nuit".split(), "bb": "krug wald zicht baum kraft spiel".split(), "cc": "ñosa ción llama perro queso año".split()}


def corpus(seed, n):
    draw = random.Random(seed)
    return [(" ".join(draw.choices(VOCABULARY[lang], k=draw.randint(3, 40))).capitalize() + ".", lang) for lang in VOCABULARY for _ in range(n)]


def test_forward_backward_matches_enumeration():
    draw = np.random.default_rng(0)
    field = Field(["x", "y", "z"])
    field.start, field.move = draw.normal(size=3), draw.normal(size=(3, 3))
    sizes = [4, 1, 6, 4, 2]
    scores = draw.normal(size=(sum(sizes), 3))
    got, at = field.posteriors(scores, sizes), 0
    for n in sizes:
        own, expected = scores[at : at + n], np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            weight = np.exp(field.start[path[0]] + sum(own[t, k] for t, k in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:])))
            for t, k in enumerate(path):
                expected[t, k] += weight
        assert np.allclose(got[at : at + n], expected / expected.sum(axis=1, keepdims=True))
        at += n


def test_learns_and_labels_mixed_text():
    field = train(corpus(0, 80))
    assert field.languages == ["aa", "bb", "cc"]
    assert all(field.move[k, k] > field.move[k, j] for k in range(3) for j in range(3) if j != k)
    held = corpus(1, 40)
    predicted = Labeller(field).predict([t for t, _ in held])
    assert sum(p == lang for (p, _), (_, lang) in zip(predicted, held)) >= 0.98 * len(held)
    mixed = "ton mot lune sole bleu rive krug wald zicht baum kraft spiel"
    assert [k for _, k in label_words(field, mixed)] == ["aa"] * 6 + ["bb"] * 6


def test_features_do_not_depend_on_company():
    words = ["a", "été", "longer", "東京", "a"]
    feature, owner = features(words)
    for i, w in enumerate(words):
        assert sorted(feature[owner == i]) == sorted(features([w])[0])


def test_whole_table(spark):
    texts = [t for t, _ in corpus(2, 60)]
    langs = [k for _, k in corpus(2, 60)]
    rows = [(i, t, k, "s", 1) for i, (t, k) in enumerate(zip(texts, langs))]
    rows += [(900, None, "aa", None, None), (901, "", "bb", None, None), (902, "12 34 !!", "aa", None, None), (None, texts[0], "bb", None, None), (903, "ton " * 60_000, None, None, None), (0, texts[0], langs[0], "s", 1)]
    got = language_id(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    import zlib

    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    found = {r.doc_id: r.lang_pred for r in got}
    assert {found[i] for i in (900, 901, 902)} == {"und"} and found[903] == "aa" and found[None] == langs[0]
    held = [(r.lang_pred, langs[r.doc_id]) for r in got if r.held_out and r.doc_id < len(langs)]
    assert held and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_nothing_labelled_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "some text", None, None, None)], SCHEMA)
    assert [tuple(r) for r in language_id(rows).collect()] == [(1, False, "und", 0.0)]
    assert language_id(spark.createDataFrame([], SCHEMA)).collect() == []


def test_carries_any_columns(spark):
    frame, rows = make_documents(spark)
    field = train(corpus(0, 10))
    got = label_documents(frame, "text", field)
    assert got.columns == [*frame.columns, "lang_pred", "lang_score"] and got.count() == len(rows)


def test_texts_are_sent_to_the_workers_once(spark):
    """The pipeline's stage sent each text twice, in its row and beside it, which an executor's memory did not hold at 0.5 GB."""
    frame, rows = make_documents(spark)
    field = train(corpus(0, 10))
    flat = label_documents(frame.select("doc_id", "text"), "text", field)
    from pyspark.sql import functions as F

    nested = label_documents(frame.select(F.struct("*").alias("row")), "row.text", field)
    assert "lang_text" not in nested._jdf.queryExecution().optimizedPlan().toString() + flat._jdf.queryExecution().optimizedPlan().toString()
    key = lambda r: (str(r[0]), str(r[1]), r[2], round(r[3], 9))
    assert sorted(map(key, flat.collect())) == sorted(map(key, nested.select("row.doc_id", "row.text", "lang_pred", "lang_score").collect()))
    numbers = label_documents(frame.select("doc_id"), "doc_id", field).collect()  # what is no string is cast
    assert len(numbers) == len(rows) and {r.lang_pred for r in numbers} == {"und"}
