import re
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feltloom.llm import common
from feltloom.llm.exact_dedup import _candidates, drop_exact_duplicates
from feltloom.llm.simhash import drop_near_duplicates
from feltloom.llm.similar import _prefixes

from helpers import SCHEMA, make_documents
from test_packing import check
from test_similar import expected
from test_simhash import brute_components, plain_fingerprint
from test_toxicity import BAD, CLEAN


def survivors(frame):
    return Counter(map(tuple, frame.select("doc_id", "text").collect()))


def brute_exact(rows):
    best = {}
    for doc, text, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        key = (-len(text or ""), doc is None, doc or 0)
        if norm not in best or key < best[norm][0]:
            best[norm] = (key, (doc, text))
    return Counter(row for _, row in best.values())


def brute_near(rows):
    roots = brute_components({plain_fingerprint(r[1]) for r in rows})
    groups = defaultdict(list)
    for r in rows:
        groups[roots[plain_fingerprint(r[1])]].append((r[0] is None, r[0] or 0))
    return Counter(min(g) for g in groups.values())


def test_exact_stage(spark):
    frame, rows = make_documents(spark)
    got = drop_exact_duplicates(frame)
    assert got.columns == frame.columns
    lengths = Counter((d, len(t or "")) for d, t in survivors(got).elements())
    assert lengths == Counter((d, len(t or "")) for d, t in brute_exact(rows).elements())


def test_near_stage(spark):
    frame, rows = make_documents(spark)
    got = drop_near_duplicates(frame)
    assert got.columns == frame.columns
    assert Counter((d is None, d or 0) for d, _ in survivors(got).elements()) == brute_near(rows)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top, draw = tmp_path_factory.mktemp("tables"), random.Random(5)
    rows = []
    for i in range(150):
        words = draw.choices(CLEAN, k=draw.randint(20, 200))
        if i % 3 == 0:
            words[::9] = draw.choices(BAD, k=len(words[::9]))
        rows.append((i, " ".join(words), "en", "s", 1))
    for i in range(150, 220):
        rows.append((i, " ".join(draw.choices("über straße zwölf krug wald baum kraft spiel".split(), k=draw.randint(20, 200))), "de", "s", 1))
    rows += [(400, rows[151][1], "de", "s", 1), (401, rows[151][1].replace(" ", "  "), "de", "s", 1), rows[152], (402, None, None, None, None), (403, "12 34", "en", None, None), (404, "", None, None, None), (None, rows[153][1] + " krug", "de", None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 150 and i % 3 == 0)) for i in range(220)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top), rows


def test_every_stage_takes_effect(spark, tables):
    top, rows = tables
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, top)
        assert docs.columns == columns
        kept = docs.collect()
        seen[name] = kept
        docs = spark.createDataFrame(kept, SCHEMA)
    assert Counter(r.doc_id for r in seen["language_id"]) == Counter(r[0] for r in rows if re.search(r"[^\W\d_]", r[1] or ""))
    bad = {r[0] for r in rows if r[0] is not None and r[0] < 150 and r[0] % 3 == 0}
    kept = {r.doc_id for r in seen["toxicity"]}
    assert len(kept & bad) <= 2 and len({r[0] for r in rows} - kept - bad) <= 5
    assert Counter(len(t) for _, t in survivors(spark.createDataFrame(seen["exact_dedup"], SCHEMA)).elements()) == Counter(len(t) for _, t in brute_exact(list(map(tuple, seen["toxicity"]))).elements())
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in seen["near_dedup"]) == expected(list(map(tuple, seen["exact_dedup"])))
    pieces = corpus_pipeline.packing(spark, docs, top).collect()
    check(pieces, list(map(tuple, seen["near_dedup"])), 2048)
    assert Counter(p.doc_id for p in corpus_pipeline.run(spark, top).collect()) == Counter(p.doc_id for p in pieces)


def test_empty_table(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_send_a_few_mb_at_a_time(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    rows = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 5000).alias("text"))
    try:
        corpus_pipeline.near_dedup(spark, make_documents(spark)[0], "")
        assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= (4 << 20) + 10_000
        spark.conf.set(setting, "1m")
        corpus_pipeline.near_dedup(spark, make_documents(spark)[0], "")
        assert spark.conf.get(setting) == "1m"  # a session's own setting stays
    finally:
        spark.conf.unset(setting)


def test_a_stage_drops_what_a_worker_kept_for_another(spark):
    kept = common._kept
    kept["toxicity"] = "a network and its caches"
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text_hash": [2], "text": ["a b c d e f"]})
    try:
        list(_prefixes(SimpleNamespace(key=1, value=(np.zeros(0, np.int64), np.zeros(0, np.int64))))([batch]))
        assert "toxicity" not in kept
        kept["toxicity"] = "again"
        list(_candidates(1 << 20)([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [b"a"], "chars": [1]})]))
        assert "toxicity" not in kept
    finally:
        kept.clear()
