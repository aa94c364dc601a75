"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Native throughout: DataFrame and SQL functions only. Words and word pairs are hashed into two ranges
of ``BUCKETS`` buckets each. One pass counts them over all documents (the raw multinomial) and over the
trusted ones (the target); both counts leave each task as at most ``2 * BUCKETS`` partial sums. A
bucket's ratio is log((target + PRIOR) / (expected + PRIOR)), where expected is what the raw corpus
would put there among as many n-grams; the prior draws rare buckets to zero. The second pass scores
every document where it is read, without a shuffle: the mean ratio of its n-grams, kept if it is at
least ``THRESHOLD`` nats. The ratios (``2 * BUCKETS`` doubles, 4 MB whatever the corpus) reach it as a
scalar subquery.

The trusted target is a bounded sample of labelled rows: the ``TRUSTED`` documents of quality 1 whose
hashed ids are smallest. Everything else covers all documents.

Defined results: a null or blank text has no words, all counts zero, and fails the base rules; a null
doc_id is never trusted; repeated rows count and are returned each; with no trusted document every
ratio is zero, so the base rules alone decide; an empty table gives an empty result. Extra columns
are ignored. Repeated windows are told apart by 64-bit hashes of their five words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feltloom.llm.sampling import bounded_ids

#: Documents of the trusted sample; buckets of each n-gram order; pseudo-counts; nats per n-gram.
TRUSTED, BUCKETS, PRIOR, THRESHOLD = 20_000, 1 << 18, 5.0, -0.25
_SPACE = r"[\x20\x09-\x0D]"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE + "+"), "")


def _pairs(hashes: Column) -> Column:
    """Hashes of neighbouring words."""
    most = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), most), F.slice(hashes, F.lit(2), most), lambda a, b: F.xxhash64(a, b))


def _bucket(hashed: Column, buckets: int) -> Column:
    return hashed.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


def _repeat_words(hashes: Column, pairs: Column) -> Column:
    """Words in 5-word windows that are found twice or more, from the words' hashes."""

    def covered(windows: Column) -> Column:
        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        # Each start covers up to the next one, five words at most.
        reach = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(5)), F.lit(5))), F.lit(0), lambda a, b: a + b)
        return _let(order, lambda s: _let(starts(s), reach))

    # A window's hash is made of the hashes of its first two pairs of words and its last word.
    most = F.greatest(F.size(hashes) - 4, F.lit(0))
    whole = lambda p: F.zip_with(F.zip_with(F.slice(p, F.lit(1), most), F.slice(p, F.lit(3), most), lambda a, b: F.xxhash64(a, b)), F.slice(hashes, F.lit(5), most), lambda a, b: F.xxhash64(a, b))
    windows = _let(pairs, whole)
    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """At most ``most`` ids of quality 1, those of the smallest hashes."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    return bounded_ids(good, most).select(F.col("doc_id").alias("trusted_id"))


def ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = TRUSTED, prior: float = PRIOR) -> DataFrame:
    """bucket, ratio: a row for each of the 2 * buckets buckets."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = rows.join(F.broadcast(trusted_ids(labels, most)), F.col("doc_id") == F.col("trusted_id"), "left")
    hashed = known.select(F.col("trusted_id").isNotNull().alias("trusted"), _hashes(_words(F.col("text"))).alias("hashes"))
    single = F.transform("hashes", lambda h: _bucket(h, buckets))
    pair = F.transform(_pairs(F.col("hashes")), lambda h: _bucket(h, buckets) + buckets)
    grams = hashed.select("trusted", F.explode(F.concat(single, pair)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum(F.col("trusted").cast("long")).alias("target"))
    dense = docs.sparkSession.range(2 * buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    totals = counts.groupBy((F.col("bucket") >= buckets).alias("pair")).agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    both = dense.join(F.broadcast(totals), (F.col("bucket") >= buckets) == F.col("pair"), "left")
    expected = F.coalesce(F.col("raw") * F.col("all_target") / F.col("all_raw"), F.lit(0.0))
    return both.select("bucket", F.log((F.col("target") + prior) / (expected + prior)).alias("ratio"))


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = TRUSTED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr."""
    table = ratios(docs, labels, buckets, most)
    model = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"]).alias("model")).scalar()
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = rows.select("doc_id", "text", _words(text).alias("words")).select("*", _hashes(F.col("words")).alias("hashes"))
    split = split.select("*", _pairs(F.col("hashes")).alias("pairs"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("hashes"), F.col("pairs")).cast("long").alias("n_repeat_words"),
        F.struct("hashes", "pairs").alias("grams"),
    )

    # Each column is used once from here on, so the optimizer folds these projections into one and the
    # ratios stay a reference: they are never a column of the rows.
    def mean(grams: Column, table: Column) -> Column:
        words, pairs = grams["hashes"], grams["pairs"]
        first = F.aggregate(words, F.lit(0.0), lambda a, h: a + F.get(table, _bucket(h, buckets)))
        second = F.aggregate(pairs, F.lit(0.0), lambda a, h: a + F.get(table, _bucket(h, buckets) + buckets))
        return (first + second) / F.greatest(F.size(words) + F.size(pairs), F.lit(1))

    llr = _let(F.struct("grams", "model"), lambda x: mean(x["grams"], x["model"]))
    found = counted.select("*", model.alias("model")).select(*[c for c in counted.columns if c != "grams"], llr.alias("llr"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr"
    )
