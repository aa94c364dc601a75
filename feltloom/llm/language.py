"""Language identification by a linear-chain conditional random field.

Words are labelled with languages in their context: an emission score from hashed features of the word
(affixes, inner character n-grams and the word itself, which is the lexicon) and learned transitions
between neighbouring words, normalised by forward-backward. A document's language is the one with the
most posterior mass over its words, its score the mean posterior; mixed texts are labelled word by
word (``label_words``).

The field is trained in numpy by stochastic gradient on a bounded sample of labelled rows
(``TRAIN_DOCUMENTS``, those of the smallest hashed ids in the training fold; whole texts, of which
``TRAIN_WINDOWS`` windows of ``TRAIN_WORDS`` words of each). A document's label stands for all of
its words; some windows are spliced from two documents, which teaches the transitions. Every document
is then labelled whole, whatever its length, in one pass without a shuffle. The weights (under 4 MB for
each eight languages) are broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is everything if
nothing is labelled. A null doc_id is in no fold: it is predicted, not held out, and not learned from.
Repeated rows get the same result each; an empty table gives an empty result; extra columns are
ignored. Ties between languages go to the first in code point order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltloom.llm.common import Shared, id_text, importable, sliced, worker_cache
from feltloom.llm.sampling import bounded_ids, fitted_in_task, fold

#: The bounded sample: documents, windows of each, words of a window.
TRAIN_DOCUMENTS, TRAIN_WINDOWS, TRAIN_WORDS = 4000, 4, 32
#: Hashed features; share of spliced windows; passes; step; decay.
FEATURES, SPLICED, EPOCHS, STEP, DECAY = 1 << 16, 0.25, 3, 0.5, 1e-6
#: Words of a worker's emission cache; bytes of text labelled at a time.
CACHE_WORDS, SLICE_BYTES = 200_000, 1 << 20
UNDETERMINED = "und"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word index) pairs of lower-case words: n-grams of ``^word$`` up to 3, the affixes among
    them up to 4 characters with their border, and the whole word."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[word]
    last = sizes[word] - 1
    mix, out, owner = np.uint64(0x9E3779B97F4A7C15), [], []
    rolled = codes * mix
    whole = np.add.reduceat((codes + np.uint64(17)) * (place.astype(np.uint64) * np.uint64(2654435761) + np.uint64(1)) * mix, starts) if len(words) else codes
    out.append((whole ^ (whole >> np.uint64(29))) * mix)
    owner.append(np.arange(len(words)))
    for n in range(2, 5):
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + codes[n - 1 :] * mix if len(rolled) > 1 else rolled[:0]
        m = len(rolled)
        fits = place[:m] + n - 1 <= last[:m]
        if n == 4:
            fits &= (place[:m] == 0) | (place[:m] + n - 1 == last[:m])
        out.append(rolled[fits] * mix + np.uint64(n))
        owner.append(word[:m][fits])
    hashed = np.concatenate(out)
    return ((hashed >> np.uint64(24)) % np.uint64(FEATURES)).astype(np.int64), np.concatenate(owner)


def letters(piece: str) -> str:
    """The lower-case letters of a piece; empty if it has none."""
    low = piece.lower()
    return low if low.isalpha() else "".join(c for c in low if c.isalpha())


class Field:
    """Weights of the field: emissions (features x languages), start (languages), transitions (from x to)."""

    def __init__(self, languages: list[str]):
        n = len(languages)
        self.languages, self.emit = languages, np.zeros((FEATURES, n), np.float32)
        self.start, self.move = np.zeros(n), np.zeros((n, n))

    def scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)))
        feature, owner = features(words)
        return np.stack([np.bincount(owner, self.emit[feature, k], len(words)) for k in range(len(self.languages))], axis=1)

    def posteriors(self, scores: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Posterior of every word by scaled forward-backward; ``scores`` are of all sequences one after another."""
        order = np.argsort(-np.array(sizes), kind="stable")
        lengths = np.array(sizes)[order]
        begins = (np.cumsum(sizes) - np.array(sizes))[order]
        local = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
        steps = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
        rows = [begins[:n] + t for t, n in enumerate(active.tolist())]
        packed = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        p = local[packed]
        ends = np.concatenate([[0], np.cumsum(active)])
        move, start = np.exp(self.move - self.move.max()), np.exp(self.start - self.start.max())
        forward = np.empty_like(p)
        now = None
        for t in range(steps):
            a, b = ends[t], ends[t + 1]
            now = p[a:b] * (start if now is None else now[: b - a] @ move)
            now /= now.sum(axis=1, keepdims=True)
            forward[a:b] = now
        back = np.ones((0, p.shape[1]))
        for t in range(steps - 1, -1, -1):
            a, b = ends[t], ends[t + 1]
            if len(back) < b - a:  # sequences that end here
                back = np.concatenate([back, np.ones((b - a - len(back), p.shape[1]))])
            forward[a:b] *= back
            back = (p[a:b] * back) @ move.T
            back /= back.sum(axis=1, keepdims=True)
        forward /= forward.sum(axis=1, keepdims=True)
        out = np.empty_like(forward)
        out[packed] = forward
        return out


def label_words(field: Field, text: str) -> list[tuple[str, str]]:
    """(piece, language) of every piece with a letter."""
    pieces = [p for p in text.split() if letters(p)]
    if not pieces or not field.languages:
        return []
    best = field.posteriors(field.scores([letters(p) for p in pieces]), [len(pieces)]).argmax(axis=1)
    return [(p, field.languages[k]) for p, k in zip(pieces, best.tolist())]


def windows(rows: list[tuple[str, int]], seed: int = 0) -> tuple[list[list[str]], np.ndarray]:
    """Windows of TRAIN_WORDS words and their labels, some spliced from two documents."""
    draw = np.random.default_rng(seed)
    found, labels = [], []
    for text, label in rows:
        words = [w for w in map(letters, text.split()) if w]
        if not words:
            continue
        for _ in range(min(TRAIN_WINDOWS, 1 + len(words) // TRAIN_WORDS)):
            at = int(draw.integers(0, max(1, len(words) - TRAIN_WORDS + 1)))
            own = words[at : at + TRAIN_WORDS]
            own = (own * TRAIN_WORDS)[:TRAIN_WORDS]
            found.append(own)
            labels.append([label] * TRAIN_WORDS)
    n = len(found)
    for i in draw.permutation(n)[: int(SPLICED * n)].tolist():
        j, k = int(draw.integers(0, n)), int(draw.integers(1, TRAIN_WORDS))
        found[i], labels[i] = found[i][:k] + found[j][k:], labels[i][:k] + labels[j][k:]
    return found, np.array(labels, np.int64).reshape(len(found), TRAIN_WORDS)


def train(rows: list[tuple[str, str]], seed: int = 0) -> Field:
    """Fit the field on (text, language) rows by stochastic gradient with AdaGrad steps."""
    rows = sorted((t, lang) for t, lang in rows if t and lang)
    field = Field(sorted({lang for _, lang in rows}))
    number = {lang: k for k, lang in enumerate(field.languages)}
    found, gold = windows([(t, number[lang]) for t, lang in rows], seed)
    n = len(field.languages)
    if not found or n < 2:
        return field
    draw = np.random.default_rng(seed)
    square, square_move, square_start = np.full_like(field.emit, 1e-2), np.full((n, n), 1e-2), np.full(n, 1e-2)
    size = 128
    for _ in range(EPOCHS):
        order = draw.permutation(len(found))
        for i in range(0, len(order), size):
            some = order[i : i + size].tolist()
            words = [w for s in some for w in found[s]]
            distinct = sorted(set(words))
            where = {w: k for k, w in enumerate(distinct)}
            at = np.array([where[w] for w in words])
            feature, owner = features(distinct)
            m = len(some)
            emission = np.stack([np.bincount(owner, field.emit[feature, k], len(distinct)) for k in range(n)], axis=1)
            truth = np.eye(n)[gold[some].reshape(-1)]
            posterior, pair = _expectations(field, emission[at].reshape(m, TRAIN_WORDS, n))
            error = np.zeros((len(distinct), n))
            np.add.at(error, at, truth - posterior.reshape(-1, n))
            used, inverse = np.unique(feature, return_inverse=True)
            gradient = np.stack([np.bincount(inverse, error[owner, k], len(used)) for k in range(n)], axis=1) / m
            square[used] += gradient**2
            field.emit[used] += STEP * (gradient / np.sqrt(square[used])).astype(np.float32) - np.float32(DECAY) * field.emit[used]
            g = gold[some]
            counts = np.zeros((n, n))
            np.add.at(counts, (g[:, :-1].reshape(-1), g[:, 1:].reshape(-1)), 1)
            change, first = (counts - pair) / m, (np.eye(n)[g[:, 0]] - posterior[:, 0]).mean(axis=0)
            square_move += change**2
            square_start += first**2
            field.move += STEP * change / np.sqrt(square_move)
            field.start += STEP * first / np.sqrt(square_start)
    return field


def _expectations(field: Field, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (sequence, word, language) and expected transitions of sequences of one length."""
    p = np.exp(scores - scores.max(axis=2, keepdims=True))
    move, start = np.exp(field.move - field.move.max()), np.exp(field.start - field.start.max())
    steps = p.shape[1]
    forward, back = np.empty_like(p), np.ones_like(p)
    for t in range(steps):
        now = p[:, t] * (start if t == 0 else forward[:, t - 1] @ move)
        forward[:, t] = now / now.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        now = (p[:, t + 1] * back[:, t + 1]) @ move.T
        back[:, t] = now / now.sum(axis=1, keepdims=True)
    posterior = forward * back
    posterior /= posterior.sum(axis=2, keepdims=True)
    pair = np.einsum("sti,ij,stj->stij", forward[:, :-1], move, (p * back)[:, 1:])
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return posterior, pair.sum(axis=(0, 1))


class Labeller:
    """A field with a cache of its emissions by piece: -1 for a piece without a letter."""

    def __init__(self, field: Field):
        self.field, self.rows = field, {}
        self.scores = np.zeros((0, len(field.languages)))
        self.used = 0

    def index(self, pieces: set[str]) -> None:
        if len(self.rows) > CACHE_WORDS:
            self.rows, self.used = {}, 0
        missing = [p for p in pieces if p not in self.rows]
        words = [letters(p) for p in missing]
        distinct = list(dict.fromkeys(w for w in words if w))
        found = self.field.scores(distinct)
        if self.used + len(distinct) > len(self.scores):
            grown = np.zeros((2 * (self.used + len(distinct)), found.shape[1]))
            grown[: self.used] = self.scores[: self.used]
            self.scores = grown
        self.scores[self.used : self.used + len(distinct)] = found
        at = {w: self.used + i for i, w in enumerate(distinct)}
        self.used += len(distinct)
        self.rows.update((p, at[w] if w else -1) for p, w in zip(missing, words))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.field.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        pieces = [(t or "").split() for t in texts]
        self.index({p for x in pieces for p in x})
        get = self.rows.__getitem__
        at = [np.fromiter(map(get, x), np.int64, len(x)) for x in pieces]
        at = [x[x >= 0] for x in at]
        sizes = [len(x) for x in at]
        results: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        full = [i for i, n in enumerate(sizes) if n]
        if full:
            posterior = self.field.posteriors(self.scores[np.concatenate([at[i] for i in full])], [sizes[i] for i in full])
            begins = np.cumsum([0] + [sizes[i] for i in full])[:-1]
            means = np.add.reduceat(posterior, begins, axis=0) / np.array([sizes[i] for i in full])[:, None]
            for i, k, row in zip(full, means.argmax(axis=1).tolist(), means):
                results[i] = (self.field.languages[k], float(min(1.0, max(0.0, row[k]))))
        return results


def fit(docs: DataFrame, most: int = TRAIN_DOCUMENTS) -> Field:
    """Learn from text and non-null lang of documents whose crc32(doc_id) mod 4 is not 2."""
    ids = bounded_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").where((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull()), most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    # ``most`` ids are broadcast; an id that is repeated gives its greatest row.
    sample = rows.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("text", "lang")).alias("row"))
    return fitted_in_task(sample.select("row.text", "row.lang"), train, lambda: Field([]))


def _predict(shared: Shared, carried: int, path: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = worker_cache(("language", shared.key), lambda: Labeller(shared.value))
        for whole in batches:
            text = whole.column(whole.schema.get_field_index(path[0]))
            for name in path[1:]:
                text = pc.struct_field(text, name)
            columns = [*whole.columns[:carried], text]
            names = [str(i) for i in range(carried)] + ["text"]
            for batch in sliced([pa.RecordBatch.from_arrays(columns, names=names)], "text", SLICE_BYTES):
                found = labeller.predict(batch.column(carried).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:carried], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*whole.schema.names[:carried], "lang_pred", "lang_score"])

    return run


def label_documents(rows: DataFrame, text: str, field: Field) -> DataFrame:
    """``rows`` with lang_pred and lang_score of the column ``text``, which is sent to the workers once: a string as it stands in its row."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*rows.schema.fields]).add("lang_pred", StringType()).add("lang_score", DoubleType())
    is_text = isinstance(rows.select(text).schema[0].dataType, StringType)
    sent = rows if is_text else rows.withColumn("lang_text", F.col(text).cast("string"))
    return sent.mapInArrow(_predict(Shared(rows.sparkSession, field), len(rows.columns), text.split(".") if is_text else ["lang_text"]), schema)


def drop_undetermined(docs: DataFrame) -> DataFrame:
    """``docs`` without those of no determined language: a text without letters has none, a mixed one has that of most words."""
    importable(docs.sparkSession)
    found = label_documents(docs.select(F.struct("*").alias("row")), "row.text", fit(docs))
    return found.where(F.col("lang_pred") != UNDETERMINED).select("row.*")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = label_documents(id_text(docs), "text", fit(docs))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
