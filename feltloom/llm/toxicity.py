"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of two learned inputs: an embedding of the word and the mean of the embeddings
of its character n-grams (with word borders), both hashed. Two gated recurrent units read the text from
either end and leave two states at each word. Attention pools the states of a window of ``WINDOW`` words,
and a logistic unit scores the window. All overlapping windows of a text are scored: one begins at every word
(``STRIDE`` = 1), the last one ends with the text; the document's score is that of its worst window. Windows share
the states of their words; a window's sums are put together from the end of one block of words and the beginning of the next. A
text's score is the same to the last bit alone, in company and in any order.

The units read a text in spans of ``SPAN`` words, each begun ``LEAD`` words early (from its own end too), from a
state of zero: a state depends on 64 to 320 words before it, whatever the length of the text, and long texts
are read at many places at a time. A text of up to ``SPAN`` words is one span.

The network is trained here in numpy (back-propagation through time, AdaGrad steps) in one task, on a bounded
sample of labelled rows: ``TRAIN_EACH`` documents of either label, those of the smallest hashed ids in the
training fold, whole. A document is a bag of stretches of ``STRETCH`` words: each pass trains on the worst window
of those drawn. The threshold is set on the scores of the sample's whole texts so that 0.5 gives the best F1, each
document counting for as many as its label has in the training fold.
Scoring takes whole texts in one pass without a shuffle; the weights (under 6 MB) are broadcast. Since
nothing but the word decides what it adds to the gates, workers keep that per distinct word.

Defined results: a null or empty text, or one without letters, has the score of an empty window; with
nothing labelled every score is 0. A null doc_id is in no fold: it is scored, not held out, and not
learned from. Repeated rows get the same score each; of a labelled id that is repeated the greatest text is learned from;
several labels of a document count as toxic if one does; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltloom.llm.common import Shared, id_text, importable, rows_of, sliced, worker_cache
from feltloom.llm.language import letters
from feltloom.llm.sampling import bounded_ids, fitted_in_task, fold

#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 64, 1
#: Words of a span and read before it; of a stretch that is trained on.
SPAN, LEAD, STRETCH = 256, 64, 128
#: The bounded sample: documents of each label.
TRAIN_EACH = 2500
#: Hashed rows of either embedding, size of an input, of a state, of the attention.
BUCKETS, INPUT, STATE, ATTENTION = 1 << 16, 10, 8, 8
#: Passes over the sample (more if it is small: at least BATCHES batches), stretches drawn of each document, documents of a batch, step.
EPOCHS, BATCHES, BAG, BATCH, STEP = 6, 300, 2, 64, 0.05
#: Words of a worker's cache; bytes of text scored at a time; spans read at a time.
CACHE_WORDS, SLICE_BYTES, AT_ONCE = 150_000, 2 << 20, 2048
#: Columns of a product come in multiples of this.
WIDTH = 64


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket of each word, character buckets, the word of each): n-grams of 3 to 5 of ``^word$``."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[word]
    mix, odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
    whole = np.add.reduceat((codes + np.uint64(31)) * (place.astype(np.uint64) * np.uint64(0x85EBCA6B) + np.uint64(1)) * mix, starts)
    whole = (whole ^ (whole >> np.uint64(29))) * odd
    out, owner, rolled = [], [], codes * mix
    for n in range(2, 6):
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(31))) * odd + codes[n - 1 :] * mix if len(rolled) > 1 else rolled[:0]
        if n > 2:
            fits = place[: len(rolled)] + n <= sizes[word[: len(rolled)]]
            out.append(rolled[fits] * mix + np.uint64(n))
            owner.append(word[: len(rolled)][fits])
    few = np.uint64(BUCKETS)
    return ((whole >> np.uint64(20)) % few).astype(np.int64), ((np.concatenate(out) >> np.uint64(24)) % few).astype(np.int64), np.concatenate(owner)


def starts(n: int) -> list[int]:
    """Where the windows of n words begin."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def pool(level: np.ndarray, valued: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in columns of ``sizes`` words: the worst window's pooled value, its first word, its attention in sum."""
    steps, n = level.shape
    sums = [np.concatenate([np.zeros((1, n)), np.cumsum(v, axis=0)]) for v in (level, valued)]
    first = np.arange(max(1, steps - WINDOW + 1))
    last = np.minimum(first + WINDOW, steps)
    total, value = (v[last] - v[first] for v in sums)
    found = np.where(first[:, None] <= np.maximum(0, sizes - WINDOW), value / np.maximum(total, 1e-300), -np.inf)
    worst = found.argmax(axis=0)
    columns = np.arange(n)
    return found[worst, columns], worst, np.maximum(total[worst, columns], 1e-300)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product, its columns by the same steps whatever stands beside them, which BLAS does not promise."""
    n = b.shape[1]
    if n % WIDTH:
        b = np.concatenate([b, np.zeros((len(b), padded(n) - n), b.dtype)], axis=1)
    return np.einsum("kj,jm->km", a, np.ascontiguousarray(b))[:, :n]


def padded(n: int) -> int:
    """``n`` up to the next multiple of ``WIDTH``."""
    return -(-n // WIDTH) * WIDTH


def summed(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The weighted sum of rows, one after another in double precision."""
    total = np.zeros(rows.shape[1])
    for weight, row in zip(weights, rows):
        total += float(weight) * row.astype(np.float64)
    return total


def worst_windows(score: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text (``sizes`` words, at least one) the greatest value that attention pools over a window.

    Attention is taken relative to the text's greatest. A window is the end of a block of ``WINDOW`` words and the
    beginning of the next, so its sums are of its own words alone: nothing cancels, and no text enters another's.
    """
    base, blocks = np.cumsum(sizes) - sizes, -(-sizes // WINDOW)
    first_block = WINDOW * (np.cumsum(blocks) - blocks)
    places = np.repeat(first_block - base, sizes) + np.arange(len(score))
    attention = np.exp(score - np.repeat(np.maximum.reduceat(score, base), sizes))
    counts = np.maximum(1, sizes - WINDOW + 1)
    ends = np.cumsum(counts)
    begin = np.arange(ends[-1]) + np.repeat(first_block - (ends - counts), counts)
    sums = []
    for words in (attention, attention * value):
        block = np.zeros(WINDOW * int(blocks.sum()))
        block[places] = words
        block = block.reshape(-1, WINDOW)
        ahead, after = np.cumsum(block, axis=1).reshape(-1), np.cumsum(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        sums.append(after[begin] + np.where(begin % WINDOW, ahead[np.minimum(begin + WINDOW - 1, len(ahead) - 1)], 0.0))
    return np.maximum.reduceat(sums[1] / np.maximum(sums[0], 1e-300), ends - counts)


class Network:
    """Parameters; of the gate matrices, columns are update, reset and candidate."""

    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale=1.0: (scale * draw.normal(size=shape)).astype(np.float32)
        s = STATE
        self.word, self.char = normal(BUCKETS, INPUT, scale=0.1), normal(BUCKETS, INPUT, scale=0.3)
        self.dense = {"bias": np.zeros(2 * 3 * s, np.float32), "into": normal(INPUT, 2 * 3 * s, scale=INPUT**-0.5), "look": normal(2 * s, ATTENTION, scale=(2 * s) ** -0.5), "query": normal(ATTENTION, scale=ATTENTION**-0.5), "out": normal(2 * s, scale=0.3), "level": np.zeros(1, np.float32)}
        for way in "fb":
            self.dense[way + "gates"], self.dense[way + "candidate"] = normal(s, 2 * s, scale=s**-0.5), normal(s, s, scale=s**-0.5)
        self.fitted = False

    def inputs(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, INPUT), np.float32)
        whole, char, owner = features(words)
        counts = np.bincount(owner, minlength=len(words))
        chars = np.stack([np.bincount(owner, self.char[char, k], len(words)) for k in range(INPUT)], axis=1) / counts[:, None]
        return self.word[whole] + chars.astype(np.float32)

    def gates(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of both directions, whatever words it is asked with."""
        return np.ascontiguousarray(times(self.dense["into"].T, self.inputs(words).T).T) + self.dense["bias"]

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: x (step, window, gates of both directions), mask (step, window). keep: also what back-propagation needs."""
        d, s, (steps, n) = self.dense, STATE, mask.shape
        states, kept = np.empty((steps, n, 2 * s), np.float32), []
        full = bool(mask.all())
        for way, own in ((0, "f"), (1, "b")):
            gates, candidate = d[own + "gates"], d[own + "candidate"]
            h = np.zeros((n, s), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                at = x[t, :, 3 * s * way : 3 * s * (way + 1)]
                zr = h @ gates
                zr += at[:, : 2 * s]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                z, r = zr[:, :s], zr[:, s:]
                c = (r * h) @ candidate
                c += at[:, 2 * s :]
                np.tanh(c, out=c)
                new = c - h
                new *= z
                new += h
                if not full:
                    new *= mask[t][:, None]
                if keep:
                    kept.append((way, t, h, zr, c))
                states[t, :, s * way : s * (way + 1)] = h = new
        look = np.tanh(states.reshape(-1, 2 * s) @ d["look"]).reshape(steps, n, -1)
        level = np.exp((look @ d["query"]).astype(np.float64)) * mask
        worst, first, total = pool(level, level * (states @ d["out"]), mask.sum(axis=0).astype(int))
        logits = (worst + d["level"][0]).astype(np.float32)
        if not keep:
            return logits
        inside = (np.arange(steps)[:, None] >= first) & (np.arange(steps)[:, None] < first + WINDOW)
        weight = (level * inside / total).astype(np.float32)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        return logits, states, look, weight, pooled, kept

    def read(self, table: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every word of texts of ``sizes`` words: the logarithm of its attention (before pooling), and its state's part of a logit.

        No text's numbers depend on the others.

        ``table``: what words add to the gates; ``at``: rows of it, all texts in a row.
        """
        d, s, n = self.dense, STATE, len(at)
        base = np.cumsum(sizes) - sizes
        spans = -(-sizes // SPAN)
        of = np.repeat(np.arange(len(sizes)), spans)
        core = (np.arange(len(of)) - np.repeat(np.cumsum(spans) - spans, spans)) * SPAN
        core_end = np.minimum(core + SPAN, sizes[of])
        states = np.empty((2 * s, n), np.float32)
        for way, own in ((0, "f"), (1, "b")):
            # A gate is (tanh(half its input) + 1) / 2; the halves are taken into the matrices where they can be.
            gates, candidate = np.ascontiguousarray(0.5 * d[own + "gates"].T), np.ascontiguousarray(0.5 * d[own + "candidate"].T)
            added, mine = table[:, 3 * s * way : 3 * s * (way + 1)], states[s * way : s * (way + 1)]
            if way == 0:
                lead = core - np.maximum(core - LEAD, 0)
                begin, step = base[of] + core - lead, 1
            else:
                lead = np.minimum(core_end + LEAD, sizes[of]) - core_end
                begin, step = base[of] + core_end + lead - 1, -1
            long = lead + core_end - core
            order = np.argsort(-long, kind="stable")
            for k in range(0, len(order), AT_ONCE):
                some = order[k : k + AT_ONCE]
                length, start, early = long[some], begin[some], lead[some]
                h = np.zeros((s, padded(len(some))), np.float32)
                rows = np.zeros(h.shape[1], at.dtype)
                for t in range(int(length[0])):
                    m = int(np.searchsorted(-length, -t, "left"))  # spans that are longer than t
                    place = start[:m] + step * t
                    rows[:m] = at[place]
                    x = np.ascontiguousarray(added[rows[: padded(m)]].T)
                    h = h[:, : padded(m)]
                    zr = times(gates, h)
                    x[: 2 * s] *= 0.5
                    zr += x[: 2 * s]
                    np.tanh(zr, out=zr)
                    zr += 1
                    c = times(candidate, zr[s:] * h)
                    c += x[2 * s :]
                    np.tanh(c, out=c)
                    c -= h
                    c *= zr[:s]
                    c *= 0.5
                    h = h + c
                    if t >= LEAD:
                        mine[:, place] = h[:, :m]
                    else:
                        counts = np.flatnonzero(early[:m] <= t)
                        mine[:, place[counts]] = h[:, counts]
        look = np.ascontiguousarray(d["look"].T)
        score, value = np.empty(n), np.empty(n)
        for k in range(0, n, AT_ONCE):
            own = np.zeros((2 * s, padded(min(AT_ONCE, n - k))), np.float32)
            m = min(AT_ONCE, n - k)
            own[:, :m] = states[:, k : k + m]
            seen = np.tanh(times(look, own))
            score[k : k + m] = summed(d["query"], seen)[:m]
            value[k : k + m] = summed(d["out"], own)[:m]
        return score, value

    def backward(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean logistic loss by the dense parameters and by x."""
        d, s = self.dense, STATE
        logits, states, look, weight, pooled, kept = self.forward(x, mask, True)
        error = ((_sigmoid(logits) - labels) * weights / len(labels)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in d.items()}
        g["level"][0], g["out"] = error.sum(), pooled.T @ error
        by_pooled = error[:, None] * d["out"]
        by_states = weight[:, :, None] * by_pooled
        by_weight = np.einsum("tnk,nk->tn", states, by_pooled)
        by_score = weight * (by_weight - (weight * by_weight).sum(axis=0))
        g["query"] = np.einsum("tn,tna->a", by_score, look)
        by_look = by_score[:, :, None] * d["query"] * (1 - look**2)
        g["look"] = np.einsum("tnk,tna->ka", states, by_look)
        by_states += by_look @ d["look"].T
        by_x = np.zeros_like(x)
        carried = {0: np.zeros_like(states[0, :, :s]), 1: np.zeros_like(states[0, :, :s])}
        for way, t, h, zr, c in reversed(kept):
            own = "fb"[way]
            at = (carried[way] + by_states[t, :, s * way : s * (way + 1)]) * mask[t][:, None]
            z, r = zr[:, :s], zr[:, s:]
            by_c = at * z * (1 - c**2)
            by_rh = by_c @ d[own + "candidate"].T
            by_zr = np.concatenate([at * (c - h) * z * (1 - z), by_rh * h * r * (1 - r)], axis=1)
            g[own + "candidate"] += (r * h).T @ by_c
            g[own + "gates"] += h.T @ by_zr
            carried[way] = at * (1 - z) + by_rh * r + by_zr @ d[own + "gates"].T
            by_x[t, :, 3 * s * way : 3 * s * way + 2 * s], by_x[t, :, 3 * s * way + 2 * s : 3 * s * (way + 1)] = by_zr, by_c
        loss = float(np.mean(weights * (np.logaddexp(0, logits) - labels * logits)))
        return g, by_x, loss


class Scorer:
    """A network with a cache of what each distinct piece adds to the gates."""

    def __init__(self, network: Network):
        self.network, self.rows, self.used = network, {}, 1
        self.table = np.zeros((1024, 6 * STATE), np.float32)  # row 0 pads

    def index(self, pieces: set[str]) -> None:
        if self.used > CACHE_WORDS or len(self.rows) > 2 * CACHE_WORDS:
            self.rows, self.used = {}, 1
        missing = [p for p in pieces if p not in self.rows]
        words = [letters(p) for p in missing]
        distinct = list(dict.fromkeys(w for w in words if w))
        if self.used + len(distinct) > len(self.table):
            grown = np.zeros((int(1.3 * (self.used + len(distinct))), self.table.shape[1]), np.float32)
            grown[: self.used] = self.table[: self.used]
            self.table = grown
        for i in range(0, len(distinct), 20_000):
            some = distinct[i : i + 20_000]
            self.table[self.used + i : self.used + i + len(some)] = self.network.gates(some)
        at = {w: self.used + i for i, w in enumerate(distinct)}
        self.used += len(distinct)
        self.rows.update((p, at[w] if w else 0) for p, w in zip(missing, words))

    def words(self, texts: list[str | None]) -> list[np.ndarray]:
        """Table rows of the words of each text."""
        pieces = [(t or "").split() for t in texts]
        self.index({p for x in pieces for p in x})
        get = self.rows.__getitem__
        found = [np.fromiter(map(get, x), np.int32, len(x)) for x in pieces]
        return [x[x > 0] for x in found]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the worst window's."""
        words = self.words(texts)
        sizes = np.array([len(w) for w in words], np.int64)
        out = np.full(len(texts), float(self.network.dense["level"][0]))
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        at, sizes = np.concatenate([words[i] for i in full]), sizes[full]
        out[full] += worst_windows(*self.network.read(self.table, at, sizes), sizes)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.network.fitted:
            return np.zeros(len(texts))
        return _sigmoid(self.logits(texts))


def train(rows: list[tuple[str, int]], seed: int = 0, totals: tuple[float, float] | None = None) -> Network:
    """Fit a network on (text, label) rows; ``totals``: documents of label 0 and 1 that they stand for."""
    rows = sorted((t or "", int(label)) for t, label in rows)
    labels = np.array([label for _, label in rows], np.float32)
    network, draw = Network(seed), np.random.default_rng(seed)
    if not len(rows) or labels.min() == labels.max():
        return network
    where: dict[str, int] = {}  # row 0 pads
    known = {p: letters(p) for p in {p for t, _ in rows for p in t.split()}}
    at = [np.array([where.setdefault(w, len(where) + 1) for w in map(known.__getitem__, t.split()) if w], np.int64) for t, _ in rows]
    distinct = list(where)
    whole, char, owner = features(distinct) if distinct else (np.zeros(0, np.int64),) * 3
    counts = np.bincount(owner, minlength=len(distinct)).astype(np.float32)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    char = char[order]
    squares = {k: np.full_like(v, 1e-4) for k, v in network.dense.items()}
    square_word, square_char = np.full_like(network.word, 1e-4), np.full_like(network.char, 1e-4)
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)

    def rows_of_words(used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of used words; their character buckets and the word of each."""
        spans = [char[ends[i] : ends[i + 1]] for i in used.tolist()]
        own = np.repeat(np.arange(len(used)), [len(x) for x in spans])
        flat = np.concatenate(spans) if spans else np.zeros(0, np.int64)
        sums = np.stack([np.bincount(own, network.char[flat, k], len(used)) for k in range(INPUT)], axis=1)
        return network.word[whole[used]] + (sums / counts[used][:, None]).astype(np.float32), flat, own

    def stretch(x: np.ndarray) -> np.ndarray:
        begin = int(draw.integers(0, max(1, len(x) - STRETCH + 1)))
        out = np.zeros(STRETCH, np.int64)
        own = x[begin : begin + STRETCH]
        out[: len(own)] = own
        return out

    epochs = max(EPOCHS, -(-BATCHES * BATCH // len(rows)))
    for _ in range(epochs):
        shuffled = draw.permutation(len(rows))
        for i in range(0, len(shuffled), BATCH):
            some = shuffled[i : i + BATCH]
            bag = [(j, stretch(at[doc])) for j, doc in enumerate(some.tolist()) for _ in range(BAG if len(at[doc]) > STRETCH else 1)]
            picks, of = np.stack([b for _, b in bag]), np.array([j for j, _ in bag])
            used = np.unique(picks)
            used = used[used > 0] - 1
            inputs, flat, own = rows_of_words(used)
            local = np.zeros(len(distinct) + 1, np.int64)
            local[used + 1] = np.arange(1, len(used) + 1)
            padded = np.concatenate([np.zeros((1, INPUT), np.float32), inputs])
            table = padded @ network.dense["into"] + network.dense["bias"]
            table[0] = 0
            rows_at = local[picks]
            rows_at = rows_at[:, : max(1, int((rows_at > 0).sum(axis=1).max()))]
            logits = network.forward(table[rows_at.T], (rows_at.T > 0).astype(np.float32))
            best = np.array([np.flatnonzero(of == j)[np.argmax(logits[of == j])] for j in range(len(some))])
            chosen = rows_at[best]
            chosen = chosen[:, : max(1, int((chosen > 0).sum(axis=1).max()))]
            x, mask = table[chosen.T], (chosen.T > 0).astype(np.float32)
            g, by_x, _ = network.backward(x, mask, labels[some], weight[some])
            by_x *= mask[:, :, None]
            flat_x = by_x.reshape(-1, by_x.shape[2])
            by_row = np.stack([np.bincount(chosen.T.reshape(-1), flat_x[:, k], len(padded)) for k in range(flat_x.shape[1])], axis=1)[1:].astype(np.float32)
            g["bias"], g["into"] = by_row.sum(axis=0), inputs.T @ by_row
            by_input = by_row @ network.dense["into"].T
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            shrink = min(1.0, 1.0 / max(norm, 1e-9))
            for k, v in g.items():
                squares[k] += (shrink * v) ** 2
                network.dense[k] -= STEP * shrink * v / np.sqrt(squares[k])
            for values, square, bucket, by in ((network.word, square_word, whole[used], by_input), (network.char, square_char, flat, by_input[own] / counts[used][own][:, None])):
                rows_used, inverse = np.unique(bucket, return_inverse=True)
                gradient = shrink * np.stack([np.bincount(inverse, by[:, k], len(rows_used)) for k in range(INPUT)], axis=1).astype(np.float32)
                square[rows_used] += gradient**2
                values[rows_used] -= STEP * gradient / np.sqrt(square[rows_used])
    network.fitted = True
    # Set the level so that a score of 0.5 gives the best F1 on the sample, midway to the next document.
    found = np.concatenate([Scorer(network).logits([t for t, _ in rows[i : i + 200]]) for i in range(0, len(rows), 200)])
    best = np.argsort(-found, kind="stable")
    stands = np.ones(2) if totals is None else np.array(totals) / np.bincount(labels.astype(int), minlength=2)
    counts = stands[labels[best].astype(int)]
    hits = np.cumsum(labels[best] * counts)
    f1 = 2 * hits / (np.cumsum(counts) + hits[-1])
    k = int(np.argmax(f1))
    cut = found[best[k]] if k + 1 == len(best) else (found[best[k]] + found[best[k + 1]]) / 2
    network.dense["level"] -= np.float32(cut)
    return network


def _score(shared: Shared, carried: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(("toxicity", shared.key), lambda: Scorer(shared.value))
        for batch in sliced(batches, "tox_text", SLICE_BYTES):
            found = scorer.scores([t for (t,) in rows_of(batch, "tox_text")])
            columns = [batch.column(i) for i in range(carried)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], names=[*batch.schema.names[:carried], "tox_score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_EACH) -> Network:
    """Learn from the labels of documents whose crc32(doc_id) mod 5 is not 0."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where((fold(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull())
    each = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = bounded_ids(each.where("toxic = 1"), most).withColumn("toxic", F.lit(1)).union(bounded_ids(each.where("toxic = 0"), most).withColumn("toxic", F.lit(0)))
    counts = tuple(each.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first())
    # 2 * most ids are broadcast; an id that is repeated gives one text.
    sample = id_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    return fitted_in_task(sample.select("text", "toxic"), lambda rows: train(rows, totals=counts), Network)


def score_documents(rows: DataFrame, text: str, network: Network) -> DataFrame:
    """``rows`` with tox_score of the column ``text``."""
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*rows.schema.fields]).add("tox_score", DoubleType())
    return rows.withColumn("tox_text", F.col(text).cast("string")).mapInArrow(_score(Shared(rows.sparkSession, network), len(rows.columns)), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic."""
    importable(docs.sparkSession)
    found = score_documents(docs.select(F.struct("*").alias("row")), "row.text", fit(docs, labels))
    return found.where("tox_score < 0.5").select("row.*")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = score_documents(id_text(docs), "text", fit(docs, labels))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))
