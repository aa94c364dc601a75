import random
import zlib

import numpy as np
import pytest

from feltloom.llm import toxicity as toxicity_module
from feltloom.llm.toxicity import LEAD, SPAN, STATE, STRIDE, WINDOW, Network, Scorer, score_documents, starts, toxicity, train, worst_windows
from feltloom.llm.language import letters

from helpers import SCHEMA, make_documents

CLEAN = "stone river walks under the green hill near old town with soft light and calm water".split()
BAD = "blarg snorfle".split()
LABELS = "doc_id long, quality int, toxic int"


def corpus(seed, n):
    draw, rows = random.Random(seed), []
    for i in range(n):
        words = draw.choices(CLEAN, k=draw.randint(5, 150))
        if i % 3 == 0:
            for _ in range(1 + len(words) // 40):
                words.insert(draw.randint(0, len(words)), draw.choice(BAD))
        rows.append((" ".join(words) + ".", int(i % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def network():
    return train(corpus(0, 240))


def test_gradients_match_differences():
    draw = np.random.default_rng(1)
    net = Network(3)
    x, mask = draw.normal(size=(6, 4, 6 * STATE)).astype(np.float32), np.ones((6, 4), np.float32)
    mask[4:, 1] = mask[2:, 2] = 0
    labels, weights = np.array([1, 0, 1, 0], np.float32), np.array([1, 2, 1, 0.5], np.float32)
    net.dense = {k: v.astype(np.float64) for k, v in net.dense.items()}
    g, by_x, _ = net.backward(x, mask, labels, weights)

    def loss():
        z = net.forward(x, mask).astype(float)
        return float(np.mean(weights * (np.logaddexp(0, z) - labels * z)))

    for name in ("look", "query", "out", "level", "fgates", "bgates", "fcandidate", "bcandidate"):
        flat = net.dense[name].reshape(-1)
        for i in draw.choice(len(flat), min(4, len(flat)), replace=False):
            flat[i] += 1e-2
            up = loss()
            flat[i] -= 2e-2
            down = loss()
            flat[i] += 1e-2
            assert abs((up - down) / 2e-2 - g[name].reshape(-1)[i]) < 2e-3
    for i in [(0, 0, 3), (3, 1, 20), (5, 0, 40), (1, 2, 30)]:
        x[i] += 1e-2
        up = loss()
        x[i] -= 2e-2
        down = loss()
        x[i] += 1e-2
        assert abs((up - down) / 2e-2 - by_x[i]) < 2e-3


def test_windows_cover_and_overlap():
    for n in (0, 1, WINDOW - 1, WINDOW, WINDOW + 1, WINDOW + STRIDE, 1000):
        begin = starts(n)
        assert set(range(n)) <= {i for b in begin for i in range(b, b + WINDOW)}
        assert all(0 < b - a <= STRIDE for a, b in zip(begin, begin[1:])) and (n <= WINDOW or begin[-1] == n - WINDOW)


def test_held_out_accuracy(network):
    rows = corpus(9, 150)
    predicted = Scorer(network).scores([t for t, _ in rows]) >= 0.5
    assert np.mean(predicted == np.array([y for _, y in rows])) >= 0.97


def plain_run(network, own, x):
    """States of one direction, word by word."""
    d, h, out = network.dense, np.zeros(STATE), []
    for row in x.astype(float):
        z, r = np.split(1 / (1 + np.exp(-(h @ d[own + "gates"] + row[: 2 * STATE]))), 2)
        h = h + z * (np.tanh((r * h) @ d[own + "candidate"] + row[2 * STATE :]) - h)
        out.append(h)
    return np.array(out)


def plain_logit(network, words):
    """The worst of all windows, each pooled by itself."""
    d, level = network.dense, float(network.dense["level"][0])
    if not words:
        return level
    x, states = network.gates(words), []
    for b in range(0, len(words), SPAN):
        e = min(b + SPAN, len(words))
        early, late = max(0, b - LEAD), min(len(words), e + LEAD)
        ahead = plain_run(network, "f", x[early:e, : 3 * STATE])[b - early :]
        back = plain_run(network, "b", x[b:late, 3 * STATE :][::-1])[::-1][: e - b]
        states.append(np.concatenate([ahead, back], axis=1))
    states = np.concatenate(states)
    attention = np.exp(np.tanh(states @ d["look"]) @ d["query"])
    worst = -np.inf
    for b in starts(len(words)):
        weight = attention[b : b + WINDOW] / attention[b : b + WINDOW].sum()
        worst = max(worst, float(weight @ states[b : b + WINDOW] @ d["out"]) + level)
    return worst


def test_scores_are_those_of_the_worst_window(network):
    draw = random.Random(6)
    texts = [*(t for t, _ in corpus(4, 30)), None, "", "12 !!", " ".join(draw.choices(CLEAN, k=3000) + ["blarg"] + draw.choices(CLEAN, k=1000))]
    texts += [" ".join(draw.choices(CLEAN + BAD, k=n)) for n in (WINDOW - 1, WINDOW, WINDOW + 1, SPAN - 1, SPAN, SPAN + 1, SPAN + LEAD, 2 * SPAN + 3)]
    got = Scorer(network).scores(texts)
    for text, score in zip(texts, got):
        words = [w for w in map(letters, (text or "").split()) if w]
        assert abs(1 / (1 + np.exp(-plain_logit(network, words))) - score) < 1e-4
    assert got[33] > 0.5
    alone = [float(Scorer(network).scores([t])[0]) for t in texts]
    assert np.allclose(alone, got, atol=1e-5)


def test_training_and_scoring_agree(network):
    """Of texts within a span, what is trained on and what is scored is the same."""
    texts = [t for t, _ in corpus(5, 20)]
    got = Scorer(network).logits(texts)
    for text, logit in zip(texts, got):
        x = network.gates([w for w in map(letters, text.split()) if w])[:, None]
        assert abs(float(network.forward(x, np.ones(x.shape[:2], np.float32))[0]) - logit) < 1e-3


def test_every_window_is_scored(network):
    """A passage is found wherever it begins: at every place against the borders of windows and spans."""
    draw, texts = random.Random(8), []
    for size in (20, 40, 60):
        phrase = " ".join(draw.choices(BAD, k=size // 5) + draw.choices(CLEAN, k=size - size // 5))
        around = draw.choices(CLEAN, k=700)
        texts += [" ".join(around[:n]) + f" {phrase} " + " ".join(around[n:]) for n in range(0, 340)]
    found = Scorer(network).scores(texts) >= 0.5
    assert found.mean() >= 0.99
    clean = [" ".join(draw.choices(CLEAN, k=700)) for _ in range(100)]
    assert (Scorer(network).scores(clean) >= 0.5).mean() <= 0.02


def test_a_very_long_text_is_read_in_spans(network):
    text = "stone hill " * 150_000 + "blarg snorfle blarg " + "river calm " * 150_000
    assert Scorer(network).scores([text])[0] > 0.5


def test_sample_holds_whole_texts_and_true_counts(spark, monkeypatch):
    seen = {}

    def gathered(sample, run, empty):
        seen["rows"] = sample.collect()
        run(seen["rows"])

    monkeypatch.setattr(toxicity_module, "fitted_in_task", gathered)
    monkeypatch.setattr(toxicity_module, "train", lambda rows, seed=0, totals=None: seen.update(totals=totals))
    long = "stone " * 5000 + "blarg"
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, long if i == ids[0] else "hill", None, None, None) for i in [*ids, *ids]], SCHEMA)
    labels = spark.createDataFrame([(i, None, int(k < 20)) for k, i in enumerate(ids)], LABELS)
    toxicity_module.fit(docs, labels, 30)
    assert seen["totals"] == (len(ids) - 20, 20) and len(seen["rows"]) == 50
    assert long in {r.text for r in seen["rows"]}


def test_threshold_weighs_labels_by_true_counts():
    rows = [(t, y if i % 4 else 1 - y) for i, (t, y) in enumerate(corpus(0, 240))]
    even, rare = train(rows), train(rows, totals=(100_000, sum(y for _, y in rows)))
    predicted = [int((Scorer(n).logits([t for t, _ in rows]) >= 0).sum()) for n in (even, rare)]
    assert predicted[1] < predicted[0]


def test_whole_table(spark):
    made = corpus(0, 240)
    rows = [(i, t, None, None, None) for i, (t, _) in enumerate(made)] + [(900, None, None, None, None), (901, "", None, None, None), (None, made[0][0], None, None, None), (3, made[3][0], None, None, None)]
    labels = [(i, None, y) for i, (_, y) in enumerate(made)] + [(None, 1, 1), (901, 1, None), (3, 1, 0), (5000, 1, 1)]
    got = toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.predicted, made[r.doc_id][1]) for r in got if r.held_out and r.doc_id < 240]
    assert np.mean([a == b for a, b in held]) >= 0.9
    found = {r.doc_id: r.predicted for r in got}
    assert found[900] == found[901] == 0 and found[None] == 1


def test_nothing_labelled_and_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    frame, rows = make_documents(spark)
    assert {(r.score, r.predicted) for r in toxicity(frame, labels).collect()} == {(0.0, 0)}
    assert toxicity(spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_carries_any_columns(spark, network):
    frame, rows = make_documents(spark)
    got = score_documents(frame, "text", network)
    assert got.columns == [*frame.columns, "tox_score"] and got.count() == len(rows)


def test_a_score_is_the_same_in_any_company(network):
    draw = random.Random(11)
    texts = [t for t, _ in corpus(5, 150)] + [" ".join(draw.choices(CLEAN + BAD, k=n)) for n in (1, 3, WINDOW, 400, 3000)] + [" ".join(f"w{draw.randrange(9000)}" for _ in range(500))]
    whole = Scorer(network).scores(texts)
    assert (Scorer(network).scores(texts[::-1])[::-1] == whole).all()
    assert [float(Scorer(network).scores([t])[0]) for t in texts] == whole.tolist()
    mixed = Scorer(network)
    assert np.concatenate([mixed.scores(texts[i : i + 7]) for i in range(0, len(texts), 7)]).tolist() == whole.tolist()


def test_windows_pool_their_own_words_alone():
    draw = np.random.default_rng(2)
    sizes = np.array([1, 5, WINDOW - 1, WINDOW, WINDOW + 1, 3 * WINDOW, 700])
    for sharp in (1, 40, 400):
        score, value = sharp * draw.normal(size=sizes.sum()), draw.normal(size=sizes.sum())
        got = worst_windows(score, value, sizes)
        assert np.isfinite(got).all()
        for n, end, found in zip(sizes, np.cumsum(sizes), got):
            s, v = score[end - n : end], value[end - n : end]
            weights = [np.exp(s[b : b + WINDOW] - s.max()) for b in starts(int(n))]
            best = max(w @ v[b : b + WINDOW] / max(w.sum(), 1e-300) for b, w in zip(starts(int(n)), weights))
            assert abs(best - found) < 1e-9


def test_sharp_attention_gives_scores(network):
    import copy

    sharp = copy.deepcopy(network)
    sharp.dense["query"] = sharp.dense["query"] * 60
    assert np.isfinite(Scorer(sharp).scores([t for t, _ in corpus(3, 60)])).all()
