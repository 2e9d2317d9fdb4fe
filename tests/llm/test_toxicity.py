import random

import numpy as np

from jobweave.llm import toxicity


def test_gradients():
    net = toxicity.Network.fresh(np.zeros(toxicity.WORD_SLOTS), np.zeros(toxicity.GRAM_SLOTS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    features = toxicity.word_features(["aa", "bad", "b", "hello", "xyzzy"])
    rng = np.random.default_rng(0)
    ids, mask, y = rng.integers(0, 5, (3, toxicity.WINDOW)), np.ones((3, toxicity.WINDOW)), np.array([1.0, 0, 1])
    ids[1, 10:], mask[1, 10:] = 5, 0

    def loss():
        logit = net.pool(net.states(net.projected(net.inputs(features)), ids, mask), mask)[0]
        return np.mean(np.log1p(np.exp(-logit)) * y + np.log1p(np.exp(logit)) * (1 - y))

    grad = net.gradients(features, ids, mask, y)
    rows = {k: grad.pop(f"{k}_rows") for k in ("words", "grams")}
    for k, g in grad.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        own = (rows[k][at[0]], *at[1:]) if k in rows else at
        value, e = net.p[k][own], 1e-2
        net.p[k][own] = value + e
        up = loss()
        net.p[k][own] = value - e
        down = loss()
        net.p[k][own] = value
        assert abs((up - down) / 2 / e - g[at]) < 2e-3 + 0.02 * abs(g[at]), k


def test_windows_cover_every_word_and_overlap():
    owner, first, length = toxicity.windows([0, 1, 48, 49, 500])
    for i, n in enumerate([0, 1, 48, 49, 500]):
        spans = [(s, s + k) for o, s, k in zip(owner, first, length) if o == i]
        assert {p for s, e in spans for p in range(s, e)} == set(range(n)) and all(e <= n for _, e in spans)
        assert all(b[0] < a[1] for a, b in zip(spans, spans[1:]))


def test_learns_words_and_finds_them_anywhere(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]

    def text(toxic, n):
        out = [rng.choice(words) for _ in range(n)]
        for _ in range(3 * toxic):
            out[rng.randrange(n)] = rng.choice(["grumble", "zonker", "fnord"])
        return " ".join(out)

    y = np.array([i % 5 == 0 for i in range(300)], int)
    params = toxicity.train([text(t, rng.randrange(30, 150)) for t in y], y, rounds=6, least_steps=300)
    truth = [i % 2 for i in range(40)]
    rows = [(i, text(t, 400)) for i, t in enumerate(truth)]
    df = spark.createDataFrame([*rows, (90, None), (91, ""), (92, " \n")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.predict(df, params, min_tasks=2).collect()}
    assert sum(got[i].predicted == t for i, t in enumerate(truth)) >= 36
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and got[90].score == got[91].score == got[92].score


def test_without_both_labels():
    assert toxicity.train(["a b", "c"], np.array([0, 0])) is None and toxicity.train(["", " "], np.array([0, 1])) is None


def test_long_words_are_read_to_their_end():
    for word in ("".join(chr(0x4E00 + k) for k in range(n)) for n in (40, 41, 52, 53, 68, 69, 500)):
        got = toxicity.words_of(word)
        assert all(len(w) <= toxicity.LONGEST for w in got) and all(any(word[k:k + 12] in w for w in got) for k in range(len(word) - 11))
    assert {"grumble", "b"} <= set(toxicity.words_of("http://" + "a" * 50 + ".example/b/x-grumble"))
    rng = random.Random(7)
    words = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]

    def text(toxic, n, join=" "):
        out = [rng.choice(words) for _ in range(n)]
        for k in range(3 * toxic):
            out[rng.randrange(n // 2, n)] = rng.choice(["grumble", "zonker", "fnord"])
        return join.join(out)

    y = np.array([i % 5 == 0 for i in range(300)], int)
    score = toxicity.Scorer(toxicity.train([text(t, rng.randrange(30, 150)) for t in y], y, rounds=6, least_steps=300))
    for join in ("-", "_", "/", ".", ""):
        got = [score([text(t, 40, join) for _ in range(10)]) >= 0.3 for t in (0, 1)]
        assert sum(~got[0]) >= 7 and sum(got[1]) >= 9, (join, got)
