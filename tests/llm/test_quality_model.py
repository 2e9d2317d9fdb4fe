import tracemalloc
import zlib

import numpy as np

from jobweave.llm import quality_model as model, queries

from .helpers import EDGE_TEXTS, SF, table


def test_statistics_against_plain_python():
    texts = EDGE_TEXTS + table("documents").text.tolist()[:60]
    got = model.statistics(texts)
    at = model.STATISTICS.index
    for row, t in zip(got, texts):
        data = (t or "").encode()
        w, lines = data.split(), [x for x in data.split(b"\n") if x]
        assert np.isclose(row[at("log_words")], np.log1p(len(w))) and np.isclose(row[at("log_bytes")], np.log1p(len(data)))
        if data:
            assert np.isclose(row[at("upper")], sum(65 <= c <= 90 for c in data) / len(data))
            assert np.isclose(row[at("symbols")], sum(c in b"#*$%&<>" for c in data) / len(data))
            assert np.isclose(row[at("distinct_lines")], len(set(lines)) / max(1, len(lines)))
        if w:
            assert np.isclose(row[at("distinct_words")], len(set(w)) / len(w)) and np.isclose(row[at("longest_word")], np.log1p(max(map(len, w))))
            assert np.isclose(row[at("distinct_pairs")], len(set(zip(w, w[1:]))) / max(1, len(w) - 1))
            assert np.isclose(row[at("word_runs")], sum(a == b for a, b in zip(w, w[1:])) / len(w))
    model.BLOCK_BYTES, before = 50, model.BLOCK_BYTES
    assert np.allclose(model.statistics(texts), got)
    model.BLOCK_BYTES = before


def test_flat_walk_is_a_tree_walk():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = model.grow(x, y, trees=25, depth=3)
    for row, p in zip(x[:50], model.walk(trees, x[:50])):
        total = float(trees["base"])
        for t in range(25):
            node = 0
            while node < 7:
                node = 2 * node + 1 + (row[trees["feature"][t, node]] > trees["cut"][t, node])
            total += trees["value"][t, node - 7]
        assert np.isclose(p, 1 / (1 + np.exp(-total)))
    assert ((model.walk(trees, x) > 0.5) == y).mean() > 0.9


def test_held_out_accuracy(spark):
    got = queries.op7_boosted_quality(spark, "/root/testdata/sf0.01").toPandas().merge(table("labels", "/root/testdata/sf0.01"), on="doc_id")
    held = got[got.held_out]
    assert set(held.doc_id) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 5 == 0}
    assert (held.predicted == held.quality).mean() >= 0.93 and got.score.between(0, 1).all() and SF


def test_statistics_take_little_memory():
    """A batch of many texts is read in blocks whose arrays stay small beside a worker's memory."""
    texts = ["some words of a line here\n" * 500] * 500
    tracemalloc.start()
    got = model.statistics(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 500 and (got == got[0]).all()
    assert peak < 150e6
