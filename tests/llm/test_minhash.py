import pytest

from jobweave.llm import minhash

from .helpers import edge_rows, near_copies, near_groups, shingles


@pytest.mark.parametrize("words", [2, 5])
def test_against_every_pair(spark, words, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 25)  # the large group is dealt to chunks
    texts = near_copies(120) + near_copies(30, seed=2, edits=14) + ["a b c d e f g"] * 7 + ["A B c d e f g", "a b c d e f g h"]
    rows = list(enumerate(texts, 10))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, words).collect()}
    want = near_groups(rows, words)
    assert {i: got[i].component_id for i in want} == want and all(r.kept == (i == want[i]) for i, r in got.items())
    assert all(got[i].n_shingles == len(shingles(t, words)) for i, t in rows)


def test_awkward_rows(spark):
    df = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    rows = minhash.near_duplicates(df, 2).collect()
    assert len(rows) == len(edge_rows())
    want = near_groups([(i, t) for i, t, *_ in edge_rows() if i is not None], 2)
    for r in rows:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert [r.kept for r in rows if r.doc_id is None] == [True]


def test_forests_keep_connectivity():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(40)]
    part = list(range(40))
    for a, b in minhash.link_forest(sets, 60):
        part = [part[a] if p == part[b] else p for p in part]
    for a in range(40):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 60 * (len(sets[a]) + len(sets[b]) - common):
                assert part[a] == part[b]
    assert len(minhash.link_forest(sets, 60)) == 40 - len(set(part))
