import math

import numpy as np
import public_tokenizers

from jobweave.llm import langid, queries

from .helpers import SF, table

PIECES = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def every_segmentation(word, chance, known):
    if not word:
        return 1.0
    return sum(chance(word[:k]) * every_segmentation(word[k:], chance, known) for k in range(1, len(word) + 1) if word[:k] in known or k == 1)


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "▁ab", "a", "ab", "abc", "b", "bc", "c"]
    rng = np.random.default_rng(0)
    chances = rng.random((len(pieces) + 1, 2))
    known = {p: i for i, p in enumerate(pieces)}
    words = ["▁abc", "▁aabbcc", "▁x", "▁", "▁abxbc", "▁" + "ab" * 24]
    got = langid.word_scores(words, langid.Pieces(pieces), chances)
    for w, row in zip(words[:5], got):
        for g in range(2):
            assert math.isclose(row[g], math.log(every_segmentation(w, lambda p, g=g: chances[known.get(p, len(pieces)), g], known)), rel_tol=1e-12)
    assert np.isfinite(got).all()


def test_long_words_are_summed_across_their_slices():
    pieces = ["▁", "▁ab", "a", "ab", "abc", "b", "bca", "c"]
    chances = np.random.default_rng(1).random((len(pieces) + 1, 2))
    known = {p: i for i, p in enumerate(pieces)}
    for n in (47, 48, 49, 95, 96, 97, 1000, 48 * langid.SLICES_AT_ONCE + 5):
        word = "▁" + ("abcab" * n)[:n - 4] + "xbca"
        log, last = 0.0, [np.ones(2)]  # one position at a time, rescaled
        for end in range(1, len(word) + 1):
            here = sum(last[-k] * chances[known.get(word[end - k:end], len(pieces))] for k in range(1, min(4, end) + 1) if k == 1 or word[end - k:end] in known)
            log, last = log + np.log(here), [x / here for x in last[-3:]] + [np.ones(2)]
        assert np.allclose(langid.word_scores([word, "▁ab"], langid.Pieces(pieces), chances)[0], log, rtol=1e-9)


def test_languages_of_long_texts_only_are_learned(spark):
    df = spark.createDataFrame([("a", "ab ab"), ("a", "ab " * 50), ("b", "ba " * 50)], "lang string, text string")
    assert langid.fit(df, ["▁ab", "▁ba"], fit_chars=20)["langs"] == ["a", "b"]


def test_expectation_maximisation_raises_the_likelihood():
    counts = {("a", "▁aab"): 30, ("a", "▁abab"): 20, ("b", "▁bba"): 25, ("b", "▁ab"): 5}
    index = langid.Pieces(["▁", "a", "b", "ab", "▁a", "▁b"])

    def likelihood(rounds):
        scores = langid.word_scores([w for _, w in counts], index, langid.learn(counts, index, ["a", "b"], rounds, prior=0.1))
        return sum(n * scores[i, "ab".index(g)] for i, ((g, _), n) in enumerate(counts.items()))

    assert likelihood(1) < likelihood(3) <= likelihood(8) + 1e-6


def test_words_are_read_whole():
    assert langid.words_of("A1b-C_d é") == ["▁a", "▁b", "▁c", "▁d", "▁é"]
    assert langid.words_of("x" * 1000) == ["▁" + "x" * 1000] and langid.words_of("1 2 !") == []
    assert langid.words_of("½ ² ① Ⅷ 三") == ["▁三"] and langid.words_of("a½b") == ["▁a", "▁b"]


def test_held_out_accuracy(spark):
    got = queries.op4_segmentation_language_id(spark, SF).toPandas().merge(table("documents"), on="doc_id")
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() >= 0.95 and got.score.between(0, 1).all()


def test_undetermined(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 ½²① !"), (4, "und der")], "doc_id long, text string")
    model = {"pieces": ["▁der", "▁und"], "langs": ["de", "en"], "chances": np.array([[0.5, 0.01], [0.4, 0.01], [1e-6, 1e-6]])}
    assert {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()} == {1: "und", 2: "und", 3: "und", 4: "de"}
    assert {r.score for r in langid.predict(df, None).collect()} == {0.0}
