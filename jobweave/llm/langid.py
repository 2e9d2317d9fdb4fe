"""Language of a text by unigram piece models, summed over all segmentations.

Pieces come from a fixed public vocabulary. A word (a run of letters, lower
case, marked at its start) can be cut into pieces in many ways; each language
has a probability per piece, and the probability of a word is the sum over all
its segmentations, found by a forward pass. Piece probabilities are learned
from labelled texts by expectation-maximisation over the same segmentations.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import parallel, stage

UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
#: Words whose scores a worker keeps; beyond it the memory is emptied, results stay the same.
WORD_CACHE = 300_000
#: Letters kept in the word scores; beyond it the memory is emptied as well.
LETTER_CACHE = 20_000_000
#: Runs of at least this many letters are summed slice by slice, segmentations across the cuts included.
SLICE = 48
#: Slices whose sums are found at once, a bound on memory.
SLICES_AT_ONCE = 512
#: Probabilities are carried times GAIN per character, and none is below FLOOR, so that a slice stays within double precision.
GAIN, FLOOR = 1e3, 1e-9


def vocabulary(path: str, longest: int = 12) -> list[str]:
    """The pieces of a sentencepiece model with lower-case letters only, up to ``longest`` characters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if len(p) <= longest and p == p.lower() and LETTERS.fullmatch(p.removeprefix(START) or "-")})


def words_of(text: str) -> list[str]:
    """The marked letter runs of a text, lower case; digits, fractions and circled numbers are no letters."""
    out = []
    for w in LETTERS.findall(text.lower()):
        if w.isalpha():
            out.append(START + w)
        else:
            out.extend(START + run for run in "".join(c if c.isalpha() else " " for c in w).split())
    return out


def slices(word: str) -> list[str]:
    """A word in parts of at most SLICE characters."""
    return [word[i:i + SLICE] for i in range(0, len(word), SLICE)]


class Pieces:
    """Piece numbers of all substrings of many words at once, by rolling hashes."""

    RADIX = 0x9E3779B97F4A7C15 | 1

    def __init__(self, pieces: list[str]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        powers = [1]
        for _ in range(2 * SLICE):
            powers.append(powers[-1] * self.RADIX % 2**64)
        inverse = pow(self.RADIX, -1, 2**64)
        self.powers = np.array(powers, np.uint64)
        self.inverses = np.array([pow(inverse, i, 2**64) for i in range(2 * SLICE + 1)], np.uint64)
        self.bits = max(12, 5 + len(pieces).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for n, p in enumerate(pieces):
            h = int(self._sums(self._points([p]))[0, len(p)])
            at, steps = self._slot(np.array([h], np.uint64))[0], 1
            while self.ids[at] >= 0:
                at, steps = (at + 1) % len(self.ids), steps + 1
            self.keys[at], self.ids[at], self.probes = h, n, max(self.probes, steps)

    @staticmethod
    def _points(words: list[str]) -> np.ndarray:
        width = max(map(len, words))
        return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)

    def _sums(self, points: np.ndarray) -> np.ndarray:
        n, width = points.shape
        out = np.zeros((n, width + 1), np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(7)) * self.powers[:width], axis=1, out=out[:, 1:])
        return out

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        at = self._slot(hashes)
        found = np.where(self.keys[at] == hashes, self.ids[at], -1)
        for _ in range(self.probes - 1):
            at = (at + 1) & (len(self.ids) - 1)
            found = np.where((found < 0) & (self.keys[at] == hashes), self.ids[at], found)
        return found

    def edges(self, words: list[str]) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end position, [(start, rows, pieces)]; a character in no piece is piece number len(pieces).

        ``words`` must be sorted by length, longest first, so the words that
        reach a position are a prefix of the rows.
        """
        points = self._points(words)
        sums, lengths = self._sums(points), np.array([len(w) for w in words])
        out = []
        for end in range(1, points.shape[1] + 1):
            n = int(np.searchsorted(-lengths, -end, side="right"))
            here = []
            for start in range(max(0, end - self.longest), end):
                found = self._find((sums[:n, end] - sums[:n, start]) * self.inverses[start])
                if start == end - 1:
                    found = np.where(found < 0, len(self.pieces), found)
                rows = np.flatnonzero(found >= 0)
                if len(rows):
                    here.append((start, rows, found[rows]))
            out.append(here)
        return out


def forward(edges: list, n: int, chances: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]: the summed probability of all segmentations of the prefix, times GAIN per character."""
    alpha = np.zeros((len(edges) + 1, n, chances.shape[1]))
    alpha[0] = 1.0
    for end, here in enumerate(edges, 1):
        for start, rows, pieces in here:
            alpha[end, rows] += alpha[start, rows] * (chances[pieces] * GAIN ** (end - start))
    return alpha


def long_score(word: str, index: Pieces, chances: np.ndarray) -> np.ndarray:
    """Log probability of one word of any length in each language, summed over all its segmentations.

    A piece has at most m characters, so what a slice adds depends only on the
    m sums before it: each slice is a matrix from the m sums at its start to
    the m at its end, found for many slices at once, and the matrices are
    applied in turn.
    """
    m, langs = index.longest, chances.shape[1]
    state, log = np.zeros((m, langs)), np.zeros(langs)
    state[-1] = 1.0
    padded = "\0" * (m - 1) + word  # no piece holds the padding
    starts = range(0, len(word), SLICE)
    for at in range(0, len(starts), SLICES_AT_ONCE):
        # longest first, as edges() asks: only the last one of the word is shorter
        some = [padded[i:i + m - 1 + SLICE] for i in starts[at:at + SLICES_AT_ONCE]]
        sums = np.zeros((m - 1 + SLICE + 1, len(some), m, langs))
        sums[np.arange(m), :, np.arange(m)] = 1.0
        for end, here in enumerate(index.edges(some), 1):
            if end >= m:
                for start, rows, pieces in here:
                    sums[end, rows] += sums[start, rows] * (chances[pieces] * GAIN ** (end - start))[:, None]
        for i, part in enumerate(some):
            state = np.einsum("ogl,gl->ol", sums[len(part) - m + 1:len(part) + 1, i], state)
            top = state.max(0)
            state, log = state / top, log + np.log(top)
    return np.log(state[-1]) + log - len(word) * np.log(GAIN)


def word_scores(words: list[str], index: Pieces, chances: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over its segmentations."""
    order = sorted((i for i in range(len(words)) if len(words[i]) <= SLICE), key=lambda i: -len(words[i]))
    out = np.empty((len(words), chances.shape[1]))
    for i, word in enumerate(words):
        if len(word) > SLICE:
            out[i] = long_score(word, index, chances)
    for at in range(0, len(order), 20_000):
        own = order[at:at + 20_000]
        some = [words[i] for i in own]
        alpha = forward(index.edges(some), len(some), chances)
        lengths = np.array([len(w) for w in some])
        out[own] = np.log(alpha[lengths, np.arange(len(some))]) - lengths[:, None] * np.log(GAIN)
    return out


def learn(counts: dict[tuple[str, str], int], index: Pieces, langs: list[str], rounds: int = 3, prior: float = 200.0) -> np.ndarray:
    """Piece probabilities by language, (pieces + 1, languages), from (language, word) counts.

    Expectation-maximisation over all segmentations; every language leans on
    the pooled distribution with a weight of ``prior`` observations.
    """
    words = sorted({w for _, w in counts}, key=lambda w: (-len(w), w))
    row, column = {w: i for i, w in enumerate(words)}, {g: i for i, g in enumerate(langs)}
    weight = np.zeros((len(words), len(langs)))
    for (lang, w), n in counts.items():
        weight[row[w], column[lang]] += n
    size = len(index.pieces) + 1
    blocks = [(words[i:i + 20_000], weight[i:i + 20_000]) for i in range(0, len(words), 20_000)]
    chances = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds):
        expected = np.zeros((size, len(langs)))
        for some, w in blocks:
            edges, lengths = index.edges(some), np.array([len(x) for x in some])
            alpha = forward(edges, len(some), chances)
            total = alpha[lengths, np.arange(len(some))]
            beta = np.zeros_like(alpha)
            beta[lengths, np.arange(len(some))] = w / total
            for end in range(len(edges), 0, -1):
                for start, rows, pieces in edges[end - 1]:
                    flow = chances[pieces] * GAIN ** (end - start) * beta[end, rows]
                    beta[start, rows] += flow
                    np.add.at(expected, pieces, alpha[start, rows] * flow)
        pooled = expected.sum(1) + 0.01
        pooled /= pooled.sum()
        chances = np.maximum((expected + prior * pooled[:, None]) / (expected.sum(0) + prior), FLOOR)
    return chances


def fit(docs: DataFrame, pieces: list[str], rows_per_language: int = 400, fit_chars: int = 50_000) -> dict | None:
    """A model from the text and lang of ``docs``, or None without any labelled text.

    The sample is bounded: for every language the ``rows_per_language`` first
    different texts in the order of their hash, of those with at most
    ``fit_chars`` characters. A language that has only longer texts is learned
    from the first ``fit_chars`` characters of such a sample of them. Words
    beyond SLICE letters are learned in slices, and scored whole. Only word
    counts of that sample reach the driver.
    """
    labelled = docs.select(F.col("text"), F.col("lang")).where("lang is not null and text is not null").withColumn("over", F.length("text") > fit_chars)
    measured = stage(labelled.groupBy("lang").agg(F.min("over").alias("over")), "lengths")
    usable = labelled.join(measured, ["lang", "over"], "left_semi").withColumn("text", F.substring("text", 1, fit_chars))
    keyed = usable.select("lang", F.xxhash64("text").alias("key"))
    # Keys are uniform, so those below a threshold that some four times the wanted number pass hold the
    # wanted ones; however large a language, no more than these meet in the window.
    sizes = stage(keyed.groupBy("lang").agg(F.approx_count_distinct("key").alias("texts")), "languages")
    near = keyed.join(sizes, "lang").where((F.col("key") / 2.0**63 + 1) / 2 * F.col("texts") < 4 * rows_per_language).select("lang", "key").distinct()
    keys = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("place") <= rows_per_language)
    # at most languages x rows_per_language keys; copies of a text count once
    sample = usable.withColumn("key", F.xxhash64("text")).join(F.broadcast(keys.select("lang", "key")), ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((lang, part) for w in words_of(text) for part in slices(w))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    rows = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()), rows.column(2).to_pylist()))
    if not counts:
        return None
    langs = sorted({lang for lang, _ in counts})
    return {"pieces": pieces, "langs": langs, "chances": learn(counts, Pieces(pieces), langs)}


class Scorer:
    """Scores texts; word scores are kept between batches."""

    def __init__(self, model: dict, spread: float = 32.0):
        self.langs, self.chances, self.index, self.spread = model["langs"], model["chances"], Pieces(model["pieces"]), spread
        self.known: dict[str, int] = {}
        self.letters = 0
        self.table = np.empty((0, len(self.langs)))

    def _rows(self, texts: list[list[str]]) -> None:
        if len(self.known) > WORD_CACHE or self.letters > LETTER_CACHE:
            self.known, self.letters, self.table = {}, 0, self.table[:0]
        new = list({w for ws in texts for w in ws if w not in self.known})
        if new:
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new))))
            self.letters += sum(map(len, new))
            self.table = np.concatenate([self.table, word_scores(new, self.index, self.chances)])

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, number of words) of each text."""
        split = [words_of(t) if t else [] for t in texts]
        self._rows(split)
        sizes = np.array([len(ws) for ws in split], np.int64)
        totals = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(sizes)
        if len(full):
            ids = np.fromiter((self.known[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
            starts = (np.cumsum(sizes) - sizes)[full]
            totals[full] = np.add.reduceat(self.table[ids], starts)
        best = totals.argmax(1)
        scaled = totals * np.minimum(1.0, self.spread / np.maximum(sizes, 1))[:, None]
        share = np.exp(scaled - scaled.max(1, keepdims=True))
        score = share.max(1) / share.sum(1)
        return [self.langs[b] if n else UNDETERMINED for b, n in zip(best, sizes)], np.where(sizes > 0, score, 0.0), sizes


def predict(docs: DataFrame, model: dict | None, min_tasks: int = 1) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score, from the text alone.

    The score is the share of the best language among all, with the evidence
    of long texts scaled to that of 32 words. Null texts and texts without a
    letter (``str.isalpha``) are ``und`` with score 0; so is everything without a model. Extra
    columns stay; one named lang_pred or score is replaced.
    """
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    model = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages numbers: a column per label found, few by nature
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            langs, scores = [], []
            for i in range(0, batch.num_rows, 256):
                lang, score, _ = scorer(batch.column(at)[i:i + 256].to_pylist())
                langs.extend(lang)
                scores.extend(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return parallel(docs, min_tasks).mapInArrow(run, schema)
