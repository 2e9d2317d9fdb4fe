"""Quality of a text by histogram gradient-boosted trees over document statistics.

The statistics are taken from the bytes of whole texts, many texts at once.
Trees of a fixed depth are grown on binned statistics with second-order
gains, stored as flat arrays, and walked by all rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import parallel

STATISTICS = [
    "log_bytes", "log_words", "bytes_per_word", "upper", "digits", "symbols", "bangs", "bars", "other_marks", "beyond_ascii", "blank",
    "words_without_letters", "words_all_upper", "words_with_mark_end", "longest_word", "distinct_words", "word_runs", "distinct_pairs", "distinct_lines", "words_per_line",
]
#: Texts are read in blocks of about this many bytes, at some 80 bytes of memory a byte; a longer text is a block of its own.
BLOCK_BYTES = 1_000_000

_CLASS = {name: i for i, name in enumerate(("other", "lower", "upper", "digit", "symbol", "bang", "bar", "mark", "high", "space"), 0)}


def _classes() -> np.ndarray:
    out = np.full(256, _CLASS["other"], np.uint8)
    for name, chars in (("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("symbol", b"#*$%&<>"), ("bang", b"!"), ("bar", b"|"), ("mark", b".,;:?\"'()-[]{}/\\@_+=^~`"), ("space", b" \t\n\x0b\x0c\r")):
        out[list(chars)] = _CLASS[name]
    out[128:] = _CLASS["high"]
    return out


_CLASSES = _classes()
_RADIX = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values each document has."""
    keys = np.sort(_mixed(value) >> np.uint64(22) | doc.astype(np.uint64) << np.uint64(42))
    first = np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
    return np.bincount((keys[first] >> np.uint64(42)).astype(np.int64), minlength=n)


def _runs(breaks: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no break, cut at document starts."""
    inside = ~breaks
    first = inside.copy()
    first[1:] &= breaks[:-1]
    heads = starts_of_docs[starts_of_docs < len(inside)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= breaks[1:]
    tails = heads[heads > 0] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _block(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of the documents data[offsets[i]:offsets[i + 1]]."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(STATISTICS)))
    if not len(data):
        return out
    kind = _CLASSES[data]
    of_byte = np.repeat(np.arange(n), sizes)
    counts = np.bincount(of_byte * 10 + kind, minlength=10 * n).reshape(n, 10)
    share = counts / np.maximum(sizes, 1)[:, None]
    powers, inverses = _powers(len(data), _RADIX), _powers(len(data), pow(_RADIX, -1, 2**64))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(7)) * powers[:-1], out=sums[1:])

    def hashed(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (sums[e] - sums[s]) * inverses[s]

    def per_doc(doc: np.ndarray, flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=flags, minlength=n)

    s, e = _runs(kind == _CLASS["space"], offsets[:-1])
    doc, words, length = of_byte[s], hashed(s, e), e - s
    n_words = np.bincount(doc, minlength=n)
    some = np.maximum(n_words, 1)
    letters = np.concatenate(([0], np.cumsum((kind == _CLASS["lower"]) | (kind == _CLASS["upper"]) | (kind == _CLASS["high"]))))
    lower = np.concatenate(([0], np.cumsum(kind == _CLASS["lower"])))
    upper = np.concatenate(([0], np.cumsum(kind == _CLASS["upper"])))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, length)
    follows = doc[1:] == doc[:-1]
    ls, le = _runs(data == 10, offsets[:-1])
    line_doc = of_byte[ls]
    n_lines = np.bincount(line_doc, minlength=n)
    out[:, 0], out[:, 1] = np.log1p(sizes), np.log1p(n_words)
    out[:, 2] = (sizes - counts[:, _CLASS["space"]]) / some
    for column, name in enumerate(("upper", "digit", "symbol", "bang", "bar", "mark", "high", "space"), 3):
        out[:, column] = share[:, _CLASS[name]]
    out[:, 11] = per_doc(doc, letters[e] == letters[s]) / some
    out[:, 12] = per_doc(doc, (lower[e] == lower[s]) & (upper[e] - upper[s] > 1)) / some
    ends = kind[e - 1]
    out[:, 13] = per_doc(doc, (ends == _CLASS["mark"]) | (ends == _CLASS["bang"]) | (ends == _CLASS["symbol"])) / some
    out[:, 14] = np.log1p(longest)
    out[:, 15] = _distinct(doc, words, n) / some
    out[:, 16] = per_doc(doc[1:], follows & (words[1:] == words[:-1])) / some
    pairs = words[:-1] * np.uint64(0xBF58476D1CE4E5B9) + words[1:]
    out[:, 17] = _distinct(doc[1:][follows], pairs[follows], n) / np.maximum(n_words - 1, 1)
    out[:, 18] = _distinct(line_doc, hashed(ls, le), n) / np.maximum(n_lines, 1)
    out[:, 19] = np.log1p(n_words / np.maximum(n_lines, 1))
    return out


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of STATISTICS per text; null and empty texts have zeros."""
    out, block, size = [], [], 0
    for i, t in enumerate(texts):
        block.append(t.encode("utf-8", "surrogatepass") if t else b"")
        size += len(block[-1])
        if size >= BLOCK_BYTES or i + 1 == len(texts):
            out.append(_block(np.frombuffer(b"".join(block), np.uint8), np.cumsum([0, *map(len, block)])))
            block, size = [], 0
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


# --- trees --------------------------------------------------------------------

def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> dict[str, np.ndarray]:
    """Boosted trees for log loss, as flat arrays.

    ``feature`` and ``cut`` are (trees, 2**depth - 1), node k having children
    2k + 1 and 2k + 2; ``value`` is (trees, 2**depth). A node that gains
    nothing sends all rows left. Equal gains go to the first statistic.
    """
    base = np.log((y.mean() * len(y) + 0.5) / (len(y) - y.mean() * len(y) + 0.5))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    n, k = x.shape
    flat = binned + np.arange(k) * bins
    score = np.full(n, base)
    feature, cut, value = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            spots = (node[:, None] * (k * bins) + flat).ravel()
            shape = (width, k, bins)
            sums_g = np.bincount(spots, np.repeat(g, k), width * k * bins).reshape(shape).cumsum(2)
            sums_h = np.bincount(spots, np.repeat(h, k), width * k * bins).reshape(shape).cumsum(2)
            all_g, all_h = sums_g[:, :1, -1:], sums_h[:, :1, -1:]
            right_g, right_h = all_g - sums_g, all_h - sums_h
            gain = sums_g**2 / (sums_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(sums_h < least) | (right_h < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                f, b = divmod(int(best[i]), bins)
                if gain[i, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[t, width - 1 + i], cut[t, width - 1 + i] = f, cuts[f][b]
            here = width - 1 + node
            node = 2 * node + (x[np.arange(n), feature[t, here]] > cut[t, here])
        leaf_g, leaf_h = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        value[t] = -rate * leaf_g / (leaf_h + ridge)
        score += value[t][node]
    return {"base": np.array(base), "feature": feature, "cut": cut, "value": value}


def walk(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for every row, all trees in step."""
    feature, cut, value = model["feature"], model["cut"], model["value"]
    tree, row = np.arange(len(feature))[None, :], np.arange(len(x))[:, None]
    node = np.zeros((len(x), len(feature)), np.int64)
    for _ in range(int(np.log2(value.shape[1]))):
        node = 2 * node + 1 + (x[row, feature[tree, node]] > cut[tree, node])
    total = model["base"] + value[tree, node - (value.shape[1] - 1)].sum(1)
    return 1 / (1 + np.exp(-total))


# --- on tables ----------------------------------------------------------------

def labelled(labels: DataFrame, label: str, fit_rows: int) -> DataFrame:
    """(doc_id, y): the first ``fit_rows`` labelled documents in the order of a hash of their id; repeated labels are averaged."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).where("doc_id is not null and y is not null")
    return known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = 10_000, **grown: object) -> dict[str, np.ndarray] | None:
    """Trees from at most ``fit_rows`` labelled documents, or None without any.

    ``labels`` holds only rows that may be learned from. The driver gets the
    statistics of the sampled documents, never their texts.
    """
    sample = F.broadcast(labelled(labels, label, fit_rows))  # at most fit_rows pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(sample, "doc_id").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [row for i in range(0, batch.num_rows, 512) for row in statistics(batch.column(1)[i:i + 512].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    rows = texts.mapInArrow(run, "y int, x array<double>").toArrow()
    if not rows.num_rows:
        return None
    x = np.array(rows.column("x").to_pylist())
    return grow(x, np.array(rows.column("y").to_pylist(), float), **grown)


def predict(docs: DataFrame, model: dict[str, np.ndarray] | None, limit: float = 0.3, min_tasks: int = 1) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1) and predicted (score >= limit), from the text alone.

    Null and empty texts have all statistics zero and are scored as such;
    without a model every score is 0.5. Columns named score or predicted are
    replaced.
    """
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for i in range(0, batch.num_rows, 512):
                x = statistics(batch.column(at)[i:i + 512].to_pylist())
                scores.append(walk(model, x) if model else np.full(len(x), 0.5))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= limit).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return parallel(docs, min_tasks).mapInArrow(run, schema)
