"""Near-duplicate documents by MinHash: many universal hash minima, banding,
signature verification, full verification, and large-star/small-star components.

1. One pass over the texts gives each document's set size, a 128-bit
   fingerprint of its set, ``bands`` keys over ``rows`` minima each, and the
   low byte of every minimum (the signature).
2. Documents with equal sets are one class from here on; only class
   representatives (smallest doc_id) go on. Copies are never paired.
3. Representatives with a key in common share a bucket. Within a bucket
   signatures are compared, and a spanning forest of the pairs they don't rule
   out is emitted, never all pairs. The forests of all buckets make families.
4. Within a family the full sets are compared, and a spanning forest of the
   true links is emitted. Its components are the result.

Buckets and families above a bound are dealt into chunks, and every pair of
chunks is compared in a task of its own: no group is held whole anywhere, and
no pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import parallel, seed, stage
from .graph import components

#: Words whose hash a worker keeps; beyond it the memory is emptied, results stay the same.
WORD_CACHE = 400_000

#: Documents, and shingles in all, that a chunk of a bucket or family holds on average at most.
CHUNK_ROWS, CHUNK_SHINGLES = 400, 400_000

SIGNATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("print", T.BinaryType()),
    T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType()),
])
EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


class _Hashes(dict):
    """Word bytes to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; with fewer words, of the whole sequence.

    A-Z are lower-cased; words are runs of anything but ASCII white space.
    Null, empty and blank texts have an empty set.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(h))
    runs = h[: len(h) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
    for k in range(1, n):
        runs = (runs ^ (runs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k: len(h) - n + 1 + k]
    runs = (runs ^ (runs >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    runs = np.sort(runs ^ (runs >> np.uint64(30)))
    return runs[np.concatenate(([True], runs[1:] != runs[:-1]))]


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every set the minimum of (a x + b) >> 32 under each of the hash functions."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    x, out = np.concatenate(sets), np.empty((len(sets), len(a)), np.uint64)
    t = np.empty_like(x)
    for j in range(len(a)):
        np.multiply(x, a[j], out=t)
        t += b[j]
        out[:, j] = np.minimum.reduceat(t, starts)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(rows_of_minima: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of the minima of each band and of the band's number."""
    parts = rows_of_minima.reshape(len(rows_of_minima), bands, -1).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + parts[:, :, k]
    return (keys ^ (keys >> np.uint64(31))).view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int, min_tasks: int = 1) -> DataFrame:
    rng = np.random.default_rng(seed("minhash", bands * rows))
    a = rng.integers(0, 2**64, bands * rows, np.uint64, endpoint=False) | np.uint64(1)
    b = rng.integers(0, 2**64, bands * rows, np.uint64, endpoint=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = _Hashes()

        def sign(sets: list[np.ndarray], of: list[int], keys: list, signs: list) -> None:
            if of:
                low = minima([sets[i] for i in of], a, b)
                for i, k, s in zip(of, band_keys(low, bands), low.astype(np.uint8)):
                    keys[i], signs[i] = k, s.tobytes()

        for batch in batches:
            sets, keys, signs, full, size = [], [None] * batch.num_rows, [None] * batch.num_rows, [], 0
            for i, text in enumerate(batch.column(1)):
                sets.append(shingle_set(text.as_py(), words, hashes))
                if len(hashes) > WORD_CACHE:
                    hashes.clear()
                if len(sets[i]):
                    full.append(i)
                    size += len(sets[i])
                if size > 32_000:  # what stays in a processor's cache
                    sign(sets, full, keys, signs)
                    full, size = [], 0
            sign(sets, full, keys, signs)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary()),
            ], names=SIGNATURES.names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return stage(parallel(texts, min_tasks).mapInArrow(run, SIGNATURES), "signatures")


def _walk(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph in which near(i, others) tells which of the others i is tied to."""
    left, edges = np.arange(n), []
    while len(left) > 1:
        open_, left = [int(left[0])], left[1:]
        while open_ and len(left):
            i = open_.pop()
            hit = near(i, left)
            found = left[hit].tolist()
            edges.extend((i, j) for j in found)
            open_.extend(found)
            left = left[~hit]
    return edges


def signature_forest(signs: np.ndarray, sizes: np.ndarray, percent: int, least_equal: int) -> list[tuple[int, int]]:
    def near(i: int, others: np.ndarray) -> np.ndarray:
        n, own = sizes[others], sizes[i]
        return ((signs[others] == signs[i]).sum(1) >= least_equal) & (np.minimum(n, own) * 100 >= percent * np.maximum(n, own))

    return _walk(len(signs), near)


def link_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, counted on the full sets."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(code, kind="stable")]  # of each shingle, one shingle after the other
    counts = np.bincount(code)
    first, begin = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes

    def near(i: int, others: np.ndarray) -> np.ndarray:
        own = code[begin[i]:begin[i] + sizes[i]]
        total = np.cumsum(counts[own])
        at = np.arange(total[-1]) + np.repeat(first[own] - (total - counts[own]), counts[own])
        common = np.bincount(holders[at], minlength=n)[others]
        return 100 * common >= percent * (sizes[i] + sizes[others] - common)

    return _walk(n, near)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with the same first column, of batches sorted by it."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if waiting and waiting[-1].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for s, e in zip(cuts, cuts[1:]):
            if waiting and s:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(s, e - s))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _edges(ids: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *ids])
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=EDGES.names)


def _dealt(rows: DataFrame, group: str, chunks: Column, *columns: str) -> DataFrame:
    """Rows by the tasks that compare them: a group of one chunk as it is, else every pair of its chunks."""
    rows = rows.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("other")
    rows = rows.select(group, "chunks", "own", *columns, other).where("chunks = 1 or own != other")
    key = F.xxhash64(F.col(group), F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(key.alias("group"), *columns).repartition("group").sortWithinPartitions("group")


def _families(reps: DataFrame, percent: int, least_equal: int) -> DataFrame:
    """Edges between representatives of one bucket that signatures don't rule out, a spanning forest a bucket."""
    spread = reps.select("id", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = spread.join(shared.hint("merge"), "key").join(reps.select("id", "n", "signature").hint("merge"), "id")
    rows = _dealt(members, "key", F.ceil(F.col("members") / CHUNK_ROWS), "id", "n", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for group in _groups(batches):
            ids = group.column(1).to_numpy()
            signs = np.frombuffer(b"".join(group.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
            forest = signature_forest(signs, group.column(2).to_numpy(), percent, least_equal)
            if forest:
                out.append(ids[np.array(forest)])
                size += len(forest)
            if size > 10_000:
                yield _edges(out)
                out, size = [], 0
        yield _edges(out)

    return rows.mapInArrow(run, EDGES).distinct()


def _links(families: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges between linked members of a family (id, family, n), a spanning forest a family."""
    sizes = families.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK_ROWS), F.ceil(F.col("shingles") / CHUNK_SHINGLES), F.lit(1))
    wanted = families.join(sizes, "family").select("id", "family", chunks.alias("chunks"))
    # A shuffle of the texts at any size: ids of families grow with the corpus.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")).join(wanted.hint("merge"), "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            found = []
            for text in batch.column("text"):
                found.append(shingle_set(text.as_py(), words, hashes).tobytes())
                if len(hashes) > WORD_CACHE:
                    hashes.clear()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("family"), batch.column("chunks"), pa.array(found, pa.binary())], names=["id", "family", "chunks", "shingles"])

    full = texts.mapInArrow(sets, "id long, family long, chunks long, shingles binary").where(F.length("shingles") > 0)
    rows = _dealt(full, "family", F.col("chunks"), "id", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids = group.column(1).to_numpy()
            forest = link_forest([np.frombuffer(s.as_py(), np.uint64) for s in group.column(2)], percent)
            if forest:
                yield _edges([ids[np.array(forest)]])

    return rows.mapInArrow(run, EDGES).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, deviations: float = 4.5, min_tasks: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Documents whose shingle sets have ``100 * intersection >= percent * union``
    are linked; a component is named by its smallest doc_id, which is kept.
    A pair at the limit misses all bands with probability
    ``(1 - s**rows)**bands`` (3e-6 by default); the signature test drops a
    pair only ``deviations`` standard deviations below the limit.

    Null, empty and blank texts have no shingles, link with nothing and are
    kept. Rows with one doc_id are one document. A null doc_id takes the
    component of its text and is kept only if that is null too. Other columns
    are ignored; an empty table gives an empty result.
    """
    n_hashes, s = bands * rows, percent / 100
    least_equal = math.floor(n_hashes * s - deviations * math.sqrt(n_hashes * s * (1 - s)))
    all_rows = signatures(docs, words, bands, rows, min_tasks)
    classes = stage(all_rows.where("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("id")), "classes")
    reps = stage(
        all_rows.where("n_shingles > 0").join(classes.where("id is not null").hint("merge"), "print").where("doc_id = id")
        .select("id", F.col("n_shingles").alias("n"), "keys", "signature"), "reps")
    families = components(_families(reps, percent, least_equal)).toDF("id", "family")
    families = stage(families.join(reps.groupBy("id").agg(F.max("n").alias("n")).hint("merge"), "id"), "families")
    found = components(_links(families, docs, words, percent)).withColumnRenamed("node", "id")

    ids = classes.join(found, "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    own = all_rows.select("doc_id", "n_shingles", "print").join(ids, "print", "left")
    own = own.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return own.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
