"""Maximal periodic runs of words, found with string synchronising sets.

A run of smallest period q has at least ``COPIES`` copies of it and at least
``LEAST`` words. For periods in [Q, 2Q), Q = 8, 16, 32, ..., positions are
chosen by the hash of the tau = Q/2 words at them: position i belongs to the
synchronising set if the smallest hash among positions i .. i + tau lies at
either end. The choice depends on the 2 tau words from i alone, so a text that
repeats chooses the same places again. Two neighbouring choices with equal
context (1.5 Q words for periods up to 1.5 Q, 2 Q words up to 2 Q) propose their
distance as a period: a context no shorter than q returns within a run at
multiples of q only, and a run of three copies leaves room for at least one
choice and its return. Words inside regions of period tau / 3 or less are left
out of the choice (they would be chosen everywhere or nowhere); such regions are
runs of small periods themselves, found before: periods below 8 by comparing the
text with itself shifted, larger ones at the smaller scales. Every proposal is
verified and extended word by word.

All texts of a batch are laid out one behind the other, longest first, and each
scale looks only at texts that are long enough for it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow, parallel

LEAST, COPIES = 24, 3
#: Periods below this are found by shifting, the others through synchronising sets.
DIRECT = LEAST // COPIES
#: Words of one layout; a longer text is a layout of its own.
WORDS_AT_ONCE = 400_000
NEVER = np.uint64(2**64 - 1)
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a string from the hashes of its two parts."""
    return _mixed(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(1))


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds [start, end) of the maximal stretches of true."""
    padded = np.zeros(len(equal) + 2, bool)
    padded[1:-1] = equal
    turns = np.flatnonzero(padded[1:] != padded[:-1])
    return turns[::2], turns[1::2]


def _shifted_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal (start, end, q) with q < DIRECT, q the smallest period, and COPIES copies."""
    found, seen = [], set()
    for q in range(1, min(DIRECT, len(words))):
        starts, ends = _stretches(words[q:] == words[:-q])
        enough = ends - starts >= (COPIES - 1) * q
        for s, e in zip(starts[enough].tolist(), (ends[enough] + q).tolist(), strict=True):
            if (s, e) not in seen:  # else a smaller period has it
                seen.add((s, e))
                found.append((s, e, q))
    return found


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values: prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, NEVER)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _chosen(names: np.ndarray, tau: int, dense: list[tuple[int, int, int]]) -> np.ndarray:
    """The synchronising set of scale tau. ``names`` has the hash of the tau words at each position."""
    ranks = names.copy()
    for s, e, q in dense:
        if 3 * q <= tau and e - s >= tau:
            ranks[s : e - tau + 1] = NEVER
    if len(ranks) <= tau:
        return np.empty(0, np.int64)
    least = _lowest(ranks, tau + 1)
    inner = len(least)
    return np.flatnonzero((least != NEVER) & ((ranks[:inner] == least) | (ranks[tau:] == least)))


def _proposals(at: np.ndarray, context: np.ndarray, reach: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of neighbouring choices with equal context ``reach`` words long, at distances in [low, high].

    Of proposals with one distance that overlap by a context, which lie in one
    periodic stretch, only the first is kept.
    """
    order = np.argsort(context, kind="stable")
    ahead, here = at[order[1:]], at[order[:-1]]
    far = ahead - here
    fits = (context[order[1:]] == context[order[:-1]]) & (far >= low) & (far <= high)
    here, far = here[fits], far[fits]
    order = np.lexsort((here, far))
    here, far = here[order], far[order]
    first = np.ones(len(here), bool)
    first[1:] = (far[1:] != far[:-1]) | (here[1:] > here[:-1] + reach)
    return here[first], far[first]


def _extended(words: np.ndarray, i: int, q: int, first: int, last: int) -> tuple[int, int]:
    """The maximal stretch of period q around words i .. i + q, between words first and last (exclusive)."""
    end, step = i, 64
    while end + q < last:
        here = words[end : min(end + step, last - q)]
        same = here == words[end + q : end + q + len(here)]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = end + len(here), 2 * step
    start, step = i, 64
    while start > first:
        here = words[max(start - step, first) : start]
        same = (here == words[start - len(here) + q : start + q])[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, step = start - len(here), 2 * step
    return start, end + q


def runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Per text of word numbers: its runs as (start, length, period), by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = [k for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])) if len(texts[k]) >= LEAST]
    if not order:
        return out
    lengths = np.array([len(texts[k]) for k in order])
    first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    words = np.empty(int((lengths + 1).sum()), np.int64)
    for n, (k, at) in enumerate(zip(order, first.tolist(), strict=True)):
        words[at : at + len(texts[k])] = texts[k]
        words[at + len(texts[k])] = -1 - n  # no run crosses it
    dense = _shifted_runs(words)
    names = _mixed(words.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    by_size, size = {1: names}, 1
    while size < DIRECT // 2:
        by_size[2 * size] = _joined(by_size[size][:-size], by_size[size][size:])
        size *= 2
    scale = DIRECT
    while scale * COPIES <= lengths[0]:
        kept = int(np.searchsorted(-lengths, -scale * COPIES, side="right"))
        upto = int(first[kept - 1] + lengths[kept - 1] + 1)
        half, tau = scale // 2, scale // 2
        by_half = by_size[half][: max(upto - half + 1, 0)]
        by_scale = _joined(by_half[:-half], by_half[half:])
        at = _chosen(by_half, tau, dense)
        found = set()
        for reach, low, high in ((3 * half, scale, 3 * half), (4 * half, 3 * half + 1, 2 * scale - 1)):
            own = at[at + reach <= upto]
            context = _joined(by_scale[own], by_half[own + scale] if reach == 3 * half else by_scale[own + scale])
            for i, q in zip(*(x.tolist() for x in _proposals(own, context, reach, low, high)), strict=True):
                k = int(np.searchsorted(first, i, side="right")) - 1
                s, e = _extended(words, i, q, int(first[k]), int(first[k] + lengths[k]))
                if e - s >= COPIES * q:
                    found.add((s, e, q))
        dense += sorted(found)
        by_size[scale], scale = by_scale, 2 * scale
    for s, e, q in sorted(dense, key=lambda r: (r[0], r[2])):
        if e - s >= max(LEAST, COPIES * q):
            k = int(np.searchsorted(first, s, side="right")) - 1
            out[order[k]].append((s - int(first[k]), e - s, q))
    return out


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document whose id asks for a periodic rest, made periodic; others as they are."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _told(doc_id: int | None, words: list[bytes], own: list[tuple[int, int, int]]) -> tuple:
    best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    if own:
        keep = np.ones(len(words), bool)
        for start, length, q in own:
            keep[start + q : start + length] = False
        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(own), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def _layouts(texts: Iterator[tuple[int | None, list[bytes]]]) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    held, size = [], 0
    for doc_id, words in texts:
        if held and size + len(words) > WORDS_AT_ONCE:
            yield held
            held, size = [], 0
        held.append((doc_id, words))
        size += len(words)
    if held:
        yield held


def periodic_runs(docs: DataFrame, plant: bool = False, min_tasks: int = 0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its runs, told by number, best run and digests.

    Words are maximal sequences without ASCII white space. Null and empty texts
    have no word, so no run, and the digests of empty strings. Texts are read
    whole whatever their length; repeated rows get a row each. With ``plant``
    some texts are made periodic first, by their id (a null id: never). Extra
    columns are ignored.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SCHEMA.split(", ")])
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            split = (((texts[k].as_py() or "").encode().split()) for k in range(len(ids)))
            given = ((i, planted(w, i) if plant else w) for i, w in zip(ids, split, strict=True))
            for group in _layouts(given):
                number: dict[bytes, int] = {}
                numbers = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for _, words in group]
                rows = [_told(i, words, own) for (i, words), own in zip(group, runs(numbers), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return parallel(narrow(docs, "doc_id", "text"), min_tasks).mapInArrow(search, SCHEMA)
