"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is a sequence of words; a long word enters as its overlapping slices
and as its parts between marks. Each word enters as a learned word vector
(hashed words) beside the mean of learned vectors of its runs of three and six
characters, and with how much more often training texts of label 1 hold the
word or its most telling run. Two gated
recurrent passes, one each way, read a window of words; attention pools their
states to one logit. Every text is scored on all its overlapping windows and
takes the highest. Everything is trained here, in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import parallel, seed
from .quality_model import labelled

WINDOW, STRIDE = 48, 32
WORD_SLOTS, GRAM_SLOTS = 1 << 18, 1 << 17
WORD_SIZE, GRAM_SIZE, STATE = 6, 8, 8
#: Words whose inputs a worker keeps; beyond it the memory is emptied, results stay the same.
WORD_CACHE = 400_000
#: Longer words are sliced; what is no longer than the overlap is whole in a slice.
LONGEST, OVERLAP = 40, 12
TRIM = "\"'.,;:!?()[]{}<>|#$%&*+-/\\=@^_`~«»„“”‘’…"


JOINS = re.compile(f"[{re.escape(TRIM)}]+")


def slices(word: str) -> list[str]:
    """Overlapping slices that cover a long word, then its parts between marks that are short enough to be words."""
    if len(word) <= LONGEST:
        return [word]
    parts = JOINS.split(word)
    cut = [word[s:s + LONGEST] for s in range(0, len(word) - OVERLAP, LONGEST - OVERLAP)]
    return cut + [p for p in parts if p and len(p) <= LONGEST]


def words_of(text: str | None) -> list[str]:
    """White-space words of a text, lower case, without marks at their ends, long ones in slices; a word repeated at once counts once."""
    words = [w.strip(TRIM) for w in text.lower().split()] if text else []
    if any(len(w) > LONGEST for w in words):
        words = [s for w in words for s in slices(w)]
    return words[:1] + [w for w, before in zip(words[1:], words) if w != before]


def _slot(data: str, size: int) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(data.encode("utf-8", "surrogatepass")) % size


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slots, and the slots of all words' character runs with the word each belongs to."""
    slots = np.fromiter((_slot(w, WORD_SLOTS) for w in words), np.int64, len(words))
    grams, owner = [], []
    for i, w in enumerate(words):
        p = f"<{w}>"  # a bag of runs; the word slot has the whole word
        own = [p[k:k + 3] for k in range(max(1, len(p) - 2))] + [p[k:k + 6] for k in range(len(p) - 5)]
        grams.extend(own)
        owner.extend([i] * len(own))
    known = {g: _slot(g, GRAM_SLOTS) for g in set(grams)}
    return slots, np.fromiter(map(known.__getitem__, grams), np.int64, len(grams)), np.array(owner, np.int64)


def leans(features: tuple, lean: np.ndarray, gram_lean: np.ndarray) -> np.ndarray:
    """Of each word: its own lean or that of its most telling run, whichever is more."""
    slots, grams, owner = features
    starts = np.searchsorted(owner, np.arange(len(slots)))
    return np.maximum(lean[slots], np.maximum.reduceat(gram_lean[grams], starts)) if len(slots) else np.zeros(0, np.float32)


def _lean(counts: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """How far the share of texts of label 1 exceeds that of label 0, in deviations beyond what chance explains, -2 to 2."""
    share = np.minimum((counts.sum(0) + 1) / (n0 + n1 + 2), 0.99)
    z = (counts[1] / n1 - counts[0] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return np.clip(np.sign(z) * np.maximum(np.abs(z) - 4, 0), -4, 4) / 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters and the passes through them; arrays are float32."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, lean: np.ndarray, gram_lean: np.ndarray) -> Network:
        """Small random weights, but for one unit each way that starts by following the lean, and attention by looking at it."""
        rng = np.random.default_rng(seed("toxicity"))
        size = WORD_SIZE + GRAM_SIZE + 1
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        p = {"words": draw(WORD_SLOTS, WORD_SIZE, scale=0.05), "grams": draw(GRAM_SLOTS, GRAM_SIZE, scale=0.1), "lean": lean.astype(np.float32), "gram_lean": gram_lean.astype(np.float32)}
        for way in "fb":
            p |= {f"in_{way}": draw(size, 3 * STATE, scale=size**-0.5), f"bias_{way}": np.zeros(3 * STATE, np.float32), f"on_{way}": draw(STATE, 3 * STATE, scale=STATE**-0.5)}
            p[f"in_{way}"][-1, [0, 2 * STATE]] = 0.0, 1.5
            p[f"bias_{way}"][[0, 2 * STATE]] = -1.0, -1.0
        p |= {"look": draw(2 * STATE, scale=0.3), "out": draw(2 * STATE, scale=0.3), "base": np.full(1, -1.0, np.float32)}
        p["look"][[0, STATE]], p["out"][[0, STATE]] = 3.0, 2.0
        return cls(p)

    def inputs(self, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        slots, grams, owner = features
        n = np.maximum(np.bincount(owner, minlength=len(slots)), 1)[:, None]
        starts = np.searchsorted(owner, np.arange(len(slots)))
        sums = np.add.reduceat(self.p["grams"][grams], starts, axis=0) if len(slots) else np.zeros((0, GRAM_SIZE), np.float32)
        return np.concatenate([self.p["words"][slots], sums / n, leans(features, self.p["lean"], self.p["gram_lean"])[:, None]], 1).astype(np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Inputs of both passes to all gates, one row per word; the last row stands for padding."""
        rows = np.concatenate([x @ self.p[f"in_{w}"] + self.p[f"bias_{w}"] for w in "fb"], 1)
        return np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])

    def states(self, table: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(time, windows, 2 * STATE) states; ``keep`` collects what the way back needs."""
        n, steps = ids.shape
        out = np.zeros((steps, n, 2 * STATE), np.float32)
        for k, way in enumerate("fb"):
            on, h = self.p[f"on_{way}"], np.zeros((n, STATE), np.float32)
            own = np.ascontiguousarray(table[:, 3 * STATE * k:3 * STATE * (k + 1)])
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                x, r = own[ids[:, t]], h @ on
                gates = _sigmoid(x[:, :2 * STATE] + r[:, :2 * STATE])
                z, reset = gates[:, :STATE], gates[:, STATE:]
                new = np.tanh(x[:, 2 * STATE:] + reset * r[:, 2 * STATE:])
                before, h = h, (new + z * (h - new)) * mask[:, t, None]
                out[t, :, STATE * k:STATE * (k + 1)] = h
                if keep is not None:
                    keep.append((k, t, z, reset, new, r[:, 2 * STATE:], before))
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, attention, pooled states)."""
        look = np.where(mask.T > 0, states @ self.p["look"], -1e9)
        share = np.exp(look - look.max(0))
        share /= share.sum(0)
        pooled = np.einsum("tn,tnd->nd", share, states)
        return pooled @ self.p["out"] + self.p["base"][0], share, pooled

    def logits(self, table: np.ndarray, ids: np.ndarray, mask: np.ndarray, at_once: int = 4096) -> np.ndarray:
        parts = [self.pool(self.states(table, ids[i:i + at_once], mask[i:i + at_once]), mask[i:i + at_once])[0] for i in range(0, len(ids), at_once)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def gradients(self, features: tuple, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over windows; ``ids`` number the words of ``features``, its length is padding."""
        p, keep = self.p, []
        x = self.inputs(features)
        table = self.projected(x)
        states = self.states(table, ids, mask, keep)
        logit, share, pooled = self.pool(states, mask)
        d = (_sigmoid(logit) - y) / len(y)
        g = {"out": pooled.T @ d, "base": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["out"]
        d_share = np.einsum("tnd,nd->tn", states, d_pooled)
        d_look = share * (d_share - (share * d_share).sum(0))
        g["look"] = np.einsum("tn,tnd->d", d_look, states)
        d_states = share[:, :, None] * d_pooled + d_look[:, :, None] * p["look"]
        d_table = np.zeros_like(table)
        back = {k: np.zeros((len(y), STATE), np.float32) for k in (0, 1)}
        g |= {f"on_{w}": np.zeros_like(p[f"on_{w}"]) for w in "fb"}
        for k, t, z, reset, new, r_new, before in reversed(keep):
            way = "fb"[k]
            dh = (d_states[t, :, STATE * k:STATE * (k + 1)] + back[k]) * mask[:, t, None]
            d_new = dh * (1 - z) * (1 - new**2)
            d_z = dh * (before - new) * z * (1 - z)
            d_reset = d_new * r_new * reset * (1 - reset)
            d_in = np.concatenate([d_z, d_reset, d_new], 1)
            d_r = np.concatenate([d_z, d_reset, d_new * reset], 1)
            g[f"on_{way}"] += before.T @ d_r
            np.add.at(d_table[:, 3 * STATE * k:3 * STATE * (k + 1)], ids[:, t], d_in)
            back[k] = dh * z + d_r @ p[f"on_{way}"].T
        d_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            own = d_table[:-1, 3 * STATE * k:3 * STATE * (k + 1)]
            g[f"in_{way}"], g[f"bias_{way}"] = x.T @ own, own.sum(0)
            d_x += own @ p[f"in_{way}"].T
        slots, grams, owner = features
        n = np.maximum(np.bincount(owner, minlength=len(slots)), 1)
        # of the large tables only the rows in use
        for name, used, rows in (("words", slots, d_x[:, :WORD_SIZE]), ("grams", grams, (d_x[:, WORD_SIZE:WORD_SIZE + GRAM_SIZE] / n[:, None])[owner])):
            g[f"{name}_rows"], at = np.unique(used, return_inverse=True)
            g[name] = np.zeros((len(g[f"{name}_rows"]), rows.shape[1]), rows.dtype)
            np.add.at(g[name], at, rows)
        return g


def windows(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first word, number of words) of the windows that cover texts of these sizes."""
    owner, first, length = [], [], []
    for i, n in enumerate(sizes):
        for s in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE) if n else ():
            owner.append(i)
            first.append(s)
            length.append(min(WINDOW, n - s))
    return np.array(owner, np.int64), np.array(first, np.int64), np.array(length, np.int64)


def _lay_out(ids: np.ndarray, starts: np.ndarray, length: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and mask of the windows, (windows, WINDOW)."""
    at = np.arange(WINDOW)
    mask = at < length[:, None]
    grid = np.where(mask, ids[np.minimum(starts[:, None] + at, len(ids) - 1)] if len(ids) else 0, pad)
    return grid, mask.astype(np.float32)


def train(texts: list[str], y: np.ndarray, rounds: int = 12, least_steps: int = 500, rate: float = 0.01, penalty: float = 1e-4) -> dict[str, np.ndarray] | None:
    """Parameters learned from texts and labels, or None without both labels.

    A text of label 1 teaches by the window the network rates highest, one of
    label 0 by that and one other; both are chosen anew each round.
    """
    keep = [i for i, t in enumerate(texts) if t and t.split()]
    texts, y = [texts[i] for i in keep], np.asarray(y, np.float32)[keep]
    if not 0 < y.sum() < len(y):
        return None
    split = [words_of(t) for t in texts]
    words = sorted({w for ws in split for w in ws})
    number = {w: i for i, w in enumerate(words)}
    features = word_features(words)
    n1, n0 = y.sum(), len(y) - y.sum()
    counts, gram_counts = np.zeros((2, WORD_SLOTS)), np.zeros((2, GRAM_SLOTS))
    edges = np.searchsorted(features[2], np.arange(len(words) + 1))
    for ws, label in zip(split, y.astype(int)):
        own = [number[w] for w in set(ws)]
        counts[label, np.unique(features[0][own])] += 1
        gram_counts[label, np.unique(np.concatenate([features[1][edges[k]:edges[k + 1]] for k in own]))] += 1
    net = Network.fresh(_lean(counts, n0, n1), _lean(gram_counts, n0, n1))
    sizes = [len(ws) for ws in split]
    ids = np.fromiter((number[w] for ws in split for w in ws), np.int64, sum(sizes))
    owner, first, length = windows(sizes)
    starts = (np.cumsum(sizes) - sizes)[owner] + first
    grid, mask = _lay_out(ids, starts, length, len(words))
    rng = np.random.default_rng(seed("rounds"))
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items() if not k.endswith("lean")} for _ in range(2))
    step = 0
    bounds = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    ends = np.append(bounds[1:], len(owner))
    heaviest = np.append(leans(features, net.p["lean"], net.p["gram_lean"]), -9.0)[grid].max(1)
    turns = max(rounds, -(-least_steps * 64 // (2 * len(bounds))))
    for turn in range(turns):
        # at first a window is rated by its most telling word
        logit = net.logits(net.projected(net.inputs(features)), grid, mask) if turn else heaviest
        top = np.array([s + int(logit[s:e].argmax()) for s, e in zip(bounds, ends)])
        other = bounds + (rng.random(len(bounds)) * (ends - bounds)).astype(np.int64)
        chosen = np.concatenate([top, other[(y == 0) & (other != top)]])
        chosen = rng.permutation(np.concatenate([chosen, np.repeat(top[y == 1], max(0, min(3, int(n0 / n1) // 3)))]))
        now = rate * (1 - turn / turns)
        for i in range(0, len(chosen), 64):
            some = chosen[i:i + 64]
            used, local = np.unique(np.append(grid[some].ravel(), len(words)), return_inverse=True)
            used = used[:-1]
            near = local[:-1].reshape(len(some), WINDOW)
            grad = net.gradients(_part(features, used), near, mask[some], y[owner[some]])
            step += 1
            rows_of = {k: grad.pop(f"{k}_rows") for k in ("words", "grams")}
            for k, g in grad.items():
                rows = rows_of.get(k, slice(None))
                g = g + penalty * net.p[k] if k not in ("words", "grams", "base") else g
                mean[k][rows] += 0.1 * (g - mean[k][rows])
                square[k][rows] += 0.01 * (g * g - square[k][rows])
                net.p[k][rows] -= (now * (mean[k][rows] / (1 - 0.9**step)) / (np.sqrt(square[k][rows] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net.p


def _part(features: tuple, used: np.ndarray) -> tuple:
    """The features of some words, numbered in their order."""
    slots, grams, owner = features
    s, e = np.searchsorted(owner, used), np.searchsorted(owner, used, side="right")
    spots = np.concatenate([np.arange(a, b) for a, b in zip(s, e)]) if len(used) else np.zeros(0, np.int64)
    return slots[used], grams[spots], np.repeat(np.arange(len(used)), e - s)


class Scorer:
    """Scores texts; what the network needs of a word is kept between batches."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.net = Network(params)
        self.known: dict[str, int] = {}
        self.table = np.zeros((1, 6 * STATE), np.float32)  # the first row is padding
        self.blank = float(_sigmoid(params["base"].astype(float))[0])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.known) > WORD_CACHE:
            self.known, self.table = {}, self.table[:1]
        new = list({w for ws in split for w in ws if w not in self.known})
        if new:
            self.known.update(zip(new, range(len(self.known) + 1, len(self.known) + 1 + len(new))))
            self.table = np.concatenate([self.table, self.net.projected(self.net.inputs(word_features(new)))[:-1]])
        sizes = [len(ws) for ws in split]
        ids = np.fromiter((self.known[w] for ws in split for w in ws), np.int64, sum(sizes))
        owner, first, length = windows(sizes)
        best = np.full(len(texts), -np.inf)
        before = np.cumsum(sizes) - sizes
        for i in range(0, len(owner), 4096):
            own = owner[i:i + 4096]
            grid, mask = _lay_out(ids, before[own] + first[i:i + 4096], length[i:i + 4096], 0)
            np.maximum.at(best, own, self.net.logits(self.table, grid, mask))
        return np.where(np.isfinite(best), _sigmoid(best), self.blank)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = 3_000, fit_chars: int = 20_000) -> dict[str, np.ndarray] | None:
    """Parameters from at most ``fit_rows`` labelled texts of at most ``fit_chars`` characters.

    ``labels`` holds only rows that may be learned from. The bounds are on what
    is learned from; every text is scored whole. None without both labels.
    """
    sample = F.broadcast(labelled(labels, label, fit_rows))  # at most fit_rows pairs of numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where(F.length("text") <= fit_chars)
    rows = rows.join(sample, "doc_id").groupBy("doc_id").agg(F.first("text").alias("text"), F.first("y").alias("y")).toArrow().sort_by("doc_id")
    return train(rows.column("text").to_pylist(), np.array(rows.column("y").to_pylist(), float)) if rows.num_rows else None


def predict(docs: DataFrame, params: dict[str, np.ndarray] | None, limit: float = 0.3, min_tasks: int = 1) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1) and predicted (score >= limit), from the text alone.

    Null, empty and blank texts take the network's base rate; without
    parameters every score is 0. Columns named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")
    params = docs.sparkSession.sparkContext.broadcast(params)  # fixed size, see WORD_SLOTS and GRAM_SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(params.value) if params.value else None
        for batch in batches:
            parts = [np.zeros(0)]
            for i in range(0, batch.num_rows, 256):
                texts = batch.column(at)[i:i + 256].to_pylist()
                parts.append(scorer(texts) if scorer else np.zeros(len(texts)))
            score = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= limit).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return parallel(docs, min_tasks).mapInArrow(run, schema)
