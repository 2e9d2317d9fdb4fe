import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from jobweave.llm import runs

from .helpers import DOCS, WORD, edge_rows, table


def brute_runs(words):
    """Every maximal run of smallest period by comparing the words with themselves at all distances."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    own = brute_runs(words)
    best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    dropped = {i for s, n, q in own for i in range(s + q, s + n)}
    lines, kept = "".join(f"{s},{n},{q}\n" for s, n, q in own), " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(own), *best, 1000 * best[1] // best[2] if own else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def made(rng):
    """Random words over a few letters, with periodic stretches, nested periods and long blocks of one word."""
    letters, text = rng.choice([2, 2, 3, 50]), []
    for _ in range(rng.randrange(1, 8)):
        if rng.random() < 0.4:
            text += [rng.randrange(letters) for _ in range(rng.randrange(60))]
            continue
        p = rng.randrange(1, 70)
        root = [rng.randrange(letters) for _ in range(p)]
        if rng.random() < 0.3:
            root = [0] * (p - 1) + [1]
        elif rng.random() < 0.3:
            root = (root[: rng.randrange(1, p // 3 + 2)] * p)[: p - 1] + [77]
        text += (root * 9)[: int(p * rng.uniform(2.5, 5))]
    return (text * rng.choice([1, 1, 1, 3]))[:900]


@pytest.mark.parametrize("seed", range(12))
def test_against_all_distances(seed):
    rng = random.Random(seed)
    texts = [made(rng) for _ in range(12)]
    assert runs.runs([np.array(t, np.int64) for t in texts]) == [brute_runs(t) for t in texts]


def test_large_periods():
    rng = random.Random(3)
    for p in (300, 511, 512, 513, 768, 1000):
        root = [rng.randrange(10**6) for _ in range(p)]
        text = [-5, *(root * 4)[: 3 * p], -6, *range(10**7, 10**7 + 50)]
        assert runs.runs([np.array(text) + 10])[0] == [(1, 3 * p, p)]
        assert runs.runs([np.array(text[:3 * p]) + 10])[0] == []  # one word short of three copies


def test_rows(spark):
    long = " ".join(f"w{i % 7}" for i in range(9000)) + " " + " ".join(f"v{i % 2000}" for i in range(7000))
    rows = edge_rows() + [(i + 1000, t, "en", "s", 1) for i, t in enumerate(table("documents").text.tolist())]
    rows += [(5000 + i, "x y z " * n, "en", "s", 1) for i, n in enumerate((7, 8, 9, 400))] + [(6000, long, None, None, None)]
    got = runs.periodic_runs(spark.createDataFrame(rows, DOCS), plant=True, min_tasks=3).collect()
    slow = [r for r in rows if r[0] != 6000]
    assert sorted((tuple(r) for r in got if r.doc_id != 6000), key=repr) == sorted((brute(r[0], r[1]) for r in slow), key=repr)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in slow) > 10
    big = next(r for r in got if r.doc_id == 6000)
    assert (big.n_runs, big.start, big.length, big.period, big.exponent_milli) == (2, 0, 9000, 7, 9000 * 1000 // 7)
