import hashlib
import math
import random
import re
from collections import Counter

import pytest

from jobweave.llm import imatch

from .helpers import DOCS, edge_rows


def terms(text):
    plain = text.translate(str.maketrans(imatch.UPPER + imatch.MARKS, imatch.LOWER + " " * len(imatch.MARKS)))
    return {w for w in re.split("[\x20\x09-\x0d]+", plain) if w}


def brute(rows, rare, common):
    """Fingerprints by plain sets."""
    docs = sorted(((i is not None, i or 0, hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest(), i, t or "") for i, t in rows), key=lambda d: d[:3])
    texts = [d[4] for d in docs]
    found = Counter(w for t in texts for w in terms(t))
    lexicon = {w for w, n in found.items() if rare * len(texts) < n <= common * len(texts)}

    def depth(term, series):
        draw = int(hashlib.md5(f"{series}:{term}".encode()).hexdigest()[:3], 16)
        return max([k for k in range(1, imatch.DEPTH + 1) if draw < 4096 / 2**k], default=0)

    def fingerprint(text):
        own, out = sorted(terms(text) & lexicon, key=lambda w: w.encode()), []
        for k in range(imatch.FIRST, imatch.DEPTH + 1):
            for s in range(imatch.SERIES):
                kept = [w for w in own if depth(w, s) >= k]
                out.append(hashlib.md5(" ".join(kept).encode()).hexdigest()[:8] if kept else imatch.EMPTY)
        return out

    def near(a, b):
        used = [x == y for x, y in zip(a, b, strict=True) if x != imatch.EMPTY or y != imatch.EMPTY]
        return sum(used) / len(used) if used else 1.0

    prints, out = [fingerprint(t) for t in texts], []
    for k, d in enumerate(docs):
        follows, m = (k + 1) % len(docs), len(d[4]) // 4
        edited = d[4][: len(d[4]) - m] + texts[follows][:m]
        changed = fingerprint(edited)
        out.append((d[3], len(d[4]), hashlib.sha256(edited.encode()).hexdigest(), "".join(prints[k]), "".join(changed), round(near(prints[k], changed), 9), round(near(prints[k], prints[follows]), 9)))
    return sorted(out, key=repr)


def fingerprints(spark, rows, **bounds):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = imatch.compare_with_edited(df.repartition(3), **bounds).collect()
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, got)), key=repr)


def corpus(n=160):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 3) for k in range(400)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 120))) + rng.choice([".", "\n", " Ünd, ʼs"])) for i in range(n)]


@pytest.mark.parametrize(("rare", "common"), [(imatch.RARE, imatch.COMMON), (0.02, 0.5), (0.9, 0.95)])
def test_brute_force(spark, rare, common):
    rows = corpus()
    rows += [(500, rows[3][1]), (501, rows[3][1]), (7, rows[7][1]), (7, rows[7][1]), (7, "other text of the same id"), (None, rows[9][1])]
    assert fingerprints(spark, rows, rare=rare, common=common) == brute(rows, rare, common)


def test_awkward_rows(spark):
    rows = [r[:2] for r in edge_rows()]
    assert fingerprints(spark, rows, rare=0.0, common=1.0) == brute(rows, 0.0, 1.0)
    assert fingerprints(spark, [(1, "alone here")]) == brute([(1, "alone here")], imatch.RARE, imatch.COMMON)


def test_a_long_document_between_short_ones(spark):
    rows = [(0, "a b c"), (1, "x y " * 30000), (2, ""), (3, "b c " * 50), (4, "z " * 9000)]
    assert fingerprints(spark, rows, rare=0.0, common=1.0) == brute(rows, 0.0, 1.0)


def test_equal_texts_and_edits(spark):
    rows = corpus(300)
    rows += [(i + 1000, t) for i, t in rows[:40]]
    got = {r[0]: r for r in fingerprints(spark, rows, rare=0.01, common=0.5)}
    assert all(got[i][3] == got[i + 1000][3] for i in range(40))
    mean = lambda k: math.fsum(r[k] for r in got.values()) / len(got)
    assert mean(5) > 0.2 > 0.1 > mean(6)


def test_native(spark):
    plan = imatch.compare_with_edited(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lexicon_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(imatch, "LEXICON_TERMS", 0)
    rows = corpus(60)
    assert fingerprints(spark, rows, rare=0.02, common=0.5) == brute(rows, 0.02, 0.5)
