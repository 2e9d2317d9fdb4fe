import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobweave.llm import packing

from .helpers import edge_rows, table

PATH = public_tokenizers.path("word_bpe_49k.json")
CASES = {
    "spread": lambda r: [min(4096, 1 + int(r.expovariate(1 / 900))) for _ in range(3000)],
    "large": lambda r: [r.randint(1400, 4096) for _ in range(2000)],
    "hot": lambda r: [300] * 3000 + [r.randint(1, 4096) for _ in range(2000)],
    "ones": lambda r: [1] * 9000 + [r.randint(1, 4096) for _ in range(100)],
    "pairs": lambda r: [n for a in (r.randint(1, 4095) for _ in range(500)) for n in (a, 4096 - a)],
    "triples": lambda r: [n for a in (r.randint(1, 2000) for _ in range(300)) for n in (a, 2050 - a, 2046)],
    "quadruples": lambda r: [n for a, b, c in ((r.randint(1, 900), r.randint(1, 900), r.randint(1, 900)) for _ in range(300)) for n in (a, b, c, 4096 - a - b - c)],
    "one": lambda r: [5], "none": lambda r: [],
}


@pytest.mark.parametrize("case", list(CASES))
def test_plan(case):
    lengths = CASES[case](random.Random(4))
    plan, used = packing.plan_sequences(Counter(lengths)), Counter()
    for combination, times in plan:
        assert times > 0 and sum(combination) <= 4096
        for n in combination:
            used[n] += times
    assert used == Counter(lengths)
    sequences, bound = sum(t for _, t in plan), -(-sum(lengths) // 4096)
    if case != "hot":  # no two pieces of more than half a sequence fit together
        assert sequences <= max(bound, sum(n > 2048 for n in lengths)) + 4
    if case in ("spread", "pairs", "triples"):
        assert sequences == bound


def test_ids_over_all_of_unicode():
    """Every character before, between and behind letters and marks, in whole texts, against the tokenizer."""
    rng, encode, known = random.Random(9), Tokenizer.from_file(PATH), packing.WordIds(PATH)
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [c + m for c in every for m in (".",)] + [f"a{c} {c}b%" for c in rng.sample(every, 20000)]
    texts += ["".join(rng.choices(["İ", "क़", "ड़", "שּ", "é", "e\u0301", "A", "ß", "'s", "'", ".", "%", "ǅ", "Σ", "ﬁ", "1", "½", "x"], k=rng.randrange(1, 9))) for _ in range(6000)]
    bad = []
    for at in range(0, len(texts), 4096):
        some = texts[at:at + 4096]
        known.learn({w for t in some for w in t.encode().split()})
        for t, e in zip(some, encode.encode_batch_fast(some, add_special_tokens=False), strict=True):
            if b"".join(map(known.__getitem__, t.encode().split())) != np.array(e.ids, "<u4").tobytes():
                bad.append(t)
    assert bad == []


def test_round_trip(spark):
    rows = [r[:2] for r in edge_rows()] + [(i + 1000, t) for i, t in enumerate(table("documents").text.tolist())] + [(9000, "<|endoftext|> it's A.B, é! ½ ²x"), (9001, "wordword " * 9000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, min_tasks=3).toPandas()
    encode, want = Tokenizer.from_file(PATH), Counter()
    for doc_id, text in rows:
        ids = encode.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            own = np.array(ids[k:k + 4096], "<u4")
            want[(doc_id, k // 4096, k, len(own), zlib.crc32(own.tobytes()))] += 1
    got["doc_id"] = got.doc_id.astype(object).where(got.doc_id.notna(), None)
    assert Counter((None if r.doc_id is None else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, own in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert own.length.sum() <= 4096 and (own.offset == own.length.cumsum() - own.length).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1
