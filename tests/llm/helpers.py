"""Small tables and plain restatements shared by the tests."""

import random
import re

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

EDGE_TEXTS = [
    None, "", " \t\n", "one", "One", "two words", "a b c d e", "a b c d e f", "same same same same same same same same same same same same",
    "# * $ % & | < >", "line one\nline one\n\nline two\n \nline one", "é" * 30, "word " * 3000, "x" * 5000, "A B c", "日本語 テキスト", "1 2 3 !!", "\x0bv\x0cf\rr",
    "Eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf", "the quick brown fox jumps over the lazy dog and runs to the hills for it is late",
]


def table(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pandas()


def edge_rows():
    """Documents with nulls in every column, ties, repeated rows, empty and long texts."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(EDGE_TEXTS)]
    return [*rows, rows[5], rows[5], (None, "no id at all here", "en", "s0", None), (100, "a b c d e f", "en", "s1", 11)]


def near_copies(n, seed=1, words=60, edits=4):
    """Copies of one text, each with a few words replaced, among unrelated texts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    texts = []
    for _ in range(n):
        own = base[:]
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    return texts + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n // 4)]


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def near_groups(rows, k, percent=80):
    """{doc_id: smallest reachable doc_id} by comparing every pair."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}
