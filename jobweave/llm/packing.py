"""Best-fit packing of tokenised documents by exact-complement hashing.

Documents become token pieces of at most ``capacity`` tokens. What the packing
decides on is the histogram of piece lengths (at most ``capacity`` counts,
whatever the input holds): the planner indexes the sums of single, pair and
triple lengths, takes the combination that fills the gap of the longest open
length exactly, as often as its lengths last, and packs the rest by best fit.
The plan is a bounded list of (combination, how often). Pieces then find their
place by their rank within their length, so that no task ever holds one length
whole, even if a third of all pieces share it.
"""

from __future__ import annotations

import bisect
import struct
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import parallel, stage

CAPACITY = 4096
END_ID = 1
#: Words whose token ids a worker keeps; beyond it the memory is emptied, results stay the same.
WORD_CACHE = 600_000
#: Texts cut into words together.
TEXTS_AT_ONCE = 1024

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()),
    T.StructField("rank", T.LongType()),
])

PLAN = T.StructType([
    T.StructField("length", T.LongType()), T.StructField("from_rank", T.LongType()), T.StructField("to_rank", T.LongType()),
    T.StructField("first_sequence", T.LongType()), T.StructField("offset", T.LongType()),
])


# --- tokens -----------------------------------------------------------------

class WordIds(dict):
    """White-space words (UTF-8) to the bytes of their token ids (little-endian unsigned 32-bit).

    Tokens of this kind of vocabulary never span white space, and a run of
    letters and the ASCII marks after it are cut apart; so a word of letters and
    trailing marks has the ids of its letters, then those of its marks. That
    holds for letters that the tokenizer's normalisation leaves as they are (or
    only lower-cases, in ASCII); such runs go straight to the vocabulary's
    merges. All other words go through the whole tokenizer.
    """

    MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merged = self.tokenizer.model.tokenize
        self.runs: dict[bytes, bytes] = {}  # of letters, and of marks
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = dict(zip([b for b in range(256) if b not in printable], range(256, 512)))

    def _letters(self, run: bytes) -> bytes:
        shown = run.decode("latin-1")
        ids = [t.id for t in self.merged(shown if run.isascii() else shown.translate(self.alphabet))]
        self.runs[run] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, stem: bytes) -> bytes | None:
        """A run of letters as the normalisation leaves it, or None where it does more than lower-case."""
        word = stem.decode()
        small = "".join([c.lower() for c in word])
        return small.encode() if word.isalpha() and small.isalpha() and unicodedata.is_normalized("NFC", word) else None

    def learn(self, words: set[bytes]) -> None:
        """Make sure that all of ``words`` are known."""
        if len(self) > WORD_CACHE:
            self.clear()
            self.runs.clear()
        runs, whole = self.runs, []
        for raw in words.difference(self):
            stem = raw.rstrip(self.MARKS)
            small = stem.lower() if stem.isalpha() else self._plain(stem)  # of bytes: only ASCII letters
            if small is None:
                whole.append(raw)
                continue
            ids = runs.get(small) or self._letters(small)
            if len(stem) < len(raw):
                after = raw[len(stem):]
                if after not in runs:
                    runs[after] = self._whole([after.decode()])[0]
                ids += runs[after]
            self[raw] = ids
        self.update(zip(whole, self._whole([w.decode() for w in whole])))


_WORDS: dict[str, WordIds] = {}  # of this Python worker, by tokenizer file


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, min_tasks: int = 1) -> DataFrame:
    """One row per piece, with its place among the pieces of its length in its task.

    ``docs`` has doc_id and text (null: empty, hence one piece holding only the
    end id); other columns are ignored. Repeated rows are separate documents.
    The result is written to the shared folder once, so ranks never change.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer_path not in _WORDS:
            _WORDS[tokenizer_path] = WordIds(tokenizer_path)
        known = _WORDS[tokenizer_path]
        ranks: Counter = Counter()
        part = TaskContext.get().partitionId()
        closing = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                # bytes.split cuts at the six ASCII blanks
                some = [t.split() if t else [] for t in batch.column(1)[at:at + TEXTS_AT_ONCE].cast(pa.binary()).to_pylist()]
                known.learn(set().union(*some))
                for doc_id, ws in zip(batch.column(0)[at:at + TEXTS_AT_ONCE].to_pylist(), some):
                    ids = b"".join([*map(known.__getitem__, ws), closing])
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start:start + 4 * capacity]
                        n = len(own) // 4
                        out.append((doc_id, k, start // 4, n, zlib.crc32(own), part, ranks[n]))
                        ranks[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=PIECES.names)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return stage(parallel(texts, min_tasks).mapInArrow(run, PIECES), "pieces")


# --- plan -------------------------------------------------------------------

class _Stock:
    """How many pieces of each length are left, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.order = sorted(self.left)

    def take(self, combination: list[int], times: int) -> None:
        for n, k in Counter(combination).items():
            self.left[n] -= k * times
            if not self.left[n]:
                del self.left[n]
                self.order.pop(bisect.bisect_left(self.order, n))

    def times(self, combination: list[int]) -> int:
        """How often the combination can be taken; 0 if it can't."""
        return min(self.left.get(n, 0) // k for n, k in Counter(combination).items())

    def at_most(self, n: int) -> int | None:
        i = bisect.bisect_right(self.order, n)
        return self.order[i - 1] if i else None


class _Sums:
    """Which sums one, two and three of the lengths at hand have.

    A sum of k lengths and one length more make the sums of k + 1. Lengths are
    only ever used up, so an index built earlier knows every sum there is, and
    some that are gone; those fail at the counts.
    """

    DEPTH = 3

    def __init__(self, stock: _Stock, capacity: int):
        one = np.zeros(capacity + 1, bool)
        one[stock.order] = True
        self.sums = [np.zeros(capacity + 1, bool), one]
        self.sums[0][0] = True
        for _ in range(self.DEPTH - 1):
            more = np.zeros(capacity + 1, bool)
            for n in stock.order:
                more[n:] |= self.sums[-1][: capacity + 1 - n]
            self.sums.append(more)

    def filling(self, stock: _Stock, chosen: list[int], gap: int) -> list[int] | None:
        """The fewest lengths, up to one and an indexed triple, that with ``chosen`` fill the gap exactly and are at hand."""
        order = np.array(stock.order)
        for k in range(1, self.DEPTH + 2):
            found = self._fill(stock, order, chosen, gap, k)
            if found:
                return found
        return None

    def _fill(self, stock: _Stock, order: np.ndarray, chosen: list[int], gap: int, k: int) -> list[int] | None:
        if k == 1:
            return [gap] if gap in stock.left and stock.times([*chosen, gap]) else None
        # the longest of the k comes first, so each combination is met once
        own = order[(order <= gap) & (order * k >= gap)]
        for n in own[self.sums[k - 1][gap - own]][::-1].tolist():
            if stock.times([*chosen, n]):
                rest = self._fill(stock, order[order <= n], [*chosen, n], gap - n, k - 1)
                if rest:
                    return [n, *rest]
        return None


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence, how many such sequences)], for counts by length.

    Lengths are 1 to ``capacity``. The longest length opens a sequence. If one
    combination of others fills its gap exactly it is taken as often as the
    counts last; else the longest piece that fits is added (best fit) and the
    rest of the gap is tried again. Work depends on the number of different
    lengths, not on the number of pieces.
    """
    stock, out, built = _Stock(counts), [], 0
    sums = _Sums(stock, capacity)
    while stock.order:
        if built > 64:
            sums, built = _Sums(stock, capacity), 0
        before = len(stock.order)
        head, chosen, gap = stock.order[-1], [stock.order[-1]], capacity - stock.order[-1]
        while gap and stock.order:
            exact = sums.filling(stock, chosen, gap)
            if exact:
                chosen, gap = chosen + exact, 0
                break
            best = stock.at_most(gap)
            while best is not None and not stock.times([*chosen, best]):
                best = stock.at_most(best - 1)
            if best is None:
                break
            chosen.append(best)
            gap -= best
        times = stock.times(chosen)
        stock.take(chosen, times)
        out.append((chosen, times))
        built += before - len(stock.order)
        assert head == chosen[0]
    return out


def plan_rows(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from_rank, to_rank, first_sequence, offset): ranks to places."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], used[n] + times, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return rows


# --- placement ----------------------------------------------------------------

def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its sequence_id and offset.

    The driver gets one count per length (at most ``capacity`` rows) and sends
    back the plan, whose rows are bounded by the lengths, not by the pieces.
    """
    spark = pieces.sparkSession
    by_part = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan_rows(plan_sequences(counts, capacity)), PLAN)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = by_part.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # A task's share of a length overlaps few slots: shares meet slots first, then pieces meet shares.
    shares = shares.join(F.broadcast(slots), "length").where("from_rank < earlier + n and to_rank > earlier")
    shares = shares.groupBy("part", "length", "earlier").agg(F.collect_list(F.struct("from_rank", "to_rank", "first_sequence", "offset")).alias("slots"))
    rank = F.col("rank") + F.col("earlier")
    slot = F.element_at(F.filter("slots", lambda s: (s.from_rank <= rank) & (s.to_rank > rank)), 1)
    return pieces.join(shares, ["part", "length"]).withColumn("slot", slot).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.first_sequence") + rank - F.col("slot.from_rank")).alias("sequence_id"),
        F.col("slot.offset").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, min_tasks: int = 1) -> DataFrame:
    """Tokenise and pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Null and empty texts are documents of the end id alone; an empty table
    gives an empty result; repeated rows are packed once each.
    """
    return place(tokenise(docs, tokenizer_path, capacity, end_id, min_tasks), capacity)
