"""Sums over the words that a posting and a profile have in common.

A tally adds up, over a posting's list of word numbers, the weights these words
have for a profile. All profiles of a block are met at once: an Arrow function
turns a batch of postings into a matrix of words and multiplies it with each
profile's few words. The results ride along with the posting, one array a
tally, so pairs carry numbers only, and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from .wordsearch import arrow_udf

C = F.col
#: Profiles that meet a posting in one row, and as many as are met this way at all.
BLOCK, PROFILES = 256, 4096
#: Postings in one matrix of words.
ROWS = 512


@dataclass(frozen=True)
class Part:
    """The words of a profile's column ``own`` weigh ``weight`` each where a posting's column ``listed`` has them."""

    own: str
    listed: str
    weight: int


class _Side:
    """The words of a block of profiles that count for one posting column."""

    def __init__(self, people: list[Row], parts: list[Part]):
        weights = [{} for _ in people]
        for person, own in zip(people, weights):
            for part in parts:
                for n in set(person[part.own]):
                    own[n] = own.get(n, 0) + part.weight
        self.words = np.array(sorted({n for own in weights for n in own}), np.int64)
        most = max((sum(map(abs, own.values())) for own in weights), default=0)
        kind = np.float32 if most < 1 << 24 else np.float64  # sums of whole numbers stay exact
        self.people = [(np.searchsorted(self.words, list(own)), np.array(list(own.values()), kind)) for own in weights]
        self.kind = kind

    def add(self, lists: pa.Array, out: np.ndarray) -> None:
        """Adds the sums of ``lists``, one row each, to ``out``, one column a profile."""
        if not len(self.words):
            return
        lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        values = lists.flatten().to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(self.words, values), len(self.words) - 1)
        known = self.words[place] == values
        row = np.repeat(np.arange(len(lists)), lengths)
        for at in range(0, len(lists), ROWS):
            some = slice(ends[at], ends[min(at + ROWS, len(lists))])
            n = min(ROWS, len(lists) - at)
            held = np.zeros((len(self.words), n), self.kind)
            held[place[some][known[some]], row[some][known[some]] - at] = 1
            met = held.any(1)
            for k, (words, weight) in enumerate(self.people):
                mine = met[words]
                if mine.any():
                    out[at:at + n, k] += (weight[mine] @ held[words[mine]]).astype(np.int64)


def _blocks(people: list[Row]) -> list[list[Row]]:
    return [people[i:i + BLOCK] for i in range(0, len(people), BLOCK)]


def _listed(block: pa.Array, sizes: list[int], fill) -> pa.Array:
    """Per row the list that ``fill`` gives for it and all profiles of its block."""
    number = block.to_numpy(zero_copy_only=False)
    lengths = np.array(sizes, np.int64)[number]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    out = None
    for b in np.unique(number):
        rows = np.flatnonzero(number == b)
        values = fill(int(b), rows)
        if out is None:
            out = np.zeros(ends[-1], values.dtype)
        out[(ends[rows][:, None] + np.arange(sizes[b])).ravel()] = values.ravel()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out if out is not None else np.zeros(0, np.int64)))


def tally(people: list[Row], parts: list[Part], block: Column) -> Column:
    """An array of sums, one a profile of the row's block."""
    listed = list(dict.fromkeys(p.listed for p in parts))
    sides = [[_Side(some, [p for p in parts if p.listed == c]) for c in listed] for some in _blocks(people)]
    sizes = [len(some) for some in _blocks(people)]

    def sums(number: pa.Array, *lists: pa.Array) -> pa.Array:
        def fill(b: int, rows: np.ndarray) -> np.ndarray:
            out = np.zeros((len(rows), sizes[b]), np.int64)
            for side, column in zip(sides[b], lists):
                side.add(column.take(pa.array(rows)) if len(rows) < len(column) else column, out)
            return out

        return _listed(number, sizes, fill)

    return arrow_udf(sums, "array<bigint>")(block, *[C(c) for c in listed])


def places(people: list[Row], block: Column) -> Column:
    """An array of whether the posting's location names one of the places a profile wants, one a profile of the row's block."""
    wanted = [[[t for t in person["target_locations"] or [] if t is not None] for person in some] for some in _blocks(people)]
    sizes = [len(some) for some in _blocks(people)]

    def here(number: pa.Array, location: pa.Array) -> pa.Array:
        names = location.to_pylist()

        def fill(b: int, rows: np.ndarray) -> np.ndarray:
            seen: dict[str, np.ndarray] = {}
            out = np.zeros((len(rows), sizes[b]), bool)
            for k, i in enumerate(rows.tolist()):
                name = names[i] or ""
                if name not in seen:
                    seen[name] = np.array([any(t in name for t in own) for own in wanted[b]], bool)
                out[k] = seen[name]
            return out

        return _listed(number, sizes, fill)

    return arrow_udf(here, "array<boolean>")(block, C("location"))


def met(postings: DataFrame, profiles: DataFrame, tallies: dict[str, list[Part]], reach: bool = False) -> DataFrame | None:
    """Pairs with a column a tally of ``tallies``, and ``here``; None for more than ``PROFILES`` profiles.

    ``profiles`` is a stored table numbered by ``slot``. With ``reach``, only
    pairs where one of the posting's domains (``j_top``) is one that the profile reaches (``p_reach``).
    Columns that nothing reads are not computed.
    """
    arrays = sorted({p.own for parts in tallies.values() for p in parts})
    people = profiles.select("slot", "target_locations", "p_reach", *arrays).orderBy("slot").limit(PROFILES + 1).collect()
    if len(people) > PROFILES or [p["slot"] for p in people] != list(range(len(people))):
        return None
    numbers = range(max(1, -(-len(people) // BLOCK)))
    blocked = postings.withColumn("__block", F.explode(F.lit(list(numbers)))) if len(numbers) > 1 else postings.withColumn("__block", F.lit(0))
    found = {f"__{name}": tally(people, parts, C("__block")) for name, parts in tallies.items()} | {"__here": places(people, C("__block"))}

    def slots(chosen) -> list[list[int]]:
        return [[p["slot"] - b * BLOCK for p in some if chosen(p)] for b, some in enumerate(_blocks(people) or [[]])]

    if reach:
        domains = range(max((d for p in people for d in p["p_reach"] or []), default=-1) + 1)
        listed = _table([slots(lambda p, d=d: d in (p["p_reach"] or [])) for d in domains])
        at = F.array_distinct(F.flatten(F.transform("j_top", lambda d: F.coalesce(F.get(F.get(listed, d), C("__block")), F.array().cast("array<int>")))))
    else:
        at = F.get(_table(slots(lambda p: True)), C("__block"))
    rows = blocked.withColumns(found).withColumn("__at", F.explode(at))
    values = {name: F.get(f"__{name}", C("__at")) for name in [*tallies, "here"]}
    named = rows.withColumns(values | {"slot": (C("__at") + C("__block") * BLOCK).cast("int")})
    return named.drop("__at", "__block", *found).join(profiles, "slot").drop("slot")


def _table(lists: list) -> Column:
    """A nested list of numbers as a literal that may be empty."""
    import json

    depth = 3 if lists and lists[0] and isinstance(lists[0][0], list) else 2
    return F.from_json(F.lit(json.dumps(lists)), "array<" * depth + "int" + ">" * depth)


def counted(pairs: DataFrame, name: str, otherwise: Column) -> Column:
    """A tally that pairs come with, or the same by intersecting word lists."""
    return C(name) if name in pairs.columns else otherwise
