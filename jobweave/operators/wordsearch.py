"""Which words of a table occur in which texts, for any number of words.

Up to ``IN_ROW`` words are sought inside the texts' own rows, where neither
texts nor tokens are written or shuffled: ``finder`` looks each distinct token
of a text up among those it has seen. Beyond that words are found by joins.
Texts are cut at spaces. A word without a space occurs in a text exactly if it
occurs inside one of its tokens, and a corpus has far fewer distinct tokens
than characters. So the pieces of the distinct tokens, of the lengths that
words have, are joined with the words by equality; the tokens found are joined
back with the texts that hold them, each with all its words in one row. A text
of several fields shares its fields' tokens with other texts, and tokens are cut
once and written down. A phrase is sought by its longest part, and the texts
found that way are checked for the whole phrase.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage

C = F.col
#: More words than these are met by joins.
IN_ROW = 200_000
#: Tokens a task remembers the words of, and the longest of them.
REMEMBERED, LONGEST = 500_000, 64
#: Texts whose words are marked at once, the marks of words in them, and the bytes of text that are cut into tokens at once.
TEXTS, MARKS, CUT = 128, 1 << 22, 1 << 24
#: Longer tokens are read in overlapping stretches of this many characters.
STRETCH = 256


class Words:
    """Numbered words (without a number, or empty, none), and which of them occur in texts with single spaces."""

    def __init__(self, words: Iterable[tuple[int, str]]):
        self.words = sorted((n, w) for n, w in words if w)
        self.numbers = np.array([n for n, _ in self.words], np.int32)
        self.phrases = [place for place, (_, w) in enumerate(self.words) if " " in w]
        # the places of the words with each part; a phrase is sought by its longest part and has a place of its own behind all words
        self.parts: dict[str, list[int]] = {}
        for place, (_, w) in enumerate(self.words):
            if " " not in w:
                self.parts.setdefault(w, []).append(place)
        for k, place in enumerate(self.phrases, len(self.words)):
            self.parts.setdefault(max(self.words[place][1].split(" "), key=len), []).append(k)
        # parts of one character, and the lengths of all others by their first two, shortest first
        self.letters = {part for part in self.parts if len(part) == 1}
        heads: dict[str, set[int]] = {}
        for part in self.parts.keys() - self.letters:
            heads.setdefault(part[:2], set()).add(len(part))
        self.lengths = {head: sorted(sizes) for head, sizes in heads.items()}
        self.remembered: dict[str, np.ndarray] = {}

    def __reduce__(self):
        return _same, (tuple(self.words),)

    def _in(self, token: str) -> np.ndarray:
        found = self.remembered.get(token)
        if found is None:
            places, n = [p for c in set(token) & self.letters for p in self.parts[c]], len(token)
            for i in range(n - 1):
                for size in self.lengths.get(token[i:i + 2], ()):
                    if i + size > n:
                        break
                    places += self.parts.get(token[i:i + size], ())
            found = np.array(places, np.int64)
            if len(token) <= LONGEST:
                if len(self.remembered) >= REMEMBERED:
                    self.remembered.clear()
                self.remembered[token] = found
        return found

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Where each text's tokens end, the numbers of its tokens, and of each token the start and size of its words in a list of them."""
        lists = pc.split_pattern(texts, " ")
        tokens = lists.flatten().dictionary_encode()
        places = [self._in(t) for t in tokens.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, places), np.int64, len(places))
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        return ends, tokens.indices.to_numpy(), np.cumsum(sizes) - sizes, sizes, np.concatenate([np.zeros(0, np.int64), *places])

    def marks(self, found: tuple[np.ndarray, ...], first: int, last: int) -> np.ndarray:
        """A row of marks for each of some texts: of its words, then of the phrases of which it holds the longest part."""
        ends, token, starts, sizes, places = found
        width = len(self.words) + len(self.phrases)
        marks = np.zeros((last - first) * width, bool)
        token, row = token[ends[first]:ends[last]], np.repeat(np.arange(last - first) * width, np.diff(ends[first:last + 1]))
        size = sizes[token]
        # from each token's place in the list of all tokens' words to those of its words, row by row
        at = np.repeat(starts[token] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        marks[np.repeat(row, size) + places[at]] = True
        return marks.reshape(last - first, width)

    def find(self, fields: list[pa.Array], texts: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text, given by its fields' places: how many words each row has, and their numbers in order."""
        n, out, held = len(self.words), [([], []) for _ in texts], [self.tokens(f) for f in fields]
        step = max(1, min(TEXTS, MARKS // max(1, n)))
        for at in range(0, len(fields[0]), step):
            found = [self.marks(h, at, min(at + step, len(fields[0]))) for h in held]
            for own, (counts, numbers) in zip(texts, out):
                marks = np.logical_or.reduce([found[k] for k in own])
                for i, k in zip(*np.nonzero(marks[:, n:])):
                    text = " ".join(f for f in (fields[j][at + int(i)].as_py() for j in own) if f is not None)
                    marks[i, self.phrases[k]] = self.words[self.phrases[k]][1] in text
                rows, places = np.nonzero(marks[:, :n])
                counts.append(np.bincount(rows, minlength=len(marks)))
                numbers.append(self.numbers[places])
        return [(np.concatenate([np.zeros(0, np.int64), *c]), np.concatenate([np.zeros(0, np.int32), *v])) for c, v in out]


_SEEN: dict[tuple, Words] = {}


def _same(words: tuple) -> Words:
    """One ``Words`` a worker process, so that a task finds the tokens its predecessors met."""
    if words not in _SEEN:
        _SEEN.clear()
        _SEEN[words] = Words(words)
    return _SEEN[words]


def finder(words: Words, fields: dict[str, Column], texts: dict[str, list[str]]) -> Column:
    """A struct of the sorted numbers of the words in each of ``texts``, which are some of ``fields`` side by side."""
    places = [[list(fields).index(f) for f in own] for own in texts.values()]

    def find(*columns: pa.Array) -> pa.Array:
        size = sum(pc.binary_length(c).fill_null(0).to_numpy().astype(np.int64) for c in columns)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // CUT, prepend=0)).tolist()
        found = [words.find([c.slice(a, b - a) for c in columns], places) for a, b in zip([0, *cuts], [*cuts, len(size)])]
        lists = []
        for k in range(len(places)):
            ends = np.cumsum(np.concatenate([[0], *[f[k][0] for f in found]]))
            lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([f[k][1] for f in found]), pa.int32())))
        return pa.StructArray.from_arrays(lists, list(texts))

    kind = "struct<" + ", ".join(f"{t}: array<int>" for t in texts) + ">"
    return arrow_udf(find, kind)(*fields.values())


def arrow_udf(function: Callable, kind: str) -> Column:
    """``function`` of any number of Arrow arrays as a column function."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)  # type hints can't tell of any number of arguments
        return F.arrow_udf(function, kind, F.ArrowUDFType.SCALAR)


def _pieces(token: Column, lengths: list[int]) -> Column:
    """All parts of a token that are as long as some word."""

    def of_length(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(token) - size + 1)
        return F.when(F.length(token) >= size, F.transform(starts, lambda i: F.substring(token, i, size))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(F.lit(lengths), of_length)))


def tokens_with(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, n) for every word of ``words`` (n, part) whose part occurs in a token of ``tokens`` (token, distinct)."""
    lengths = sorted(r[0] for r in words.select(F.length("part")).distinct().collect())
    if not lengths:
        return tokens.join(words.limit(0), F.lit(False)).select("token", "n")
    starts = F.sequence(F.lit(1), F.greatest(F.length("token"), F.lit(1)), F.lit(STRETCH))
    stretched = tokens.select("token", F.explode(F.transform(starts, lambda i: F.substring(C("token"), i, F.lit(STRETCH - 1 + lengths[-1])))).alias("stretch"))
    pieces = stretched.select("token", F.explode(_pieces(C("stretch"), lengths)).alias("part"))
    return pieces.join(words, "part").select("token", "n").distinct()


def occurrences(rows: DataFrame, key: str, texts: dict[str, str | list[str]], words: DataFrame) -> DataFrame:
    """Per ``key`` the sorted numbers of the words found, one array per entry of ``texts`` (result column: text column,
    or several columns that make up the text, put side by side with spaces).

    ``rows`` is read more than once: give a stored table. Texts and words
    (n int, w string) have single spaces only. Keys without any word are left
    out; empty words are found nowhere.
    """
    parts = F.split("w", " ")
    longest = F.array_max(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("l"), (-i).alias("i"), p.alias("p"))))["p"]
    known = stage(words.where("w <> ''").select("n", "w", longest.alias("part"), (F.size(parts) > 1).alias("phrase")), "words")

    made_of = [[t] if isinstance(t, str) else t for t in texts.values()]
    fields = list(dict.fromkeys(f for own in made_of for f in own))
    masks = [sum(1 << fields.index(f) for f in own) for own in made_of]
    listed = stage(_tokens(rows, key, fields), "listed")
    single = listed.select(key, F.explode("listed").alias("x")).select(key, C("x.fields").alias("fields"), F.explode("x.tokens").alias("token"))
    tokens = tokens_with(single.select("token").distinct(), known.select("n", "part")).join(known.select("n", "phrase"), "n")
    lists = stage(tokens.groupBy("token").agg(*[F.collect_list(F.when(C("phrase") == p, C("n"))).alias(name) for p, name in ((False, "ns"), (True, "phrases"))]), "tokens")
    found = single.join(lists, "token")
    sides = sum((F.when(C("fields").bitwiseAND(F.lit(m)) != 0, 1 << k).otherwise(0) for k, m in enumerate(masks)), F.lit(0))
    found = found.select(key, sides.alias("sides"), "ns", "phrases")
    hits = found.where(F.size("ns") > 0).select(key, "sides", "ns")
    if not known.where("phrase").isEmpty():
        held = F.filter(F.sequence(F.lit(0), F.lit(len(texts) - 1)), lambda k: F.getbit("sides", k) == 1)
        asked = found.where(F.size("phrases") > 0).select(key, F.explode("phrases").alias("n"), held.alias("held")).select(key, "n", F.explode("held").alias("side")).distinct()
        asked = asked.join(known.select("n", "w"), "n").join(rows.select(key, *fields), key)
        text = F.element_at(F.array(*[F.concat_ws(" ", *own) for own in made_of]), C("side") + 1)
        side = F.element_at(F.lit([1 << k for k in range(len(texts))]), C("side") + 1)
        hits = hits.unionByName(asked.where(F.contains(text, C("w"))).select(key, side.alias("sides"), F.array("n").alias("ns")))
    grouped = hits.groupBy(key).agg(F.collect_list(F.struct("sides", "ns")).alias("x"))

    def words_of(k: int) -> Column:
        mine = F.filter("x", lambda x: x["sides"].bitwiseAND(F.lit(1 << k)) != 0)
        return F.array_sort(F.array_distinct(F.flatten(F.transform(mine, lambda x: x["ns"]))))

    return grouped.select(key, *[words_of(k).alias(out) for k, out in enumerate(texts)])


def _tokens(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, listed): the distinct tokens of each field of a row; bit k of ``fields`` stands for the k-th field.

    A field equal to an earlier one of its row isn't cut again: its bit is set in that field's.
    """
    def bits(k: int) -> Column:
        return sum((F.when(F.equal_null(C(fields[k]), C(f)), 1 << j).otherwise(0) for j, f in enumerate(fields) if j > k), F.lit(1 << k))

    def cut(k: int) -> Column:
        seen = F.lit(False)
        for f in fields[:k]:
            seen = seen | F.equal_null(C(fields[k]), C(f))
        return F.when(C(fields[k]).isNotNull() & ~seen, F.array_distinct(F.split(C(fields[k]), " "))).otherwise(F.array().cast("array<string>"))

    return rows.select(key, F.array(*[F.struct(bits(k).alias("fields"), cut(k).alias("tokens")) for k in range(len(fields))]).alias("listed"))


def containing(texts: DataFrame, words: DataFrame, size: int = 6) -> DataFrame:
    """(text, word) for every word of ``words`` (word) that occurs anywhere in a text of ``texts`` (text), spaces included.

    For short texts, such as names, on both sides; values must be distinct. A
    word is sought by that of its grams of ``size`` characters which fewest
    texts hold (a shorter word by itself), and pairs meeting there are checked
    for the whole word. Nulls and empty strings occur nowhere and hold nothing.

    Texts are cut into grams of the lengths sought only. A text has as many
    grams as characters, which size estimates miss, so grams are always
    shuffled and never broadcast.
    """
    lengths = sorted(r[0] for r in words.where("word <> ''").select(F.least(F.length("word"), F.lit(size))).distinct().collect())
    if not lengths:
        return texts.join(words.limit(0), F.lit(False)).select("text", "word")
    grams = texts.select("text", F.explode(_pieces(C("text"), lengths)).alias("gram")).hint("merge")
    own = F.when(F.length("word") >= size, _pieces(C("word"), [size])).when(C("word") != "", F.array("word"))
    held = grams.groupBy("gram").agg(F.count("*").alias("texts"))
    counted = words.select("word", F.explode(own).alias("gram")).join(held.hint("merge"), "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    sought = counted.groupBy("word").agg(F.min_by("gram", "texts").alias("gram"), F.min("texts").alias("texts")).where("texts > 0")
    return grams.join(sought.select("word", "gram"), "gram").where(F.contains("text", "word")).select("text", "word")
