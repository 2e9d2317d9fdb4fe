"""Which words of a small vocabulary occur in a text, as a column expression.

For a taxonomy's words, which are few and known when the query is written: each
is sought in the text as a substring by built-in functions. Vocabularies that
come from data, of any size, are searched by ``wordsearch``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _codes(text: Column, terms: Sequence[str]) -> Column:
    """``2*number`` for a word seen once, ``2*number+1`` if it occurs again behind its first occurrence."""
    if not terms:
        return F.array().cast("array<int>")

    def code(term: Column, number: Column) -> Column:
        behind = F.instr(text, term) + F.length(term)
        again = F.call_function("locate", term, text, behind) > 0
        return F.when((term != "") & F.contains(text, term), (number * 2 + F.when(again, 1).otherwise(0)).cast("int"))

    return F.array_compact(F.transform(F.lit(list(terms)), code))


def find_terms(terms: Sequence[str]):
    """Function column -> array<int> of codes, ascending; none for a null text."""
    return lambda text: _codes(F.coalesce(text, F.lit("")), terms)


def find_each(terms: Sequence[str]):
    """As find_terms for a column of several texts: array<array<int>>."""
    return lambda texts: F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: _codes(F.coalesce(t, F.lit("")), terms))


def hit_ids(codes: Column) -> Column:
    """Vocabulary numbers of the words found."""
    return F.transform(codes, lambda c: F.shiftright(c, 1))


def code_id(code: Column) -> Column:
    return F.shiftright(code, 1)


def code_count(code: Column) -> Column:
    """1, or 2 for two occurrences and more."""
    return code.bitwiseAND(F.lit(1)) + F.lit(1)
