"""Quality rules: a threshold table compiled into one Spark projection.

Each rule bounds the ratio of two measures of a text. All measures are built-in
expressions, so the whole table is evaluated next to the scan, without a
shuffle and without user functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\x0b\f\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of the languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it with on are as this be at from by or was an a",
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son",
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le o",
)


@dataclass(frozen=True)
class Rule:
    """``low <= (numerator + plus) / denominator <= high``; a bound of None is open, and so is a denominator of 0."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    plus: int = 0


#: The production table.
RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 25.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.2),
    Rule("bang_ratio", "n_bangs", "n_words", None, 0.5),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.01, None, plus=1),  # short texts may have none
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Rule("words_per_line", "n_words", "n_lines", 1.0, None),
)


def _number_in(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measures(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the measures of its text, each a long.

    Null texts measure 0 throughout. A word is a run of anything but ASCII
    white space; a window of five words is repeated if it occurs at another
    place of the text as well, overlapping or not, and all words inside
    repeated windows count once.
    """
    text, words, windows, ranked, starts = (F.col(f"_{c}") for c in ("text", "words", "windows", "ranked", "starts"))
    df = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    inner = F.btrim(text, F.lit(BLANKS))
    df = df.withColumns({
        "_words": F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_BREAK)),
        "_lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    stop = sorted({w for words_ in STOP_WORDS for w in words_.split()})
    df = df.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": _number_in(text, SYMBOLS).cast("long"),
        "n_bangs": _number_in(text, "!").cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WINDOW)]))),
    })
    # Only texts with a repeated window go on to place their windows.
    df = df.withColumn("_ranked", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda k, e: F.coalesce(F.get(ranked, k)["h"] == e["h"], F.lit(False))
    df = df.withColumn("_starts", F.sort_array(F.transform(F.filter(ranked, lambda e, k: same(k - 1, e) | same(k + 1, e)), lambda e: e["i"])))
    covered = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, n: a + n), F.lit(0)).cast("long"))
    return df.drop("_text", "_words", "_lines", "_windows", "_ranked", "_starts")


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition on the measures."""
    verdict = F.lit(True)
    for r in rules:
        ratio = (F.col(r.numerator) + r.plus) / F.nullif(F.col(r.denominator), F.lit(0))
        for bound, ok in ((r.low, ratio >= F.lit(r.low)), (r.high, ratio <= F.lit(r.high))):
            if bound is not None:
                verdict = verdict & F.coalesce(ok, F.lit(True))
    return verdict


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of ``docs`` (doc_id, text).

    Empty and null texts have no words and fail the base; repeated rows are
    judged one by one; other columns are ignored; an empty table gives none.
    """
    measured = measures(docs.select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured.select("doc_id", *names, base_failed().alias("base_failed"), (~base_failed() & passes(rules)).alias("kept"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same over the table ``documents`` in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS for w in words.split()}))
    tests = [f"coalesce(({r.numerator} + {r.plus}) / nullif({r.denominator}, 0) {sign} {bound}, true)" for r in rules for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return rf"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
split as (
  select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l from texts),
windows as (
  select doc_id, unnest(range(1, len(w) - 3)) as i, w from split where len(w) >= 5),
keyed as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from windows),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from keyed) where n > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, (select unnest(range(0, 5)) as k) group by doc_id),
measured as (
  select s.doc_id, len(w)::bigint as n_words, list_sum(list_transform(w, lambda x: length(x)))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, length(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_bangs,
    len(list_filter(w, lambda x: lower(x) in ({stop})))::bigint as n_stop_words,
    len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from split s left join covered c on c.doc_id = s.doc_id),
based as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from measured)
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(tests) or "true"} as kept from based
"""
