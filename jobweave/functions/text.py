"""Text columns: cleaning, identity, truncation, markup, HTML entities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab


def let(c: Column, body) -> Column:
    """``body(c)`` with ``c`` computed once per row however often it is used."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later filters can't repeat: it is exploded from a list of one.

    A filter on a plain column moves below it and computes it again for every mention.
    """
    return df.select(*[df[c] for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def settled(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition which is computed here, from columns made before, and only once."""
    return once(df, "__met", condition).where("__met").drop("__met")


def nonblank(c: Column) -> Column:
    """Blank is unknown: empty strings become null."""
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Collapse whitespace and trim, keeping '' for a blank value."""
    return F.trim(F.regexp_replace(c, vocab.SPACE_FAST, " "))


def clean(c: Column) -> Column:
    return nonblank(squeeze(c))


def norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(clean(c)), vocab.DASHES_FAST, "-")


def normal(c: Column) -> Column:
    """As ``norm``, but '' for a blank or missing text; a long text is squeezed only once."""
    return F.regexp_replace(F.lower(squeeze(F.coalesce(c, F.lit("")))), vocab.DASHES_FAST, "-")


def joined(*cols: Column) -> Column:
    """Fields side by side with one space each, blanks kept as ''."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])


def canonical_company(c: Column) -> Column:
    out = F.lower(clean(c))
    for word in vocab.LEGAL_FORMS:
        out = F.replace(out, F.lit(word), F.lit(""))
    return clean(out)


def stable_id(*parts: Column) -> Column:
    """First 18 hex digits of SHA-1 over the non-empty cleaned parts."""
    raw = F.concat_ws("|", *[F.lower(clean(p)) for p in parts])
    return F.substring(F.sha1(raw), 1, 18)


def compact_text(c: Column, limit: int | None = None) -> Column:
    """Text in single spaces; whole, or its first ``limit`` characters and an ellipsis."""
    if limit is None:
        return clean(c)

    def cut(text: Column) -> Column:
        short = F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("…"))
        return F.when(F.length(text) > limit, short).otherwise(text)

    return let(clean(c), cut)


def has(c: Column, pattern: str) -> Column:
    """Pattern search where a missing text is simply no match."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def needed_words(pattern: str) -> list[str]:
    """Lower-case words of which every match of ``pattern`` holds one, ASCII case aside; [] if it needs none."""

    def best(items) -> list[str]:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            if str(op) == "LITERAL":
                run += chr(arg).lower()
                continue
            found, run = found + ([[run]] if run else []), ""
            if str(op) == "SUBPATTERN":
                found.append(best(arg[-1]))
            elif str(op) == "BRANCH":
                parts = [best(part) for part in arg[1]]
                found.append([w for part in parts for w in part] if all(parts) else [])
            elif str(op) == "MAX_REPEAT" and arg[0] > 0:
                found.append(best(arg[2]))
        return max(filter(None, found), key=lambda words: min(map(len, words)), default=[])

    return list(dict.fromkeys(best(re._parser.parse(pattern))))


def low_has(low: Column, pattern: str, raw: Column | None = None) -> Column:
    """``has`` for long texts: the pattern is tried only where a word it needs occurs.

    ``low`` is the text in lower case; the pattern is tried on ``raw`` if given.
    """
    tried = has(low if raw is None else raw, pattern)
    words = needed_words(pattern)
    held = F.lit(False)
    for word in words:
        held = held | F.coalesce(low.contains(word), F.lit(False))
    return held & tried if words else tried


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def one_decimal(c: Column) -> Column:
    return F.floor(c * 10 + F.lit(0.5)) / 10


# --- fixed values: entities decoded after tags are gone, '&' last ------------
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_html(c: Column) -> Column:
    """Breaks and closing blocks become newlines, other tags one space."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</(?:p|li|div|h[1-6])>", "\n")
    c = unescape(F.regexp_replace(c, "<[^>]+>", " "))
    c = F.regexp_replace(c, "[ \t]+", " ")
    return nonblank(F.regexp_replace(F.regexp_replace(c, r"\n\s*\n\s*\n+", "\n\n"), r"^\s+|\s+$", ""))


def page_text(c: Column) -> Column:
    """Visible text of a page: script and style bodies dropped, tags to spaces."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return clean(unescape(F.regexp_replace(c, "<[^>]+>", " ")))


def ordered_join(names: Column, sep: str = "/") -> Column:
    """Distinct non-blank names in first-seen order."""
    kept = F.filter(F.transform(names, clean), lambda x: x.isNotNull())
    return nonblank(F.array_join(F.array_distinct(kept), sep))
