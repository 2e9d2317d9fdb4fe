"""Merge, de-duplication, refresh and ranking of the job catalogue.

DataFrame in, DataFrame out. Every input carries ``ord``, a unique number for
feed order, which is the last sort key everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import provenance, signals, urls
from ..functions.dates import parse_date
from ..functions.text import canonical_company, clean, compact_text, has, joined, low_has, nonblank, squeeze, stable_id
from ..session import stage
from . import keys
from .wordsearch import containing

C = F.col
RANK_FIELDS = ("__updated_at", "__company")


def dedupe_by_id(df: DataFrame) -> DataFrame:
    """Longest description per id, earliest on ties."""
    own = F.coalesce(nonblank(C("id")), stable_id(*map(C, ["source", "company", "role", "location"])))
    size = F.coalesce(F.length(clean(C("jd"))), F.lit(0))
    return keys.keep_first(df, [own], [size.desc(), C("ord")])


def merge_catalog(df: DataFrame, fields: Sequence[str] = vocab.MERGE_FIELDS) -> DataFrame:
    """One row per canonical (company, role, place).

    The winner has the longest description; its blank fields are filled from
    the other rows in feed order, and all distinct labels and links of the
    group are kept in feed order. Fill values, provenance and the number of
    the winner are settled on short rows and written first; only winners then
    carry their texts into a sort or a shuffle. Provenance is reduced to
    distinct values before it is gathered.
    """
    rows = keys.drop_nameless(df).withColumn("key", keys.catalogue_key())
    rows = rows.withColumns({f: clean(C(f)) for f in fields})
    size = F.coalesce(F.length(C("jd")), F.lit(0))
    keep = [c for c in df.columns if c not in ("key", "source_label", "source_url")]
    fill = [F.min_by(C(f), F.when(C(f).isNotNull(), C("ord"))).alias(f"__{f}") for f in fields if f != "jd"]
    longest = F.struct(size, -C("ord"))
    narrow = rows.groupBy("key").agg(F.max_by("ord", longest).alias("__ord"), *fill)
    filled = [
        (F.coalesce(C(f"w.{c}"), C(f"__{c}")) if c in fields and c != "jd" else C(f"w.{c}")).alias(c) for c in keep
    ]
    sources = (
        rows.select(
            "key", "ord",
            F.explode(
                F.array(
                    F.struct(F.lit("label").alias("kind"), F.coalesce(clean(C("source_label")), clean(C("source"))).alias("value")),
                    F.struct(F.lit("url").alias("kind"), clean(C("source_url")).alias("value")),
                )
            ).alias("s"),
        )
        .filter("s.value is not null")
        .groupBy("key", "s.kind", "s.value")
        .agg(F.min("ord").alias("ord"))
        .groupBy("key")
        .agg(*[F.sort_array(F.collect_list(F.when(C("kind") == k, F.struct("ord", "value")))).alias(k) for k in ("label", "url")])
        .select("key", C("label.value").alias("source_labels"), C("url.value").alias("source_urls"))
    )
    best = stage(narrow.join(sources, "key", "left"), "merged")
    won = best.select(C("key").alias("__key"), "__ord")
    # Numbers that repeat leave several rows of a key, of which the same rule takes one.
    winners = rows.join(won, (C("key") == C("__key")) & C("ord").eqNullSafe(C("__ord"))).groupBy("key").agg(F.max_by(F.struct(*keep), longest).alias("w"))
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(C(c), empty).alias(c) for c in ("source_labels", "source_urls")]
    return winners.join(best, "key").select("key", *filled, *lists)


def first_rows(ordered: DataFrame, cap: int | None) -> DataFrame:
    """All rows in order, or the first ``cap`` of them."""
    return ordered if cap is None else ordered.limit(cap)


def compact_catalog(df: DataFrame, jd_chars: int | None = None, cap: int | None = None, sources: int | None = None) -> DataFrame:
    """The merged catalogue, newest first.

    Whole by default; ``jd_chars`` trims descriptions, ``cap`` keeps that many
    rows and ``sources`` that many labels and links of each.
    """
    order = [F.coalesce(clean(C(c)), F.lit("")).desc() for c in ("updated_at", "company", "role")]
    merged = first_rows(merge_catalog(df).orderBy(*order, "ord"), cap).withColumn("jd", compact_text(C("jd"), jd_chars))
    return merged.withColumns({c: F.slice(c, 1, sources) for c in ("source_labels", "source_urls")}) if sources is not None else merged


def dedupe_best_quality(df: DataFrame) -> DataFrame:
    """Best source quality per (company, role, city); rows without a key stay."""
    # A key holds '|', a row's running number does not, so rows without a key meet nobody; the input is read once.
    own = F.coalesce(keys.opportunity_key(), F.monotonically_increasing_id().cast("string"))
    quality = provenance.source_quality(C("source_tier"), C("apply_url"), C("notice_url"), C("source"))
    return keys.keep_first(df, [own], [quality.desc(), C("ord")])


def dedupe_canonical(df: DataFrame) -> DataFrame:
    """First row in feed order per feed key."""
    return keys.keep_first(df, [keys.feed_key()], [C("ord")])


def upsert(existing: DataFrame, fresh: DataFrame, mode: str, trusted: str = "direct-official:") -> DataFrame:
    """Bring fresh rows into a catalogue on (company, role, place, link).

    ``replace``: fresh wins. ``insert_only``: the old row wins. ``overlay``:
    non-empty fresh fields overwrite the old row, but only when the fresh row's
    source starts with ``trusted``. The last row wins inside each input.
    """
    columns = [c for c in existing.columns if c != "ident"]

    def latest(df: DataFrame) -> DataFrame:
        named = keys.drop_nameless(df)
        return keys.keep_first(named, [keys.listing_identity()], [C("ord").desc()]).withColumn("ident", keys.listing_identity())

    old, new = latest(existing).alias("o"), latest(fresh).alias("f")
    both = old.join(new, C("o.ident") == C("f.ident"), "full_outer")
    new_wins = {
        "replace": C("f.ident").isNotNull(),
        "insert_only": C("o.ident").isNull(),
        "overlay": C("o.ident").isNull(),
    }[mode]

    def pick(c: str) -> Column:
        whole = F.when(new_wins, C(f"f.{c}")).otherwise(C(f"o.{c}"))
        if mode != "overlay":
            return whole.alias(c)
        value = C(f"f.{c}")
        present = value.isNotNull() & (value.cast("string") != "")
        over = C("f.source").startswith(trusted) & present
        return F.when(over, value).otherwise(whole).alias(c)

    return both.select(*map(pick, columns))


def replace_partition(existing: DataFrame, fresh: DataFrame, ok_sources: DataFrame, scope: Column | None = None) -> DataFrame:
    """Swap the rows of successfully refreshed sources; failed ones keep theirs.

    ``scope`` narrows what is dropped to one sub-window of a source.
    """
    # One row a source: written first, so that its true size decides on a broadcast and the catalogue isn't shuffled for it.
    done = stage(ok_sources.select(keys.low(C("source")).alias("__done")).distinct(), "done")
    hit = keys.low(C("source")) == C("__done")
    kept = existing.join(done, hit & scope if scope is not None else hit, "left_anti")
    present = kept.select(keys.position_identity().alias("__ident"))
    new = keys.keep_first(keys.drop_nameless(fresh), [keys.position_identity()], [C("ord")])
    new = new.withColumn("__ident", keys.position_identity()).join(present, "__ident", "left_anti").drop("__ident")
    return kept.unionByName(new)


def last_good(fresh: DataFrame, previous: DataFrame, gates: DataFrame) -> DataFrame:
    """Per source: fresh rows that pass their gates, else the previous rows.

    ``gates(source, min_rows, role_word, place, min_place_rows)``; a source
    without a gate only has to be non-empty. Adds ``preserved_previous``.
    """
    passing = (
        fresh.join(gates, "source", "left")
        .groupBy("source")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.coalesce(F.lower("role").contains(F.lower("role_word")), F.lit(False))).alias("with_role"),
            F.count_if(F.coalesce(C("location").contains(C("place")), F.lit(False))).alias("in_place"),
            *[F.max(c).alias(c) for c in ("min_rows", "role_word", "place", "min_place_rows")],
        )
        .filter(
            (C("n") >= F.coalesce("min_rows", F.lit(1)))
            & (C("role_word").isNull() | (C("with_role") > 0))
            & (C("place").isNull() | (C("in_place") >= F.coalesce("min_place_rows", F.lit(1))))
        )
        .select("source")
    )
    passing = stage(passing, "passing")  # one row a source, evaluated once
    good = fresh.join(passing, "source", "left_semi").withColumn("preserved_previous", F.lit(False))
    kept = previous.join(passing, "source", "left_anti").withColumn("preserved_previous", F.lit(True))
    return good.unionByName(kept)


def priority_union(df: DataFrame, source_order: dict[str, int], other: int = 99) -> DataFrame:
    """First row per feed key, sources in rank order."""
    rank = F.lit(other)
    for source, place in source_order.items():
        rank = F.when(C("source") == source, place).otherwise(rank)
    return keys.keep_first(df, [keys.feed_key()], [rank, C("source"), C("ord")])


def _cleaned(df: DataFrame, *names: str) -> DataFrame:
    """Columns ``__name`` with the cleaned text of each field, '' for none; whatever reads them, each is cleaned once."""
    return df.withColumns({f"__{n}": squeeze(F.coalesce(C(n), F.lit(""))) for n in names})


def domestic_score() -> Column:
    """The score of a row whose fields ``_cleaned`` has prepared."""
    blob, jd_low = F.concat_ws(" ", "__role", "__jd", "__batch", "__graduation"), F.lower("__jd")
    place = F.when(C("__location").contains(vocab.CAPITAL), 65).when(C("__location").rlike("|".join(vocab.FIRST_TIER)), 38).otherwise(0)
    tech = F.when(has(C("__role"), vocab.TECH_FEED), 22).when(low_has(jd_low, vocab.TECH_FEED, C("__jd")), 9).otherwise(0)
    link = F.when(clean(C("apply_url")).isNotNull(), 8).when(clean(C("notice_url")).isNotNull(), 3).otherwise(0)
    return (
        provenance.source_priority(clean(C("source")))
        + place
        + F.when(low_has(F.lower(blob), vocab.CAMPUS_FEED, blob), 35).otherwise(0)
        + F.when(has(F.concat("__role", "__jd", "__batch", "__graduation"), vocab.TARGET_YEAR), 18).otherwise(0)
        + tech
        + link
    )


def _ranked(rows: DataFrame, keys: Sequence[str], cap: int | None, newest_first: bool) -> DataFrame:
    """Rows by score, date and ``keys``, all or the first ``cap``; RANK_FIELDS serve only the order."""
    by_date = C("__updated_at").desc() if newest_first else C("__updated_at").asc()
    return first_rows(rows.orderBy(C("score").desc(), by_date, *keys), cap).drop(*[c for c in rows.columns if c in RANK_FIELDS])


def rank_domestic(df: DataFrame, cap: int | None = None, newest_first: bool = False) -> DataFrame:
    """Domestic rows by score; equal scores are listed oldest first by default.

    A full sort reads its input twice, first to find the ranges, so the scores,
    which read whole descriptions, are dealt out with their rows before it: only
    the columns asked for are shuffled. With a ``cap`` each task keeps its first
    rows and nothing is dealt.
    """
    rows = _cleaned(df.filter(provenance.is_domestic(C("location"), C("source"))), "role", "jd", "batch", "graduation", "location", "updated_at", "company")
    scored = rows.withColumn("score", domestic_score()).drop("__role", "__jd", "__batch", "__graduation", "__location")
    return _ranked(scored if cap is not None else scored.repartition(C("ord")), ["__company", "ord"], cap, newest_first)


def rank_global(df: DataFrame, cap: int | None = None, newest_first: bool = False) -> DataFrame:
    blob = joined(clean(C("role")), clean(C("batch")), clean(C("graduation")))
    score = provenance.source_priority(clean(C("source"))) + F.when(has(blob, vocab.CAMPUS_FEED), 20).otherwise(0)
    return _ranked(_cleaned(df.withColumn("score", score), "updated_at"), ["ord"], cap, newest_first)


def signal_filter(df: DataFrame, cutoff: str, rule: str) -> DataFrame:
    """Rows of one query set worth keeping.

    ``current``: recent and naming the year or campus; ``watch``: naming the
    year, or recent and campus; ``explicit``: the query itself names the year.
    """
    recent = F.coalesce(parse_date(C("updated_at")) >= F.lit(cutoff).cast("date"), F.lit(False))
    explicit, campus = has(C("role"), vocab.TARGET_YEAR), has(C("role"), vocab.CAMPUS_FEED)
    rule_of = {"current": recent & (explicit | campus), "watch": explicit | (recent & campus), "explicit": F.lit(True)}
    return df.filter(rule_of[rule])


def signal_union(sets: Sequence[DataFrame]) -> DataFrame:
    """Later sets override earlier ones; inside a set the last notice link wins."""
    total = None
    for number, rows in enumerate(sets):
        named = keys.drop_nameless(rows).filter(clean(C("notice_url")).isNotNull())
        distinct = keys.keep_first(named, [clean(C("notice_url"))], [C("ord").desc()]).withColumn("set_no", F.lit(number))
        total = distinct if total is None else total.unionByName(distinct)
    return keys.keep_first(total, [keys.listing_identity()], [C("set_no").desc(), C("ord").desc()])


def tenant_guard(rows: DataFrame, registry: DataFrame, shared_host: str) -> DataFrame:
    """Keep rows answered by a host registered for their source.

    ``rows(source, response_url, origin_url, tenant)``,
    ``registry(source, start_url, api_hosts)``. On the shared host the call
    must come from the registered page and carry a numeric tenant.
    """
    known = registry.select(
        C("source").alias("__s"), urls.host(C("start_url")).alias("__start"),
        F.transform("api_hosts", lambda h: F.lower(F.trim(h))).alias("__api"),
    )
    answered = urls.host(C("response_url"))
    direct = (answered == C("__start")) | F.array_contains(C("__api"), answered)
    scoped = (answered == shared_host) & (urls.host(C("origin_url")) == C("__start")) & C("tenant").rlike("^[0-9]+$")
    return rows.join(known, (C("source") == C("__s")) & (direct | scoped), "left_semi")


def official_lookup(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Official link of the first registry company whose name contains, or is
    contained in, the row's company; the row's own link otherwise.

    ``registry(no, name, url)``, of any size, ``no`` being its order. Distinct
    names meet distinct companies by joins on their rarest grams, once in each
    direction. Nameless entries match nothing; an entry without a url leaves
    the row its own link.
    """
    company = F.coalesce(clean(C("company")), F.lit(""))
    companies = stage(rows.select(company.alias("__company")).where("__company <> ''").distinct(), "companies")
    names = stage(registry.where("name <> ''").groupBy("name").agg(F.min("no").alias("no"), F.min_by("url", "no").alias("url")), "names")
    inside = containing(companies.select(C("__company").alias("text")), names.select(C("name").alias("word"))).select(C("text").alias("__company"), C("word").alias("name"))
    around = containing(names.select(C("name").alias("text")), companies.select(C("__company").alias("word"))).select(C("word").alias("__company"), C("text").alias("name"))
    found = inside.unionByName(around).join(names, "name").groupBy("__company").agg(F.min("no").alias("official_no"), F.min_by("url", "no").alias("__url"))
    first = stage(found, "official")  # its true size decides how all rows are joined with it
    return (
        rows.drop("official_no", "official_url").withColumn("__company", company)
        .join(first, "__company", "left")
        .withColumn("official_url", F.coalesce(C("__url"), nonblank(C("apply_url")), nonblank(C("notice_url"))))
        .drop("__company", "__url")
    )
