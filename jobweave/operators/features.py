"""Compact features of profiles and postings, computed once per side.

Pairs of a profile and a posting only ever carry these short columns; the
texts stay behind. Words are numbered by a table of the profiles' words, so
evidence is a matter of small integers. Batches of up to ``wordsearch.IN_ROW``
words and ``tallies.PROFILES`` profiles are met inside the postings' rows; larger ones are
joined, and neither their profiles nor their words pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import dates, provenance, signals
from ..functions.text import clean, joined, low_has, norm
from ..session import stage
from ..taxonomy import Taxonomy, norm_py
from . import profiles as P, scoring
from .ordering import numbered
from .tallies import Part, met
from .wordsearch import IN_ROW, Words, finder, occurrences

C = F.col


@dataclass(frozen=True)
class Batch:
    """Profiles staged for matching, with the table (n, w) of the words their evidence may use."""

    profiles: DataFrame
    words: DataFrame
    taxonomy: Taxonomy


def make_batch(profiles: DataFrame, taxonomy: Taxonomy, skills: int = 64, keywords: int = 40) -> Batch:
    """Stage any number of profiles and number their words.

    Needs the columns of ``profiles.profile`` plus ``target_locations`` and
    ``target_directions`` (arrays). ``skills`` and ``keywords`` are the numbers
    of a profile's skills and keywords that count, the published ones by default.
    """
    base = stage(
        profiles.select(
            "profile_id", "career", "domains", "degree", "graduation_year", "recommended_roles", "target_locations", "target_directions",
            F.slice(F.filter("skills", lambda s: F.length(norm(s)) >= 2), 1, skills).alias("skills"),
            F.col("keywords").alias("all_keywords"), F.slice("keywords", 1, keywords).alias("keywords"),
        ),
        "profiles",
    )
    said = base.select(F.explode(F.concat("skills", "all_keywords", "recommended_roles")).alias("w")).select(norm(C("w")).alias("w"))
    fixed = base.sparkSession.createDataFrame([(w,) for w in taxonomy.words()], "w string")
    distinct = said.where("w is not null").union(fixed).distinct()
    words = stage(numbered(distinct, "w", position="n").select(C("n").cast("int").alias("n"), "w"), "words")
    return Batch(_number(base, words, taxonomy), words, taxonomy)


def taxonomy_numbers(batch: Batch) -> dict[str, int]:
    """The numbers of the taxonomy's own words, which are as few as its entries."""
    own = batch.words.sparkSession.createDataFrame([(w,) for w in batch.taxonomy.words()], "w string")
    return {r["w"]: r["n"] for r in batch.words.join(own, "w").collect()}


def _number(base: DataFrame, words: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Replace words by numbers through one join on the word table."""
    generic, generic_v9 = F.lit(vocab.GENERIC_SKILLS), F.lit(vocab.V9_GENERIC)
    primary_words = F.lit([[norm_py(t) for t in taxonomy.strong_terms(i)] for i in range(len(taxonomy.domains))])
    primary = F.coalesce(F.get(primary_words, F.get("career", F.lit(0))["d"]), F.array().cast("array<string>"))

    def numbered_words(kind: int, column: str) -> Column:
        return F.transform(column, lambda w, i: F.struct(F.lit(kind).alias("k"), i.alias("i"), norm(w).alias("w"), w.alias("raw")))

    kinds = enumerate(["skills", "all_keywords", "recommended_roles"])
    said = base.select(
        "profile_id", primary.alias("primary_words"), F.explode(F.concat(*[numbered_words(k, c) for k, c in kinds])).alias("x")
    ).select("profile_id", "primary_words", "x.*")
    size = F.length("w")
    told = said.join(words, "w").select(
        "profile_id", "k", "i", "n", "w", "raw", size.alias("size"), F.length("raw").alias("raw_size"),
        F.when(F.array_contains(generic, C("w")), 35).when(F.array_contains("primary_words", C("w")), 170).when(size >= 7, 125).otherwise(100).alias("w100"),
        F.when(F.array_contains(generic_v9, C("w")), 45).when(size >= 8, 135).when(size >= 5, 115).otherwise(100).alias("v9"),
        F.array_contains(generic, C("w")).alias("is_generic"),
    )
    skill, keyword, role = C("k") == 0, C("k") == 1, C("k") == 2

    def ids(condition: Column) -> Column:
        kept = F.array_sort(F.collect_list(F.when(condition, F.struct("i", "n"))))
        return F.transform(kept, lambda x: x["n"])

    grouped = told.groupBy("profile_id").agg(
        *[ids(skill & (C("w100") == w)).alias(f"sk_{w}") for w in (35, 170, 125, 100)],
        F.coalesce(F.sum(F.when(skill, C("w100"))), F.lit(0)).alias("sk_total"),
        ids(keyword & (C("i") < 40) & (size_ok(C("size"), 3)) & ~C("is_generic")).alias("kw"),
        ids(skill).alias("sk_all"),
        ids(skill & (C("raw_size") > 1) & (C("raw_size") >= 6)).alias("add_long"),
        ids(skill & (C("raw_size") > 1) & (C("raw_size") < 6)).alias("add_short"),
        ids(keyword & (C("raw_size") > 2)).alias("add_kw"),
        ids(role).alias("role_all"),
        ids(role & size_ok(C("size"), 3)).alias("role_long"),
        ids(skill & (C("i") < 24) & size_ok(C("size"), 3)).alias("sk_24"),
        ids(skill & (C("i") < 30) & size_ok(C("size"), 3)).alias("sk_30"),
        ids(skill & (C("i") < 14) & size_ok(C("size"), 3)).alias("sk_14"),
        *[ids(skill & (C("i") < 36) & (C("v9") == w)).alias(f"v9_{w}") for w in (45, 135, 115, 100)],
        F.coalesce(F.sum(F.when(skill & (C("i") < 36), C("v9"))), F.lit(0)).alias("v9_total"),
        F.array_sort(F.collect_set(F.when(~role, F.struct("n", "w")))).alias("p_names"),
    )
    arrays = [n for n, t in grouped.dtypes if t == "array<int>"]
    filled = base.join(grouped, "profile_id", "left")
    no_names = F.array().cast("array<struct<n:int,w:string>>")
    filled = filled.withColumn("p_names", F.coalesce("p_names", no_names)).withColumns({a: F.coalesce(C(a), F.array().cast("array<int>")) for a in arrays} | {t: F.coalesce(C(t), F.lit(0)) for t in ("sk_total", "v9_total")})
    top = F.slice("career", 1, 4)
    domain_names = F.lit([norm_py(d.name) for d in taxonomy.domains])
    targets = F.filter(
        F.transform(
            domain_names,
            lambda name, d: F.when(F.exists("target_directions", lambda t: name.contains(norm(t)) | norm(t).contains(name)), d).otherwise(-1),
        ),
        lambda d: d >= 0,
    )
    reach = [[j for j in range(len(taxonomy.domains)) if taxonomy.related(d.id, taxonomy.domains[j].id)] for d in taxonomy.domains]
    return stage(
        numbered(filled, "profile_id", position="slot").select(
            "profile_id", C("slot").cast("int").alias("slot"),
            F.transform(top, lambda r: r["d"]).alias("p_top"),
            direction_codes(F.transform(top, lambda r: r["d"]), taxonomy).alias("p_codes"), targets.alias("p_targets"),
            F.coalesce(F.get("career", F.lit(0))["confidence"], F.lit(0)).alias("p_conf"),
            F.array_distinct(F.flatten(F.transform(top, lambda r: F.get(F.lit(reach), r["d"])))).alias("p_reach"),
            F.transform(F.slice("career", 1, 5), lambda r: F.struct(r["d"].alias("d"), r["confidence"].alias("c"))).alias("p_dirs"),
            F.array_union("sk_all", "kw").alias("p_words"), F.array_union("role_all", "sk_30").alias("p_cheap"),
            F.array_distinct(F.concat("add_long", "add_short", "add_kw", "role_all")).alias("p_add"),
            target_numbers(C("target_directions"), taxonomy).alias("p_wanted"), signals.first_degree(C("degree")).alias("p_first_degree"),
            signals.degree_rank(C("degree")).alias("p_degree"), C("degree").alias("p_degree_name"), C("graduation_year").alias("p_year"),
            "target_locations", "target_directions", *arrays, "sk_total", "v9_total", "skills", "p_names",
        ),
        "profile-features",
    )


def direction_codes(p_top: Column, taxonomy: Taxonomy) -> Column:
    """Best direction points per posting domain d and its rank k, at 4*d+k.

    A code is tenths of points * 100 + tie-break (earlier pairs higher) * 2 +
    whether the domains are equal, so the greatest code is the pair to take.
    """
    n = len(taxonomy.domains)
    kin = F.lit([2 if a == b else int(taxonomy.related(taxonomy.domains[a].id, taxonomy.domains[b].id)) for a in range(n) for b in range(n)])
    places = F.sequence(F.lit(0), F.lit(4 * n - 1))

    def best(place: Column) -> Column:
        d, k = F.floor(place / 4).cast("int"), place % 4

        def code(p: Column, i: Column) -> Column:
            near = F.get(kin, p * n + d)
            tie = (15 - (i * 4 + k)) * 2
            same, related = (300 - 45 * i - 40 * k) * 100 + tie + 1, (140 - 22 * i - 20 * k) * 100 + tie
            return F.when(near == 2, same).when(near == 1, related).otherwise(0)

        return F.coalesce(F.array_max(F.transform(p_top, code)), F.lit(0))

    return F.transform(places, best)


def target_numbers(targets: Column, taxonomy: Taxonomy) -> Column:
    """Domain numbers of target directions given by id or name."""
    ids, names = taxonomy.ids(), taxonomy.names()
    return F.transform(targets, lambda t: (F.greatest(F.array_position(ids, t), F.array_position(names, t)) - 1).cast("int"))


def size_ok(c: Column, least: int) -> Column:
    return c >= least


TEXT_FIELDS = ["role", "department", "industry", "jd", "batch", "graduation"]


def side_by_side(*fields: str) -> Column:
    """Normalised fields in a row; equals normalising the joined raw fields."""
    return F.coalesce(F.concat_ws(" ", *[C(f"__{f}") for f in fields]), F.lit(""))


def lower_has(blob: Column, pattern: str) -> Column:
    """Pattern search in lower-case text, without case folding."""
    return low_has(blob, pattern.removeprefix("(?i)"))


def found_words(rows: DataFrame, batch: Batch, fields: dict[str, Column], texts: dict[str, list[str]]) -> DataFrame:
    """(ord, one array of word numbers per entry of ``texts``) for every row; a text is some normalised fields side by side."""
    staged = stage(rows.select("ord", *[f.alias(n) for n, f in fields.items()]), "texts")
    hits = occurrences(staged, "ord", texts, batch.words)
    none = F.array().cast("array<int>")
    return staged.select("ord").join(hits, "ord", "left").select("ord", *[F.coalesce(n, none).alias(n) for n in texts])


def by_number(jobs: DataFrame, batch: Batch, build: Callable[[DataFrame, Words | None], DataFrame]) -> DataFrame:
    """``build(rows, words)`` of the postings, which seeks the words inside the rows, or by joins on ``ord`` where they are None.

    Joins are for vocabularies too large for a row's search, and for numbers
    that several postings share. Postings without a number play no part.
    """
    listed = [(r["n"], r["w"]) for r in batch.words.limit(IN_ROW + 1).collect()]
    if len(listed) > IN_ROW:
        return build(jobs, None)
    numbers = jobs.where("ord is not null")
    shared = stage(numbers.groupBy("ord").count().where("count > 1").select("ord"), "shared")
    if shared.isEmpty():
        return build(numbers, Words(listed))
    return build(numbers.join(shared, "ord", "left_anti"), Words(listed)).unionByName(build(numbers.join(shared, "ord", "left_semi"), None))


def with_words(rows: DataFrame, batch: Batch, words: Words | None, fields: dict[str, Column], texts: dict[str, list[str]]) -> DataFrame:
    """``rows`` with one array of word numbers per entry of ``texts``."""
    if words is None:
        return rows.join(found_words(rows, batch, fields, texts), "ord")
    return rows.withColumn("__found", finder(words, fields, texts)).withColumns({t: C("__found")[t] for t in texts}).drop("__found")


def job_features(jobs: DataFrame, batch: Batch, as_of: str) -> DataFrame:
    """Everything the scorers need of a posting, without its texts. ``ord`` tells the postings apart."""
    return by_number(jobs, batch, lambda rows, words: job_columns(rows, batch, as_of, words))


def job_columns(jobs: DataFrame, batch: Batch, as_of: str, words: Words | None, *more: str) -> DataFrame:
    """The features of ``job_features`` and the columns ``more``.

    Every field is normalised once; all longer texts are put together from
    the normalised fields.
    """
    normal = jobs.withColumns({f"__{c}": norm(C(c)) for c in TEXT_FIELDS})
    texts = normal.withColumns(
        {
            "__career": side_by_side("role", "department", "industry", "jd"),
            "__body": side_by_side("jd", "department", "industry"),
            "__blob": side_by_side("role", "batch", "graduation", "jd"),
        }
    )
    found = P.classify(texts, batch.taxonomy, C("__career"), title=C("__role"), out="__scores", normal=True)
    sought = {"title_ids": ["role"], "body_ids": ["jd", "department", "industry"]}
    fields = ("role", "jd", "department", "industry")
    flags = F.struct(*[lower_has(C("__blob"), p).alias(n) for n, p in (("campus", vocab.CAMPUS), ("intern", vocab.INTERN), ("senior", vocab.SENIOR), ("social", vocab.SOCIAL))])
    age = dates.age_days(dates.parse_date(C("updated_at")), as_of)
    facts = found.select(
        "ord", "id", "company", "role", "location", "updated_at", "company_type", "batch",
        age.alias("age"),
        F.transform(F.slice("__scores", 1, 4), lambda r: r["d"]).alias("j_top"),
        F.coalesce(F.get("__scores", F.lit(0))["confidence"], F.lit(0)).alias("j_conf"),
        flags.alias("flags"),
        signals.cohort_years(C("__blob")).alias("blob_years"),
        signals.cohort_years(C("graduation")).alias("cohort_years"),
        F.regexp_extract_all(joined(C("graduation"), C("batch"), C("role")), F.lit("(20[0-9]{2})"), F.lit(1)).alias("any_years"),
        clean(C("graduation")).isNotNull().alias("has_cohort"),
        signals.degree_rank(C("education")).alias("j_degree"),
        provenance.source_score(C("source_tier"), C("source_label"), C("source"), C("source_url"), C("apply_url"), C("notice_url")).alias("source"),
        signals.completeness(C("jd"), C("apply_url")).alias("complete"),
        signals.is_sparse(C("jd")).alias("sparse"),
        F.coalesce("source_tier", F.lit(1)).alias("tier"),
        *more, *[f"__{c}" for c in fields],
    ).withColumns({"fresh": dates.freshness(C("age")), **scoring.stage_of(C("flags"))}).withColumn("trust", scoring.trust_of())
    listed = with_words(facts, batch, words, {c: C(f"__{c}") for c in fields}, sought).drop(*[f"__{c}" for c in fields])
    return listed.withColumn("all_ids", F.array_union("title_ids", "body_ids"))


def all_pairs(features: DataFrame, batch: Batch, tallies: dict[str, list[Part]] = scoring.TALLIES) -> DataFrame:
    """Every posting with every profile, for checks of the parts of a score; ``plans.recommend`` never makes these."""
    pairs = met(features, batch.profiles, tallies) if "slot" in batch.profiles.columns else None
    return features.crossJoin(batch.profiles.drop("slot")) if pairs is None else pairs
