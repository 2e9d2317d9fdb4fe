"""Texts to career profiles.

All of it is map-only except ``keywords``: a text is searched once per field
for the taxonomy's words, and everything after that works on the short list of
hits inside the row. Scores are added up in whole ten-thousandths, so results
do not depend on the order of additions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions import signals
from ..functions.text import has, let, nonblank, norm, round_half_up
from ..taxonomy import Taxonomy, norm_py
from .terms import code_count, code_id, find_each, find_terms, hit_ids

C = F.col
UNIT = 10_000


def trim_all(c: Column) -> Column:
    space = f"{vocab.ANY_SPACE}+"
    return F.regexp_replace(c, f"^{space}|{space}$", "")


def by_word(taxonomy: Taxonomy) -> Column:
    """word number -> entries(e number, d domain, m is a major, w weight, t text)."""
    words = {w: i for i, w in enumerate(taxonomy.words())}
    rows: list[list[dict]] = [[] for _ in words]
    for e, entry in enumerate(taxonomy.entries()):
        rows[words[norm_py(entry.term)]].append(
            {"e": e, "d": entry.domain, "m": entry.kind == "major", "w": entry.weight, "t": entry.term}
        )
    kind = "array<array<struct<e:int,d:int,m:boolean,w:int,t:string>>>"
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), kind)


def _total(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, x: acc + x[field])


def _per_domain(items: Column, evidence: int) -> Column:
    """items(e, d, t, v, a) -> domains(neg, d, score10, anchors, evidence), best first."""

    def fold(d: Column) -> Column:
        def make(own: Column) -> Column:
            score10 = F.floor((_total(own, "v") + F.lit(UNIT // 20)) / F.lit(UNIT // 10))
            return F.struct(
                (-score10).alias("neg"), d.alias("d"), score10.alias("score10"), _total(own, "a").alias("anchors"),
                F.slice(F.array_distinct(F.transform(own, lambda x: x["t"])), 1, evidence).alias("evidence"),
            )

        return let(F.filter(items, lambda x: x["d"] == d), make)

    folded = F.transform(F.array_distinct(F.transform(items, lambda x: x["d"])), fold)
    return F.array_sort(F.filter(folded, lambda r: r["score10"] > 0))


def hits_to_terms(codes: Column, lookup: Column) -> Column:
    """Term hits with weight times min(2, occurrences); majors play no part."""
    rows = F.flatten(
        F.transform(
            codes,
            lambda c: F.transform(
                F.filter(F.get(lookup, code_id(c)), lambda n: ~n["m"]),
                lambda n: F.struct(
                    n["e"].alias("e"), n["d"].alias("d"), n["t"].alias("t"), (n["w"] * code_count(c) * UNIT).cast("bigint").alias("v"),
                    F.lit(0).cast("bigint").alias("a"),
                ),
            ),
        )
    )
    return F.array_sort(rows)


def term_hits(df: DataFrame, taxonomy: Taxonomy, text: Column, out: str = "term_scores", evidence: int = 8) -> DataFrame:
    """Per domain with a hit: weighted score and the words found."""
    codes = find_terms(taxonomy.words())(C("__text"))
    items = hits_to_terms(C("__codes"), by_word(taxonomy))
    return (
        df.withColumn("__text", norm(text))
        .withColumn("__codes", codes)
        .withColumn(out, let(items, lambda i: _per_domain(i, evidence)))
        .drop("__text", "__codes")
    )


def direction_scores(scores: Column, taxonomy: Taxonomy, top: int = 6) -> Column:
    """Best directions with a confidence relative to the first."""
    peak = F.get(scores, F.lit(0))["score10"].cast("double")

    def row(r: Column, i: Column) -> Column:
        share = r["score10"] / peak * F.when(i == 0, 1.0).otherwise(0.92)
        sure = F.greatest(F.lit(18), F.least(F.lit(96), round_half_up(34 + 62 * share)))
        return F.struct(
            r["d"].alias("d"), F.get(taxonomy.names(), r["d"]).alias("name"), (r["score10"] / 10).alias("score"),
            sure.cast("int").alias("confidence"), r["evidence"].alias("evidence"),
        )

    return F.transform(F.slice(scores, 1, top), row)


def _career_items(body: Column, title: Column | None, major: Column | None, lookup: Column, major_points: int) -> Column:
    """Hits of one text with the title and major multipliers applied."""

    def flag(ids: Column | None, word: Column) -> Column:
        return F.array_contains(ids, word) if ids is not None else F.lit(False)

    def entry(n: Column, c: Column) -> Column:
        word = code_id(c)
        factor = F.when(flag(title, word), 185).otherwise(100) * F.when(flag(major, word), 155).otherwise(100)
        value = F.when(n["m"], F.lit(major_points * UNIT)).otherwise(n["w"] * code_count(c) * factor)
        anchor = F.when(n["m"] | (n["w"] >= 7), 1).otherwise(0)
        return F.struct(n["e"].alias("e"), n["d"].alias("d"), n["t"].alias("t"), value.cast("bigint").alias("v"), anchor.cast("bigint").alias("a"))

    rows = F.flatten(F.transform(body, lambda c: F.transform(F.get(lookup, code_id(c)), lambda n: entry(n, c))))
    if major is not None:
        only = F.array_except(major, hit_ids(body))
        extra = F.flatten(
            F.transform(only, lambda w: F.transform(F.filter(F.get(lookup, w), lambda n: n["m"]), lambda n: entry(n, F.shiftleft(w, 1))))
        )
        rows = F.concat(rows, extra)
    return F.array_sort(rows)


def classify_scores(domains: Column, taxonomy: Taxonomy, top: int = 7) -> Column:
    """Top domains with confidence; the first one's depends on its lead."""
    first, second = F.get(domains, F.lit(0)), F.get(domains, F.lit(1))
    raw = first["score10"] / 10
    margin = (first["score10"] - F.coalesce(second["score10"], F.lit(0))) / 10
    sure = round_half_up(
        F.least(
            F.lit(98.0),
            24 + F.least(F.lit(42.0), raw * 1.7) + F.least(F.lit(24.0), margin * 1.7) + F.when(first["anchors"] >= 2, 8).otherwise(0),
        )
    )
    sure = F.when(raw < 7, F.least(sure, F.lit(42))).otherwise(sure)
    sure = F.when(margin < 2, F.least(sure, F.lit(58))).otherwise(sure)

    def rows(confidence: Column) -> Column:
        def row(r: Column, i: Column) -> Column:
            share = round_half_up(confidence * ((r["score10"] / 10) / F.greatest(F.lit(1.0), raw)) * 0.94)
            other = F.greatest(F.lit(18), F.least(F.lit(94), share))
            return F.struct(
                r["d"].alias("d"), F.get(taxonomy.ids(), r["d"]).alias("id"), F.get(taxonomy.names(), r["d"]).alias("name"),
                (r["score10"] / 10).alias("score"), r["score10"].alias("score10"),
                F.when(i == 0, confidence).otherwise(other).cast("int").alias("confidence"),
                r["evidence"].alias("evidence"), r["anchors"].cast("int").alias("anchors"),
            )

        return F.transform(F.slice(domains, 1, top), row)

    return let(sure, rows)


def domain_scores(
    df: DataFrame, taxonomy: Taxonomy, text: Column, title: Column | None = None, major: Column | None = None,
    resume: bool = False, out: str = "domains", normal: bool = False,
) -> DataFrame:
    """All domains with a score: title hits weigh 1.85, major-text hits 1.55.

    ``normal`` says the texts are normalised already.
    """
    find = find_terms(taxonomy.words())
    fix = (lambda c: c) if normal else norm
    step = df.withColumns(
        {"__body_n": fix(text), "__title_n": fix(title) if title is not None else F.lit(None).cast("string"),
         "__major_n": fix(major) if major is not None else F.lit(None).cast("string")}
    )
    found = {"__bc": find(C("__body_n"))}
    found |= {"__tc": find(C("__title_n"))} if title is not None else {}
    found |= {"__mc": find(C("__major_n"))} if major is not None else {}
    # Search results are bound outside the lambdas that use them.
    hits = F.struct(
        C("__bc").alias("body"),
        (hit_ids(C("__tc")) if title is not None else F.lit(None)).alias("title"),
        (hit_ids(C("__mc")) if major is not None else F.lit(None)).alias("major"),
    )

    def score(h: Column) -> Column:
        items = _career_items(
            h["body"], h["title"] if title is not None else None, h["major"] if major is not None else None,
            by_word(taxonomy), 14 if resume else 5,
        )
        return let(items, lambda i: _per_domain(i, 12))

    return step.withColumns(found).withColumn(out, let(hits, score)).drop("__body_n", "__title_n", "__major_n", *found)


def classify(
    df: DataFrame, taxonomy: Taxonomy, text: Column, title: Column | None = None, resume: bool = False, out: str = "scores", normal: bool = False
) -> DataFrame:
    scored = domain_scores(df, taxonomy, text, title, major_window(text) if resume else None, resume, "__domains", normal)
    return scored.withColumn(out, classify_scores(C("__domains"), taxonomy)).drop("__domains")


def major_window(text: Column) -> Column:
    """First 20 non-blank lines that speak of a degree or field of study."""
    lines = F.filter(F.transform(F.split(text, "\n"), trim_all), lambda x: x != "")
    return F.array_join(F.slice(F.filter(lines, lambda x: x.rlike(vocab.MAJOR_LINE)), 1, 20), " ")


def tidy(c: Column) -> Column:
    """Spaces and tabs squeezed, newlines kept."""
    c = F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit(" ")), "[\t\r]+", " ")
    return trim_all(F.regexp_replace(c, " {2,}", " "))


def _header(line: Column) -> Column:
    value = trim_all(F.regexp_replace(tidy(line), r"[【】\[\]#*]", ""))

    def match(v: Column) -> Column:
        out = F.lit(-1)
        for number, (_, _, _, words) in reversed(list(enumerate(vocab.SECTIONS))):
            out = F.when(v.rlike(rf"(?i)^({words})\s*[:：]?$"), number).otherwise(out)
        return F.when(F.length(v) > 32, -1).otherwise(out)

    return let(value, match)


def split_sections(text: Column) -> Column:
    """array<struct<no, name, label, weight, text>>; weights in hundredths."""
    known = [*vocab.SECTIONS, (*vocab.OTHER_SECTION, "")]
    names, labels, weights = (F.lit([s[i] for s in known]) for i in (0, 1, 2))
    other = len(known) - 1

    def section(no: Column, body: Column) -> Column:
        return F.struct(
            no.alias("no"), F.get(names, no).alias("name"), F.get(labels, no).alias("label"), F.get(weights, no).alias("weight"), body.alias("text")
        )

    def cut(lines: Column) -> Column:
        def at(heads: Column) -> Column:
            marks = F.filter(F.transform(heads, lambda h, i: F.when(h >= 0, i).otherwise(-1)), lambda i: i >= 0)
            starts = F.concat(F.array(F.lit(-1)), marks)

            def piece(p: Column, k: Column) -> Column:
                until = F.coalesce(F.get(marks, k), F.size(lines))
                body = trim_all(F.array_join(F.slice(lines, p + 2, until - p - 1), "\n"))
                return section(F.when(p < 0, other).otherwise(F.get(heads, p)), body)

            return F.filter(F.transform(starts, piece), lambda s: s["text"] != "")

        return let(F.transform(lines, _header), at)

    found = let(F.split(text, "\n"), cut)
    whole = F.when(tidy(text) != "", F.array(section(F.lit(other), text)))
    return F.when(F.size(found) > 0, found).otherwise(whole)


def _career(codes: Column, majors: Column, lookup: Column, taxonomy: Taxonomy) -> Column:
    return let(
        _career_items(codes, None, hit_ids(majors), lookup, 14),
        lambda items: let(_per_domain(items, 12), lambda d: classify_scores(d, taxonomy)),
    )


def _domain_skills(scores: Column, codes: Column, lookup: Column) -> Column:
    """Present strong terms of the top four domains, longest first, at most 64."""
    generic = F.lit(vocab.PROFILE_GENERIC)
    ids = hit_ids(codes)

    def of(row: Column) -> Column:
        entries = F.flatten(F.transform(ids, lambda w: F.filter(F.get(lookup, w), lambda n: (n["d"] == row["d"]) & ~n["m"] & (n["w"] >= 5))))
        strong = F.filter(F.array_sort(entries), lambda n: ~F.array_contains(generic, F.lower(n["t"])))
        return F.transform(strong, lambda n: n["t"])

    words = F.array_distinct(F.flatten(F.transform(F.slice(scores, 1, 4), of)))
    return F.slice(longest_first(words), 1, 64)


def _core_skills(codes: Column, lookup: Column) -> Column:
    """Every core-taxonomy term present, longest first, at most 48."""
    entries = F.array_sort(F.flatten(F.transform(hit_ids(codes), lambda w: F.filter(F.get(lookup, w), lambda n: ~n["m"]))))
    return F.slice(longest_first(F.array_distinct(F.transform(entries, lambda n: n["t"]))), 1, 48)


def longest_first(words: Column) -> Column:
    keyed = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w"))))
    return F.transform(keyed, lambda k: k["w"])


def _roles(scores: Column, roles: Column, limit: int) -> Column:
    named = F.flatten(F.transform(F.slice(scores, 1, 4), lambda r: F.get(roles, r["d"])))
    return F.slice(F.array_distinct(F.filter(named, lambda x: x != "")), 1, limit)


def _ingested(weight: Column, label: Column, scores: Column, codes: Column, lookup: Column, roles: Column) -> Column:
    """What one text contributes to a section-aware profile."""
    skills = F.slice(F.array_distinct(F.concat(_domain_skills(scores, codes, lookup), _core_skills(codes, lookup))), 1, 72)
    return F.struct(
        weight.alias("weight"), label.alias("label"), scores.alias("scores"), _roles(scores, roles, 18).alias("roles"), skills.alias("skills")
    )


def section_profile(df: DataFrame, taxonomy: Taxonomy, text: Column, whole_weight: int = 72) -> DataFrame:
    """Whole text and sections scored apart and combined by section weight.

    Adds ``sections``, ``career`` (scores of the whole text alone), ``domains``
    (top six of the combination), ``recommended_roles`` and ``skills``.
    """
    find, find_all = find_terms(taxonomy.words()), find_each(taxonomy.words())
    lookup, roles = by_word(taxonomy), F.lit([list(d.roles) or [""] for d in taxonomy.domains])
    step = (
        df.withColumn("__text", text)
        .withColumn("sections", split_sections(C("__text")))
        .withColumn("__long", F.filter("sections", lambda s: F.length(tidy(s["text"])) >= 12))
        .withColumn("__norm", norm(C("__text")))
        .withColumn("__window", norm(major_window(C("__text"))))
        .withColumn("__parts", F.transform("__long", lambda s: F.coalesce(norm(s["text"]), F.lit(""))))
        .withColumn("__windows", F.transform("__long", lambda s: F.coalesce(norm(major_window(s["text"])), F.lit(""))))
        .withColumns({"__c": find(C("__norm")), "__m": find(C("__window")), "__cs": find_all(C("__parts")), "__ms": find_all(C("__windows"))})
    )

    # The whole text goes first, then its sections; every text is a struct of
    # its weight, label and search results, so lambdas see nothing from outside.
    def text_of(weight: Column, label: Column, codes: Column, majors: Column) -> Column:
        return F.struct(weight.alias("weight"), label.alias("label"), codes.alias("codes"), majors.alias("majors"))

    zipped = F.arrays_zip("__long", "__cs", "__ms")
    parts = F.transform(zipped, lambda z: text_of(z["__long"]["weight"], z["__long"]["label"], z["__cs"], z["__ms"]))
    texts = F.concat(F.array(text_of(F.lit(whole_weight), F.lit("全文"), C("__c"), C("__m"))), parts)

    def contribution(t: Column) -> Column:
        return let(
            _career(t["codes"], t["majors"], lookup, taxonomy),
            lambda scores: _ingested(t["weight"], t["label"], scores, t["codes"], lookup, roles),
        )

    step = step.withColumn("__all", F.transform(texts, contribution))

    votes = F.flatten(F.transform("__all", lambda g: F.transform(g["roles"], lambda r: F.struct(r.alias("r"), g["weight"].cast("bigint").alias("v")))))
    rows = F.flatten(
        F.transform(
            "__all",
            lambda g: F.transform(
                g["scores"],
                lambda r: F.struct(
                    r["d"].alias("d"), (r["score10"] * g["weight"]).alias("v"),
                    F.transform(r["evidence"], lambda e: F.concat(g["label"], F.lit(":"), e)).alias("evidence"),
                ),
            ),
        )
    )

    def combine(items: Column) -> Column:
        def one(d: Column) -> Column:
            return let(
                F.filter(items, lambda x: x["d"] == d),
                lambda own: F.struct(
                    (-_total(own, "v")).alias("neg"), d.alias("d"),
                    F.slice(F.array_distinct(F.flatten(F.transform(own, lambda x: x["evidence"]))), 1, 10).alias("evidence"),
                ),
            )

        ranked = F.array_sort(F.transform(F.array_distinct(F.transform(items, lambda x: x["d"])), one))
        return F.slice(F.filter(ranked, lambda r: r["neg"] < 0), 1, 6)

    def finish(ranked: Column) -> Column:
        peak = F.get(ranked, F.lit(0))["neg"]

        def row(r: Column, i: Column) -> Column:
            share = r["neg"] / peak * F.when(i == 0, 1.0).otherwise(0.94)
            sure = F.greatest(F.lit(20), F.least(F.lit(97), round_half_up(36 + 61 * share)))
            return F.struct(
                r["d"].alias("d"), F.get(taxonomy.ids(), r["d"]).alias("id"), F.get(taxonomy.names(), r["d"]).alias("name"),
                (F.floor((-r["neg"] + 50) / 100) / 10).alias("score"), sure.cast("int").alias("confidence"), r["evidence"].alias("evidence"),
            )

        return F.transform(ranked, row)

    def ranked_roles(all_votes: Column) -> Column:
        def tally(r: Column, i: Column) -> Column:
            return F.struct((-_total(F.filter(all_votes, lambda v: v["r"] == r), "v")).alias("n"), i.alias("i"), r.alias("r"))

        counted = F.array_sort(F.transform(F.array_distinct(F.transform(all_votes, lambda v: v["r"])), tally))
        return F.slice(F.transform(counted, lambda t: t["r"]), 1, 14)

    skills = F.slice(F.array_distinct(F.flatten(F.transform("__all", lambda g: g["skills"]))), 1, 64)
    step = step.withColumns({"career": F.get("__all", F.lit(0))["scores"], "domains": let(let(rows, combine), finish), "recommended_roles": let(votes, ranked_roles), "skills": skills})
    return step.drop(*[c for c in step.columns if c.startswith("__")])


def extract_skills(df: DataFrame, taxonomy: Taxonomy, text: Column, out: str = "skills") -> DataFrame:
    """Skills of the whole text alone (before sections add theirs)."""
    lookup = by_word(taxonomy)
    step = df.withColumns({"__norm": norm(text), "__window": norm(major_window(text))})
    find = find_terms(taxonomy.words())
    hits = F.struct(find(C("__norm")).alias("codes"), find(C("__window")).alias("majors"))

    def skills(h: Column) -> Column:
        return let(
            _career(h["codes"], h["majors"], lookup, taxonomy),
            lambda s: F.array_distinct(F.concat(_domain_skills(s, h["codes"], lookup), _core_skills(h["codes"], lookup))),
        )

    return step.withColumn(out, F.slice(let(hits, skills), 1, 72)).drop("__norm", "__window")


def keyword_tokens(text: Column) -> Column:
    """Latin words of the normalised text, then runs of Han characters, in order."""
    latin = F.regexp_extract_all(F.coalesce(norm(text), F.lit("")), F.lit(f"({vocab.LATIN_WORD})"), F.lit(1))
    han = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({vocab.HAN_RUN})"), F.lit(1))
    stop_latin, stop_han = F.lit(vocab.LATIN_STOP), F.lit(vocab.HAN_STOP)
    return F.concat(
        F.filter(latin, lambda w: ~F.array_contains(stop_latin, w)), F.filter(han, lambda w: ~F.array_contains(stop_han, w))
    )


def keywords(df: DataFrame, key: str, text: Column, n: int = 60) -> DataFrame:
    """``(key, keywords)``: the n most frequent words, first seen first."""
    words = df.select(key, F.posexplode(keyword_tokens(text)).alias("pos", "word"))
    counted = words.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    w = Window.partitionBy(key).orderBy(C("n").desc(), "pos")
    top = counted.withColumn("rank", F.row_number().over(w)).filter(C("rank") <= n)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))


def clean_resume(text: Column) -> Column:
    """Text as stored: blanks squeezed, blank lines at most one, capped."""
    c = F.regexp_replace(F.replace(text, F.lit("\x00"), F.lit(" ")), "[ \t]+", " ")
    return trim_all(F.regexp_replace(c, "\n{3,}", "\n\n"))


def display_name(text: Column, file_name: Column) -> Column:
    """First of eight lines that is a short Han name, else the file's stem."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), trim_all), lambda x: x != ""), 1, 8)
    name = F.get(F.filter(lines, lambda x: x.rlike(r"^[\x{4e00}-\x{9fa5}·]{2,6}$")), F.lit(0))
    return F.coalesce(name, F.regexp_replace(file_name, r"(?i)\.(pdf|docx|txt)$", ""))


def profile(df: DataFrame, taxonomy: Taxonomy, key: str = "profile_id", text: str = "text", file_name: str = "file_name") -> DataFrame:
    """Everything known about a résumé, one row per résumé."""
    base = df.withColumn("raw", clean_resume(C(text)))
    scored = section_profile(base, taxonomy, C("raw"))
    found = scored.withColumns(
        {
            "display_name": display_name(C("raw"), C(file_name)),
            "degree": signals.infer_degree(C("raw")),
            "graduation_year": signals.graduation_year(C("raw")),
            "cities": F.slice(F.filter(F.lit(vocab.PROFILE_CITIES), lambda c: C("raw").contains(c)), 1, 16),
            "quality": profile_quality(C("raw"), C("sections"), C("domains")),
        }
    )
    words = keywords(base, key, C("raw"))
    return found.join(words, key, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def profile_quality(text: Column, sections: Column, domains: Column) -> Column:
    named = F.size(F.filter(sections, lambda s: s["name"] != vocab.OTHER_SECTION[0]))
    evidence = F.aggregate(domains, F.lit(0), lambda acc, d: acc + F.size(d["evidence"]))
    label = F.when((named >= 4) & (evidence >= 8), "clear").when((named >= 2) & (evidence >= 4), "usable").otherwise("check")
    return F.struct(
        F.length(tidy(text)).alias("chars"), named.alias("sections"), evidence.alias("evidence"), F.size(domains).alias("domains"), label.alias("label")
    )
