"""I-Match fingerprints: terms of a document-frequency band, hashed over randomised lexicon subsets.

The lexicon holds the terms found in more than ``RARE`` and at most ``COMMON``
of all documents (an inverse document frequency between ln 8 and ln 256).
Subsets are nested in ``SERIES`` independent series: the subset of depth k
(``FIRST`` to ``DEPTH``) of a series keeps a term with probability 2^-k, by the
term's own hash. A
fingerprint has one hash a subset: that of the sorted distinct terms that the
text and the subset share. Dense subsets tell near-equal texts apart, sparse
ones still agree after large edits, for short and long texts alike. Documents
that share no term with a subset have ``EMPTY`` there.

A term of the lexicon occurs in more than ``RARE`` of the documents, so the
lexicon has fewer than (mean distinct terms of a document) / RARE terms, however
many documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, narrow, parallel, stage
from .ordering import numbered

#: Shares of documents between which a term belongs to the lexicon.
RARE, COMMON = 1 / 256, 1 / 8
SERIES, FIRST, DEPTH = 6, 4, 11
SUBSETS = SERIES * (DEPTH - FIRST + 1)
EMPTY = "00000000"
WIDTH = len(EMPTY)
#: Characters that separate terms like white space does.
MARKS = ".,;:!?\"'()[]{}<>/|"
#: The lexicon is broadcast up to this number of terms and joined by a shuffle beyond.
LEXICON_TERMS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """The distinct terms of a text: lower-case words without the marks around and between them."""
    plain = F.translate(text, UPPER + MARKS, LOWER + " " * len(MARKS))
    return F.array_remove(F.array_distinct(F.split(plain, SPACE)), "")


def _depths(term: Column) -> Column:
    """Per series the deepest subset that keeps the term (0: none), four bits each."""
    packed = F.lit(0)
    for s in range(SERIES):
        draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{s}:"), term).cast("binary")), 1, 3), 16, 10).cast("int")
        # a draw below 2^(12 - k) of 2^12 has at most 12 - k binary digits
        depth = F.when(draw == 0, DEPTH).otherwise(F.least(F.lit(DEPTH), 12 - F.length(F.bin(draw))))
        packed = packed + depth * (16**s)
    return packed.cast("int")


def lexicon(docs: DataFrame, rare: float = RARE, common: float = COMMON) -> DataFrame:
    """(term, depths) of the terms in more than ``rare`` and at most ``common`` of the rows of ``docs`` (text)."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("found"))
    banded = counts.where((F.col("found") > F.lit(rare * n)) & (F.col("found") <= F.lit(common * n)))
    return stage(banded.select("term", _depths(F.col("term")).alias("depths")), "lexicon")


def _kept(lists: Column, depth: int) -> Column:
    """Of each list (one per text and series) the entries that the series' subset of this depth keeps."""

    def keeps(series: Column):
        return lambda e: F.call_function("shiftright", e["depths"], series * 4).bitwiseAND(15) >= depth

    return F.transform(lists, lambda entries, i: F.filter(entries, keeps(i % SERIES)))


def _sided(text: str, side: int) -> Column:
    return F.transform(terms(F.col(text)), lambda t: F.struct(F.lit(side).alias("side"), t.alias("term"), F.lit(None).cast("string").alias("with")))


def _hashed(entries: Column) -> Column:
    listed = F.array_join(F.transform(entries, lambda e: e["term"]), " ")
    return F.when(F.size(entries) == 0, F.lit(EMPTY)).otherwise(F.substring(F.md5(listed.cast("binary")), 1, WIDTH))


def with_prints(docs: DataFrame, words: DataFrame, keys: list[str], texts: dict[str, str], carried: str) -> DataFrame:
    """``keys``, ``carried`` and, per text column, its fingerprint as bytes; ``texts`` maps text columns to result columns.

    ``keys`` identify a row. Where the rows are already dealt by the first key,
    the terms come back together without another shuffle. A row goes through
    that gathering once a term, so only the keys go with it; the carried string
    goes with the empty term, which stands for the row itself.
    """
    sides = list(texts)
    itself = F.array(F.struct(F.lit(-1).alias("side"), F.lit("").alias("term"), F.col(carried).alias("with")))
    listed = F.concat(itself, *[_sided(c, s) for s, c in enumerate(sides)])
    single = docs.select(*keys, F.explode(listed).alias("_e")).select(*keys, "_e.side", "_e.term", "_e.with")
    known = words.unionByName(words.sparkSession.createDataFrame([("", 0)], words.schema))
    known = F.broadcast(known) if words.count() <= LEXICON_TERMS else known
    entry = F.struct("term", "depths")
    lists = [F.array_repeat(F.array_sort(F.collect_list(F.when(F.col("side") == s, entry))), SERIES) for s in range(len(sides))]
    now = single.join(known, "term").groupBy(*keys).agg(F.max("with").alias(carried), F.concat(*lists).alias("_lists"))
    for k in range(FIRST, DEPTH + 1):  # each subset is filtered from the one that holds it
        now = now.withColumn("_lists", _kept(F.col("_lists"), k)).withColumn(f"_h{k}", F.transform("_lists", _hashed))
    prints = [F.concat(*[F.slice(f"_h{k}", 1 + s * SERIES, SERIES) for k in range(FIRST, DEPTH + 1)]) for s in range(len(sides))]
    return now.select(*keys, carried, *[F.unhex(F.array_join(p, "")).alias(texts[c]) for c, p in zip(sides, prints, strict=True)])


def shown(prints: Column) -> Column:
    return F.lower(F.hex(prints))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either fingerprint (hexadecimal) has a term; 1 if none has."""
    both = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: F.struct(F.substring(a, k * WIDTH + 1, F.lit(WIDTH)).alias("a"), F.substring(b, k * WIDTH + 1, F.lit(WIDTH)).alias("b")))
    used = F.filter(both, lambda x: (x["a"] != EMPTY) | (x["b"] != EMPTY))
    return F.when(F.size(used) == 0, F.lit(1.0)).otherwise(F.size(F.filter(used, lambda x: x["a"] == x["b"])) / F.size(used))


def compare_with_edited(docs: DataFrame, rare: float = RARE, common: float = COMMON, min_tasks: int = 0) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its text after an edit, and their likeness.

    The edit replaces the last quarter of the code points (rounded down) by the
    first as many of the next document, or all it has; documents ascend by
    doc_id (null first), those of one doc_id by the hash of id and text, and the
    first follows the last. Repeated rows follow each other; a row alone is its
    own successor. Null texts count as empty: their fingerprint has no term.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. No rows give no rows; extra columns are ignored.

    Each text is dealt once, by its own key. Only heads of texts, as long as
    the document before needs them, travel to another key.
    """
    rows = parallel(narrow(docs, "doc_id", "text"), min_tasks).withColumn("text", F.coalesce("text", F.lit("")))
    told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))
    keyed = rows.withColumn("key", F.unhex(F.md5(told.cast("binary"))))
    words = lexicon(rows, rare, common)
    facts = keyed.groupBy("key", "doc_id").agg(F.count("*").cast("int").alias("copies"), F.first(F.length("text")).alias("n_chars"))
    facts = stage(numbered(facts, "doc_id", "key"), "facts")
    n = facts.count()
    ahead = facts.select(((F.col("position") + n - 1) % max(n, 1)).alias("position"), F.col("key").alias("next_key"))
    order = stage(facts.join(ahead, "position").drop("position"), "order")
    tail = F.expr("n_chars div 4")
    dealt = keyed.select("key", "text").repartition("key")
    wanted = order.select(F.col("next_key").alias("key"), F.col("key").alias("to"), tail.alias("need")).where("need > 0")
    heads = dealt.join(wanted, "key").select(F.col("to"), F.substring("text", F.lit(1), F.col("need")).alias("head")).groupBy("to").agg(F.first("head").alias("head"))
    known = dealt.join(order.select("key", "copies", tail.alias("tail")), "key").join(heads, F.col("key") == F.col("to"), "left").drop("to")
    known = known.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))))
    follows = F.when(F.col("copy") == F.col("copies"), F.coalesce("head", F.lit(""))).otherwise(F.substring("text", F.lit(1), F.col("tail")))
    edited = known.select("key", "copy", "text", F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("tail")), follows).alias("edited"))
    edited = edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    prints = stage(with_prints(edited, words, ["key", "copy"], {"text": "own", "edited": "changed"}, "edited_sha256"), "prints")
    next_one = F.when(F.col("copy") == F.col("copies"), F.col("next_key")).otherwise(F.col("key")).alias("next_key")
    linked = prints.join(order, "key").select(next_one, "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "own", "changed")
    joined = linked.join(prints.where("copy = 1").select(F.col("key").alias("next_key"), F.col("own").alias("next")), "next_key")
    hexed = joined.select("doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"), shown(F.col("next")).alias("next"))
    return hexed.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))


def oracle_sql(rare: float = RARE, common: float = COMMON) -> str:
    """The same over the table documents, for DuckDB."""
    marks = (UPPER + MARKS).replace("'", "''")

    def split(column: str) -> str:
        return f"list_filter(list_distinct(regexp_split_to_array(translate({column}, '{marks}', '{LOWER}{' ' * len(MARKS)}'), '{SPACE}')), lambda x: x <> '')"

    draws = ", ".join(f"case when substr(md5('{s}:' || term), 1, 3) = '000' then {DEPTH} else least({DEPTH}, 11 - floor(log2(('0x' || substr(md5('{s}:' || term), 1, 3))::int))::int) end as d{s}" for s in range(SERIES))
    hashes = ", ".join(f"coalesce(substr(md5(string_agg(term, ' ' order by term) filter (where d{r} >= {k})), 1, {WIDTH}), '{EMPTY}')" for k in range(FIRST, DEPTH + 1) for r in range(SERIES))
    slots = [f"substr({{0}}, {1 + WIDTH * k}, {WIDTH})" for k in range(SUBSETS)]

    def near(a: str, b: str) -> str:
        used = " + ".join(f"({s.format(a)} <> '{EMPTY}' or {s.format(b)} <> '{EMPTY}')::int" for s in slots)
        same = " + ".join(f"({s.format(a)} <> '{EMPTY}' and {s.format(a)} = {s.format(b)})::int" for s in slots)
        return f"case when {used} = 0 then 1.0 else ({same})::double / ({used}) end"

    return f"""
with rows as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id nulls first, md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, ''))) as p from documents),
next as (select *, coalesce(lead(p) over (order by p), 1) as q, coalesce(lead(text) over (order by p), first(text) over (order by p)) as follows from rows),
edits as (select p, q, doc_id, length(text) as n_chars, text, substr(text, 1, length(text) - length(text) // 4) || substr(follows, 1, length(text) // 4) as edited from next),
counts as (select term, count(*) as found from (select unnest({split('text')}) as term from rows) group by term),
lexicon as (select term, {draws} from counts where found > {rare!r} * (select count(*) from rows) and found <= {common!r} * (select count(*) from rows)),
both_texts as (select p, 0 as side, unnest({split('text')}) as term from edits union all select p, 1, unnest({split('edited')}) from edits),
prints as (select p, side, concat({hashes}) as print from both_texts join lexicon using (term) group by p, side),
told as (
  select e.p, q, doc_id, n_chars, edited, coalesce(a.print, repeat('{EMPTY}', {SUBSETS})) as fingerprint, coalesce(b.print, repeat('{EMPTY}', {SUBSETS})) as edited_fingerprint
  from edits e left join prints a on a.p = e.p and a.side = 0 left join prints b on b.p = e.p and b.side = 1)
select t.doc_id, t.n_chars, sha256(t.edited) as edited_sha256, t.fingerprint, t.edited_fingerprint,
  {near('t.fingerprint', 't.edited_fingerprint')} as near_edited, {near('t.fingerprint', 'u.fingerprint')} as near_next
from told t join told u on u.p = t.q
"""
