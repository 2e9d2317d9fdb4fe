"""One thin query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import hnsw, html_main, imatch, langid, merkle, minhash, mixing, packing, quality_model, quality_rules, runs, toxicity, warc
from .common import fold, scratch_path, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


OP1_SQL = """
with rows as (select page_id, coalesce(html, '') as h from pages),
told as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha1(h) as payload_digest from rows),
held as (select payload_digest, payload_bytes, max(page_id) as holder from told where payload_bytes >= 1000 group by 1, 2 having count(*) > 1)
select page_id, payload_bytes, payload_digest, case when page_id <> holder then 'revisit' else 'response' end as record_type,
  case when page_id <> holder then holder end as refers_to
from told left join held using (payload_digest, payload_bytes)
"""


@query(OP1_SQL)
def op1_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "archive"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(quality_rules.oracle_sql())
def op2_threshold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


OP3_SQL = """
with recursive
fine as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from fine a join fine b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
reach(x, y) as (
  select vec_id, vec_id from embeddings
  union
  select r.x, l.y from reach r join links l on r.y = l.x),
part as (select x as vec_id, min(y) as component_id from reach group by x)
select vec_id, (select count(*) from links where x = vec_id) as n_links, component_id, vec_id = component_id as kept from part
"""


@query(OP3_SQL)
def op3_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op4_segmentation_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))
    model = langid.fit(docs.where(~F.col("held_out")), langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model, min_tasks=cores(spark)).drop("text")


@query()
def op5_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(labels.doc_id, 4) != 2))
    return toxicity.predict(docs.select("doc_id", "held_out", "text"), model, min_tasks=cores(spark)).drop("text")


@query(mixing.oracle_sql())
def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "tokens", "epoch", "block", "block_rank")


@query()
def op7_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)))
    labels = table(spark, sf_dir, "labels")
    model = quality_model.fit(docs, labels.where(fold(labels.doc_id, 5) != 0))
    return quality_model.predict(docs.select("doc_id", "held_out", "text"), model, min_tasks=cores(spark)).drop("text")


OP8_SQL = r"""
with recursive
words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) else w end as s from words),
shingle as (select doc_id, unnest(s) as g, len(s) as n from sets),
-- linked sets differ in at most a fifth of their union, so they share one of the rarest shingles kept here
ranked as (
  select doc_id, g, n, row_number() over (partition by doc_id order by f, g) as r
  from (select *, count(*) over (partition by g) as f from shingle)),
prefix as (select * from ranked where r <= n - ceil(0.8 * n) + 1),
pairs as (
  select distinct a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny from prefix a join prefix b on a.g = b.g and a.doc_id < b.doc_id
  where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
common as (
  select x, y, any_value(nx) as nx, any_value(ny) as ny, count(*) as c
  from pairs join shingle a on a.doc_id = x join shingle b on b.doc_id = y and a.g = b.g group by x, y),
links as (select x, y from common where 100 * c >= 80 * (nx + ny - c)),
both_ways as (select x, y from links union all select y, x from links),
reach(x, y) as (
  select doc_id, doc_id from documents
  union
  select r.x, b.y from reach r join both_ways b on r.y = b.x),
part as (select x, min(y) as component_id from reach group by x)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from sets join part on x = doc_id
"""


@query(OP8_SQL)
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80, min_tasks=cores(spark))


@query()
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), min_tasks=cores(spark))


@query()
def op10_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"), min_tasks=cores(spark))


OP11_SQL = r"""
with recursive
table_of as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as crcs from range(256) t(i)),
told as (
  select doc_id, source, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])) as inverse,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
    text, replace(text, chr(10), '') as bare
  from documents, table_of),
leaves as (
  select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(head || case when xor(inverse, 4294967295) % 2 = 0 then coalesce(strlen(bare) || ':' || bare, '-') else coalesce(strlen(text) || ':' || text, '-') end) as seen
  from told),
placed as (
  select *, row_number() over () as id, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by source) as n from leaves),
nodes as (
  select source, 0::bigint as level, place, leaf as hash, n from placed
  union all
  select source, level + 1, place // 3, sha256(string_agg(hash, '' order by place)), (any_value(n) + 2) // 3 from nodes where n > 1 group by source, level, place // 3),
sides as (
  select *, coalesce(string_agg(hash, '') over (partition by source, level, place // 3 order by place rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(hash, '') over (partition by source, level, place // 3 order by place rows between 1 following and unbounded following), '') as r from nodes),
walk as (
  select id, doc_id, leaf, source, 0::bigint as level, place, seen as held, '' as proof from placed
  union all
  select id, doc_id, leaf, w.source, w.level + 1, w.place // 3, sha256(l || held || r), proof || l || r
  from walk w join sides s on w.source is not distinct from s.source and w.level = s.level and w.place = s.place where s.n > 1),
subroots as (select source, level, hash as subroot, row_number() over (order by source nulls first) - 1 as rank, count(*) over () as k from nodes where n = 1),
crown as (
  select 0::bigint as level, rank as place, subroot as hash, k as n from subroots
  union all
  select level + 1, place // 3, sha256(string_agg(hash, '' order by place)), (any_value(n) + 2) // 3 from crown where n > 1 group by level, place // 3),
over_sides as (
  select *, coalesce(string_agg(hash, '') over (partition by level, place // 3 order by place rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(hash, '') over (partition by level, place // 3 order by place rows between 1 following and unbounded following), '') as r from crown),
climb as (
  select id, doc_id, leaf, subroot, 0::bigint as level, rank as place, held, proof from walk w join subroots s on w.source is not distinct from s.source and w.level = s.level
  union all
  select id, doc_id, leaf, subroot, c.level + 1, c.place // 3, sha256(l || held || r), proof || l || r from climb c join over_sides s on c.level = s.level and c.place = s.place where s.n > 1)
select doc_id, leaf, subroot, hash as root, sha256(proof) as proof_sha256, held as folded_root, held = hash as verified
from climb join crown on n = 1 and climb.level = crown.level
"""


@query(OP11_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.without_line_ends(table(spark, sf_dir, "documents"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True, min_tasks=cores(spark))


@query(imatch.oracle_sql())
def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_edited(table(spark, sf_dir, "documents"), min_tasks=cores(spark))
