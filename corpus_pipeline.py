"""From raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result to the shared folder and reads it back for the next. All
but the last return the columns of ``documents``. Models learn only from
labelled documents of the training folds that their operators' queries use.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobweave.llm import langid, minhash, mixing, packing, quality_model
from jobweave.llm.common import fold, scratch_path, table

#: A document whose language leads the others by no more than this share is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: A document less likely of good quality than this is rejected.
LEAST_QUALITY = 0.3


def _cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language go; ``lang`` stays what the corpus says."""
    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = langid.fit(docs.where(fold(docs.doc_id, 4) != 2), pieces)
    judged = langid.predict(docs, model, min_tasks=_cores(spark))
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rates low go."""
    labels = table(spark, sf_dir, "labels")
    model = quality_model.fit(docs, labels.where(fold(labels.doc_id, 5) != 0))
    return quality_model.predict(docs, model, LEAST_QUALITY, min_tasks=_cores(spark)).where("predicted = 1").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8)."""
    decided = minhash.near_duplicates(docs, words=5, percent=80, min_tasks=_cores(spark))
    return docs.join(decided.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, at tempered source weights; documents of small sources come once an epoch."""
    return mixing.mix(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset; a document taken twice is packed twice."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), min_tasks=_cores(spark))


STAGES = [("language_id", language_id), ("quality", quality), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]
#: Models and tokens can't be stated in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = scratch_path(spark, name)
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
