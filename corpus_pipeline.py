"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns
a DataFrame; all but the last return the columns of ``documents``. ``run`` writes every
stage as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, decontaminate, langid, lines, similar
from lexmill.llm.common import materialize
from lexmill.llm.queries import BPE_RANKS, PIECES

#: No stage is plain SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones included); of the rest ``lang`` becomes the predicted language."""
    model = langid.fit(docs, langid.sentencepiece_vocabulary(public_tokenizers.path(PIECES)))
    told = langid.predict(docs, model, out=("_lang_pred", "_lang_score")).where(F.col("_lang_pred") != langid.UNDETERMINED)
    return told.withColumn("lang", F.col("_lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites ``text`` without recurring lines; ``n_chars`` follows. No document goes."""
    return lines.rewrite(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate component: five-word shingles, similarity 0.8 or more.

    Texts are linked through deletion variants of SimHash fingerprints and verified; an exact step compares those that this leaves apart.
    """
    return similar.keep_one_of_similar(docs, shingle_words=5, similarity=0.8).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a verified benchmark passage."""
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of each kept document."""
    return bpe.token_digests(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
