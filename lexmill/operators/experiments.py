"""Experiments: two variants of chunking and retrieval over the same questions, each with an index of its own, compared."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunking, evaluation, retrieval

#: What a variant may set, and other names for sizes of chunks.
PARAMETERS = set("chunking chunk_size overlap overlap_chars embedding_model embedding_dimensions retrieval top_k bm25_top_k vector_top_k rrf_k rerank rerank_model rerank_top_k final_top_k score_threshold metadata_filters prompt_version prompt_text".split())
CHUNK_ALIASES = {"chunk_size": "target_chars", "overlap": "overlap_chars", "overlap_chars": "overlap_chars"}
CHUNK_SIZES = {"target_chars": "target", "min_chars": "least", "max_chars": "most", "overlap_chars": "overlap"}
#: Metrics of which less is better.
LOWER_IS_BETTER = ("latency", "average_latency", "p50_latency_ms", "p95_latency_ms", "cost", "average_cost", "hallucination_rate")


@dataclass(frozen=True)
class Variant:
    name: str
    parameters: dict = field(default_factory=dict)

    def __post_init__(self):
        if unknown := sorted(set(self.parameters) - PARAMETERS):
            raise ValueError(f"unsupported experiment parameters: {unknown}")
        if not _finite(self.parameters):
            raise ValueError("parameters must be finite numbers")

    def chunks(self, base: chunking.ChunkConfig = chunking.ChunkConfig()) -> chunking.ChunkConfig:
        """The sizes of the base with the variant's own, whichever names they go by."""
        own = dict(self.parameters.get("chunking", {})) | {CHUNK_ALIASES[k]: v for k, v in self.parameters.items() if k in CHUNK_ALIASES}
        if unknown := sorted(set(own) - set(CHUNK_SIZES)):
            raise ValueError(f"unsupported chunking parameters: {unknown}")
        sizes = {k: getattr(base, k) for k in CHUNK_SIZES.values()} | {CHUNK_SIZES[k]: int(v) for k, v in own.items()}
        return chunking.ChunkConfig(**sizes)

    def depth(self) -> int:
        """How many hits are kept: the final depth, or the one that stands for all."""
        return int(self.parameters.get("final_top_k", self.parameters.get("top_k", retrieval.DEPTHS["final"])))


def _finite(value) -> bool:
    if isinstance(value, dict):
        return all(map(_finite, value.values()))
    if isinstance(value, list | tuple):
        return all(map(_finite, value))
    return not isinstance(value, float) or math.isfinite(value)


@dataclass(frozen=True)
class Experiment:
    name: str
    baseline: Variant
    candidate: Variant
    tolerance: float = 0.0
    lower_is_better: tuple[str, ...] = LOWER_IS_BETTER

    def __post_init__(self):
        names = [n.strip() for n in self.lower_is_better]
        if self.baseline.name == self.candidate.name:
            raise ValueError("baseline and candidate names must be different")
        if not math.isfinite(self.tolerance) or self.tolerance < 0:
            raise ValueError("the tolerance must be a finite number from 0 up")
        if "" in names or len(set(names)) < len(names):
            raise ValueError("names of metrics must not be blank or repeated")


def variant_cases(variant: Variant, docs: DataFrame, questions: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, recall, hit, mrr, passed) of keyword search over the variant's own chunks, judged by documents (query_id, doc_id)."""
    chunks = chunking.chunk_documents(docs, variant.chunks()).select("chunk_id", "doc_id", "section_title", "content")
    # Texts are cut once: the index keeps the document of each chunk.
    index = retrieval.keyword_index(chunks, "chunk_id", F.concat_ws(" ", "section_title", "content"), keep=("doc_id",))
    depth = variant.depth()
    hits = retrieval.bm25(questions, index, depth).join(index["words"].select("id", "doc_id"), "id")
    found = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")).join(relevant, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("wanted"))
    m = questions.select("query_id").join(wanted, "query_id", "left").join(found, "query_id", "left")
    none, got = F.col("wanted").isNull(), F.coalesce("found", F.lit(0))
    recall = F.when(none, 1.0).otherwise(got / F.col("wanted"))
    return m.select("query_id", F.round(recall, 6).alias("recall"), F.when(none | (got > 0), 1.0).otherwise(0.0).alias("hit"), F.round(F.when(none, 1.0).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), (recall == 1).alias("passed"))


def case_changes(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(query_id, baseline_passed, new_regression) of cases that the candidate fails. Both must have the same cases: a case of one side alone raises."""
    both = baseline.select("query_id", F.col("passed").alias("baseline_passed")).join(candidate.select("query_id", F.col("passed").alias("candidate_passed")), "query_id", "full_outer")
    one_sided = F.col("baseline_passed").isNull() | F.col("candidate_passed").isNull()
    checked = F.when(one_sided, F.raise_error(F.concat(F.lit("only one variant has case "), F.col("query_id").cast("string"))).cast("boolean")).otherwise(F.col("candidate_passed"))
    return both.withColumn("candidate_passed", checked).where("not candidate_passed").select("query_id", "baseline_passed", F.col("baseline_passed").alias("new_regression"))


def compare(experiment: Experiment, baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, baseline, candidate, delta, regressed, conclusion) of two tables of cases."""
    sums = lambda cases: cases.agg(*[F.round(F.avg(m), 6).alias(m) for m in ("recall", "hit", "mrr")]).unpivot([], ["recall", "hit", "mrr"], "metric", "value")
    told = evaluation.compare(sums(baseline), sums(candidate), experiment.tolerance, experiment.lower_is_better)
    failed = case_changes(baseline, candidate).agg(F.count("*").alias("failed"))
    worse = told.agg(F.bool_or("regressed").alias("any"))
    said = F.when(F.col("any"), F.format_string("Regression detected. Review regressed metrics and %d candidate failed case(s) before promotion.", "failed")).otherwise("No configured metric or failed-case regression was detected.")
    one = worse.crossJoin(failed).select(said.alias("conclusion"))  # one row
    return told.crossJoin(one)
