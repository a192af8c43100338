"""Registered queries: an experiment of two chunk sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments
from ..registry import query
from ..sources import tables
from ..sources.tables import stored
from .retrieval import _relevant, questions

EXPERIMENT = experiments.Experiment("chunk-size", experiments.Variant("600", {"chunk_size": 600, "overlap": 60, "top_k": 10}), experiments.Variant("800", {"top_k": 10}))


def _cases(spark, sf):
    docs, relevant = tables.documents(spark, sf), stored(_relevant(spark, sf), "relevant")
    return [stored(experiments.variant_cases(v, docs, questions(spark, sf), relevant), "cases") for v in (EXPERIMENT.baseline, EXPERIMENT.candidate)]


@query("experiment_report")
def experiment_report(spark, sf):
    """Chunks of 600 characters against 800, each in an index of its own."""
    return experiments.compare(EXPERIMENT, *_cases(spark, sf))


@query("experiment_failures")
def experiment_failures(spark, sf):
    """Both variants side by side: the cases that either fails."""
    a, b = _cases(spark, sf)
    both = a.select("query_id", F.col("passed").alias("baseline_passed")).join(b.select("query_id", F.col("passed").alias("candidate_passed")), "query_id", "full_outer")
    return both.withColumn("change", F.when(F.col("baseline_passed") & ~F.col("candidate_passed"), "regressed").when(~F.col("baseline_passed") & F.col("candidate_passed"), "mended").otherwise("same"))
