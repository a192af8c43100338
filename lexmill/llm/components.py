"""Connected components by alternating star contraction (Kiveris et al., 2014).

Edges stay distributed. Each round is two aggregations and two equi-joins. A node
with very many neighbours is pre-aggregated, and its edges meet its least neighbour without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_join, map_batches, materialize

#: Edges that one task of ``thin_edges`` looks at together.
FOREST_EDGES = 20_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return hot_join(both, least, ["u"], "n", total=2 * edges.count()).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``pairs`` that join two parts not yet joined by the ones before: the same components, fewer pairs than nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kept = []
    for u, v in pairs:
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((u, v))
    return kept


def thin_edges(edges: DataFrame) -> DataFrame:
    """(u, v): ``edges`` without those that only close circles within a block of ``FOREST_EDGES``; components stay the same.

    Blocks are cut where neighbouring u's are together, so a dense group shrinks to a few edges a node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            while len(held) >= FOREST_EDGES:
                yield rows(held[:FOREST_EDGES])
                del held[:FOREST_EDGES]
        yield rows(held)

    def rows(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        kept = forest(pairs)
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["u", "v"])

    now = materialize(edges.select("u", "v").where("u <> v"), "links")
    parts = -(-now.count() // FOREST_EDGES) or 1
    return now.repartitionByRange(parts, "u", "v").transform(map_batches, run, "u long, v long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v); component is the smallest reachable node.

    Null ends and self-loops are ignored; nodes without an edge are not returned;
    an empty edge table gives an empty result.
    """
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    stamp = None
    for _ in range(max_rounds):
        large = materialize(_large_star(now), "large")
        discard(now)
        now = materialize(_small_star(large), "stars")
        discard(large)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == stamp or new[0] == 0:
            break
        stamp = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
