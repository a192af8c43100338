"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors are one class and compared once. Unit vectors are turned to principal axes,
so that leading dimensions carry most of a product, and are dealt into strips of neighbours;
strips whose boxes on the leading axes are too far apart are never compared. The others
are compared tile by tile: products over the leading dimensions come first, the rest is
bounded by the product of suffix norms (Cauchy-Schwarz), and a tile or pair is given up as soon
as the bound is under the threshold. Pairs that remain are decided on the vectors as given, in double precision.

Strips are compared in square blocks: a strip is copied once for each group of strips it
meets, not once for each strip.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_join, map_batches, materialize
from .components import connected_components

#: Vectors in a strip, and in the part of one that a tile takes from its left side.
STRIP_ROWS, TILE_ROWS = 2048, 512
#: Vectors in a group of strips, at most: two groups are in one task's memory. Fewer rows make MIN_GROUPS groups.
GROUP_ROWS, MIN_GROUPS = 65_536, 6
#: Leading axes on which strips have boxes.
BOX_AXES = 16
_SLACK = 1e-9
_STEPS = (8, 16, 32, 64, 128, 256, 512)
#: A tile goes on whole until this share of its pairs is left.
_FEW = 0.02


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares within range.
    top = np.abs(rows).max(1, keepdims=True)
    rows = rows / top
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, class, d, v): digest, length and packed components of every vector that may link; equal vectors have one class."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(ok)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 is 0.0
            raw = [x.tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])] if len(sizes) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "class", "d", "v"])

    return rows.transform(map_batches, pack, "vec_id long, class binary, d long, v binary")


def principal_axes(classes: DataFrame, size: int) -> np.ndarray:
    """(size, size) orthogonal axes by falling variance, from the second moments of all unit vectors; size² numbers reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(0), size))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = classes.select("v").transform(map_batches, moments, "i long, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    matrix = np.zeros((size, size))
    matrix[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("x").to_numpy()
    _, axes = np.linalg.eigh((matrix + matrix.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


class _Rows:
    """Vectors of a strip or group: places as given, on principal axes, and suffix norms at the steps."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        self.x = _unit(x)
        self.r = self.x @ axes
        self.steps = [s for s in _STEPS if s < self.r.shape[1]]
        self.tails = np.sqrt(np.stack([(self.r[:, s:] ** 2).sum(1) for s in self.steps] or [np.zeros(len(x))], 1))

    def pairs(self, a: slice, b: slice, least: float, begin: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places (i, j) within slices ``a`` and ``b`` with cosine >= ``least``; of the steps from ``begin`` on, the one to begin the next tile with is told."""
        x, r, tails, steps, size = self.x, self.r, self.tails, self.steps, self.r.shape[1]
        i = j = got = None
        done, found = 0, max(0, len(steps) - 1)
        for k, stop in enumerate([*steps, size]):
            if k < min(begin, len(steps)):
                continue
            if i is None:
                part = r[a, done:stop] @ r[b, done:stop].T if done == 0 else part + r[a, done:stop] @ r[b, done:stop].T
                done = stop
                if stop == size:
                    i, j = np.nonzero(part >= least - _SLACK)
                    break
                live = part >= least - _SLACK - np.outer(tails[a, k], tails[b, k])
                left = np.count_nonzero(live)
                if left <= _FEW * live.size:
                    i, j = np.nonzero(live)
                    got, found = part[i, j], k if left > 0.1 * _FEW * live.size else max(0, k - 1)
            else:
                got = got + np.einsum("nd,nd->n", r[a][i, done:stop], r[b][j, done:stop])
                done = stop
                live = got >= least - _SLACK - (tails[a][i, k] * tails[b][j, k] if stop < size else 0)
                i, j, got = i[live], j[live], got[live]
        near = np.einsum("nd,nd->n", x[a][i], x[b][j]) >= least
        return i[near] + a.start, j[near] + b.start, found


def _settle(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Lower labels (places of a component's first member) along links, by the labels that their ends have, until nothing changes."""
    while True:
        ends = np.concatenate((label[u], label[v]))
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, ends, np.concatenate((low, low)))
        while not (deeper := label[label] == label).all():
            label[~deeper] = label[label[~deeper]]
        if (label == before).all():
            return


def _compare(x: np.ndarray, weight: np.ndarray, strips: list[tuple[int, int]], meet: list[tuple[int, int]], axes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight of what each row links with, and the place of a smaller row it hangs on; ``meet`` names pairs of ``strips`` (start, stop)."""
    rows = _Rows(x, axes)
    links, label, begin = np.zeros(len(x), np.int64), np.arange(len(x)), 0
    for p, q in meet:
        for at in range(*strips[p], TILE_ROWS):
            a = slice(at, min(strips[p][1], at + TILE_ROWS))
            b = slice(at if p == q else strips[q][0], strips[q][1])
            i, j, begin = rows.pairs(a, b, least, begin)
            if p == q:
                i, j = i[i < j], j[i < j]
            if len(i):
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                _settle(label, i, j)
    return links, label


def _apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Least squared distances of a box from others."""
    gap = np.maximum(0, np.maximum(lows - high, low - highs))
    return (gap * gap).sum(1)


def _deal(classes: DataFrame, size: int, rows: int, axes: np.ndarray, strip_rows: int) -> DataFrame:
    """(strip, ids, weights, x, low, high): vectors packed by place on the leading axes; low and high bound the strip's box."""
    lead = axes[:, :4]

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = _unit(_matrix(batch.column(2), size)) @ lead
            r = np.concatenate((r, np.zeros((len(r), 4 - r.shape[1]))), 1)
            cell = np.clip(np.floor(r * 4) + 4, 0, 7).astype(np.int64)
            key = (((cell[:, 0] * 8 + cell[:, 1]) * 8 + cell[:, 2]) * 8 + cell[:, 3]).astype(np.float64) * 4 + r[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=["id", "weight", "v", "place"])

    keyed = classes.select("id", "weight", "v").transform(map_batches, coordinates, "id long, weight long, v binary, place double")
    ranged = keyed.repartitionByRange(-(-rows // strip_rows), "place", "id").withColumn("part", F.spark_partition_id())

    def strip(name: int, held: pa.Table) -> pa.RecordBatch:
        x = _matrix(held.column("v"), size)
        r = (_unit(x) @ axes)[:, :BOX_AXES]
        box = [pa.array([c.tolist()], pa.list_(pa.float64())) for c in (r.min(0) - _SLACK, r.max(0) + _SLACK)]
        packed = [pa.array([c.tobytes()], pa.binary()) for c in (held.column("id").to_numpy(), held.column("weight").to_numpy(), x)]
        return pa.RecordBatch.from_arrays([pa.array([name]), *packed, *box], names=["strip", "ids", "weights", "x", "low", "high"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each range partition as one or more strips."""
        waiting, held, made = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, strip_rows):
                waiting.append(batch.slice(at, strip_rows))
                held += waiting[-1].num_rows
                while held >= strip_rows:
                    table = pa.Table.from_batches(waiting)
                    yield strip(table.column("part")[0].as_py() * 1_000_000 + made, table.slice(0, strip_rows))
                    waiting, held, made = table.slice(strip_rows).to_batches(), held - strip_rows, made + 1
        if held:
            table = pa.Table.from_batches(waiting)
            yield strip(table.column("part")[0].as_py() * 1_000_000 + made, table)

    schema = "strip long, ids binary, weights binary, x binary, low array<double>, high array<double>"
    return materialize(ranged.transform(map_batches, pack, schema), "strips")


def _links(classes: DataFrame, size: int, rows: int, threshold: float, strip_rows: int, group_rows: int) -> DataFrame:
    """(id, root, n): for classes of one length, what each links with in a block of strips, and a class it hangs on."""
    axes = principal_axes(classes, size)
    packed = _deal(classes, size, rows, axes, strip_rows)
    # Boxes: two rows of BOX_AXES numbers for each strip, so a 2,000th of the vectors' own size at 64 dimensions.
    bounds = packed.select("strip", "low", "high").orderBy("strip").toArrow()
    names = bounds.column("strip").to_numpy()
    lows, highs = (np.array(bounds.column(c).to_pylist()) for c in ("low", "high"))
    in_group = max(1, min(group_rows // strip_rows, -(-len(names) // MIN_GROUPS)))
    group = np.arange(len(names)) // in_group
    reach = max(0.0, 2 - 2 * threshold) + 1e-7
    sent = classes.sparkSession.sparkContext.broadcast((names, lows, highs, group))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A copy of a strip for each group that holds a strip it can reach."""
        names, lows, highs, group = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                me = int(np.searchsorted(names, batch.column(0)[k].as_py()))
                near = np.unique(group[_apart(lows[me], highs[me], lows, highs) <= reach]).tolist()
                one = batch.slice(k, 1)
                for other in near:
                    a, b = min(group[me], other), max(group[me], other)
                    yield pa.RecordBatch.from_arrays([pa.array([int(a)]), pa.array([int(b)]), pa.array([me]), *one.columns[1:4]], names=["a", "b", "strip", "ids", "weights", "x"])

    def compare(table: pa.Table) -> pa.Table:
        _, lows, highs, group = sent.value
        order = np.argsort(table.column("strip").to_numpy())
        table = table.take(pa.array(order))
        numbers = table.column("strip").to_pylist()
        ids, weights = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("ids", "weights"))
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float64).reshape(-1, size)
        stops = np.cumsum([len(i.as_py()) // 8 for i in table.column("ids")]).tolist()
        strips = list(zip([0, *stops[:-1]], stops, strict=True))
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        meet = [
            (p, q)
            for p in range(len(strips))
            for q in range(p, len(strips))
            if {int(group[numbers[p]]), int(group[numbers[q]])} == {a, b} and _apart(lows[numbers[p]], highs[numbers[p]], lows[numbers[q]][None], highs[numbers[q]][None])[0] <= reach
        ]
        links, label = _compare(x, weights, strips, meet, axes, threshold)
        some = np.flatnonzero(links)
        return pa.table({"id": ids[some], "root": ids[label[some]], "n": links[some]})

    met = packed.transform(map_batches, partners, "a long, b long, strip long, ids binary, weights binary, x binary")
    found = materialize(met.groupBy("a", "b").applyInArrow(compare, "id long, root long, n long"), "links")
    discard(packed)
    return found


def link_embeddings(vectors: DataFrame, threshold: float = 0.9, strip_rows: int = STRIP_ROWS, group_rows: int = GROUP_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``.

    ``n_links`` counts the other rows with cosine >= threshold; ``component_id`` is the
    smallest vec_id reachable by links. Vectors that are null, zero, empty, or that hold null or non-finite
    components link with nothing; vectors of different lengths have no cosine and do not link.
    Repeated rows each count, so copies of a row link with each other, and rows with one id but different vectors
    are different rows. A row with a null id links with nothing.
    Labels and other columns are ignored; an empty table gives an empty result.
    """
    valid = materialize(_valid(vectors, id_col, vector_col), "vectors")
    # Classes are numbered once, as they are written.
    classes = materialize(valid.groupBy("class", "d").agg(F.first("v").alias("v"), F.count("*").alias("weight"), F.min("vec_id").alias("least")).withColumn("id", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy("d").agg(F.count("*").alias("n")).where("n > 1")
    # Lengths with more vectors than a strip are compared in strips; there are fewer of them than strips. All shorter groups are one task each.
    large = [(r.d, r.n) for r in sizes.where(F.col("n") > strip_rows).orderBy("d").collect()]

    def small(table: pa.Table) -> pa.Table:
        size = table.column("d")[0].as_py()
        ids, weights = table.column("id").to_numpy(), table.column("weight").to_numpy()
        x = _matrix(table.column("v"), size)
        links, label = _compare(x, weights, [(0, len(x))], [(0, 0)], np.eye(size), threshold)
        some = np.flatnonzero(links)
        return pa.table({"id": ids[some], "root": ids[label[some]], "n": links[some]})

    few = classes.join(sizes.where(F.col("n") <= strip_rows).select("d"), "d").select("d", "id", "weight", "v")
    found = few.groupBy("d").applyInArrow(small, "id long, root long, n long")
    for d, n in large:
        found = found.unionByName(_links(classes.where(F.col("d") == d), d, n, threshold, strip_rows, group_rows))
    found = materialize(found, "links")
    labels = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    named = classes.select("class", "id", "weight", "least").join(labels, F.col("id") == F.col("node"), "left").select("class", "id", "weight", "least", F.coalesce("component", "id").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    counts = found.groupBy("id").agg(F.sum("n").alias("others"))
    linked = named.join(names, "component").join(counts, "id", "left").select("class", "component_id", "weight", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # Equal vectors are one class: the rows of a class of many stay where they are.
    rows = hot_join(valid.select("vec_id", "class"), materialize(linked, "linked"), ["class"], "weight").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    # Rows that cannot link, one for each row beyond the valid ones of its id.
    alone = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rest = alone.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return rows.unionByName(rest)
