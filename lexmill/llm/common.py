"""Scratch tables, Arrow iteration and bounded memo tables shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one step inside a task turns into Python objects at once.
STEP_ROWS = 256
#: Bytes of texts in one Arrow batch; Spark's own bound is a number of rows, which long texts exceed.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors: ``spark.checkpoint.dir``. Where that is unset, a session on one machine takes a local one; a cluster raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/lexmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that a hot-key join broadcasts, at most.
HOT_KEYS = 10_000


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int | None = None, least: int = 500) -> DataFrame:
    """``rows`` joined with ``table``, of one row a key, whose column ``weight`` says how many of ``rows`` each key has.

    Keys of more rows than a ten-thousandth of all are at most HOT_KEYS by count; they are broadcast, so their rows stay
    where they are. All others are joined by a shuffle. Both inputs are read twice. ``weight`` is dropped.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    limit = max(least, -(-total // HOT_KEYS))
    hot = F.broadcast(table.where(F.col(weight) > limit).drop(weight))
    cold = table.where(F.col(weight) <= limit).drop(weight)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def salted_join(rows: DataFrame, table: DataFrame, on: str, by: str, per: int) -> DataFrame:
    """``rows`` joined with ``table``, of one row a key ``on``: a key of more than ``per`` rows is dealt over several tasks by the hash of ``by``, its row of ``table`` copied for each."""
    parts = rows.groupBy(on).agg(F.ceil(F.count("*") / per).cast("int").alias("_parts"))
    copies = table.join(parts, on).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    dealt = rows.join(parts, on).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).drop("_parts")
    return dealt.join(copies, [on, "_part"]).drop("_part")


def in_steps(batches: Iterable[pa.RecordBatch], rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8_list(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 byte strings."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def map_batches(df: DataFrame, run: Callable, schema, model: bool = False) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches bounded in bytes (a longer row is a batch of its own).

    The byte bound is set on the session where it has none. Without ``model``, a model that an earlier operator
    left in the Python worker is let go first.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from run(batches)

    return df.mapInArrow(run if model else alone, schema)


_held: dict[str, object] = {}


def let_go() -> None:
    _held.clear()
    pa.default_memory_pool().release_unused()


def held(name: str, make: Callable):
    """The model or index that this Python worker is using; the one before is let go, so a worker never keeps two."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


class Memo(dict):
    """Bounded memo of a pure function: two generations, so that frequent keys stay."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class BitFilter:
    """Which keys may be in a table: one bit for each value of the key's low bits, 8 MB at most whatever the table.

    A key of the table is always let through. Others pass with a chance of (distinct keys /
    bits), so an exact join still follows; the filter only keeps most of them out of its shuffle.
    """

    BITS = 1 << 26

    def __init__(self, keys: DataFrame, column: str):
        bit = F.col(column).cast("long").bitwiseAND(F.lit(self.BITS - 1))
        words = keys.select(bit.alias("bit")).groupBy(F.expr("bit >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63L as int))")).alias("mask"))
        found = words.toArrow()
        table = np.zeros(self.BITS >> 6, np.int64)
        table[found.column("word").to_numpy()] = found.column("mask").to_numpy()
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        low = keys.astype(np.int64, copy=False) & (self.BITS - 1)
        return (self.table.value[low >> 6] >> (low & 63)) & 1 == 1
