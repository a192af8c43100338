"""Readers for Parquet tables and writers for index snapshots and reports."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a saved keyword index, and the version of their layout.
INDEX_TABLES, INDEX_LAYOUT = ("words", "terms", "corpus"), 2


#: Bytes of rows in one Arrow batch; Spark's own bound is 10,000 rows, which are as long as texts and pages make them.
BATCH_BYTES = 1 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python workers hold in bytes, in a session that has no such bound; a longer row is a batch of its own."""
    if spark.conf.get(_BATCH_CONF, None) in (None, "-1", str((1 << 31) - 1), f"{(1 << 31) - 1}b"):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the domain's terms: the first line is the title, the whole text the content."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.col("lang").alias("region"),
        F.col("source").alias("source_name"),
        F.col("n_chars").alias("word_count"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query traces from the event table: errors are failures, ``value`` is latency, ``props.k`` a usage counter."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").try_cast("bigint").alias("tokens"))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; where it is unset, one of this machine if Spark runs on it alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read again, so that several uses do not compute it twice."""
    path = f"{scratch(df.sparkSession)}/stored/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Small files in a folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._at = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._at, name)

    def names(self) -> list[str]:
        """What is in the folder; none where there is no folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at)) if self._fs.exists(self._at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write beside and rename into place, so that a reader sees all of it or nothing; an error where ``name`` is there already."""
        beside = f".{name}-{uuid.uuid4().hex}"
        self.write(beside, text)
        if self._fs.exists(self._path(name)) or not self._fs.rename(self._path(beside), self._path(name)):
            self.delete(beside)
            raise RuntimeError(f"{name} was written by another")

    def replace(self, beside: str, name: str) -> None:
        """Move ``beside`` to ``name``; what was there is put aside first and deleted afterwards, or put back."""
        old = f".{name}-{uuid.uuid4().hex}-old"
        there = self._fs.exists(self._path(name))
        if there:
            self._fs.rename(self._path(name), self._path(old))
        if not self._fs.rename(self._path(beside), self._path(name)):
            if there:
                self._fs.rename(self._path(old), self._path(name))
            raise RuntimeError(f"{name} could not be put in place")
        if there:
            self.delete(old)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def save_index(index: dict[str, DataFrame], path: str) -> int:
    """A new version of a keyword index: its parts are written beside those of older ones, and a manifest is put in place once all are there. Returns the version."""
    spark = index[INDEX_TABLES[0]].sparkSession
    folder = Folder(spark, path)
    number = max([0, *_versions(folder)]) + 1
    data = f"data-{number:08d}-{uuid.uuid4().hex[:8]}"
    for name in INDEX_TABLES:
        index[name].write.parquet(f"{path}/{data}/{name}")
    folder.publish(f"index-{number:08d}.json", json.dumps({"layout": INDEX_LAYOUT, "data": data}))
    return number


def _versions(folder: Folder) -> list[int]:
    return [int(n[6:14]) for n in folder.names() if n.startswith("index-") and n.endswith(".json")]


def load_index(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The newest version of a saved keyword index, or one by number; another layout than this library's is an error."""
    folder = Folder(spark, path)
    number = max(_versions(folder), default=None) if version is None else version
    if number is None:
        raise FileNotFoundError(f"no index in {path}")
    manifest = json.loads(folder.read(f"index-{number:08d}.json"))
    if manifest["layout"] != INDEX_LAYOUT:
        raise ValueError(f"the index in {path} has layout {manifest['layout']}, not {INDEX_LAYOUT}")
    return {name: spark.read.parquet(f"{path}/{manifest['data']}/{name}") for name in INDEX_TABLES}


def write_report(rows: DataFrame, path: str, title: str = "Report") -> None:
    """A report as JSON lines, as CSV with nested columns as JSON, and as a Markdown table, in one folder that is moved into place once all are there; an older one goes then."""
    parent, name = path.rstrip("/").rsplit("/", 1)
    folder, beside = Folder(rows.sparkSession, parent), f".{name}-{uuid.uuid4().hex}"
    try:
        kept = stored(rows, "report")
        kept.write.json(f"{parent}/{beside}/json")
        flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c).cast("string").alias(c) for c, kind in kept.dtypes]
        kept.select(*flat).write.option("header", True).option("escape", "\"").csv(f"{parent}/{beside}/csv")
        cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
        lines = kept.select(*flat).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(f"`{c}`")) for c in kept.columns]), F.lit(" |")).alias("line"))
        lines.write.text(f"{parent}/{beside}/markdown")
        Folder(rows.sparkSession, f"{parent}/{beside}").write("markdown/_head.md", f"# {title}\n\n| {' | '.join(kept.columns)} |\n|{' --- |' * len(kept.columns)}\n")
        folder.replace(beside, name)
    except BaseException:
        folder.delete(beside)
        raise


def upsert(table: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with equal keys."""
    return table.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)
