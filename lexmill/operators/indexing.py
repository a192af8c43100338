"""An incremental keyword index: immutable segments, tombstones, and a manifest that is swapped at the end.

A batch of documents becomes one segment: its documents with their counted terms by bucket of the id, the tombstones that it
puts on documents of older segments, and by how much each term's document frequency changes. Nothing older is written
again, and of older documents only the buckets that the batch's ids fall in are read. The next manifest is renamed into place once
every part is there; a batch that fails before leaves no trace, and of two writers of one version the second fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables
from . import retrieval

#: Buckets of ids; a batch reads the buckets of its own ids only.
BUCKETS = 16
_PARTS = {
    "docs": "id {id}, dl long, terms array<string>, tfs array<long>, digest string, bucket int",
    "terms": "term string, df long",
    "gone": "segment string, id {id}",
}


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


class KeywordIndex:
    """A keyword index in a folder, opened at its newest manifest. ``kind`` is the type of ids."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint"):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind
        self.files = tables.Folder(spark, f"{self.path}/manifests")
        versions = [int(name.split(".")[0]) for name in self.files.names() if name.endswith(".json")]
        self.manifest = json.loads(self.files.read(f"{max(versions):08d}.json")) if versions else {"version": 0, "segments": [], "n": 0, "length": 0}

    def _part(self, name: str, segments: list[str] | None = None) -> DataFrame:
        """One part of all segments, with the segment's name where the part has none of its own."""
        schema, found = _PARTS[name].format(id=self.kind), None
        for segment in self.manifest["segments"] if segments is None else segments:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/segments/{segment}/{name}")
            part = part if name == "gone" else part.withColumn("segment", F.lit(segment))
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self.spark.createDataFrame([], schema + ("" if name == "gone" else ", segment string"))
        return found

    def _live(self, name: str) -> DataFrame:
        """Rows of a part whose document no younger segment has replaced or removed."""
        rows = self._part(name)
        return rows.join(self._part("gone"), ["segment", "id"], "left_anti") if len(self.manifest["segments"]) > 1 else rows

    def parts(self) -> dict[str, DataFrame]:
        """What ``retrieval.bm25`` asks an index for; document frequencies are sums of the segments' changes."""
        corpus = self.spark.createDataFrame([(self.manifest["n"], self.manifest["length"] / self.manifest["n"] if self.manifest["n"] else 0.0)], "n long, mean double")
        counted = self._part("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return retrieval.index_of(self._live("docs").select("id", "dl", "terms", "tfs"), retrieval.inverse_frequencies(counted, corpus), corpus)

    def apply(self, changes: DataFrame, removed: DataFrame | None = None, before_swap: Callable[[], None] | None = None) -> DataFrame:
        """(id, outcome) of one batch of ``changes`` (id, title, content, approved) and of ids that are ``removed`` (id).

        Only approved documents with a token are indexed: others are ``rejected`` or ``empty`` and leave what is there. A document
        is ``added``, ``replaced`` where its tokens' text differs from what is indexed, or ``unchanged``; a removed one is ``removed`` or ``absent``. A null
        id is rejected; an id that is twice among the changes, or both changed and removed, is an error. If anything
        fails before the manifest is swapped, ``before_swap`` included, the segment is deleted and the index stays as it was.
        """
        body = F.concat_ws(" ", "title", "content")
        whole = changes.select("id", F.coalesce("approved", F.lit(False)).alias("approved"), F.sha2(body, 256).alias("digest"), F.lower(body).rlike(T.TOKEN).alias("worded"), body.alias("body"), F.lit(False).alias("leaves"))
        if removed is not None:
            whole = whole.unionByName(removed.select("id").distinct().select("id", F.lit(True).alias("approved"), F.lit("").alias("digest"), F.lit(False).alias("worded"), F.lit("").alias("body"), F.lit(True).alias("leaves")))
        whole = tables.stored(whole.withColumn("bucket", _bucket("id")), "changes")
        # What is judged is narrow: texts are read again only for documents that enter, and then cut into tokens.
        given = whole.drop("body")
        if given.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("an id occurs twice in a batch")
        touched = [r.bucket for r in given.select("bucket").distinct().collect()]  # BUCKETS at most
        old = self._part("docs").where(F.col("bucket").isin(touched))
        known = old.select("id", "segment", F.col("dl").alias("old_dl"), F.col("digest").alias("old_digest")).join(self._part("gone"), ["segment", "id"], "left_anti")
        there, same = F.col("segment").isNotNull(), F.col("digest") == F.col("old_digest")
        outcome = (
            F.when(F.col("id").isNull() | ~F.col("approved"), "rejected")
            .when(F.col("leaves"), F.when(there, "removed").otherwise("absent"))
            .when(~F.col("worded"), "empty")
            .when(~there, "added")
            .otherwise(F.when(same, "unchanged").otherwise("replaced"))
        )
        judged = tables.stored(given.join(known, "id", "left").select("id", "segment", "old_dl", outcome.alias("outcome")), "judged")
        leaves = judged.where("outcome in ('removed', 'replaced')").select("segment", "id")
        sums = judged.agg(
            F.count(F.when(F.col("outcome") == "added", 1)).alias("more"),
            F.count(F.when(F.col("outcome") == "removed", 1)).alias("fewer"),
            F.count(F.when(F.col("outcome") == "replaced", 1)).alias("other"),
            F.coalesce(F.sum(F.when(F.col("outcome").isin("removed", "replaced"), F.col("old_dl"))), F.lit(0)).alias("shorter"),
        ).first()
        if sums.more + sums.fewer + sums.other:
            segment = f"{self.manifest['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
            enters = whole.where("approved and worded and id is not null")
            if self.manifest["segments"]:
                enters = enters.join(judged.where("outcome in ('added', 'replaced')").select("id"), "id", "left_semi")
            docs = retrieval.counted(enters.select("id", T.tokens(F.col("body")).alias("tokens"), "digest", "bucket"))

            def change(new: DataFrame) -> DataFrame:
                more = new.select(F.explode("terms").alias("term"), F.lit(1).alias("by"))
                fewer = old.join(leaves, ["segment", "id"], "left_semi").select(F.explode("terms").alias("term"), F.lit(-1).alias("by"))
                return more.unionByName(fewer).groupBy("term").agg(F.sum("by").alias("df")).where("df <> 0")

            def after(new: DataFrame) -> dict:
                longer = new.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
                return {"segments": [*self.manifest["segments"], segment], "n": self.manifest["n"] + sums.more - sums.fewer, "length": self.manifest["length"] + longer - sums.shorter}

            self._commit(segment, docs, change, leaves, after, before_swap)
        return judged.select("id", "outcome")

    def compact(self, before_swap: Callable[[], None] | None = None) -> None:
        """All segments as one, without tombstones; the same search results."""
        if len(self.manifest["segments"]) < 2:
            return
        segment = f"{self.manifest['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        terms = self._part("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        self._commit(segment, self._live("docs").drop("segment"), lambda _: terms, self._part("gone", []), lambda _: {**self.manifest, "segments": [segment]}, before_swap)

    def vacuum(self) -> None:
        """Delete the segments and manifests that the newest manifest does not name."""
        folder = tables.Folder(self.spark, f"{self.path}/segments")
        for name in set(folder.names()) - set(self.manifest["segments"]):
            folder.delete(name)
        for name in self.files.names():
            if name != f"{self.manifest['version']:08d}.json":
                self.files.delete(name)

    def _commit(self, segment: str, docs: DataFrame, terms: Callable[[DataFrame], DataFrame], gone: DataFrame, after: Callable[[DataFrame], dict], before_swap: Callable[[], None] | None) -> None:
        """Writes a segment and then the next manifest; what is told of the new documents is read from where they are written."""
        at = f"{self.path}/segments/{segment}"
        try:
            docs.write.partitionBy("bucket").parquet(f"{at}/docs")
            new = self._part("docs", [segment])
            terms(new).write.parquet(f"{at}/terms")
            gone.write.parquet(f"{at}/gone")
            manifest = {**after(new), "version": self.manifest["version"] + 1}
            if before_swap:
                before_swap()
            self.files.publish(f"{manifest['version']:08d}.json", json.dumps(manifest))
        except BaseException:
            tables.Folder(self.spark, f"{self.path}/segments").delete(segment)
            raise
        self.manifest = manifest
