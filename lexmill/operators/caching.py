"""An embedding cache with expiry and one fetch for equal keys in flight, over tables and streams of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

HIT, MISS, EXPIRED, COALESCED = "hit", "miss", "expired", "coalesced"


def cache_key(provider: str, model: str, endpoint: str, version: str, text: Column) -> Column:
    """The key of a query's vector: it changes with the provider, its model and address, and the version; addresses and texts are hashed."""
    return F.concat(F.concat_ws(":", F.lit("query-embedding"), F.lit(provider), F.lit(model), F.substring(F.sha2(F.lit(endpoint), 256), 1, 16), F.lit(version)), F.lit(":"), F.sha2(text, 256))


def usable_vector(vector: Column, dimensions: int | None = None) -> Column:
    """Whether a vector may be kept and served: not empty, finite, and as long as the provider says."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    size = F.size(vector) == dimensions if dimensions else F.size(vector) > 0
    return F.coalesce(size & finite, F.lit(False))


def _served(fetch: tuple[int, bool] | None, us: int, kept: bool, latency: int, ttl: int) -> tuple[str, tuple[int, bool]]:
    """What a request at ``us`` finds after the last fetch (its start, whether its vector was kept), and the last fetch after it."""
    if fetch is None:
        return MISS, (us, kept)
    start, stored = fetch
    if us < start + latency:
        return COALESCED, fetch
    if stored and us < start + latency + ttl:
        return HIT, fetch
    return EXPIRED if stored else MISS, (us, kept)


def replay(requests: DataFrame, latency_seconds: float, ttl_seconds: float) -> DataFrame:
    """(request_id, outcome) of requests (key, ts, request_id, kept), in order of time and id.

    A miss starts a fetch; until it is there, requests of its key are coalesced, then they hit until it expires. ``kept`` says of a
    request whether its own fetch, if it has to make one, gives a usable vector: one that does not is no entry. Requests without a key
    or time are misses of their own. A key's requests are walked in one task by their order, with one fetch in memory; only their hashes are sent there.
    """
    latency, ttl = int(latency_seconds * 1_000_000), int(ttl_seconds * 1_000_000)
    kind = requests.schema["request_id"].dataType.simpleString()
    rows = requests.select(F.sha2(F.col("key").cast("string"), 256).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "request_id", F.coalesce("kept", F.lit(False)).alias("kept"))
    whole, loose = rows.where("key is not null and us is not null"), rows.where("key is null or us is null")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fetch = None, None
        for batch in batches:
            outcomes = []
            for key, us, kept in zip(*(batch.column(c).to_pylist() for c in ("key", "us", "kept")), strict=True):
                if key != now:
                    now, fetch = key, None
                outcome, fetch = _served(fetch, us, kept, latency, ttl)
                outcomes.append(outcome)
            yield pa.RecordBatch.from_arrays([batch.column("request_id"), pa.array(outcomes, pa.string())], names=["request_id", "outcome"])

    walked = whole.repartition("key").sortWithinPartitions("key", "us", "request_id").mapInArrow(walk, f"request_id {kind}, outcome string")
    return walked.unionByName(loose.select("request_id", F.lit(MISS).alias("outcome")))


class CachedRequests(StatefulProcessor):
    """The same for a stream. Requests wait for the watermark, so that they are served in order; state holds one fetch a key."""

    def __init__(self, latency: int, ttl: int):
        self.latency, self.ttl = latency, ttl

    def init(self, handle):
        self.handle = handle
        self.fetch = handle.getValueState("fetch", "start long, stored boolean")
        self.waiting = handle.getListState("waiting", "us long, request_id long, kept boolean")

    def handleInputRows(self, key, rows, timerValues):
        fresh = []
        for batch in rows:
            fresh += zip(batch["ts"].astype("datetime64[us]").astype("int64").tolist(), batch["request_id"].tolist(), batch["kept"].tolist(), strict=True)
        self.waiting.appendList(fresh)
        self.handle.registerTimer(min(f[0] for f in fresh) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() * 1000
        fetch = tuple(self.fetch.get()) if self.fetch.exists() else None
        rows, out = sorted(tuple(r) for r in self.waiting.get()), []
        for us, ident, kept in rows:
            if us < until:
                outcome, fetch = _served(fetch, us, kept, self.latency, self.ttl)
                out.append((ident, outcome))
        left = [r for r in rows if r[0] >= until]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        if fetch is not None:
            self.fetch.update(fetch)
        if out:
            yield pd.DataFrame({"request_id": [r[0] for r in out], "outcome": [r[1] for r in out]})

    def close(self):
        pass


def replay_stream(requests: DataFrame, latency_seconds: float, ttl_seconds: float, late: str = "0 seconds") -> DataFrame:
    """``replay`` of a stream of requests with a key, a time and a whole number as id: outcomes of those before the watermark."""
    rows = requests.select("key", "ts", "request_id", F.coalesce("kept", F.lit(False)).alias("kept")).withWatermark("ts", late).groupBy("key")
    return rows.transformWithStateInPandas(CachedRequests(int(latency_seconds * 1_000_000), int(ttl_seconds * 1_000_000)), "request_id long, outcome string", "Append", "EventTime")
