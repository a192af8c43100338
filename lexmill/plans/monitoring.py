"""Registered queries: alerts that hold for a time, rates of counters, and streams of both."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import caching, telemetry
from ..registry import query
from ..sources import tables
from ..streaming import monitoring

HOLD, GAP = 120, 360
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _held_sql(samples: str, hold: int, gap: int) -> str:
    return f"""e AS ({samples}), u AS (SELECT max(us) // 1000 * 1000 AS until FROM e),
 s AS (SELECT e.*, lag(us) OVER w AS pu, lag(active) OVER w AS pa FROM e, u WHERE us < until WINDOW w AS (PARTITION BY alert_key ORDER BY us, event_id)),
 r AS (SELECT *, sum((active AND NOT coalesce(pa AND us - pu <= {gap * 60_000_000}, false))::INT) OVER (PARTITION BY alert_key ORDER BY us, event_id) AS run FROM s),
 g AS (SELECT alert_key, run, min(us) AS st, max(us) FILTER (active) AS la, min(us) FILTER (NOT active) AS off FROM r WHERE run > 0 GROUP BY 1, 2),
 x AS (SELECT alert_key, st, CASE WHEN off - la <= {gap * 60_000_000} THEN off ELSE la + {gap * 60_000_000} END AS en, st + {hold * 60_000_000} AS due FROM g),
 t AS (SELECT alert_key, 'pending' AS state, st AS us FROM x UNION ALL SELECT alert_key, 'firing', due FROM x WHERE en > due UNION ALL SELECT alert_key, CASE WHEN en > due THEN 'resolved' ELSE 'inactive' END, en FROM x)
 SELECT alert_key, state, make_timestamp(us) AS at FROM t, u WHERE us < until"""


HELD = "WITH " + _held_sql("SELECT event_type AS alert_key, event_id, value > 15 AS active, epoch_us(ts) AS us FROM events", HOLD, GAP)


def _samples(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("alert_key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") > 15).alias("active"))


@query("held_alerts", HELD)
def held_alerts(spark, sf):
    """Alerts of each event type once a value has been high for two hours; six hours without a sample end one."""
    samples = _samples(tables.read(spark, sf, "events"))
    until = samples.agg(F.max("ts")).first()[0]
    return monitoring.held_alerts(samples, HOLD, GAP, until).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("held_alerts_streamed", HELD)
def held_alerts_streamed(spark, sf):
    """The same from a stream with timers in event time."""
    at = f"{tables.scratch(spark)}/streams/{uuid.uuid4().hex}"
    spark.conf.set(*_ROCKS)
    told = monitoring.held_alert_stream(_samples(monitoring.event_stream(spark, sf)), HOLD, GAP)
    return monitoring.drain(told, f"{at}/state", f"{at}/out").withColumn("at", F.col("at").cast("timestamp_ntz"))


DAY_MS = 86_400_000


@query(
    "streamed_alerts",
    f"WITH e AS (SELECT CASE WHEN event_type IN ('error', 'view') THEN 'monitor:' ELSE '' END || event_type || ':' || user_id AS alert_key, epoch_ms(ts) // {DAY_MS} AS r FROM events), c AS (SELECT max(epoch_ms(ts)) // {DAY_MS} AS closed FROM events) SELECT alert_key, CASE WHEN max(r) + 1 < max(closed) AND starts_with(alert_key, 'monitor:') THEN 'resolved' ELSE 'open' END AS status, count(DISTINCT r) AS occurrence_count FROM e, c WHERE r < closed GROUP BY 1",
)
def streamed_alerts(spark, sf):
    """The lifecycle of alerts kept as state of a stream, in rounds of a day."""
    at = f"{tables.scratch(spark)}/streams/{uuid.uuid4().hex}"
    spark.conf.set(*_ROCKS)
    prefix = F.when(F.col("event_type").isin("error", "view"), "monitor:").otherwise("")
    e = monitoring.event_stream(spark, sf).withColumn("alert_key", F.concat(prefix, F.col("event_type"), F.lit(":"), F.col("user_id").cast("string")))
    return monitoring.drain_latest(monitoring.alert_stream(e, 1440), "alert_key", f"{at}/state", f"{at}/out")


#: Requests counted by type and outcome as a server does that restarts every midnight.
EDGES = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, float("inf"))
SAMPLES = "c AS (SELECT event_id, epoch_us(ts) AS us, event_type, count(*) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id)::DOUBLE AS requests, count(*) FILTER (event_type = 'error') OVER (PARTITION BY ts::DATE ORDER BY ts, event_id)::DOUBLE AS errors, " + ", ".join(f"count(*) FILTER (value <= {'1e308' if e == float('inf') else e}) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id)::DOUBLE AS le{k}" for k, e in enumerate(EDGES)) + " FROM events)"


def _rates_sql(name: str, series: str, minutes: int) -> str:
    """Rates of ``series`` (series, us, value) at every minute, as ``name``."""
    w = minutes * 60_000_000
    return f"""{name}_in AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY us, value) AS pv, lag(us) OVER (PARTITION BY series ORDER BY us, value) AS pu FROM ({series})),
 {name}_at AS (SELECT *, unnest(generate_series((us + 59999999) // 60000000, (us + {w} + 59999999) // 60000000 - 1)) * 60000000 AS tick FROM {name}_in),
 {name}_sum AS (SELECT series, tick, count(*) AS n, min(us) AS t0, max(us) AS t1, arg_min(value, struct_pack(a := us, b := value)) AS v0, arg_max(value, struct_pack(a := us, b := value)) AS v1, coalesce(sum(pv) FILTER (value < pv AND pu > tick - {w}), 0) AS lost FROM {name}_at GROUP BY 1, 2 HAVING count(*) > 1 AND max(us) > min(us)),
 {name}_span AS (SELECT *, v1 - v0 + lost AS grown, (t1 - t0)::DOUBLE AS span, (t1 - t0)::DOUBLE / (n - 1) AS mean FROM {name}_sum),
 {name} AS (SELECT series, tick, grown * (span + least(CASE WHEN t0 - (tick - {w}) < mean * 1.1 THEN t0 - (tick - {w}) ELSE mean / 2 END, CASE WHEN grown > 0 AND v0 >= 0 THEN span * v0 / grown ELSE 'inf'::DOUBLE END) + CASE WHEN tick - t1 < mean * 1.1 THEN tick - t1 ELSE mean / 2 END) / span / {minutes * 60}.0 AS rate FROM {name}_span)"""


def _counters(spark: SparkSession, sf: str) -> DataFrame:
    """What the server's counters show after each event."""
    e = tables.read(spark, sf, "events").withColumn("day", F.to_date("ts"))
    # A day's events are one counter's life: running totals over them are what a server keeps.
    so_far = Window.partitionBy("day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = [F.count("*").over(so_far).alias("requests"), F.count_if(F.col("event_type") == "error").over(so_far).alias("errors")]
    return e.select("ts", "event_id", *counts, *[F.count_if(F.col("value") <= edge).over(so_far).alias(f"le{k}") for k, edge in enumerate(EDGES)])


def _series(counters: DataFrame, columns: list[str]) -> DataFrame:
    return counters.unpivot(["ts"], columns, "series", "value")


_two = "SELECT 'requests' AS series, us, requests AS value FROM c UNION ALL SELECT 'errors', us, errors FROM c"


@query("counter_rates", f"WITH {SAMPLES}, {_rates_sql('r5', _two, 5)}, {_rates_sql('r15', _two, 15)} SELECT series, 5 AS minutes, make_timestamp(tick) AS at, round(rate, 6) AS rate FROM r5 UNION ALL SELECT series, 15, make_timestamp(tick), round(rate, 6) FROM r15")
def counter_rates(spark, sf):
    """Requests and errors a second over 5 and 15 minutes, at every minute, over counters that restart."""
    series = tables.stored(_series(_counters(spark, sf), ["requests", "errors"]), "series")
    both = [monitoring.counter_rates(series, ["series"], m).select("series", F.lit(m).alias("minutes"), F.col("at").cast("timestamp_ntz").alias("at"), F.round("rate", 6).alias("rate")) for m in (5, 15)]
    return both[0].unionByName(both[1])


_buckets = " UNION ALL ".join(f"SELECT '{k}' AS series, us, le{k} AS value FROM c" for k in range(len(EDGES)))


@query(
    "rate_quantiles",
    f"WITH {SAMPLES}, {_rates_sql('r', _buckets, 60)}, e AS (SELECT [{', '.join('1e308' if x == float('inf') else str(x) for x in EDGES)}] AS edges), b AS (SELECT tick, edges[series::INT + 1] AS le, sum(rate) AS n FROM r, e GROUP BY 1, 2), s AS (SELECT *, max(n) OVER (PARTITION BY tick) AS total, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below FROM b WINDOW w AS (PARTITION BY tick ORDER BY le)), h AS (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY le) AS nth FROM s WHERE total > 0 AND n >= 0.95 * total) SELECT make_timestamp(tick) AS at, round(CASE WHEN le = 1e308 THEN low ELSE low + (le - low) * (0.95 * total - below) / nullif(n - below, 0) END, 4) AS p95 FROM h WHERE nth = 1",
)
def rate_quantiles(spark, sf):
    """The 95 % quantile of the last hour's values, told by the rates of bucket counters at every minute."""
    rates = monitoring.counter_rates(_series(_counters(spark, sf), [f"le{k}" for k in range(len(EDGES))]), ["series"], 60)
    edges = F.array(*[F.lit(e) for e in EDGES])
    buckets = rates.groupBy("at", F.get(edges, F.substring("series", 3, 9).cast("int")).alias("le")).agg(F.sum("rate").alias("n"))
    return telemetry.histogram_quantile(buckets, ["at"], 0.95).select(F.col("at").cast("timestamp_ntz").alias("at"), F.round("value", 4).alias("p95"))


_ratio = f"WITH {SAMPLES}, {_rates_sql('hourly', _two, 60)}, ratio AS (SELECT tick, coalesce(sum(rate) FILTER (series = 'errors'), 0) / greatest(sum(rate) FILTER (series = 'requests'), 0.001) AS x FROM hourly GROUP BY 1), "


@query("error_rate_alerts", _ratio + _held_sql("SELECT 'high_error_rate' AS alert_key, 0 AS event_id, coalesce(x, 0) > 0.25 AS active, tick AS us FROM ratio", 10, 5))
def error_rate_alerts(spark, sf):
    """An alert on the share of errors in the rate of an hour's requests that holds for ten minutes."""
    rates = monitoring.counter_rates(_series(_counters(spark, sf), ["requests", "errors"]), ["series"], 60)
    of = lambda name: F.sum(F.when(F.col("series") == name, F.col("rate")))
    ratio = tables.stored(rates.groupBy("at").agg((F.coalesce(of("errors"), F.lit(0.0)) / F.greatest(of("requests"), F.lit(0.001))).alias("x")), "ratio")
    samples = ratio.select(F.lit("high_error_rate").alias("alert_key"), F.col("at").alias("ts"), F.lit(0).alias("event_id"), (F.coalesce("x", F.lit(0.0)) > 0.25).alias("active"))
    until = samples.agg(F.max("ts")).first()[0]
    return monitoring.held_alerts(samples, 10, 5, until).withColumn("at", F.col("at").cast("timestamp_ntz"))


LATENCY, TTL = 120, 12 * 3600
#: Each fetch leads to the first request that it does not serve; from a user's first request on these are all fetches.
CACHE = f"""q AS (SELECT user_id AS k, epoch_us(ts) AS us, event_id, event_type <> 'error' AS kept FROM events),
 firsts AS (SELECT k, us, arg_min(event_id, event_id) AS event_id, arg_min(kept, event_id) AS kept FROM q GROUP BY 1, 2),
 nxt AS (SELECT a.k, a.us, a.kept, min(b.us) AS then_us FROM (SELECT *, us + {LATENCY * 1_000_000} + CASE WHEN kept THEN {TTL * 1_000_000} ELSE 0 END AS until FROM firsts) a LEFT JOIN firsts b ON a.k = b.k AND a.until <= b.us GROUP BY a.k, a.us, a.kept),
 chain AS (SELECT k, us, NULL::BOOLEAN AS prior FROM (SELECT k, min(us) AS us FROM q GROUP BY 1) UNION ALL SELECT n.k, n.then_us, n.kept FROM chain c JOIN nxt n ON n.k = c.k AND n.us = c.us WHERE n.then_us IS NOT NULL),
 served AS (SELECT q.*, c.us AS start, c.prior, q.us = c.us AND q.event_id = f.event_id AS fetches FROM q JOIN (SELECT *, lead(us, 1, 9000000000000000000) OVER (PARTITION BY k ORDER BY us) AS upto FROM chain) c ON q.k = c.k AND q.us >= c.us AND q.us < c.upto JOIN firsts f ON f.k = q.k AND f.us = q.us),
 told AS (SELECT *, CASE WHEN fetches THEN CASE WHEN prior THEN 'expired' ELSE 'miss' END WHEN us < start + {LATENCY * 1_000_000} THEN 'coalesced' ELSE 'hit' END AS outcome FROM served)"""


def _requests(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request_id"), (F.col("event_type") != "error").alias("kept"))


@query("cached_embeddings", f"WITH RECURSIVE {CACHE} SELECT event_id AS request_id, outcome FROM told")
def cached_embeddings(spark, sf):
    """What a cache of a user's query vector does with each request: two minutes to fetch, kept for half a day, failed fetches not kept."""
    return caching.replay(_requests(tables.read(spark, sf, "events")), LATENCY, TTL)


@query("cached_embeddings_streamed", f"WITH RECURSIVE {CACHE} SELECT outcome, count(*) AS n FROM told WHERE us < (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) GROUP BY 1")
def cached_embeddings_streamed(spark, sf):
    """The same from a stream of requests with keyed state, counted."""
    at = f"{tables.scratch(spark)}/streams/{uuid.uuid4().hex}"
    spark.conf.set(*_ROCKS)
    told = caching.replay_stream(_requests(monitoring.event_stream(spark, sf)), LATENCY, TTL)
    return monitoring.drain(told, f"{at}/state", f"{at}/out").groupBy("outcome").agg(F.count("*").alias("n"))
