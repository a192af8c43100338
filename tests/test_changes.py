import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexmill.operators import changes

START = datetime(2024, 1, 1)
SCHEMA = "entity string, event_id long, at timestamp, from_state string, to_state string"


def at(s):
    return START + timedelta(seconds=s)


LOG = [
    ("a", 1, at(0), "discovered", "validating"),
    ("a", 2, at(1), "discovered", "rejected"),  # lost the race
    ("a", 3, at(2), "validating", "activated"),  # no such step
    ("a", 4, at(3), None, "trial_crawl"),
    ("a", 5, at(4), "trial_crawl", "awaiting_approval"),
    ("b", 6, at(0), "approved", "activated"),
    ("c", 7, at(5), "discovered", "rejected"),
    ("c", 8, at(6), "rejected", "discovered"),
    (None, 9, at(0), None, "validating"),
    ("d", 10, None, None, "validating"),
]
WANT = {1: "applied", 2: "conflict", 3: "invalid", 4: "applied", 5: "applied", 6: "conflict", 7: "applied", 8: "applied", 9: "invalid", 10: "invalid"}
STATES = {"a": ("awaiting_approval", 3), "b": ("discovered", 0), "c": ("discovered", 2)}


def states(df):
    return {r.entity: (r.state, r.changes) for r in changes.folded(df, changes.CANDIDATE_STEPS, "discovered").collect()}


def test_a_log_folds_to_one_state(spark):
    df = spark.createDataFrame(LOG, SCHEMA)
    told = changes.apply_log(df, changes.CANDIDATE_STEPS, "discovered").collect()
    assert {r.event_id: r.outcome for r in told} == WANT and states(df) == STATES
    assert {r.event_id: r.state for r in told}[3] == "validating"
    assert states(df.limit(0)) == {}


def test_replays_and_order_change_nothing(spark):
    rng = random.Random(1)
    twice = LOG + rng.sample(LOG[:8], 5) + LOG[:3]
    rng.shuffle(twice)
    df = spark.createDataFrame(twice, SCHEMA).repartition(4)
    assert states(df) == STATES
    outcomes = [r.outcome for r in changes.apply_log(df, changes.CANDIDATE_STEPS, "discovered").collect()]
    assert outcomes.count("replayed") == 8 and outcomes.count("applied") == 5


def test_retries(spark):
    df = spark.createDataFrame([("failed", True), ("queued", True), ("succeeded", True), ("failed", False), ("failed", None)], "s string, r boolean")
    assert [r[0] for r in df.select(changes.retry_refusal(F.col("s"), F.col("r"))).collect()] == [None, "already_handled", "already_handled", "not_retryable", "not_retryable"]
    assert [r[0] for r in df.select(changes.queue_failed(F.col("s"))).collect()] == ["failed", "failed", "succeeded", "failed", "failed"]
