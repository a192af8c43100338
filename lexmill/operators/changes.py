"""States kept as a log of changes: what each event does to its entity, and the state that a log folds to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

APPLIED, REPLAYED, CONFLICT, INVALID = "applied", "replayed", "conflict", "invalid"
#: What a candidate source may become, and what a failed address may.
CANDIDATE_STEPS = {
    "discovered": ("validating", "validation_failed", "rejected", "failed"),
    "validating": ("trial_crawl", "validation_failed", "failed"),
    "trial_crawl": ("awaiting_approval", "validation_failed", "failed"),
    "awaiting_approval": ("approved", "rejected"),
    "approved": ("activated", "failed"),
    "validation_failed": ("discovered",),
    "rejected": ("discovered",),
    "failed": ("discovered",),
}
FAILURE_STEPS = {"pending": ("queued", "retrying"), "queued": ("retrying", "failed", "cancelled"), "failed": ("queued", "retrying"), "retrying": ("succeeded", "failed", "cancelled")}


def apply_log(events: DataFrame, steps: dict[str, tuple[str, ...]], start: str) -> DataFrame:
    """(event_id, outcome, state): what every event (entity, event_id, at, from_state, to_state) does, and the state of its entity after it.

    An entity begins in ``start``. Its events count by time and id. An event that was there before, by its id, is ``replayed``; one whose ``from_state``
    is not the entity's state lost a race and is a ``conflict``; a step that ``steps`` does not have is ``invalid``; none of these changes anything. So a log folds to the same
    state however often parts of it arrive and in whatever order. A null ``from_state`` is any. Events without entity, id or time are invalid, with no state.
    An entity's events are walked in one task in order, one state in memory; only marks go there.
    """
    kind = events.schema["event_id"].dataType.simpleString()
    # Of an event that arrives more than once the first by time is the event; which of equal ones does not matter.
    known = F.col("entity").isNotNull() & F.col("event_id").isNotNull() & F.col("at").isNotNull()
    first = Window.partitionBy("event_id").orderBy("at", "entity", "from_state", "to_state")
    good = events.where(known).select(F.sha2(F.col("entity").cast("string"), 256).alias("entity"), "event_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "from_state", "to_state")
    once = good.withColumn("again", F.row_number().over(first) > 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, start
        for batch in batches:
            outcomes, states = [], []
            for entity, before, after, again in zip(*(batch.column(c).to_pylist() for c in ("entity", "from_state", "to_state", "again")), strict=True):
                if entity != now:
                    now, state = entity, start
                if again:
                    outcome = REPLAYED
                elif before is not None and before != state:
                    outcome = CONFLICT
                elif after not in steps.get(state, ()):
                    outcome = INVALID
                else:
                    outcome, state = APPLIED, after
                outcomes.append(outcome)
                states.append(state)
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array(outcomes, pa.string()), pa.array(states, pa.string())], names=["event_id", "outcome", "state"])

    # A replayed event stands behind all of its time, so that it sees what the others made of the entity.
    walked = once.repartition("entity").sortWithinPartitions("entity", "at", "again", "event_id").mapInArrow(walk, f"event_id {kind}, outcome string, state string")
    return walked.unionByName(events.where(~known).select("event_id", F.lit(INVALID).alias("outcome"), F.lit(None).cast("string").alias("state")))


def folded(events: DataFrame, steps: dict[str, tuple[str, ...]], start: str) -> DataFrame:
    """(entity, state, changes): the state of every entity, and how many events made it; entities whose events all failed are in ``start``."""
    told = apply_log(events, steps, start).where(F.col("outcome") == APPLIED)
    ids = events.where("entity is not null and event_id is not null and at is not null").select("entity", "event_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at")).groupBy("event_id").agg(F.min_by("entity", "at").alias("entity"), F.min("at").alias("at"))
    last = told.join(ids, "event_id").groupBy("entity").agg(F.max_by("state", F.struct("at", "event_id")).alias("state"), F.count("*").alias("changes"))
    every = ids.select("entity").distinct()
    return every.join(last, "entity", "left").select("entity", F.coalesce("state", F.lit(start)).alias("state"), F.coalesce("changes", F.lit(0)).alias("changes"))


def retry_refusal(status: Column, retryable: Column) -> Column:
    """Why a failed address may not be queued again; null where it may."""
    return F.when(~F.coalesce(retryable, F.lit(False)), "not_retryable").when(status.isin("queued", "retrying", "succeeded"), "already_handled")


def queue_failed(status: Column) -> Column:
    """The status of a failure whose task could not be queued."""
    return F.when(status == "queued", "failed").otherwise(status)
