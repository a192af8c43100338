"""Registered queries: answers of providers under their contracts, and states folded from logs of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes, contracts
from ..registry import query
from ..sources import tables

#: A batch for each order, an article for each line: decisions from flags, lengths from quantities, statistics from the order.
LINES = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS nth, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'pending_review' END AS decision, CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS off FROM lineitem),
 c AS (SELECT l_orderkey, count(*) AS n, sum(off) AS wrong, count(*) FILTER (decision = 'accepted') AS yes, count(*) FILTER (decision = 'rejected') AS no, count(*) FILTER (decision = 'pending_review') AS pending FROM l GROUP BY 1),
 o AS (SELECT o_orderkey, o_orderpriority, c.*, yes + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS told FROM orders JOIN c ON l_orderkey = o_orderkey)"""


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    line = tables.read(spark, sf, "lineitem")
    decision = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rejected").otherwise("pending_review")
    content = F.repeat(F.lit("é"), F.col("l_quantity").cast("int"))
    length = F.col("l_quantity").cast("int") + F.when(F.col("l_tax") > 0.07, 1).otherwise(0)
    article = F.struct(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("title"), F.concat(F.lit("https://h/"), F.col("l_suppkey").cast("string")).alias("url"), content.alias("content"), length.alias("content_length"), F.lit("html").alias("extraction_method"), decision.alias("decision"), (F.col("l_returnflag") == "A").alias("accepted"), F.col("l_linestatus").alias("decision_reason"))
    keyed = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", article.alias("a"))
    of = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    grouped = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["a"]).alias("articles"), of("A").alias("yes"), of("R").alias("no"), F.count("*").alias("n"))
    rows = tables.read(spark, sf, "orders").join(grouped, "o_orderkey")
    counts = {"pages_visited": F.lit(1), "articles_discovered": F.col("n"), "articles_fetched": F.col("n"), "articles_accepted": F.col("yes") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0), "articles_rejected": F.col("no"), "articles_pending_review": F.col("n") - F.col("yes") - F.col("no"), "articles_failed": F.lit(0)}
    none = F.array().cast("array<string>")
    batch = F.to_json(F.struct(F.lit(True).alias("success"), F.col("o_orderkey").cast("string").alias("task_id"), F.struct(F.lit("https://h/").alias("url")).alias("source"), F.struct(*[v.alias(k) for k, v in counts.items()]).alias("statistics"), "articles", none.alias("failed_urls"), none.alias("warnings")))
    # Providers answer with the object, a fenced text, an object around it, or prose.
    fenced = F.concat(F.lit("```json\n"), batch, F.lit("\n```"))
    wrapped = F.to_json(F.struct(batch.alias("output")))
    first = F.substring("o_orderpriority", 1, 1)
    return rows.select("o_orderkey", F.when(first == "1", fenced).when(first == "2", wrapped).when(first == "3", F.concat(F.lit("Done: "), batch)).otherwise(batch).alias("text"))


@query(
    "contract_rows",
    f"""WITH {LINES} SELECT l.l_orderkey AS batch, l.l_orderkey::VARCHAR AS task_id, nth::INT AS nth, 'https://h/' || l_suppkey AS url, 'P' || l_partkey AS title, decision, l_quantity::INT::BIGINT AS content_length, NULL::VARCHAR AS place, NULL::VARCHAR AS error FROM l JOIN o ON o.o_orderkey = l.l_orderkey WHERE o_orderpriority[1] <> '3' AND wrong = 0 AND told = yes
 UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, '', 'not_json' FROM o WHERE o_orderpriority[1] = '3'
 UNION ALL SELECT l.l_orderkey, l.l_orderkey::VARCHAR, NULL, NULL, NULL, NULL, NULL, 'articles[' || nth || '].content_length', 'is not the length of content' FROM l JOIN o ON o.o_orderkey = l.l_orderkey WHERE o_orderpriority[1] <> '3' AND off = 1
 UNION ALL SELECT o_orderkey, o_orderkey::VARCHAR, NULL, NULL, NULL, NULL, NULL, 'statistics.articles_accepted', 'is not the number of such articles' FROM o WHERE o_orderpriority[1] <> '3' AND wrong = 0 AND told <> yes""",
)
def contract_rows(spark, sf):
    """Articles of batch answers that keep their contract, and the faults of the others."""
    return contracts.parse_batches(_batches(spark, sf), "o_orderkey", "text").withColumnRenamed("o_orderkey", "batch")


_states = "['discovered', 'validating', 'trial_crawl', 'awaiting_approval', 'approved', 'validation_failed', 'rejected', 'failed', 'activated']"
_to = "CASE event_type WHEN 'view' THEN 'validating' WHEN 'click' THEN 'trial_crawl' WHEN 'purchase' THEN 'awaiting_approval' WHEN 'error' THEN 'failed' ELSE 'discovered' END"
_steps = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]" for k, v in changes.CANDIDATE_STEPS.items()) + "}"
#: Each user's events one after another; an event expects what the one before was meant to lead to.
FOLD = f"""e AS (SELECT user_id, event_id, ts, {_to} AS goal FROM events), s AS (SELECT *, lag(goal) OVER w AS before, row_number() OVER w AS nth FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 f AS (SELECT user_id, 0::BIGINT AS nth, 'discovered' AS state, NULL::BIGINT AS event_id, '' AS outcome, 0::BIGINT AS changes FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, nth, CASE WHEN outcome = 'applied' THEN goal ELSE state END, event_id, outcome, changes + (outcome = 'applied')::INT FROM (SELECT s.user_id, s.nth, s.goal, f.state, s.event_id, f.changes, CASE WHEN s.before IS NOT NULL AND s.before <> f.state THEN 'conflict' WHEN list_contains(coalesce({_steps}[f.state], []), s.goal) THEN 'applied' ELSE 'invalid' END AS outcome FROM f JOIN s ON s.user_id = f.user_id AND s.nth = f.nth + 1))"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    kind, order = F.col("event_type"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    goal = F.when(kind == "view", "validating").when(kind == "click", "trial_crawl").when(kind == "purchase", "awaiting_approval").when(kind == "error", "failed").otherwise("discovered")
    e = tables.read(spark, sf, "events").withColumn("to_state", goal)
    log = e.select(F.col("user_id").alias("entity"), "event_id", F.col("ts").cast("timestamp").alias("at"), F.lag("to_state").over(order).alias("from_state"), "to_state")
    # Errors are delivered twice.
    return log.unionByName(log.where("to_state = 'failed'"))


@query("folded_states", f"WITH RECURSIVE {FOLD} SELECT user_id AS entity, arg_max(state, nth) AS state, max(changes) AS changes FROM f GROUP BY 1")
def folded_states(spark, sf):
    """The state that each user's log folds to, parts of it delivered twice."""
    return changes.folded(_log(spark, sf), changes.CANDIDATE_STEPS, "discovered")


@query("change_outcomes", f"WITH RECURSIVE {FOLD} SELECT outcome, count(*) AS n FROM f WHERE nth > 0 GROUP BY 1 UNION ALL SELECT 'replayed', count(*) FROM e WHERE goal = 'failed'")
def change_outcomes(spark, sf):
    """How many events were applied, lost a race, had no such step, or came again."""
    return changes.apply_log(_log(spark, sf), changes.CANDIDATE_STEPS, "discovered").groupBy("outcome").agg(F.count("*").alias("n"))


#: Answers of a model to each question, about the hits it was given: some refuse, some cite what was not there.
@query(
    "checked_answers",
    """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'not_json' WHEN c_mktsegment = 'MACHINERY' THEN 'cited_chunk_ids: missing' WHEN c_acctbal < 0 AND c_mktsegment = 'HOUSEHOLD' THEN 'a refusal has no reason' WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal > 8000 THEN 'a citation is from elsewhere' END AS error, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND NOT (c_acctbal < 0 AND c_mktsegment = 'HOUSEHOLD') AND c_acctbal <= 8000 THEN CASE WHEN c_acctbal < 0 THEN '' ELSE 'n' || c_nationkey END END AS cited FROM customer""",
)
def checked_answers(spark, sf):
    """What is wrong with structured answers, or the ids that they cite."""
    c = tables.read(spark, sf, "customer")
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    refuses = F.col("c_acctbal") < 0
    reason = F.when(refuses & (F.col("c_mktsegment") != "HOUSEHOLD"), "nothing found")
    cited = F.when(refuses, F.array().cast("array<string>")).when(F.col("c_acctbal") > 8000, F.array(nation, F.lit("x"))).otherwise(F.array(nation))
    whole = F.struct(F.col("c_name").alias("answer"), cited.alias("cited_chunk_ids"), refuses.alias("refusal"), reason.alias("refusal_reason"))
    text = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Sure! "), F.to_json(whole))).when(F.col("c_mktsegment") == "MACHINERY", F.to_json(F.struct(F.col("c_name").alias("answer")))).otherwise(F.to_json(whole))
    told = contracts.check_answers(c.select(F.col("c_custkey").alias("id"), text.alias("text"), F.array(nation, F.lit("n99")).alias("context")), "id", "text", "context")
    return told.select("id", "error", F.array_join("cited", ",").alias("cited"))
