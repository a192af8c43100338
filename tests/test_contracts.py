import copy
import json

from lexmill.operators import contracts

ARTICLE = {"title": "T", "url": "https://h/a", "content": "héllo", "content_length": 5, "extraction_method": "html", "decision": "accepted", "accepted": True, "decision_reason": "ok"}
COUNTS = {"pages_visited": 1, "articles_discovered": 1, "articles_fetched": 1, "articles_accepted": 1, "articles_rejected": 0, "articles_pending_review": 0, "articles_failed": 0}
GOOD = {"success": True, "task_id": "t1", "source": {"url": "https://h/"}, "statistics": COUNTS, "articles": [ARTICLE], "failed_urls": [], "warnings": []}


def with_(path, value):
    """GOOD with one thing changed; a value of ... takes it away."""
    out = copy.deepcopy(GOOD)
    at = out
    *way, last = path
    for p in way:
        at = at[p]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return out


FAULTS = {
    ("success",): ("yes", ("success", "bool")),
    ("task_id",): ("", ("task_id", "empty")),
    ("warnings",): (..., ("warnings", "missing")),
    ("extra",): (1, ("extra", "unknown")),
    ("started_at",): ("no time", ("started_at", "time")),
    ("source",): ({"url": "ftp://h"}, ("source.source_url", "url")),
    ("statistics", "pages_visited"): (-1, ("statistics.pages_visited", "count")),
    ("statistics", "articles_accepted"): (2, ("statistics.articles_accepted", "is not the number of such articles")),
    ("statistics", "articles_fetched"): (3, ("statistics.articles_fetched", "is not the number of articles")),
    ("failed_urls",): ([{"url": "https://h/x", "stage": "s", "error_code": "c", "error_message": "m"}], ("statistics.articles_failed", "is not the number of failures")),
    ("articles", 0, "url"): ("nowhere", ("articles[0].url", "url")),
    ("articles", 0, "decision"): ("maybe", ("articles[0].decision", "decision")),
    ("articles", 0, "content_length"): (6, ("articles[0].content_length", "is not the length of content")),
    ("articles", 0, "accepted"): (False, ("articles[0].accepted", "is not the decision")),
    ("articles", 0, "extraction_method"): ("image", ("articles[0].needs_ocr", "must be true for an image")),
    ("articles", 0, "image_count"): (1, ("articles[0].image_count", "is not the number of image_urls")),
    ("articles", 0, "quality_score"): (101, ("articles[0].quality_score", "score")),
    ("articles", 0, "title"): (None, ("articles[0].title", "text")),
}


def test_every_fault_is_told_at_its_place(spark):
    texts = [(str(path), json.dumps(with_(path, value), ensure_ascii=False)) for path, (value, _) in FAULTS.items()]
    told = {r.id: (r.place, r.error) for r in contracts.parse_batches(spark.createDataFrame(texts, "id string, text string"), "id", "text").collect()}
    assert told == {str(path): fault for path, (_, fault) in FAULTS.items()}


def test_answers_are_unwrapped_to_a_depth(spark):
    good = json.dumps(GOOD, ensure_ascii=False)
    nulls = json.dumps({**GOOD, "contract_version": None, "diagnostics": None, "articles": [{**ARTICLE, "quality_score": None, "published_at": "2024-05-01"}]})
    texts = {
        "plain": good, "fenced": f" ```json\n{good}\n``` ", "data": json.dumps({"data": GOOD}), "text": json.dumps({"output": good}), "nulls": nulls,
        "deep": json.dumps({"data": {"result": good}}), "too deep": json.dumps({"data": {"data": {"data": GOOD}}}), "prose": f"Here: {good}", "list": "[1]", "none": None, "no articles": json.dumps({**GOOD, "articles": [], "statistics": {**COUNTS, "articles_accepted": 0, "articles_fetched": 0}}),
    }
    rows = contracts.parse_batches(spark.createDataFrame(list(texts.items()), "id string, text string"), "id", "text").collect()
    good_ids = {r.id for r in rows if r.error is None}
    assert good_ids == {"plain", "fenced", "data", "text", "nulls"} and all((r.task_id, r.nth, r.title, r.content_length) == ("t1", 0, "T", 5) for r in rows if r.error is None)
    assert {r.id: r.error for r in rows if r.place == "" and r.error} == {"prose": "not_json", "list": "not_an_object", "none": "not_json", "deep": "not_an_object"}
    assert {r.id for r in rows if r.error == "missing"} == {"too deep"}


def test_model_answers(spark):
    cases = {
        '{"answer": "A", "cited_chunk_ids": ["c1"]}': None,
        '{"answer": "No.", "cited_chunk_ids": [], "refusal": true, "refusal_reason": "none"}': None,
        '{"answer": "A"}': "cited_chunk_ids: missing",
        '{"answer": "A", "cited_chunk_ids": ["c1"], "sources": []}': "sources: unknown",
        '{"answer": 3, "cited_chunk_ids": ["c1"]}': "answer: text",
        '{"answer": " ", "cited_chunk_ids": ["c1"]}': "answer is empty",
        '{"answer": "A", "cited_chunk_ids": [1]}': "cited_chunk_ids: text",
        '{"answer": "A", "cited_chunk_ids": ["c1"], "refusal": true, "refusal_reason": "r"}': "a refusal cites",
        '{"answer": "A", "cited_chunk_ids": [], "refusal": true}': "a refusal has no reason",
        '{"answer": "A", "cited_chunk_ids": []}': "an answer cites nothing",
        '{"answer": "A", "cited_chunk_ids": ["c1"], "refusal_reason": "r"}': "an answer has a refusal's reason",
        '{"answer": "A", "cited_chunk_ids": ["c1", "c9"]}': "a citation is from elsewhere",
        "Sorry": "not_json",
        "[]": "not_an_object",
    }
    df = spark.createDataFrame([(t, ["c1", "c2"]) for t in cases], "text string, context array<string>")
    told = {r.text: r for r in contracts.check_answers(df.selectExpr("text", "text as body", "context"), "text", "body", "context").collect()}
    assert {t: r.error for t, r in told.items()} == cases
    assert [r.cited for t, r in told.items() if cases[t] is None] == [["c1"], []] and told["Sorry"].answer is None


def test_long_answers_are_not_described_to_be_checked(spark):
    """The type of an answer is not written out with all that it holds, and its entries are not made text and read again."""
    v = contracts.F.col("v")
    for column in (contracts.unwrapped(contracts.F.col("text")), contracts._batch_faults(v)):
        plan = str(column)
        assert "to_json" not in plan and "from_json" not in plan
    nested = [("o", '{"a": {"b": [1]}, "c": null}'), ("l", '[{"a": 1}, 2]'), ("s", '"{}"'), ("n", "null"), ("x", "{"), ("e", "{}"), ("m", "[]")]
    rows = spark.createDataFrame(nested, "id string, text string").select("id", contracts.F.try_parse_json("text").alias("v"))
    told = {r.id: tuple(r)[1:] for r in rows.select("id", contracts.J.is_object(v), contracts.J.is_list(v), contracts.J.names(v), contracts.J.is_object(v, "$.a"), contracts.J.is_list(v, "$.a.b")).collect()}
    none = (False, False, None, False, False)
    assert told == {"o": (True, False, ["a", "c"], True, True), "l": (False, True, None, False, False), "s": none, "n": none, "x": none, "e": (True, False, [], False, False), "m": (False, True, None, False, False)}
