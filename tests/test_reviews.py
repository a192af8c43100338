import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexmill.functions import json as J
from lexmill.operators import review
from lexmill.sources import tables

FIELDS = "map<string,struct<value:string,quote:string,confidence:double>>"


def test_the_review_ladder(spark):
    docs = spark.createDataFrame([(i, "the fee is 5", d) for i, d in enumerate("accept accept review reject accept accept accept review accept".split())], "doc_id long, content string, rule_decision string")
    good = {"deadline": ("5", "fee is 5", 0.5)}
    verdicts = spark.createDataFrame(
        [(0, "accept", good), (1, " Reject ", None), (2, "accept", {}), (3, "accept", good), (5, "maybe", None), (6, "accept", {"deadline": ("6", "fee is 6", 0.5)}), (7, "accept", {"colour": ("5", "5", 0.5)}), (8, "accept", {"region": ("5", "5", 1.5)})],
        f"doc_id long, decision string, fields {FIELDS}",
    )
    told = {r.doc_id: (r.llm_status, r.final_status, r.fault, r.knowledge) for r in review.review_pipeline(docs, verdicts).collect()}
    assert told == {
        0: ("accept", "approved", None, 1),
        1: ("reject", "rejected", None, 0),
        2: ("accept", "pending_manual_review", None, 0),
        3: (None, "rejected", None, 0),
        4: ("unavailable", "pending_llm", None, 0),
        5: ("unavailable", "pending_llm", None, 0),
        6: ("unavailable", "pending_llm", "no such quote: deadline", 0),
        7: ("unavailable", "pending_llm", "unsupported field: colour", 0),
        8: ("unavailable", "pending_llm", "invalid field: region", 0),
    }
    people = spark.createDataFrame([(1, "approve", 2), (1, "reject", 1), (0, "reject", 1), (0, "later", 9)], "doc_id long, decision string, at int")
    final = {r.doc_id: r.final_status for r in review.review_pipeline(docs, verdicts, people).collect()}
    assert (final[0], final[1], final[2]) == ("rejected", "approved", "pending_manual_review")


def test_prompts_stand_for_one_content(spark):
    have = spark.createDataFrame([("p", "v1", "A")], "name string, version string, content string").select("name", "version", F.sha2("content", 256).alias("content_hash"))
    wanted = spark.createDataFrame([("p", "v1", "A"), ("p", "v2", "B"), ("q", "v1", "C"), ("q", "v1", "D"), ("p", "v1", "A")], "name string, version string, content string")
    assert {(r.name, r.version): r.state for r in review.ensured_prompts(have, wanted).collect()} == {("p", "v1"): "kept", ("p", "v2"): "new", ("q", "v1"): "changed"}
    assert review.ensured_prompts(have, spark.createDataFrame([("p", "v1", "a")], "name string, version string, content string")).first().state == "changed"


def test_json_safe_values(spark):
    row = (float("nan"), Decimal("1.50"), date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), [float("inf"), 2.0], {1: float("-inf")}, (None, Decimal("2.00")), b"x", None)
    df = spark.createDataFrame([row], "a double, b decimal(5,2), c date, d timestamp, e array<double>, f map<int,double>, g struct<x:double,y:decimal(5,2)>, h binary, i struct<x:double>")
    told = json.loads(J.json_safe(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first().j)
    assert told == {"a": None, "b": 1.5, "c": "2024-01-02", "d": "2024-01-02T03:04:05Z", "e": [None, 2.0], "f": {"1": None}, "g": {"x": None, "y": 2.0}, "h": "x", "i": None}
    assert df.select(J.payload(a=F.lit(None), b=F.lit("x"), c=F.col("b"))).first()[0] == '{"b":"x","c":1.50}'


def test_reports_and_indexes_are_put_in_place_whole(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b", ["x"]), (2, None, [])], "n int, t string, l array<string>")
    for _ in range(2):
        tables.write_report(rows, f"{tmp_path}/r", "Runs")
    folder = tables.Folder(spark, f"{tmp_path}/r")
    assert folder.names() == ["csv", "json", "markdown"] and tables.Folder(spark, f"{tmp_path}").names() == ["r"]
    head = tables.Folder(spark, f"{tmp_path}/r/markdown").read("_head.md")
    assert head == "# Runs\n\n| n | t | l |\n| --- | --- | --- |\n"
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/r/markdown").collect()) == ['| 1 | a\\|b | ["x"] |', "| 2 |  | [] |"]
    with pytest.raises(Exception, match="broken"):
        tables.write_report(rows.withColumn("t", F.raise_error(F.lit("broken"))), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r/json").count() == 2 and tables.Folder(spark, f"{tmp_path}").names() == ["r"]

    index = {name: spark.createDataFrame([(name,)], "x string") for name in tables.INDEX_TABLES}
    assert [tables.save_index(index, f"{tmp_path}/i") for _ in range(2)] == [1, 2]
    assert tables.load_index(spark, f"{tmp_path}/i")["terms"].first().x == "terms"
    tables.Folder(spark, f"{tmp_path}/i").publish("index-00000003.json", json.dumps({"layout": 99, "data": "d"}))
    with pytest.raises(ValueError, match="layout 99"):
        tables.load_index(spark, f"{tmp_path}/i")
    assert tables.load_index(spark, f"{tmp_path}/i", version=2)["corpus"].count() == 1
    with pytest.raises(FileNotFoundError):
        tables.load_index(spark, f"{tmp_path}/none")


def test_faults_of_review_rows(spark):
    good = ("q1", "PASS", None, [1, 2], ["u1", "u2"], [10], [10, 20], False, "alpha beta", "D1 | D2", "S1 | S2")
    names = ("id", "verdict", "corrected_answer", "document_ids", "source_urls", "expected_chunk_ids", "effective_chunk_ids", "effective_should_refuse", "evidence_excerpt", "document_title", "source_title")
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(names, good, strict=True))
    rows = [
        good, change(id="q2", verdict="OK"), change(id="q3", verdict="FIX", corrected_answer=" "), change(id="q4", document_ids=[1, 9], document_title="D1", source_title="S1", effective_chunk_ids=[10]),
        change(id="q5", source_urls=["u1"]), change(id="q6", effective_chunk_ids=[10, 99]), change(id="q7", document_ids=[2], document_title="D2", source_title="S2", effective_chunk_ids=[10]), change(id="q8", evidence_excerpt="other"),
        change(id="q9", document_title="X", source_title=None), change(id="q10", document_ids=[], source_urls=[], expected_chunk_ids=[], effective_chunk_ids=[], evidence_excerpt=""), change(id="q11", document_ids=[], source_urls=[], expected_chunk_ids=[], effective_chunk_ids=[], evidence_excerpt="", effective_should_refuse=True),
        change(id="q12"), change(id="q12"), change(id=" "), change(id=None),
    ]
    df = spark.createDataFrame(rows, "id string, verdict string, corrected_answer string, document_ids array<int>, source_urls array<string>, expected_chunk_ids array<int>, effective_chunk_ids array<int>, effective_should_refuse boolean, evidence_excerpt string, document_title string, source_title string")
    documents = spark.createDataFrame([(1, "u1", "D1", "S1"), (2, "u2", "D2", "S2")], "document_id int, url string, title string, source_title string")
    chunks = spark.createDataFrame([(10, 1, " alpha\n beta "), (20, 2, "gamma")], "chunk_id int, document_id int, content string")
    told = sorted(r.error for r in review.row_faults(df, documents, chunks).collect())
    assert told == sorted(
        ["INVALID_VERDICT:q2", "FIX_REQUIRES_CORRECTED_ANSWER:q3", "UNKNOWN_DOCUMENT:q4:9", "SOURCE_URL_MISMATCH:q5:2", "UNKNOWN_CHUNK:q6:99", "CHUNK_DOCUMENT_MISMATCH:q7:10", "EVIDENCE_EXCERPT_MISMATCH:q8", "DOCUMENT_TITLE_MISMATCH:q9", "SOURCE_TITLE_MISMATCH:q9"]
        + [f"POSITIVE_CASE_MISSING_{k}:q10" for k in ("DOCUMENT", "SOURCE", "CHUNK", "EVIDENCE")]
        + ["DUPLICATE_ID:q12", "MISSING_ID"]
    )
