"""Literal rows for files, reviews, evidence and state."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.functions import json as J
from lexmill.operators import discovery, evaluation, evidence, experiments, lifecycle
from lexmill.sources import files, tables


def archive(*names):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return raw.getvalue()


def test_decoding_and_archives(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("\ufeffé".encode())
    (tmp_path / "b.txt").write_bytes("政策".encode("gb18030"))
    (tmp_path / "c.zip").write_bytes(archive("ok/a.txt", "../up.txt", "/abs"))
    rows = files.read_files(spark, str(tmp_path), "*.txt").select(files.decode_text("content").alias("t"))
    assert {r.t for r in rows.collect()} == {"é", "政策"}
    entries = files.read_files(spark, str(tmp_path), "*.zip").select(files.zip_entries("content").alias("e")).first().e
    assert [(e.name, e.unsafe_path, e.uncompressed_size) for e in entries] == [("ok/a.txt", False, 1), ("../up.txt", True, 1), ("/abs", True, 1)]
    assert files.read_files(spark, str(tmp_path), "a.txt").select(files.zip_entries("content").alias("e")).first().e is None


def test_magic_and_names(spark):
    heads = [b"%PDF-1.7", b"\x89PNG\r\n\x1a\n", b"RIFF\x00\x00\x00\x00WEBP", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", archive("word/document.xml"), archive("xl/a.xml"), b" <!DOCTYPE html>", b"plain text", b"\x00\x01", b""]
    rows = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "i int, h binary")
    got = [r.t for r in rows.select("i", files.magic_type(F.col("h")).alias("t")).orderBy("i").collect()]
    assert got == ["pdf", "png", "webp", "legacy_office", "docx", "xlsx", "html", "txt", None, None]
    names = spark.createDataFrame([("a.PDF",), ("no ending",), ("x\\y.tar.gz",), (".hidden",)], "n string")
    assert [r.s for r in names.select(files.suffix(F.col("n")).alias("s")).collect()] == ["pdf", "", "gz", ""]
    assert spark.createDataFrame([("x/a b.TXT",)], "n string").select(files.safe_filename(F.col("n")).alias("s")).first().s.startswith("a_b-")
    assert spark.createDataFrame([("a.htm",)], "n string").select(files.parser_for(F.col("n")).alias("p")).first().p == "html"


def test_page_frames(spark):
    pages = [(1, 1, "Head\none\nFoot"), (1, 2, "Head\ntwo\nFoot"), (1, 3, "Head\n\nthree\nend"), (2, 1, "only\nFoot")]
    out = files.without_page_frames(spark.createDataFrame(pages, "doc_id long, page int, text string"))
    assert sorted((r.doc_id, r.page, r.text) for r in out.collect()) == [(1, 1, "one"), (1, 2, "two"), (1, 3, "three\nend"), (2, 1, "only\nFoot")]
    whole = {r.doc_id: (r.text, r.requires_ocr) for r in files.parsed_pages(out).collect()}
    assert whole == {1: ("one\n\ntwo\n\nthree\nend", True), 2: ("only\nFoot", True)}


def test_evaluation_of_two_samples(spark):
    """One sample found at the second place, one refused wrongly."""
    schema = "question_id long, retrieved_ids array<string>, relevant_ids array<string>, retrieved_document_ids array<string>, relevant_document_ids array<string>, expected_answer_points array<string>, covered_answer_points array<string>, expected_citation_ids array<string>, cited_ids array<string>, cited_document_ids array<string>, should_refuse boolean, refused boolean, evaluation_failed boolean, grounding_validated boolean, hallucinated_claims long, claim_count long, token_count long, latency_ms double, cost double"
    rows = [
        (1, ["x", "a", "a"], ["a"], [], [], ["p"], ["p"], ["a"], ["a"], [], False, False, False, None, 1, 4, 20, 100.0, 0.1),
        (2, ["y", "z"], ["b"], [], [], [], [], ["b"], [], [], False, True, False, None, 0, 0, 40, 300.0, 0.3),
    ]
    m = evaluation.aggregate_samples(evaluation.evaluate_samples(spark.createDataFrame(rows, schema))).first().asDict()
    assert (m["recall_at_1"], m["recall_at_5"], m["mrr"], m["ndcg_at_10"]) == (0.0, 0.5, 0.25, round(0.5 / 1.5849625007211562, 6))
    assert (m["citation_precision"], m["hallucination_rate"], m["p50_latency_ms"], m["p95_latency_ms"], m["average_tokens"]) == (0.5, 0.25, 100.0, 300.0, 30.0)
    assert (m["emitted_citation_precision"], m["supported_answer_recall"], m["refusal_precision"], m["question_count"]) == (1.0, 0.5, 0.0, 2)
    none = evaluation.aggregate_samples(evaluation.evaluate_samples(spark.createDataFrame([], schema))).first()
    assert none.question_count == 0 and none.mrr == none.p95_latency_ms == 0.0


def test_nearest_rank_in_buckets(spark):
    rows = [("a", float(x)) for x in [*range(100), *[7] * 200]] + [("b", 1.5), ("c", None)]
    got = {r.k: (r.p50, r.p99) for r in evaluation.nearest_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p99": 0.99}, buckets=8).collect()}
    assert got == {"a": (7.0, 96.0), "b": (1.5, 1.5)}


def test_strict_json(spark):
    texts = ['{"total_tokens": 5}', '{"tokens": true, "prompt_tokens": 2}', '{"prompt_tokens": 1, "completion_tokens": 2}', "{}", "no"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", J.parsed(F.col("t")).alias("v"))
    assert [r.n for r in rows.select("i", J.trace_tokens(F.col("v")).alias("n")).orderBy("i").collect()] == [5, 2, 3, None, None]


def test_topic_relevance(spark):
    rows = [("软件产业发展规划", "", "软件 产业"), ("软件采购公告", "软件产业", "软件产业"), ("新闻 软件企业", "", "软件"), ("x", "工业软件 扶持政策", "软件政策"), ("x", "信息化", "软件政策"), ("Open data portal", "", "open data"), ("a", "data only", "open data"), ("a", "b", " ")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, t string")
    got = [r.r for r in frame.select("i", discovery.relevance(F.col("a"), F.col("b"), F.col("t")).alias("r")).orderBy("i").collect()]
    assert got == ["DIRECT", "UNRELATED", "WEAK", "RELATED", "WEAK", "DIRECT", "RELATED", "UNRELATED"]


def test_evidence_parts(spark):
    one = spark.range(1)
    q = F.lit("《a？b》的补助金额是多少？ 2021年之后；国发〔2020〕5号")
    assert one.select(evidence.aspects(q).alias("x")).first().x == ["《a？b》的补助金额是多少", "2021年之后", "国发〔2020〕5号"]
    terms = one.select(evidence.weighted_terms(F.lit("support 软件产业")).alias("x")).first().x
    assert terms["support"] == 3.5 and terms["软件产业"] == 4.0 and terms["软件"] == 1.0 and terms["软件产"] == 2.0
    assert one.select(evidence.constraints(F.lit("2021年之后 国发〔2020〕5号 3万元")).alias("x")).first().x == ["国发〔2020〕5号", "3万元"]
    shapes = [("什么时候", "2021年5月", True), ("什么时候", "明天", False), ("比例", "5%", True), ("罚款金额", "罚款", False), ("联系电话", "13812345678", True), ("名单", "一、二", True), ("支持措施", "无", False)]
    for asked, said, want in shapes:
        assert one.select(evidence.shape_met(F.lit(asked), F.lit(said)).alias("x")).first().x is want, asked
    assert one.select(evidence.claim_supported(F.lit("企业可获得补助5万元"), F.lit("企业 可获得 补助，5 万元")).alias("x")).first().x is True
    assert one.select(evidence.claim_supported(F.lit("补助6万元"), F.lit("企业补助5万元")).alias("x")).first().x is False


def test_task_transitions(spark):
    assert lifecycle.transitions(spark).count() == 36
    tasks = spark.createDataFrame([(1, "pending"), (2, "running"), (3, "completed")], "task_id long, status string").selectExpr("*", "cast(null as timestamp) as started_at", "cast(null as timestamp) as finished_at")
    steps = spark.createDataFrame([(1, "pending", "running"), (2, "pending", "queued"), (3, "completed", "pending")], "task_id long, expected string, target string")
    out = {r.task_id: (r.status, r.moved) for r in lifecycle.advance(tasks, steps, F.current_timestamp()).collect()}
    assert out == {1: ("running", True), 2: ("running", False), 3: ("completed", False)}


def test_experiment_rules(spark):
    v = experiments.Variant("a", {"chunk_size": 600, "chunking": {"max_chars": 900}, "overlap": 50, "top_k": 7})
    assert (v.chunks().target, v.chunks().most, v.chunks().overlap, v.chunks().least, v.depth()) == (600, 900, 50, 160, 7)
    for make in (lambda: experiments.Variant("a", {"colour": 1}), lambda: experiments.Variant("a", {"rrf_k": float("nan")}), lambda: experiments.Experiment("x", v, v), lambda: experiments.Variant("a", {"chunking": {"size": 1}}).chunks()):
        with pytest.raises(ValueError):
            make()
    cases = lambda rows: spark.createDataFrame(rows, "query_id long, recall double, hit double, mrr double, passed boolean")
    a, b = cases([(1, 1.0, 1.0, 1.0, True), (2, 0.0, 0.0, 0.0, False)]), cases([(1, 0.5, 1.0, 0.5, False), (2, 0.0, 0.0, 0.0, False)])
    e = experiments.Experiment("x", experiments.Variant("a"), experiments.Variant("b"))
    out = {r.metric: (r.regressed, r.conclusion) for r in experiments.compare(e, a, b).collect()}
    assert {m: r[0] for m, r in out.items()} == {"recall": True, "hit": False, "mrr": True} and "2 candidate failed" in out["hit"][1]
    assert sorted((r.query_id, r.new_regression) for r in experiments.case_changes(a, b).collect()) == [(1, True), (2, False)]
    with pytest.raises(Exception, match="only one variant"):
        experiments.case_changes(a, b.where("query_id = 1")).collect()


def test_batches_of_long_texts_are_bounded_in_bytes(spark, tmp_path):
    """Python workers of a session without a bound of its own hold a megabyte or so of texts at a time."""
    import pandas as pd

    session = spark.newSession()
    session.range(600).select("id", F.repeat(F.lit("x"), 50_000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/long.parquet")

    @F.pandas_udf("long")
    def together(text: pd.Series) -> pd.Series:
        return pd.Series([len(text)] * len(text))

    most = tables.read(session, str(tmp_path), "long").select(together("text").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 40
