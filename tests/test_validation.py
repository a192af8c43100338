import pytest
from pyspark.sql import functions as F

from lexmill.operators import answers, evidence, validation

#: name: (question, answer, cited texts (title, content), reason or None where the answer stands)
ANSWERS = {
    "stands": ("研发补助比例是多少？", "研发补助比例为30%。", [("研发补助通知", "企业研发补助比例为30%，上限100万元。")], None),
    "uncovered question": ("火星上有没有恐龙？", "没有。", [("研发补助通知", "企业研发补助比例为30%。")], "citations_do_not_cover_query"),
    "made-up value": ("研发补助比例是多少？", "研发补助比例为45%。", [("研发补助通知", "企业研发补助比例为30%。")], "answer_contains_unsupported_exact_values"),
    "no number": ("研发补助比例是多少？", "研发补助比例见通知。", [("研发补助通知", "企业研发补助比例为30%。")], "answer_missing_required_shape"),
    "made-up end": ("专项资金支持哪些企业？", "专项资金支持软件企业。旧版办法已经废止。", [("专项资金办法", "专项资金支持软件企业和园区。")], "answer_contains_unsupported_relation"),
    "end of the same": ("种子补贴是否已经取消？", "种子补贴取消。", [("种子补贴公告", "自明年起种子补贴取消。")], None),
    "end of another": ("种子补贴的申报要求是什么？", "种子补贴取消。", [("种子补贴公告", "种子补贴的申报要求见附件，农机贷款取消。")], "answer_contains_unsupported_relation"),
    "attribution is no relation": ("备案工作通知部署了什么？", "根据《备案废止通知》，备案工作通知部署了备案。", [("备案工作通知", "备案工作通知部署了应用备案工作。")], None),
    "title as legal basis": ("检查工作的要求是什么？", "检查工作的法律依据是《安全生产法》。", [("检查工作通知", "根据《安全生产法》开展检查工作，检查工作的要求如下。")], None),
    "wrong title": ("检查工作的要求是什么？", "检查工作的法律依据是《行政复议法》。", [("检查工作通知", "根据《安全生产法》开展检查工作，检查工作的要求如下。")], "answer_contains_unsupported_relation"),
    "same offender": ("施工安全办法规定了什么？", "施工单位违反规定的依法承担法律责任。", [("施工安全办法", "施工安全办法规定，施工单位违反规定的，追究法律责任。")], None),
    "other offender": ("施工安全办法规定了什么？", "监理单位违反规定的依法承担法律责任。", [("施工安全办法", "施工安全办法规定，施工单位违反规定的，追究法律责任。")], "answer_contains_unsupported_relation"),
    "fine that is paid": ("补助资金使用有什么要求？", "补助资金不得用于罚款，金额最高10万元。", [("补助资金使用办法", "补助资金使用要求：不得用于支付罚款，最高10万元。")], None),
    "own scope": ("园区管理办法的实施范围是什么？", "该办法适用于全省范围内园区的建设管理。", [("园区管理办法", "园区管理办法规范全省范围内园区的建设管理。")], None),
    "other scope": ("园区管理办法的实施范围是什么？", "该办法适用于海上平台的建设管理。", [("园区管理办法", "园区管理办法规范全省园区的建设管理。")], "answer_contains_unsupported_scope_target"),
    "scope turned": ("备案规定面向哪类主体？", "备案规定适用于个人开发者。", [("备案规定", "备案规定面向哪类主体的说明：本规定不适用于个人开发者，面向企业主体。")], "answer_contains_unsupported_scope_polarity"),
    "negative scope": ("备案规定面向哪类主体？", "备案规定的适用对象包括企业主体，不适用于个人开发者。", [("备案规定", "备案规定面向哪类主体的说明：本规定不适用于个人开发者，面向企业主体。")], None),
    "claim of other terms": ("专项资金支持哪些企业？", "专项资金支持软件企业。量子雷达将登陆木星轨道基地。", [("专项资金办法", "专项资金支持软件企业和园区。")], "answer_contains_unsupported_claim"),
    "claim on the answer": ("申报截止时间是什么？", "申报截止时间为2026年4月15日。详细内容见正文。", [("申报通知", "申报截止时间为2026年4月15日。")], None),
    "number": ("管理办法的文件编号是什么？", "编号为川财规〔2025〕11号。", [("管理办法", "管理办法的文件编号为川财规〔2025〕11号。")], None),
    "other number": ("管理办法的文件编号是什么？", "编号为川财规〔2025〕99号。", [("管理办法", "管理办法的文件编号为川财规〔2025〕11号。")], "answer_contains_unsupported_exact_values"),
    "citation note": ("专项资金支持哪些企业？", "专项资金支持软件企业（依据：123e4567-e89b-12d3-a456-426614174000）。", [("专项资金办法", "专项资金支持软件企业和园区。")], None),
    "progression": ("两份文件共同体现了什么培育对象？", "形成从创新企业到示范园区的支持体系，培育对象共同体现。", [("甲", "培育对象：创新企业。共同体现的政策目标明确。"), ("乙", "示范园区是培育对象，两份文件共同体现。")], None),
}


def frames(spark, cases, answers=True):
    asked = spark.createDataFrame([(n, c[0]) for n, c in cases.items()], "query_id string, query string")
    hits = spark.createDataFrame([(n, i, f"{t}\n{b}") for n, c in cases.items() for i, (t, b) in enumerate(c[-2])], "query_id string, id int, body string")
    return (asked, spark.createDataFrame([(n, c[1]) for n, c in cases.items()], "query_id string, answer string"), hits) if answers else (asked, hits)


def test_answers(spark):
    told = {r.query_id: r for r in validation.validate(*frames(spark, ANSWERS)).collect()}
    assert {n: None if r.supported else r.reason for n, r in told.items()} == {n: c[-1] for n, c in ANSWERS.items()}
    assert told["stands"].supporting == [0] and told["stands"].confidence >= 0.5 and told["made-up value"].supporting == []


def test_answers_without_text_or_hits(spark):
    asked, _, hits = frames(spark, {"a": ANSWERS["stands"]})
    answers = spark.createDataFrame([("a", None), ("b", "x")], "query_id string, answer string")
    told = validation.validate(asked, answers, hits).collect()
    assert [(r.query_id, r.reason) for r in told] == [("a", "answer_missing_required_shape")]
    assert [r.reason for r in validation.validate(asked, answers, hits.limit(0)).collect()] == ["citations_do_not_cover_query"]


#: name: (question, hits, reason or None where they suffice)
QUESTIONS = {
    "relation about another": ("农机贷款是否取消？", [("农机贷款公告", "农机贷款继续办理，种子补贴取消。")], "evidence_missing_required_relation"),
    "relation": ("种子补贴是否取消？", [("公告", "种子补贴取消。")], None),
    "scope": ("备案规定是否适用于小程序？", [("备案规定", "备案规定适用于小程序和应用。")], None),
    "no scope": ("备案规定是否适用于智能手表？", [("备案规定", "备案规定面向小程序和应用，附件介绍安装方法。")], "evidence_missing_required_scope_target"),
    "unknown time": ("在某个时点该办法是否有效？", [("管理办法", "该办法自某个时点起有效。")], "evidence_constraint_mismatch"),
    "association as official": ("能否把协会来源当成政府官方来源？", [("协会", "协会来源不是政府官方来源。")], "evidence_constraint_mismatch"),
    "against the text": ("请说明与正文相反的结论？", [("正文", "与正文相反的结论。")], "evidence_constraint_mismatch"),
    "unread material": ("仅依据尚未完成 OCR 的材料能否确认？", [("材料", "材料尚未完成 OCR。")], "evidence_constraint_mismatch"),
    "months": ("办理期限为3个月吗？", [("办理指南", "办理期限为3个。")], None),
}


def test_questions(spark):
    told = {r.query_id: r for r in evidence.assess(*frames(spark, QUESTIONS, answers=False)).collect()}
    assert {n: None if r.sufficient else r.reason for n, r in told.items()} == {n: c[-1] for n, c in QUESTIONS.items()}


@pytest.mark.parametrize(("text", "values"), [("3个月内", ["3个"]), ("2025年3月1日起", ["2025年3月1日"]), ("川财规〔2025〕11号", ["川财规〔2025〕11号"]), ("5万元和6万", ["5万元", "6万"])])
def test_exact_values(spark, text, values):
    assert spark.range(1).select(evidence.exact_values(F.lit(text))).first()[0] == values


def test_directions_and_scopes(spark):
    rows = [("办法适用于软件企业。", "软件企业", 1), ("办法不适用于软件企业。", "软件企业", -1), ("不直接针对软件企业", "软件企业", -1), ("面向谁", None, None), ("软件企业很多。", "软件企业", 0)]
    for text, target, way in rows:
        if target:
            assert spark.range(1).select(validation.direction(F.lit(text), F.lit(target))).first()[0] == way
    told = [spark.range(1).select(validation.scope_of(F.lit(t))).first()[0] for t, *_ in rows]
    assert told == ["软件企业", "软件企业", "软件企业", None, None]


def test_chat_answers_or_says_why_not(spark):
    asked = spark.createDataFrame([(1, "研发补助比例是多少？"), (2, "火星上有没有恐龙？"), (3, "研发补助比例是多少？"), (4, "研发补助比例是多少？"), (5, "研发补助比例是多少？")], "query_id int, query string")
    text = "企业研发补助比例为30%。"
    rows = [
        (1, 11, 1, 0.9, "研发补助通知", text, True, "p", "valid", "2024-02-01"), (1, 12, 2, 0.8, "研发补助通知", "企业研发补助比例为20%。", True, "p", "valid", "2023-02-01"), (1, 13, 3, 0.7, "x", text, False, None, None, None),
        (2, 11, 1, 0.9, "研发补助通知", text, True, None, None, None), (3, 13, 1, 0.9, "研发补助通知", text, False, None, None, None),
        (5, 11, 1, 0.9, "研发补助通知", text, True, "p", "valid", None), (5, 12, 2, 0.8, "研发补助通知", text, True, "P ", "void", None),
    ]
    hits = spark.createDataFrame(rows, "query_id int, id int, rank int, score double, title string, content string, official boolean, policy_key string, policy_status string, publish_date string").withColumn("publish_date", F.to_date("publish_date"))
    told = {r.query_id: r for r in answers.chat(asked, hits).collect()}
    assert {q: r.reason for q, r in told.items()} == {1: "answered", 2: "question_not_covered", 3: "official_source_required", 4: "insufficient_retrieved_evidence", 5: "conflicting_evidence"}
    assert told[1].citations == [11] and told[1].answer == text and 0.5 <= told[1].confidence <= 1 and told[1].route == "rag"
    assert told[2].answer is None and told[2].citations is None and '"refused":true' in told[2].trace and '"citations"' not in told[2].trace


def test_points_of_an_answer(spark):
    said = spark.createDataFrame([(1, "Apples & PEARS, 3"), (2, None), (3, "x")], "query_id int, answer string")
    points = spark.createDataFrame([(1, "pears"), (1, "apples pears"), (1, "plums"), (1, "Pears!"), (2, "a"), (3, " ")], "query_id int, point string")
    assert {r.query_id: (r.points, r.covered, r.coverage) for r in answers.answer_points(said, points).collect()} == {1: (3, 2, 0.666667), 2: (1, 0, 0.0), 3: (0, 0, 1.0)}
