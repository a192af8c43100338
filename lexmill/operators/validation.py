"""Answers against their evidence: relation facts, scopes with a direction, claims, as column expressions over claims x hits.

A relation (an end, a penalty, a legal basis) is a word for it, the clause it stands in and what it is about; a scope is what a text applies
to, and whether it does or does not. A claim counts only where a text has the same relation about the same thing, or the same scope in the same direction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from . import evidence as E

#: Words for each relation, longest first.
CANCELLATION = ("不再实施", "取消", "撤销", "废止", "废除", "终止")
PENALTY = ("行政处罚", "法律责任", "罚款", "处罚")
LEGAL_BASIS = ("法律法规依据", "法律依据", "法定依据", "法律根据")
SUPPORT = ("支持", "补助", "资金", "奖励", "优惠", "贷款", "培训", "服务")
#: Fixed patterns: what only names a source, and fines that are paid rather than imposed.
CONTEXT = "(?:根据|依据)(?:提供的)?(?:上下文|检索内容|现有证据|上述证据)\\s*[,，]"
ATTRIBUTION = "(?s)(?:根据|依据)\\s*《.{1,240}?》(?:正文(?:内容)?|政策解读)?\\s*[,，]"
PAID_FINE = "((?:支付|用于|不得用于|禁止.{0,8}用于).{0,4})罚款"
CLAUSE_BREAK, SENTENCE_BREAK, SCOPE_BREAK = "[，,。；;\\n]|同时|但是|但|然而", "[。；;\\n]", "[。；;\\n]+"
#: Fixed patterns: who is punished.
ROLE = "((?:各)?参建(?:单位|各方)|[A-Za-z0-9（）()\\u4e00-\\u9fff]{1,12}(?:单位|部门|主体|人员|机构|企业|各方))"
OFFENCE = "违反|违法|违规"
#: Fixed patterns: what a text applies to, in order of precedence, and words that are no scope.
_NAME = "([A-Za-z0-9._+\\-\\u4e00-\\u9fff]{2,32})"
SCOPES = (
    f"(?:是否)?(?:适用于|面向){_NAME}",
    f"适用对象或实施范围(?:主要)?(?:是|为)?针对{_NAME}",
    f"(?:不|未|没有)(?:直接)?针对{_NAME}",
    f"适用(?:对象|范围)(?:是|为|包括|涵盖|覆盖){_NAME}",
)
EVERY_SCOPE = ("(?:涵盖|包括|覆盖)(?:所有|全部)?(微信小程序|小程序)", "(?:所有|全部)(微信小程序|小程序).{0,8}(?:必须|应当|需要|均应|都要)")
SCOPE_ENDS, NO_SCOPE = "(?:呢)?(?:吗)?(?:情形)?(?:对象)?(?:范围)?", ("什么", "哪些", "哪类", "何种", "谁")
SCOPE_FILLERS = ("符合条件的", "符合条件", "全省范围内", "范围内", "和", "的")
SCOPE_CUES = ("适用", "面向", "实施对象", "实施范围", "支持对象", "申请", "规范", "监管", "立足", "涵盖", "包括", "覆盖", "必须", "应当", "：")
AGAINST = "不(?:在.{0,12})?(?:适用|包括|涵盖|覆盖)|不适用|不包括|不涵盖|(?:不|未|没有)(?:直接)?针对|无需|不得"
FOR = "适用|面向|针对|涵盖|包括|覆盖|必须|应当"
#: Fixed patterns: questions that no evidence can answer.
UNKNOWN_TIME = "(?:(?:明显|显然)?不匹配|未明确|未知|不确定).{0,8}(?:历史)?(?:时间|日期|时点)|(?:某(?:个)?|那个)(?:历史)?时点|当时|彼时"
TIME_STATES = "生效|有效|废止|实施|已经"
NEVER = (
    "(?:把|将)?(?:协会|商会|联盟|学会|民间组织|行业组织|企业)(?:来源|材料|文件)?.{0,16}(?:当成|视为|作为|等同于|冒充|替代).{0,12}(?:政府)?官方(?:来源|文件|证明)?",
    "(?:证明|说明|确认|声称).{0,12}(?:与|同)(?:正文|原文|证据|材料).{0,8}(?:相反|矛盾|冲突)(?:的)?(?:结论|说法|内容)?|(?:与|同)(?:正文|原文|证据|材料).{0,8}(?:相反|矛盾|冲突)(?:的)?(?:结论|说法|内容)?",
    "(?i)(?:仅|只)?(?:根据|依据).{0,20}(?:尚未|未|没有)(?:完成)?\\s*(?:ocr|解析|识别|提取)",
)
#: Fixed patterns: claims about the answer itself, and notes of citations within it.
ABOUT_ANSWER = "^(?:该(?:总结|回答|答复|说明)(?:是)?基于|(?:详细|具体)内容(?:请)?见|上述(?:数字|数据|核对要点|内容|事项|信息|指标))"
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
CITATION_NOTE = f"(?i)[（(]\\s*(?:依据|引用|来源)(?:见|[:：])?\\s*{_UUID}(?:\\s*[；;,，]\\s*{_UUID})*\\s*[）)]"
PROGRESSION, PROGRESSION_CUES = "形成从([\\u4e00-\\u9fff]{2,24})到([\\u4e00-\\u9fff]{2,24})的(?:完整)?(?:支持)?体系", ("政策目标", "实施对象", "示范项目", "培育对象")
_TITLES = "《([^《》]+)》"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _places(text: Column, needle: Column) -> Column:
    """Places, from 1, where ``needle`` occurs."""
    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.length(needle)) == needle)
    return F.when(F.contains(text, needle), spots).otherwise(F.array().cast("array<int>"))


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9\\u4e00-\\u9fff]+", "")


def _all_in(values: Column, text: Column) -> Column:
    return F.forall(values, lambda v: F.contains(text, v))


def relation_terms(text: Column) -> Column:
    """What a clause is about: Latin words, short CJK runs, and both ends of long ones."""
    clean = E.for_matching(text)
    words = F.regexp_extract_all(clean, F.lit(f"({E.LATIN})"), F.lit(1))
    runs = F.filter(F.regexp_extract_all(clean, F.lit(f"({E.CJK})"), F.lit(1)), lambda s: (F.length(s) >= 2) & ~s.isin(*E.GENERIC_TERMS))
    ends = F.flatten(F.transform(runs, lambda s: F.when(F.length(s) > 6, F.array(F.substring(s, 1, 6), F.substring(s, -6, 6))).otherwise(F.array(s))))
    return F.array_distinct(F.concat(words, ends))


def _bound(text: Column, words: tuple[str, ...], about: Column, reach: int) -> Column:
    """Whether some clause has one of ``words`` with all of ``about`` within ``reach`` characters of it."""
    clauses = F.filter(F.split(text, CLAUSE_BREAK), lambda c: _any(c, words) & _all_in(about, c))
    at = lambda c: F.flatten(F.transform(_strings(*words), lambda w: _places(c, w)))
    near = lambda c, p: F.forall(about, lambda t: F.exists(_places(c, t), lambda q: F.abs(q - p) <= reach))
    return F.exists(clauses, lambda c: F.exists(at(c), lambda p: near(c, p)))


def _offender(sentence: Column) -> Column:
    """Who a sentence says to have offended or to be liable; null where nobody is."""
    offence = sentence.rlike(OFFENCE)
    liable = F.contains(sentence, F.lit("法律责任")) & sentence.rlike("承担|追究|明确|负有")
    last = lambda p: F.try_element_at(F.regexp_extract_all(sentence, F.lit(p), F.lit(1)), F.lit(-1))
    plain = F.regexp_replace(_letters(F.coalesce(last(f"{ROLE}(?:违反(?:规定)?|违法|违规)"), last(ROLE))), "^各", "")
    short = F.regexp_replace(plain, "^(.{2,})(?:单位|各方|主体|人员|机构|部门|企业)$", "$1")
    return F.when(offence | liable, F.when(sentence.rlike("参建单位|参建各方"), F.lit("参建")).otherwise(short))


def _penalties(text: Column) -> Column:
    """array<struct<sentence, after, before>> of the penalties that a claim speaks of."""
    sentences = F.filter(F.split(text, SENTENCE_BREAK), lambda s: _any(s, PENALTY))

    def of_sentence(s: Column) -> Column:
        clauses = F.filter(F.split(s, CLAUSE_BREAK), lambda c: _any(c, PENALTY))
        spots = lambda c: F.flatten(F.transform(_strings(*PENALTY), lambda w: F.transform(F.filter(_places(c, w), lambda p: (w != "处罚") | (F.substring(c, p - 2, F.lit(2)) != "行政") | (p < 3)), lambda p: F.struct(w.alias("w"), p.alias("p")))))
        found = F.flatten(F.transform(clauses, lambda c: F.transform(spots(c), lambda o: F.struct(s.alias("sentence"), o["w"].alias("w"), F.substring(c, o["p"] + F.length(o["w"]), F.length(c)).alias("after"), F.substring(c, F.lit(1), o["p"] - 1).alias("before")))))
        return F.filter(found, lambda o: (o["w"] != "处罚") | _offender(s).isNotNull())

    return F.flatten(F.transform(sentences, of_sentence))


def _ended(claim: Column, text: Column) -> Column:
    about = relation_terms(F.regexp_replace(E.for_matching(claim), "|".join(CANCELLATION), " "))
    return _any(text, CANCELLATION) & let(about, lambda a: (F.size(a) == 0) | _bound(text, CANCELLATION, a, 16))


def _punished(active: Column, text: Column) -> Column:
    offenders = F.filter(F.transform(F.filter(F.split(text, SENTENCE_BREAK), lambda s: _any(s, PENALTY)), _offender), lambda o: o.isNotNull())

    def one(o: Column, known: Column) -> Column:
        free = lambda what: _any(text, PENALTY) & ((F.size(what) == 0) | _bound(text, PENALTY, what, 24))
        terms = let(relation_terms(o["after"]), lambda after: F.when(F.size(after) > 0, after).otherwise(relation_terms(o["before"])))
        return let(_offender(o["sentence"]), lambda who: F.when(who.isNotNull(), F.array_contains(known, who)).otherwise(let(terms, free)))

    return let(offenders, lambda known: F.forall(_penalties(active), lambda o: one(o, known)))


def _based(claim: Column, text: Column) -> Column:
    clauses = F.filter(F.split(claim, CLAUSE_BREAK), lambda c: _any(c, LEGAL_BASIS))
    titles = lambda c: F.transform(F.regexp_extract_all(c, F.lit(_TITLES), F.lit(1)), _letters)
    return let(_letters(text), lambda letters: F.forall(clauses, lambda c: let(titles(c), lambda t: F.when(F.size(t) > 0, _all_in(t, letters)).otherwise(_any(text, LEGAL_BASIS)))))


def relation_fault(claim: Column, text: Column) -> Column:
    """The first relation of a claim that ``text`` does not have about the same thing; null where it has all, or there is none."""

    def fault(c: Column, active: Column, t: Column) -> Column:
        return (
            F.when(_any(active, CANCELLATION) & ~_ended(c, t), "cancellation")
            .when(_any(active, PENALTY) & ~_punished(active, t), "penalty")
            .when(_any(active, LEGAL_BASIS) & ~_based(c, t), "legal_basis")
        )

    plain = F.regexp_replace(F.lower(claim), CONTEXT, " ")
    said = lambda c: F.regexp_replace(F.regexp_replace(c, ATTRIBUTION, " "), PAID_FINE, "$1")
    told = let(plain, lambda c: let(said(c), lambda active: let(F.lower(text), lambda t: fault(c, active, t))))
    return F.when(_any(claim, CANCELLATION + PENALTY + LEGAL_BASIS), told)


def needs_relation(claim: Column) -> Column:
    return relation_fault(claim, F.lit("")).isNotNull()


def scope_of(text: Column) -> Column:
    """What a text says it applies to; null where it says nothing of the kind, or only asks."""
    found = F.coalesce(*(F.get(F.regexp_extract_all(text, F.lit(p), F.lit(1)), 0) for p in (*SCOPES, *EVERY_SCOPE)))
    return let(F.regexp_replace(found, f"^(.{{2,}}?){SCOPE_ENDS}$", "$1"), lambda t: F.when(~t.isin(*NO_SCOPE, ""), t))


def _scope_letters(text: Column) -> Column:
    return reduce(lambda t, phrase: F.replace(t, F.lit(phrase), F.lit("")), SCOPE_FILLERS, F.replace(_letters(text), F.lit("省内"), F.lit("省")))


def _around(text: Column, target: Column, reach: int) -> Column:
    """The text around each occurrence of ``target``."""
    return F.transform(_places(text, target), lambda p: F.substring(text, F.greatest(p - reach, F.lit(1)), F.least(p - 1, F.lit(reach)) + F.length(target) + reach))


def scope_met(target: Column, text: Column) -> Column:
    """Whether a text binds ``target`` as its scope: beside a word for it, in a clause with one, or split over its title and such a clause."""

    def met(t: Column, name: Column, title: Column, clauses: Column, target: Column) -> Column:
        beside = F.exists(_around(t, target, 50), lambda w: _any(w, SCOPE_CUES))
        cut = lambda n: (F.length(name) - 2 >= n) & F.contains(title, F.substring(name, F.lit(1), F.length(name) - n)) & F.contains(clauses, F.substring(name, -n, n))
        parted = (F.length(name) >= 7) & (clauses != "") & reduce(lambda a, b: a | b, map(cut, range(4, 9)), F.contains(title, name))
        return beside | ((F.length(name) >= 2) & F.contains(clauses, name)) | parted

    bound = lambda t: _scope_letters(F.array_join(F.filter(F.split(t, SCOPE_BREAK), lambda c: _any(c, SCOPE_CUES)), "\n"))
    first = lambda t: _scope_letters(F.regexp_extract(t, "(?s)^\\s*([^\\n]*)", 1))
    parts = lambda t, g: let(F.struct(_scope_letters(g).alias("name"), first(t).alias("title"), bound(t).alias("clauses")), lambda p: met(t, p["name"], p["title"], p["clauses"], g))
    return let(F.lower(text), lambda t: let(F.lower(target), lambda g: parts(t, g)))


def direction(text: Column, target: Column) -> Column:
    """-1 where a text says that ``target`` is out of its scope, 1 where it is in it, 0 where neither."""
    way = lambda windows: F.when(F.exists(windows, lambda w: w.rlike(AGAINST)), -1).when(F.exists(windows, lambda w: w.rlike(FOR)), 1).otherwise(0)
    return let(F.lower(text), lambda t: let(F.lower(target), lambda g: let(_around(t, g, 40), way)))


def never_answered(question: Column) -> Column:
    """Questions on an unknown time, on sources passed off as official, against the text, or on material that was not read."""
    q = F.lower(question)
    lost = q.rlike(UNKNOWN_TIME) & q.rlike(TIME_STATES) & ~q.rlike(E.DATE)
    return reduce(lambda a, b: a | b, (q.rlike(p) for p in NEVER), lost)


def _shared(question: Column, answer: Column, text: Column) -> Column:
    """Whether all three speak of one relation, or of support."""
    groups = (CANCELLATION, PENALTY, LEGAL_BASIS, SUPPORT)
    return reduce(lambda a, b: a | b, (_any(F.lower(question), g) & _any(F.lower(answer), g) & _any(text, g) for g in groups))


def _about_answer(claim: Column) -> Column:
    """A claim on the answer itself, without a value, title or relation of its own."""
    return F.lower(claim).rlike(ABOUT_ANSWER) & (F.size(E.exact_values(F.lower(claim))) == 0) & ~claim.rlike(_TITLES) & ~_any(F.lower(claim), CANCELLATION + PENALTY + LEGAL_BASIS)


def _names_number(question: Column, claim: Column, text: Column) -> Column:
    """A claim on a document's number, which is in the text."""
    numbers = F.regexp_extract_all(claim, F.lit(f"({E.POLICY_NUMBER})"), F.lit(1))
    return (F.size(numbers) > 0) & F.concat(question, F.lit("\n"), claim).rlike("编号|文号") & E.values_met(numbers, text)


def _progresses(claim: Column, text: Column) -> Column:
    """A claim on a system from one end to another, of which the text has both."""

    def there(end: Column) -> Column:
        lexical = lambda terms: (E.coverage(terms, text) >= 0.35) & (F.size(F.filter(F.map_keys(terms), lambda t: F.contains(text, t))) >= 3)
        pairs = F.when(F.length(end) >= 4, F.transform(F.sequence(F.lit(1), F.greatest(F.length(end) - 1, F.lit(1)), F.lit(2)), lambda i: F.substring(end, i, F.lit(2)))).otherwise(_strings())
        return let(E.weighted_terms(E.for_matching(_letters(end))), lexical) | let(pairs, lambda p: (F.size(p) >= 2) & _all_in(p, text))

    cues = reduce(lambda a, b: a + b, (F.contains(text, F.lit(c)).cast("int") for c in PROGRESSION_CUES))
    ends = [F.regexp_extract(claim, PROGRESSION, n) for n in (1, 2)]
    return (F.size(E.exact_values(claim)) == 0) & ~claim.rlike(_TITLES) & claim.rlike(PROGRESSION) & (cues >= 2) & there(ends[0]) & there(ends[1])


def validate(questions: DataFrame, answers: DataFrame, cited: DataFrame, least_overlap: float = E.MIN_OVERLAP) -> DataFrame:
    """(query_id, supported, confidence, reason, supporting): whether answers (query_id, answer) stand on the hits (query_id, id, body) that they cite.

    In this order an answer fails if its citations do not cover the question, it claims a relation that they lack, a scope that none of them has, or
    one in the other direction, does not have the shape that was asked for, has a value of its own, or has a claim, or is as a whole, of other terms.
    Hits of a question are the few that a search keeps, so their texts fit one row. An answer without a question has no row; a question without an answer
    has none to validate and no row.
    """
    asked = questions.join(answers, "query_id").select("query_id", "query", F.regexp_replace(F.coalesce("answer", F.lit("")), CITATION_NOTE, " ").alias("said"), F.coalesce("answer", F.lit("")).alias("answer"))
    covered = E.assess(asked.select("query_id", "query"), cited)
    target = scope_of(F.col("answer"))
    hits = cited.select("query_id", "id", F.lower("body").alias("text"))
    of_hit = asked.select("query_id", target.alias("target")).join(hits, "query_id").withColumn("way", direction(F.col("text"), F.col("target"))).groupBy("query_id").agg(
        F.array_join(F.collect_list("text"), "\n").alias("all"),
        F.bool_or(F.col("target").isNull() | scope_met(F.col("target"), F.col("text"))).alias("scoped"),
        F.collect_set(F.nullif("way", F.lit(0))).alias("directions"),
    )
    both = asked.join(of_hit, "query_id", "left").withColumn("all", F.coalesce("all", F.lit("")))

    claim = F.col("claim")
    terms = F.col("terms")
    some = lambda t: F.size(F.filter(F.map_keys(t), lambda x: F.contains(F.col("all"), x))) >= 1
    share = F.col("share")
    loose = (share < least_overlap) & ~(_shared(F.col("query"), claim, F.col("all")) & some(terms)) & ~_names_number(F.col("query"), claim, F.col("all")) & ~_progresses(claim, F.col("all"))
    each = both.select("query_id", "query", "all", F.posexplode(E.claims(F.col("said"))).alias("nth", "claim")).withColumn("terms", E.weighted_terms(E.for_matching(claim))).withColumn("share", E.coverage(terms, F.col("all")))
    judged = each.select("query_id", "nth", relation_fault(claim, F.col("all")).alias("relation"), F.when(~_about_answer(claim) & (F.size(terms) > 0) & loose, share).alias("loose"))
    of_claims = judged.groupBy("query_id").agg(F.count("relation").alias("broken"), F.min_by("loose", F.when(F.col("loose").isNotNull(), F.col("nth"))).alias("loose"))

    polar = F.col("polar")
    directions = F.col("directions")
    turned = ((polar == -1) & ~F.array_contains(directions, -1)) | ((polar != 0) & (F.size(directions) > 0) & ~F.array_contains(directions, polar))
    known = F.concat_ws("\n", "all", F.lower("query"))
    whole, overlap = F.col("whole"), F.col("overlap")
    foreign = (F.size(whole) > 0) & (overlap < least_overlap) & ~(_shared(F.col("query"), F.col("answer"), F.col("all")) & some(whole))
    told = both.join(of_claims, "query_id", "left").join(covered.withColumnsRenamed({"confidence": "sure", "reason": "_why"}), "query_id")
    told = told.withColumn("target", target).withColumn("whole", E.weighted_terms(E.for_matching(F.col("answer")))).withColumn("overlap", E.coverage(whole, F.col("all"))).withColumn("polar", direction(F.col("answer"), F.col("target")))
    reason = (
        F.when(~F.col("sufficient"), "citations_do_not_cover_query")
        .when(F.coalesce("broken", F.lit(0)) > 0, "answer_contains_unsupported_relation")
        .when(F.col("target").isNotNull() & ~F.coalesce("scoped", F.lit(False)), "answer_contains_unsupported_scope_target")
        .when(F.col("target").isNotNull() & turned, "answer_contains_unsupported_scope_polarity")
        .when(~E.shape_met(F.col("query"), F.lower("answer")), "answer_missing_required_shape")
        .when(~E.values_met(E.exact_values(F.col("answer")), known), "answer_contains_unsupported_exact_values")
        .when(F.col("loose").isNotNull(), "answer_contains_unsupported_claim")
        .when(foreign, "answer_not_supported_by_citations")
    )
    sure = (
        F.when(F.col("reason").isNull(), F.least("sure", F.greatest("overlap", F.lit(0.5))))
        .when(F.col("reason") == "citations_do_not_cover_query", F.col("sure"))
        .when(F.col("reason") == "answer_contains_unsupported_claim", F.col("loose"))
        .when(F.col("reason") == "answer_not_supported_by_citations", F.col("overlap"))
        .otherwise(0.0)
    )
    none = F.slice("supporting", 1, 0)
    return told.withColumn("reason", reason).select("query_id", F.col("reason").isNull().alias("supported"), E.bounded(sure).alias("confidence"), F.coalesce("reason", F.lit("answer_supported_by_citations")).alias("reason"), F.when(F.col("reason").isNull(), F.col("supporting")).otherwise(none).alias("supporting"))
