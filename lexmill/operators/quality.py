"""Rule filters, source scores, duplicates and the choice of an authoritative copy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.tables import stored


@dataclass(frozen=True)
class Rules:
    """Thresholds and patterns of the rule filter; the fixed defaults of the domain."""

    hard_minimum: int = 40
    soft_minimum: int = 180
    accept: float = 0.65
    reject: float = 0.25
    bad_titles: tuple[str, ...] = ("test page|page not found",)
    bad_contents: tuple[str, ...] = ("access denied|captcha required",)
    keywords: tuple[str, ...] = ("policy", "regulation", "notice", "support", "application", "\\u653f\\u7b56", "\\u901a\\u77e5", "\\u529e\\u6cd5")
    short_penalty: float = 0.35
    keyword_penalty: float = 0.25
    unofficial_penalty: float = 0.1


def rule_filter(title: Column, content: Column, official: Column, rules: Rules = Rules()) -> Column:
    """struct(score, decision, reasons): rejected outright when too short or by a pattern, else one less penalties."""
    size = F.length(F.regexp_replace(content, "(?U)^\\s+|\\s+$", ""))
    matches = lambda text, patterns: text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    on_topic = lambda whole: reduce(lambda a, b: a | b, (F.contains(whole, F.lit(k)) for k in (w.lower() for w in rules.keywords)))
    topic = let(F.lower(F.concat(title, F.lit("\n"), content)), on_topic) if rules.keywords else F.lit(True)
    flags = F.struct(size.alias("size"), matches(title, rules.bad_titles).alias("title"), matches(content, rules.bad_contents).alias("content"), topic.alias("topic"), official.alias("official"))
    return let(flags, lambda f: _judged(f, rules))


def _judged(f: Column, rules: Rules) -> Column:
    """The decision over what was found of a text, each thing once."""
    outright = F.when(f["size"] < rules.hard_minimum, "content_too_short_hard").when(f["title"], "title_reject_pattern").when(f["content"], "content_reject_pattern")
    faults = ((f["size"] < rules.soft_minimum, rules.short_penalty, "content_too_short_soft"), (~f["topic"], rules.keyword_penalty, "relevance_keyword_missing"), (~f["official"], rules.unofficial_penalty, "source_not_official"))
    less = sum((F.when(there, weight).otherwise(0.0) for there, weight, _ in faults), F.lit(0.0))
    score = F.when(outright.isNotNull(), 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - less)), 4))
    decision = F.when(outright.isNotNull() | (score <= rules.reject), "reject").when(score < rules.accept, "review").otherwise("accept")
    reasons = F.when(outright.isNotNull(), F.array(outright)).otherwise(F.array_compact(F.array(*[F.when(there, name) for there, _, name in faults])))
    return F.struct(score.alias("score"), decision.alias("decision"), F.array_join(reasons, ",").alias("reasons"))


#: Prints under one form beyond which they are told apart by a byte of their other half, too.
CROWD = 512


def near_pairs(prints: DataFrame, id_col: str, distance: int = 3, crowd: int = CROWD) -> DataFrame:
    """(a, b, distance) of different prints within ``distance`` bits, three at most, from columns id, hi, lo (32-bit halves).

    One of the halves differs in one bit or none, so halves are indexed under their 32 forms with one bit left open:
    an equi-join that misses nothing and brings few others together. Equal prints are one row, named by the smallest id:
    ``print_members`` tells which rows they are.
    """
    if distance > 3:
        raise ValueError("two halves find up to three bits")
    kinds = prints.groupBy("hi", "lo").agg(F.min(id_col).alias("id"))
    halves = kinds.select("id", "hi", "lo", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("hi").alias("v")), F.struct(F.lit(1).alias("half"), F.col("lo").alias("v")))).alias("s"))
    open_bit = halves.select("id", "hi", "lo", "s.half", "s.v", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("place"))
    key = F.expr("(v & ~shiftleft(1L, place)) + shiftleft(cast(half * 32 + place as bigint), 32)")
    form = open_bit.select("id", "hi", "lo", "place", key.alias("key"), F.expr("(v >> place) & 1L").alias("bit"))
    crowds = form.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    form = stored(form.join(crowds, "key", "left"), "forms")
    # In a crowded form two prints meet only if a byte of the half that is not indexed is the same: of at most three bits one of four bytes is spared.
    other = F.when(F.col("key") >= (32 << 32), F.col("hi")).otherwise(F.col("lo"))
    byte = F.explode(F.array(*[F.struct(F.lit(k).alias("byte"), F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255)).alias("value")) for k in range(4)]))
    close = stored(form.where("n is not null").select("*", byte.alias("s")).select("*", "s.*"), "crowds")
    bits = (F.bit_count(F.col("ah").bitwiseXOR(F.col("bh"))) + F.bit_count(F.col("al").bitwiseXOR(F.col("bl")))).cast("long")

    def met(rows: DataFrame, *on: str) -> DataFrame:
        a = rows.select(*on, "place", F.col("bit").alias("ax"), F.col("id").alias("a"), F.col("hi").alias("ah"), F.col("lo").alias("al"))
        b = rows.select(*on, F.col("bit").alias("bx"), F.col("id").alias("b"), F.col("hi").alias("bh"), F.col("lo").alias("bl"))
        return a.join(b, list(on)).where("a < b and (ax <> bx or place = 0)").select("a", "b", bits.alias("distance")).where(F.col("distance") <= distance)

    return met(form.where("n is null"), "key").unionByName(met(close, "key", "byte", "value")).distinct()


def members(rows: DataFrame, id_col: str, *same: str) -> DataFrame:
    """(id, copy_of): the smallest id among the rows that have the same values, for each of them."""
    least = rows.groupBy(*same).agg(F.min(id_col).alias("copy_of"))
    return rows.join(least, list(same)).select(id_col, "copy_of")


def print_members(prints: DataFrame, id_col: str) -> DataFrame:
    """(id, copy_of): which row of ``near_pairs`` stands for each."""
    return members(prints, id_col, "hi", "lo")


def authoritative(copies: DataFrame, group: str) -> DataFrame:
    """One id per group: official first, then priority, date, words and id."""
    best = F.max_by("doc_id", F.struct(F.col("official").cast("int"), "priority", F.coalesce(F.col("publish_date"), F.lit("1970-01-01").cast("date")), "word_count", "doc_id"))
    return copies.groupBy(group).agg(best.alias("authority_id"), F.count("*").alias("copies"))
