"""Items of JSON answers: the list at a dotted path, or the first list of objects at any depth, in document order."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import json as J
from ..functions.text import let
from ..sources.tables import stored


_mark = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)


def first_list(text: str) -> str | None:
    """Of a JSON text the list with an object in it that begins first, as it is written; None where there is none. One walk over the marks, whatever the depth."""
    stack: list[int] = []
    found: tuple[int, int] | None = None
    good: set[int] = set()
    for m in _mark.finditer(text):
        mark = m.group()
        if mark in ("{", "["):
            if mark == "{" and stack and text[stack[-1]] == "[":
                good.add(stack[-1])
            stack.append(m.start())
        elif mark in ("}", "]"):
            start = stack.pop()
            if start in good and (found is None or start < found[0]):
                found = start, m.end()
    return text[found[0] : found[1]] if found else None


@F.pandas_udf(StringType())
def _first_list(text: pd.Series) -> pd.Series:
    return text.map(first_list, na_action="ignore")


def first_lists(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, list): the first list with an object in it, in document order and at any depth, as text; no row where there is none or no JSON.

    Each text is walked once where it is: nothing is shuffled, and deep texts are not written again for each of their depths.
    """
    good = rows.where(F.try_parse_json(text).isNotNull())
    return good.select(ident, _first_list(F.col(text)).alias("list")).where("list is not null")


def _at(text: Column, dotted: str) -> Column:
    """What a path of an object's keys leads to, as text; null where it leads nowhere."""
    step = lambda part: lambda t: F.when(t.rlike("^\\s*\\{"), F.try_element_at(F.from_json(t, "map<string,string>"), F.lit(part)))
    for part in dotted.strip(".").split("."):
        text = let(text, step(part))
    return text


def items(rows: DataFrame, ident: str, text: str, dotted: str = "") -> DataFrame:
    """(ident, nth, item): the objects of the list at ``dotted``, or where that is no list, of the first list of objects, ``nth`` from 0 among all entries."""
    known = rows.select(ident, F.col(text).alias("_text"))
    known = known.withColumn("_list", _at(F.col("_text"), dotted) if dotted.strip(".") else F.lit(None).cast("string"))
    known = stored(known.withColumn("_list", F.when(F.col("_list").rlike("^\\s*\\[") & J.parsed(F.col("_list")).isNotNull(), F.col("_list"))), "at-path")
    rest = first_lists(known.where("_list is null"), ident, "_text")
    lists = known.where("_list is not null").select(ident, F.col("_list").alias("list")).unionByName(rest)
    each = lists.select(ident, F.posexplode(F.from_json("list", "array<variant>")).alias("nth", "item"))
    return each.where(F.schema_of_variant("item").startswith("OBJECT"))
