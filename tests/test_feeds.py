import json

import pytest

from lexmill.operators import feeds


def plain(value):
    """The first list with an object in it, in document order."""
    if isinstance(value, list):
        if any(isinstance(x, dict) for x in value):
            return value
        below = value
    else:
        below = list(value.values()) if isinstance(value, dict) else []
    return next((found for x in below if (found := plain(x))), None)


TEXTS = [
    '[{"a": 1}, 2, {"b": 2}]',
    '{"z": [1, [2, [{"deep": 1}]]], "a": [{"late": 1}]}',
    '{"b": {"y": [{"first": 1}]}, "a": [{"second": 1}]}',
    '{"b": {"y": [[], [[]]]}, "a": {"x": "[{}]", "w": {"v": [0, {"in": [{"not": "this"}]}]}}}',
    '{"none": [1, "x", [true, null]]}',
    '[[[[[[[[{"eight": 8}]]]]]]]]',
    '{"it\'s \\"odd\\" .key": {"": [{"k": "\\u00e9"}]}}',
    "[]",
    "3",
    '"[{}]"',
    "no json",
    None,
]


def test_first_lists_in_document_order(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    told = {r.id: json.loads(r.list) for r in feeds.first_lists(df, "id", "text").collect()}
    want = {i: found for i, t in enumerate(TEXTS) if t and t != "no json" and (found := plain(json.loads(t)))}
    assert told == want
    assert feeds.first_lists(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize(("path", "want"), [("data.rows", [(1, "path")]), ("data.none", [(0, "other")]), ("", [(0, "other")]), ("data.x", [(0, "other")])])
def test_items_at_a_path_or_else_anywhere(spark, path, want):
    text = '{"o": [{"n": "other"}], "data": {"rows": [4, {"n": "path"}, "x"], "x": {"n": 1}}}'
    found = feeds.items(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", path)
    assert [(r.nth, json.loads(r.j)["n"]) for r in found.selectExpr("nth", "to_json(item) as j").collect()] == want


def test_first_lists_are_found_where_the_texts_are(spark):
    """Deep texts too: no shuffle, and no table for each depth."""
    deep = "[1, " * 400 + '[7, {"n": [{"inner": 1}]}]' + "]" * 400
    df = spark.createDataFrame([(1, deep), (2, '[[0, {"inner": 1}], {"outer": 2}]'), (3, '{"a": "\\"[{", "b": [{}]}')], "id long, text string")
    found = feeds.first_lists(df, "id", "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.list for r in found.collect()} == {1: '[7, {"n": [{"inner": 1}]}]', 2: '[[0, {"inner": 1}], {"outer": 2}]', 3: "[{}]"}
