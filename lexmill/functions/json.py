"""Strictly typed access to JSON held as variant: a value counts only if it has the type asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S


def parsed(text: Column) -> Column:
    """Null where it is no JSON."""
    return F.try_parse_json(text)


def kind(v: Column, path: str = "$") -> Column:
    """The type of what is at ``path``; null for nothing."""
    return F.schema_of_variant(v if path == "$" else F.try_variant_get(v, path, "variant"))


def strict_bool(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def strict_int(v: Column, path: str) -> Column:
    """A whole number; true and false are none."""
    return F.when(kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def is_number(type_name: Column) -> Column:
    return type_name.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)")


def strict_number(v: Column, path: str, least: float | None = 0) -> Column:
    value = F.when(is_number(kind(v, path)), F.try_variant_get(v, path, "double"))
    return value if least is None else F.when(value >= least, value)


def strict_string(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def is_object(v: Column, path: str = "$") -> Column:
    """Whether it is an object, whatever is in it: its type as text would be made of all that it holds."""
    return F.try_variant_get(v, path, "struct<>").isNotNull()


def is_list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<struct<>>").isNotNull()


def names(v: Column) -> Column:
    """The names of an object's entries in order; null for anything else."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,struct<>>"))


def first_of(*values: Column) -> Column:
    return F.coalesce(*values)


def trace_tokens(v: Column) -> Column:
    """Tokens of a trace: a total under one of its names, else the prompt's and the completion's; null where none is told."""
    total = first_of(*[strict_int(v, f"$.{k}") for k in ("total_tokens", "tokens", "token_count")])
    prompt, completion = (F.when((x := strict_int(v, f"$.{k}")) >= 0, x) for k in ("prompt_tokens", "completion_tokens"))
    parts = F.when(prompt.isNotNull() | completion.isNotNull(), F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0)))
    return F.coalesce(F.when(total.isNotNull(), F.greatest(F.lit(0), total)), parts)


def normal_usage(v: Column) -> Column:
    """struct(prompt_tokens, completion_tokens, total_tokens) of a provider's answer, whichever names it uses for them."""
    aliases = {"prompt_tokens": ("prompt_tokens", "input_tokens", "input"), "completion_tokens": ("completion_tokens", "output_tokens", "output"), "total_tokens": ("total_tokens", "tokens")}
    places = ("$.usage", "$.token_usage", "$.data.usage", "$.data.token_usage")
    at = F.coalesce(*[F.when(is_object(v, p), F.try_variant_get(v, p, "variant")) for p in places])
    found = {k: first_of(*[F.when((x := strict_int(at, f"$.{n}")) >= 0, x) for n in names]) for k, names in aliases.items()}
    total = F.coalesce(found["total_tokens"], found["prompt_tokens"] + found["completion_tokens"])
    return F.struct(found["prompt_tokens"].alias("prompt_tokens"), found["completion_tokens"].alias("completion_tokens"), total.alias("total_tokens"))


def cost(v: Column) -> Column:
    """A provider's cost as decimal(18,8): the first that is a number from 0 up, rounded half to even."""
    inner = [f"{p}.{k}" for p in ("$.usage", "$.token_usage") for k in ("cost", "total_cost")]
    places = ["$.cost", "$.total_cost", *inner, *[p.replace("$", "$.data") for p in ("$.cost", "$.total_cost", *inner)]]
    value = lambda p: F.when(kind(v, p).isNotNull() & (kind(v, p) != "BOOLEAN"), F.try_variant_get(v, p, "string").try_cast("decimal(30,12)"))
    ok = [F.when(value(p).between(0, 9_999_999_999), value(p)) for p in places]
    return F.bround(first_of(*ok), 8).cast("decimal(18,8)")


def counters(text: Column) -> Column:
    """map<string,double> of an object's entries that are numbers."""
    entries = F.from_json(text, "map<string,variant>")
    numbers = F.map_filter(entries, lambda k, x: is_number(F.schema_of_variant(x)))
    return F.transform_values(numbers, lambda k, x: F.try_variant_get(x, "$", "double"))


def ids(text: Column, name: str) -> Column:
    """Distinct ids of an array of objects in order; objects without one are left out."""
    rows = F.from_json(text, f"array<struct<{name}:string>>")
    return F.array_distinct(F.filter(F.transform(rows, lambda x: x[name]), lambda x: x.isNotNull() & (x != "")))


def first_string(v: Column, names: tuple[str, ...]) -> Column:
    """The first of the named entries that is a text with more than white space."""
    return F.coalesce(*[F.nullif(F.trim(strict_string(v, f"$.{n}")), F.lit("")) for n in names])


def payload(**fields: Column) -> Column:
    """An object of the fields that are not null."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def _safe(value: Column, kind: S.DataType) -> Column:
    if isinstance(kind, (S.DoubleType, S.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, S.DecimalType):
        return value.cast("double")
    if isinstance(kind, (S.TimestampType, S.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss") if isinstance(kind, S.TimestampNTZType) else F.date_format(value, "yyyy-MM-dd'T'HH:mm:ssXXX")
    if isinstance(kind, S.StructType):
        return F.when(value.isNotNull(), F.struct(*[_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, S.ArrayType):
        return F.transform(value, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, S.MapType):
        named = value if isinstance(kind.keyType, S.StringType) else F.map_from_entries(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value"))))
        return F.transform_values(named, lambda k, x: _safe(x, kind.valueType))
    if isinstance(kind, (S.StringType, S.BooleanType, S.IntegralType, S.NullType, S.VariantType)):
        return value
    return value.cast("string")


def json_safe(rows: DataFrame) -> DataFrame:
    """``rows`` in types that JSON has, at any depth: times and dates as ISO text, decimals as numbers, numbers that are none as null, names of maps and all else as text."""
    return rows.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields])
