"""Line dedup with a fixed-depth template tree.

A line's leaf is its token count and leading tokens, tokens with a digit being a
wildcard already. Within a leaf a token that does not recur at its place across texts is a variable field and becomes
a wildcard; what is left is the line's template. Lines of templates that recur across
texts are boilerplate and are dropped. Copies are left whole for near-duplicate removal to judge: texts
that would lose most of themselves, and the same templates as a text that has no other lines. Of other texts
that would lose most of themselves, one keeps each template, so that no content is lost altogether. All of it is counting by key, so the
outcome depends on no order of arrival.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BitFilter, hot_join, in_steps, map_batches, materialize, utf8_list

#: Leading tokens on the path to a leaf, different texts that make a token or template recur, least share of fixed tokens.
DEPTH, MIN_TEXTS, FIXED_SHARE = 3, 8, 0.6
#: A text that would lose more than this share of its characters is left whole if it is a copy, else keeps first occurrences.
MAX_LOSS = 0.5
WILDCARD = b"<*>"
_digit = re.compile(rb"\d").search
_KEY = "doc_id long, tie long"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _leaf(tokens: list[bytes], depth: int) -> int:
    return _signed(xxhash.xxh64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:depth])))


def masked_lines(text: bytes | None, depth: int = DEPTH) -> list[tuple[int, int, list[bytes]]]:
    """(line number, leaf, tokens) of every line that has a token; parted by line feeds."""
    out = []
    for no, line in enumerate(text.split(b"\n") if text else []):
        tokens = line.split()
        if _digit(line):
            tokens = [WILDCARD if _digit(t) else t for t in tokens]
        if tokens:
            out.append((no, _leaf(tokens, depth), tokens))
    return out


def _line_hash(tokens: list[bytes]) -> int:
    return _signed(xxhash.xxh64_intdigest(b" ".join(tokens)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("tie"), F.col(text_col).alias("text"))


def recurring_lines(texts: DataFrame, depth: int = DEPTH, min_texts: int = MIN_TEXTS, fixed_share: float = FIXED_SHARE) -> DataFrame:
    """(doc_id, tie, line_no, template, size, chars, lines): recurring lines of texts keyed by (doc_id, tie = hash of the text).

    ``size`` and ``chars`` are characters of the line and of its text, ``lines`` the text's lines with a token.
    """

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in in_steps(batches):
            rows = {(leaf, tie) for tie, t in zip(step.column(0).to_pylist(), utf8_list(step.column(1)), strict=True) for _, leaf, _ in masked_lines(t, depth)}
            if rows:
                a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["leaf", "tie"])

    per_text = texts.select("tie", "text").transform(map_batches, leaves, "leaf long, tie long").distinct()
    busy = materialize(per_text.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_texts).select("leaf"), "leaves")
    likely = BitFilter(busy, "leaf")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in in_steps(batches):
            rows = []
            for i, tie, t in zip(step.column(0).to_pylist(), step.column(1).to_pylist(), utf8_list(step.column(2)), strict=True):
                found = masked_lines(t, depth)
                ok = likely.passes(np.array([leaf for _, leaf, _ in found], np.int64)).tolist() if found else []
                if any(ok):
                    text = t.decode()
                    sizes = [len(x) for x in text.split("\n")]
                    rows += [(i, tie, no, leaf, _line_hash(tokens), b" ".join(tokens).decode(), sizes[no], len(text), len(found)) for (no, leaf, tokens), k in zip(found, ok, strict=True) if k]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "tie", "line_no", "leaf", "line", "tokens", "size", "chars", "lines"])

    met = materialize(texts.transform(map_batches, lines, f"{_KEY}, line_no int, leaf long, line long, tokens string, size long, chars long, lines long").join(busy, "leaf", "left_semi"), "lines")
    # Copies of a text count once, and so do a text's lines of one token at a place or of one template.
    in_text = materialize(met.groupBy("leaf", "line", "tie").agg(F.first("tokens").alias("tokens")), "kinds")
    kinds = in_text.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"))
    # Leading tokens are the leaf's own, the same in all its lines: only later places have to be counted.
    at = F.transform(F.split("tokens", " "), lambda t, i: F.struct(i.alias("place"), t.alias("token")))
    spread = kinds.select("leaf", "line", "n", F.explode(F.filter(at, lambda x: (x["place"] >= depth) & (x["token"] != WILDCARD.decode()))).alias("x")).select("leaf", "line", "n", "x.*")
    place = ["leaf", "place", "token"]
    # Sums over lines are the count of texts or more; only where they suffice are texts told apart.
    likely_fixed = materialize(spread.groupBy(*place).agg(F.sum("n").alias("sum"), F.max("n").alias("most"), F.count("*").alias("rows")).where(F.col("sum") >= min_texts), "places")
    sure = likely_fixed.where(F.col("most") >= min_texts).select(*place, "rows")
    spread = materialize(spread.select("leaf", "line", "place", "token"), "spread")
    unsure = hot_join(spread, likely_fixed.where(F.col("most") < min_texts).select(*place, "rows"), place, "rows")
    counted = unsure.join(in_text.select("leaf", "line", "tie"), ["leaf", "line"]).select(*place, "tie").distinct().groupBy(*place).agg(F.count("*").alias("texts")).where(F.col("texts") >= min_texts)
    fixed = materialize(sure.unionByName(counted.join(likely_fixed, place).select(*place, "rows")), "fixed")
    # A token that most lines of a busy leaf have at its place is a hot key.
    # Within a leaf a template is its fixed tokens and their places.
    shape = F.xxhash64(F.array_sort(F.collect_list(F.struct("place", "token")))).alias("shape")
    later = hot_join(spread, fixed, place, "rows").groupBy("leaf", "line").agg(shape, F.count("*").alias("fixed"))
    words = F.split("tokens", " ")
    lead = F.size(F.filter(F.slice(words, 1, depth), lambda w: w != WILDCARD.decode())) if depth else F.lit(0)
    marked = kinds.select("leaf", "line", lead.alias("lead"), F.size(words).alias("size")).join(later, ["leaf", "line"], "left")
    templates = marked.select("leaf", "line", F.coalesce("shape", F.lit(0)).alias("template"), ((F.col("lead") + F.coalesce("fixed", F.lit(0))) / F.col("size")).alias("share"))
    lined = materialize(templates.where(F.col("share") >= fixed_share).select("leaf", "line", "template"), "templates")
    support = lined.join(in_text.select("leaf", "line", "tie"), ["leaf", "line"]).select("leaf", "template", "tie").distinct().groupBy("leaf", "template").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_texts)
    dropped = lined.join(support, ["leaf", "template"], "left_semi").select("leaf", "line", F.xxhash64("leaf", "template").alias("template"))
    return met.join(dropped, ["leaf", "line"]).select("doc_id", "tie", "line_no", "template", "size", "chars", "lines")


def dropped_lines(found: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """(doc_id, tie, gone): numbers of the lines of each text to drop, of what ``recurring_lines`` found."""
    text = ["doc_id", "tie"]
    of_text = found.groupBy(*text).agg(F.collect_set(F.struct("line_no", "template", "size")).alias("own"), F.count("*").alias("n"), F.first("chars").alias("chars"), F.first("lines").alias("lines"))
    lost = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["size"])
    judged = materialize(of_text.withColumn("over", lost > max_loss * F.col("chars")), "judged")
    over = judged.where("over").withColumn("shape", F.xxhash64(F.array_sort(F.array_distinct("own.template"))))
    # Rows of one shape, repeated ones too, of which one has no other line.
    copied = over.groupBy("shape").agg(F.sum(F.col("n") / F.size("own")).alias("rows"), F.max(F.size("own") == F.col("lines")).alias("whole")).where("rows > 1.5 and whole").select("shape")
    rest = over.join(copied, "shape", "left_anti").select(*text, F.explode("own").alias("x")).select(*text, "x.line_no", "x.template")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "line_no")
    first = rest.groupBy("template").agg(F.min(at).alias("first"))
    later = rest.join(first, "template").where(~at.eqNullSafe(F.col("first"))).groupBy(*text).agg(F.collect_set("line_no").alias("gone"))
    return judged.where("not over").select(*text, F.col("own.line_no").alias("gone")).unionByName(later)


def _cut(text: str | None, gone: list[int] | None) -> tuple[str | None, int]:
    """The text that stays and the number of lines dropped."""
    if not gone:
        return text, 0
    bad = set(gone)
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in bad), len(bad)


def rewrite(docs: DataFrame, depth: int = DEPTH, min_texts: int = MIN_TEXTS, fixed_share: float = FIXED_SHARE, max_loss: float = MAX_LOSS, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the lines of each text that stay; ``counts`` names columns for a text's lines and dropped lines, if wanted.

    A line recurs, and is dropped, when its template is in ``min_texts`` different texts or
    more. A text that would lose over ``max_loss`` of its characters is left whole where another row
    has the same templates and one of these rows has no other line; where none has, the first
    occurrence of a template in such texts, by id and line, stays. Lines without a token stay. A null
    text stays null with no lines, an empty one has one line; repeated rows get the same
    result each; rows with a null id are treated like others; an empty table gives an empty
    result. All other columns stay as they are, but for those named in ``counts``.
    """
    texts = _keyed(docs, id_col, text_col)
    gone = dropped_lines(recurring_lines(texts, depth, min_texts, fixed_share), max_loss)
    per_doc = materialize(gone.select(F.col("doc_id").alias("__gone_id"), F.col("tie").alias("__gone_tie"), F.col("gone").alias("__gone")), "gone")
    likely = BitFilter(per_doc, "__gone_tie")
    rest = docs.drop(*counts or ())
    rest = rest.select(*rest.columns, F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("__tie"))
    place = rest.columns.index(text_col)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(likely.passes(batch.column(batch.num_columns - 1).to_numpy())))

    def finish(columns: list, gone: list) -> pa.RecordBatch:
        old = columns[place].to_pylist()
        done = [_cut(t, g) for t, g in zip(old, gone, strict=True)]
        columns[place] = pa.array([d[0] for d in done], pa.string())
        if counts:
            columns += [pa.array([0 if t is None else t.count("\n") + 1 for t in old], pa.int64()), pa.array([d[1] for d in done], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=result.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in in_steps(batches):
            yield finish(list(step.columns[:-2]), step.column(step.num_columns - 1).to_pylist())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in in_steps(batches):
            step = step.filter(pa.array(~likely.passes(step.column(step.num_columns - 1).to_numpy())))
            yield finish(list(step.columns[:-1]), [None] * step.num_rows)

    result = T.StructType([*rest.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in counts or ())])
    some = rest.transform(map_batches, touched, rest.schema)
    same = some[id_col].cast("long").eqNullSafe(per_doc["__gone_id"]) & (some["__tie"] == per_doc["__gone_tie"])
    # Merged, not broadcast: the two Python steps are then in different stages and need no workers at one time.
    met = some.join(per_doc.hint("merge"), same, "left").drop(per_doc["__gone_id"], per_doc["__gone_tie"])
    # Texts without a dropped line are done where they are read.
    return rest.transform(map_batches, whole, result).unionByName(met.transform(map_batches, cut, result))
