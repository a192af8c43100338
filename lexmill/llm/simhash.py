"""SimHash near-duplicates over word shingles, linked through deletion-variant signatures.

Two 64-bit fingerprints at Hamming distance two or less are cut into two 32-bit
segments; one segment then differs in one bit at most. Each segment is indexed under
its 32 one-wildcard variants, equal variants are joined, and pairs are verified on
all 64 bits. A variant shared by many fingerprints is not paired: its members meet
at their one-bit neighbours instead, which is exact (two words are within two bits
if and only if they have a common neighbour within one) and never quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, in_steps, map_batches, materialize, utf8_list
from .components import connected_components

#: Variants with more fingerprints than this meet at one-bit neighbours.
PAIR_LIMIT = 48
#: Fingerprints that one task makes variants of.
TASK_PRINTS = 20_000
_VOTE_ROWS = 255 * 128


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in more than half of ``hashes``, one of so many bytes a row."""
    width = 8 * hashes.shape[1]
    votes = np.zeros(width, np.int64)
    for at in range(0, len(hashes), _VOTE_ROWS):
        block = np.unpackbits(hashes[at : at + _VOTE_ROWS], axis=1)
        whole = len(block) // 255 * 255
        votes += block[:whole].reshape(-1, 255, width).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        votes += block[whole:].sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes))


def text_fingerprint(text: bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """64-bit majority fingerprint of the XXH64 hashes of word shingles, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    n = len(words) - shingle_words + 1
    spans = zip(starts[:n].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)
    bits = np.frombuffer(b"".join([digest(line[s:e], seed) for s, e in spans]), np.uint8).reshape(n, 8)
    return int.from_bytes(majority(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one signed 64-bit fingerprint per row; null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in in_steps(batches):
            fps = np.array([text_fingerprint(t, shingle_words, seed) for t in utf8_list(step.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return ids.transform(map_batches, run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, fp long")


def _segment_variants(fps: DataFrame) -> DataFrame:
    """(key, bit, place, fp): for each of two segments, the segment with one bit left open."""
    cut = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), v.alias("value")) for i, v in enumerate((F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))))])).alias("s"))
    open_bit = cut.select("fp", "s.segment", "s.value", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("place"))
    one = F.expr("shiftleft(1L, place)")
    return open_bit.select(
        "fp",
        "place",
        F.expr("(value >> place) & 1L").cast("int").alias("bit"),
        (F.col("value").bitwiseAND(F.bitwise_not(one)) + F.expr("shiftleft(cast(segment * 32 + place as bigint), 32)")).alias("key"),
    )


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def link_fingerprints(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(u, v) links that connect all distinct fingerprints within two bits, directly or through others within two bits.

    Every returned pair is itself within two bits. Each pair is met once: in a
    variant where the open bits differ, or, with equal segments, under place 0.
    """
    prints = materialize(fps.select("fp"), "prints")
    # Each row becomes 64, so rows are dealt out by number before and not left to the size they have now.
    variants = _segment_variants(prints.repartition(-(-prints.count() // TASK_PRINTS) or 1, "fp"))
    shared = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes variants as though rows had not become 64, and files by their compressed bytes: unhinted, all of them are sent to the driver.
    met = materialize(variants.join(shared.hint("merge"), "key"), "variants")
    few = met.where(F.col("n") <= pair_limit)
    a = few.select("key", "place", F.col("bit").alias("a_bit"), F.col("fp").alias("u"))
    b = few.select("key", F.col("bit").alias("b_bit"), F.col("fp").alias("v"))
    pairs = a.join(b.hint("merge"), "key").where("u < v and (a_bit <> b_bit or place = 0)").where(_distance(F.col("u"), F.col("v")) <= 2)
    many = met.where(F.col("n") > pair_limit).select("fp").distinct()
    around = many.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))).alias("centre"))
    # At most 65 fingerprints are within one bit of a centre.
    groups = around.groupBy("centre").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = groups.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return pairs.select("u", "v").unionByName(stars)


def near_duplicate_components(docs: DataFrame, shingle_words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, fp, component_id), component_id being the smallest id reachable by links.

    Nulls and empty texts have fingerprint zero and link like any other; rows with
    a null id stay in the result and never give a component its name; repeated rows
    give repeated results; other columns of ``docs`` are ignored; an empty table
    gives an empty result.
    """
    fps = materialize(fingerprints(docs, shingle_words, seed, id_col, text_col), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "classes")
    labels = connected_components(link_fingerprints(classes))
    named = materialize(classes.join(labels, classes.fp == labels.node, "left").select("fp", "least", "rows", F.coalesce("component", "fp").alias("component")), "named")
    names = materialize(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "names")
    # Copies share a fingerprint and many fingerprints may share a component: those of many rows stay where they are.
    of_class = materialize(hot_join(named.select("fp", "rows", "component"), names, ["component"], "members").select("fp", "rows", "component_id"), "components")
    return hot_join(fps, of_class, ["fp"], "rows").select("doc_id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Rows with the same smallest id stay together; rows with a null id stay.
    """
    found = near_duplicate_components(docs, **options)
    id_col = options.get("id_col", "doc_id")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
