"""Text functions as column expressions; a pandas UDF only where Unicode normalisation needs one."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed pattern: one Latin word or number, or one CJK character.
TOKEN = "([a-z0-9]+|[\\u4e00-\\u9fff])"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def content_hash(text: Column) -> Column:
    """SHA-256 without regard to white space."""
    return F.sha2(F.regexp_replace(text, "\\s+", ""), 256)


def excerpt(text: Column, chars: int) -> Column:
    """White space collapsed, cut to ``chars`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, "\\s+", " ")), 1, chars)


def compact_excerpt(text: Column, chars: int) -> Column:
    """White space collapsed; what is longer than ``chars`` characters is cut there and back to the last space before, if there is one."""
    flat = F.trim(F.regexp_replace(text, "(?U)\\s+", " "))
    head = F.substring(flat, 1, chars)
    return F.when(F.length(flat) <= chars, flat).otherwise(F.regexp_replace(head, "(?s)(.) [^ ]*$", "$1"))


def normalised(text: Column) -> Column:
    """Lower-case letters, digits and CJK characters only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9\\u4e00-\\u9fff]", "")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def slug_key(name: Column) -> Column:
    """A readable key: a slug with the start of the name's SHA-1."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.substring(slug, 1, 40), F.lit("-"), F.substring(F.sha1(name), 1, 8))


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff]")


def iso_date(text: Column) -> Column:
    """The date in the first ten characters; null where there is none."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def written_date(text: Column) -> Column:
    """The first date of this century in a text, year, month and day parted by CJK words, hyphens, slashes or dots; null where there is none or it is no day."""
    parts = F.regexp_extract_all(text, F.lit("(20[0-9]{2})[-年/.]([0-9]{1,2})[-月/.]([0-9]{1,2})"), F.lit(0))
    return F.try_to_date(F.regexp_replace(F.get(parts, 0), "[年月/.]", "-"), "y-M-d")


def digest_embedding(text: Column, size: int) -> Column:
    """``size`` numbers of norm one: the bytes of the text's SHA-256, over and over, from -1 to 1."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(F.sha2(text, 256), (2 * (i % 32) + 1).cast("int"), F.lit(2)), 16, 10).cast("double") / 255.0 * 2 - 1)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.coalesce(x / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))


def backoff_seconds(attempts: Column) -> Column:
    """Doubling wait from a minute, an hour at most."""
    return F.least(F.lit(3600), (60 * F.pow(F.lit(2), F.least(attempts, F.lit(6)))).cast("int")).cast("long")


#: Tokens whose hash a task remembers.
MEMO_TOKENS = 50_000


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its number of tokens and, bit by bit from the lowest, how many more of their hashes have it than have not."""
    known: dict[str, int] = {}
    table = np.zeros((MEMO_TOKENS, 64), np.int8)

    def places(tokens: list[str]) -> np.ndarray:
        nonlocal table
        new = [t for t in tokens if t not in known]
        if len(known) + len(new) > len(table):
            known.clear()
            new = tokens
            if len(new) > len(table):
                table = np.zeros((len(new), 64), np.int8)
        if new:
            low = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest()[-8:] for t in new), np.uint8).reshape(-1, 8)
            table[len(known) : len(known) + len(new)] = np.unpackbits(low, axis=1)[:, ::-1].astype(np.int8) * 2 - 1
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            counts, votes = np.zeros(part.num_rows, np.int64), np.zeros((part.num_rows, 64), np.int64)
            for row, tokens in enumerate(part.column(1).to_pylist()):
                if tokens:
                    times = Counter(tokens)
                    counts[row] = len(tokens)
                    votes[row] = (np.fromiter(times.values(), np.float64, len(times)) @ table[places(list(times))]).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * part.num_rows + 1, 64), pa.int32()), pa.array(votes.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), lists], names=[batch.schema.names[0], "n", "votes"])


def token_simhash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hi, lo): 64-bit SimHash over the low 64 bits of each token's SHA-256, as two 32-bit halves.

    Votes of a text are summed where it is, so only 64 numbers of it are shuffled; a tie counts as one, no token as zero.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    told = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("tokens")).mapInArrow(_votes, f"`{id_col}` {kind}, n long, votes array<long>")
    summed = told.groupBy(id_col).agg(F.sum("n").alias("n"), *[F.sum(F.col("votes")[b]).alias(f"v{b}") for b in range(64)])
    pack = lambda low: sum((F.when(F.col(f"v{low + b}") >= 0, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(1, 32)), F.when(F.col(f"v{low}") >= 0, 1).otherwise(0)).cast("long")
    return summed.select(id_col, *[F.when(F.col("n") > 0, pack(low)).otherwise(F.lit(0)).cast("long").alias(name) for low, name in ((32, "hi"), (0, "lo"))])


#: Lines that are boilerplate wherever they stand.
BOILERPLATE = ("^打印本页$", "^关闭窗口$", "^责任编辑[:：].+$", "^扫一扫在手机打开当前页$")
#: What ends a line, and what is white space at a line's ends, in Unicode.
_BREAK, _EDGE = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"


@F.pandas_udf(StringType())
def normal_form(text: pd.Series) -> pd.Series:
    """Unicode compatibility form NFKC, which has no built-in function."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def unique_paragraphs(text: Column) -> Column:
    """Paragraphs, parted by blank lines, each kept where it comes first; white space makes no difference."""
    parts = F.filter(F.transform(F.split(text, "(?U)\\n\\s*\\n"), lambda p: F.regexp_replace(p, _EDGE, "")), lambda p: p != "")
    marks = F.transform(parts, lambda p: F.regexp_replace(p, "(?U)\\s+", ""))
    # The place of a mark's first occurrence in the list of different marks says which paragraph stays.
    firsts = F.transform(F.array_distinct(marks), lambda m: F.array_position(marks, m))
    return F.array_join(F.transform(firsts, lambda i: F.element_at(parts, i.cast("int"))), "\n\n")


def clean_lines(text: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    """Single spaces, no boilerplate lines, paragraphs once, of text in normal form."""
    rows = F.transform(F.split(text, _BREAK), lambda x: F.regexp_replace(F.regexp_replace(x, "[\\t \\u3000]+", " "), _EDGE, ""))
    kept = F.filter(rows, lambda x: ~x.rlike("|".join(f"(?:{b})" for b in boilerplate))) if boilerplate else rows
    return unique_paragraphs(F.array_join(kept, "\n"))


def clean_texts(docs: DataFrame, text_col: str, boilerplate: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """``docs`` with ``text_col`` in NFKC and cleaned by ``clean_lines``; a null text stays null."""
    normal = docs.withColumn(text_col, normal_form(text_col))
    return normal.withColumn(text_col, clean_lines(F.col(text_col), boilerplate))
