"""Heading-aware chunking: one Arrow-batched UDF per text, since packing is sequential within a document."""

from __future__ import annotations

import re
import uuid
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

CHUNK = "array<struct<chunk_index:int,content:string,section_path:array<string>,section_title:string,char_count:int>>"
#: What a heading looks like, and where a long paragraph may be cut.
_heading = re.compile(r"^(?:#{1,6}\s+.+|第[一二三四五六七八九十百千万零〇两\d]+[章节条编部分]\s*.*|[一二三四五六七八九十百千万零〇两]+、\s*.+|\d+(?:\.\d+)*[.、)]\s*.+)$")
_separators = ("\n", "。", "！", "？", "；", ";", "，", ",", " ")
_blank = re.compile(r"\n\s*\n")


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters; the fixed defaults of the domain."""

    target: int = 800
    least: int = 160
    most: int = 1200
    overlap: int = 120

    def __post_init__(self):
        if self.overlap < 0 or self.overlap >= self.target or self.least < 1 or not self.least <= self.target <= self.most:
            raise ValueError("sizes must keep 0 <= overlap < target and 0 < least <= target <= most")

    @property
    def longest_part(self) -> int:
        """A part that fits a chunk behind an overlap and a blank line."""
        return max(1, self.most - self.overlap - (2 if self.overlap else 0))


def _sections(lines: list[str]):
    """(path, title, body) in order; a heading stands below those of lower levels, one without marks is of the first level."""
    marks = [(at, text) for at, line in enumerate(lines) if (text := line.strip()) and _heading.match(text)]
    first = marks[0][0] if marks else len(lines)
    path: tuple[str, ...] = ()
    if first or not marks:
        yield path, None, "\n".join(lines[:first]).strip()
    for (at, text), stop in zip(marks, [at for at, _ in marks[1:]] + [len(lines)], strict=False):
        title = text.lstrip("#").strip()
        path = path[: max(1, len(text) - len(text.lstrip("#"))) - 1] + (title,)
        yield path, title, "\n".join(lines[at + 1 : stop]).strip()


def _parts(paragraph: str, limit: int):
    """A paragraph in parts of ``limit`` characters or so, each cut behind the last separator that leaves it a third of that."""
    rest, low = paragraph.strip(), max(1, limit // 3)
    while len(rest) > limit:
        at = max(rest.rfind(mark, low, limit + 1) for mark in _separators)
        cut = at + 1 if at >= low else limit
        if part := rest[:cut].strip():
            yield part
        rest = rest[cut:].strip()
    if rest:
        yield rest


def _packed(body: str, config: ChunkConfig):
    """Paragraphs gathered into chunks; a full chunk's end begins the next one."""
    held = ""
    for paragraph in [p.strip() for p in _blank.split(body) if p.strip()] or [body.strip()]:
        for part in _parts(paragraph, config.longest_part):
            grown = f"{held}\n\n{part}" if held else part
            if held and len(grown) > (config.target if len(held) >= config.least else config.most):
                yield held
                tail = held[len(held) - config.overlap :].lstrip() if config.overlap else ""
                grown = f"{tail}\n\n{part}".strip()
            held = grown
    if held:
        yield held


def chunks(text: str | None, config: ChunkConfig = ChunkConfig()) -> list[dict]:
    """Chunks of a text's sections in order; none for a null or blank text."""
    lines = re.sub("\r\n?", "\n", text or "").strip().splitlines()
    found = ((path, title, piece) for path, title, body in _sections(lines) for piece in _packed(f"{title}\n{body}" if title else body, config))
    return [{"chunk_index": i, "content": piece, "section_path": list(path), "section_title": title, "char_count": len(piece)} for i, (path, title, piece) in enumerate(found) if piece.strip()]


def chunk_column(text: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    @F.pandas_udf(CHUNK)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t, config))

    return run(text)


@F.pandas_udf(StringType())
def stable_id(key: pd.Series) -> pd.Series:
    """A UUID of version 5 for a name, under the URL namespace."""
    return key.map(lambda k: str(uuid.uuid5(uuid.NAMESPACE_URL, k)), na_action="ignore")


def page_texts(attachments: DataFrame) -> DataFrame:
    """(doc_id, attachment_id, attachment_name, page_number, body): pages are parted by form feeds; a single page has a number only if it is known to be one."""
    pages = attachments.select("doc_id", "attachment_id", "attachment_name", "page_count", F.split(F.coalesce("parsed_text", F.lit("")), "\f").alias("pages"))
    rows = pages.select("*", F.posexplode("pages").alias("at", "body"))
    number = F.when((F.size("pages") > 1) | F.col("page_count").isNotNull(), F.col("at") + 1)
    return rows.select("doc_id", "attachment_id", "attachment_name", "at", number.alias("page_number"), "body")


def chunk_documents(docs: DataFrame, config: ChunkConfig = ChunkConfig(), attachments: DataFrame | None = None, provider: str = "deterministic", model: str = "digest", version: str = "1") -> DataFrame:
    """One row per chunk of documents (doc_id, content) and of the pages of their attachments (see ``page_texts``).

    Chunks are numbered over a document and then its attachments. An attachment's name stands before its section paths. The id
    is the same whenever document, place, headings, embedding and content are.
    """
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("attachment_id"), F.lit(None).cast("string").alias("attachment_name"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("page_number"), F.col("content").alias("body"))
    if attachments is not None:
        rows = rows.unionByName(page_texts(attachments).withColumn("attachment_id", F.col("attachment_id").cast("long")))
    drafts = rows.select("doc_id", "attachment_id", "attachment_name", "at", "page_number", F.explode(chunk_column(F.col("body"), config)).alias("c")).select("*", "c.*").drop("c")
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("attachment_id"), "at", "chunk_index")
    owned = F.col("attachment_id").isNotNull()
    numbered = drafts.select(
        "doc_id",
        "attachment_id",
        "page_number",
        (F.row_number().over(order) - 1).cast("int").alias("chunk_index"),
        F.when(owned, F.concat(F.array("attachment_name"), "section_path")).otherwise(F.col("section_path")).alias("section_path"),
        F.coalesce("section_title", "attachment_name").alias("section_title"),
        "content",
        "char_count",
        F.sha2("content", 256).alias("content_hash"),
        T.token_count(F.col("content")).alias("token_count"),
    )
    name = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in (F.lit("chunk"), F.col("doc_id"), F.col("attachment_id"), F.col("page_number"), F.col("chunk_index"), F.array_join("section_path", " > "), F.col("section_title"), F.lit(provider), F.lit(model), F.lit(version), F.col("content_hash"))])
    return numbered.withColumn("chunk_id", stable_id(name))
