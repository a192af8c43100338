"""Files as rows: binary content decoded, listed, told by type, and reports written."""

from __future__ import annotations

import io
import zipfile
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

#: Encodings tried in turn; types by MIME type and by ending; endings of each type; parsers by ending.
ENCODINGS = ("utf-8-sig", "gb18030", "utf-16")
MIME_TYPES = {
    "application/pdf": "pdf",
    "application/msword": "doc",
    "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "image/jpeg": "jpg",
    "image/jpg": "jpg",
    "image/png": "png",
    "image/webp": "webp",
    "text/html": "html",
    "application/xhtml+xml": "html",
    "text/plain": "txt",
}
EXTENSION_TYPES = {"htm": "html", "shtml": "html", "jpeg": "jpg", **{x: x for x in "doc docx html jpg pdf png txt webp xls xlsx et jsp mp4 ofd wps".split()}}
PARSERS = {"html": "html", "htm": "html", "txt": "text", "md": "text", "csv": "text", "zip": "zip", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx"}


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content): files below a path as rows."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


@F.pandas_udf(StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Bytes as text in the first of ENCODINGS that fits, else as UTF-8 with replacements."""

    def one(raw):
        for encoding in ENCODINGS:
            try:
                return bytes(raw).decode(encoding)
            except UnicodeDecodeError:
                continue
        return bytes(raw).decode("utf-8", errors="replace")

    return content.map(one, na_action="ignore")


ENTRIES = ArrayType(StructType([StructField("name", StringType()), StructField("compressed_size", LongType()), StructField("uncompressed_size", LongType()), StructField("is_directory", BooleanType()), StructField("unsafe_path", BooleanType())]))


@F.pandas_udf(ENTRIES)
def zip_entries(content: pd.Series) -> pd.Series:
    """Entries of an archive, none of them unpacked; a path that is absolute or goes up is unsafe. Null for what is no archive."""

    def one(raw):
        try:
            infos = zipfile.ZipFile(io.BytesIO(bytes(raw))).infolist()
        except zipfile.BadZipFile:
            return None
        paths = [PurePosixPath(i.filename.replace("\\", "/")) for i in infos]
        return [{"name": i.filename, "compressed_size": i.compress_size, "uncompressed_size": i.file_size, "is_directory": i.is_dir(), "unsafe_path": p.is_absolute() or ".." in p.parts} for i, p in zip(infos, paths, strict=True)]

    return content.map(one, na_action="ignore")


def base_name(path: Column) -> Column:
    """The last part of a path, either slash parting it."""
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def suffix(name: Column) -> Column:
    """A file name's ending in lower case without the dot, if it is 1 to 15 letters and digits; else empty."""
    return F.regexp_extract(F.lower(base_name(name)), r"[^.].*?\.([a-z0-9]{1,15})$", 1)


def parser_for(name: Column) -> Column:
    """The parser of a file by its ending; a file without one raises."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv]), suffix(name)), F.raise_error(F.concat(F.lit("no parser for "), name)).cast("string"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def magic_type(head: Column) -> Column:
    """The type that the first bytes tell, null for none; packed office files are told by the names of their entries."""
    starts = lambda *codes: F.hex(head).rlike("^(?:" + "|".join(codes) + ")")
    text = F.lower(F.ltrim(F.try_to_binary(F.hex(head), F.lit("hex")).cast("string")))
    names = head.cast("string")
    return (
        F.when(starts("255044462D"), "pdf")
        .when(starts("89504E470D0A1A0A"), "png")
        .when(starts("FFD8FF"), "jpg")
        .when(F.hex(head).rlike("^52494646.{8}57454250"), "webp")
        .when(starts("D0CF11E0A1B11AE1"), "legacy_office")
        .when(starts("504B0304", "504B0506", "504B0708") & F.contains(names, F.lit("word/")), "docx")
        .when(starts("504B0304", "504B0506", "504B0708") & F.contains(names, F.lit("xl/")), "xlsx")
        .when(text.rlike("^(?:<!doctype html|<html|<\\?xml)") | F.contains(text, F.lit("<body")), "html")
        .when((F.length(head) > 0) & ~F.hex(head).rlike("^(?:..)*?00") & F.is_valid_utf8(head.cast("string")), "txt")
    )


def attachment_type(content_type: Column, disposition: Column, head: Column, filename: Column, url: Column) -> Column:
    """struct(file_type, source): by content type, disposition, first bytes, file name and address, the first that tells a type.

    Old office files have one magic for all: a name ending in doc or xls decides which.
    """
    mime = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    told = F.nullif(F.regexp_extract(disposition, r"""(?i)filename\*?=(?:UTF-8'')?["']?([^"';]+)""", 1), F.lit(""))
    named = base_name(F.coalesce(F.try_url_decode(told), told))
    address = base_name(F.try_url_decode(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)))
    magic = magic_type(head)
    by_name = lambda n: _lookup(EXTENSION_TYPES, suffix(n))
    office = F.coalesce(*[F.when(by_name(n).isin("doc", "xls"), by_name(n)) for n in (named, filename, address)])
    tries = [(_lookup(MIME_TYPES, mime), "content_type"), (by_name(named), "content_disposition"), (magic, "magic"), (by_name(filename), "original_filename"), (by_name(address), "url_suffix")]
    pick = lambda kind, source: F.struct(kind.alias("file_type"), F.lit(source).alias("source"))
    first = F.coalesce(*[F.when(kind.isNotNull(), pick(kind, source)) for kind, source in tries], pick(F.lit("unknown"), "unknown"))
    return F.when(magic == "legacy_office", F.when(office.isNotNull(), pick(office, "magic_and_filename")).otherwise(pick(magic, "magic"))).otherwise(first)


def safe_filename(name: Column, identity: Column | None = None) -> Column:
    """A file name of letters, digits, ``_`` and ``-``, with ten digits of the name's hash and its ending."""
    decoded = F.trim(F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name))
    base, ending = base_name(decoded), suffix(decoded)
    bare = F.when(ending != "", F.substring(base, F.lit(1), F.length(base) - F.length(ending) - 1)).otherwise(base)
    stem = F.substring(F.regexp_replace(F.regexp_replace(bare, "[^A-Za-z0-9_-]+", "_"), "^[_-]+|[_-]+$", ""), 1, 100)
    source = decoded if identity is None else F.concat(identity, F.lit("\u0000"), decoded)
    return F.concat(F.when(stem == "", "attachment").otherwise(stem), F.lit("-"), F.substring(F.sha2(source, 256), 1, 10), F.when(ending != "", F.concat(F.lit("."), ending)).otherwise(""))


def without_page_frames(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) of pages (doc_id, page, text) without first and last lines that half of a document's pages, two at least, have in common."""
    lines = F.filter(F.transform(F.split("text", "\\R"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.select("doc_id", "page", lines.alias("lines"))
    ends = rows.where(F.size("lines") > 0).select("doc_id", F.explode(F.array(F.struct(F.lit("first").alias("end"), F.element_at("lines", 1).alias("line")), F.struct(F.lit("last").alias("end"), F.element_at("lines", -1).alias("line")))).alias("e")).select("doc_id", "e.*")
    size = rows.groupBy("doc_id").agg(F.count("*").alias("pages"))
    often = ends.groupBy("doc_id", "end", "line").agg(F.count("*").alias("n")).join(size, "doc_id").where((F.col("pages") >= 2) & (F.col("n") >= F.greatest(F.lit(2), F.floor((F.col("pages") + 1) / 2))))
    frames = often.groupBy("doc_id").agg(F.collect_set(F.when(F.col("end") == "first", F.col("line"))).alias("first"), F.collect_set(F.when(F.col("end") == "last", F.col("line"))).alias("last"))
    met = rows.join(frames, "doc_id", "left")
    inner = F.when(F.array_contains("first", F.try_element_at("lines", F.lit(1))), F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines"))
    headless = met.withColumn("inner", inner)
    body = F.when((F.size("inner") > 0) & F.array_contains("last", F.try_element_at("inner", F.lit(-1))), F.slice("inner", F.lit(1), F.greatest(F.size("inner") - 1, F.lit(0)))).otherwise(F.col("inner"))
    return headless.select("doc_id", "page", F.array_join(body, "\n").alias("text"))


def parsed_pages(pages: DataFrame, least_chars: int = 20) -> DataFrame:
    """(doc_id, text, pages, requires_ocr): a document's pages joined; with too few characters a page it has to be read by eye."""
    n = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("pages"))
    texts = F.filter(F.transform("p", lambda x: x["text"]), lambda t: t != "")
    return n.select("doc_id", F.array_join(texts, "\n\n").alias("text"), "pages", (F.col("chars") < least_chars * F.col("pages")).alias("requires_ocr"))
