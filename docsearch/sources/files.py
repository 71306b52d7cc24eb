"""Files as rows: scanning, identity, hashing, validation and routing, all as Column expressions."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch.functions.text import nfc

#: Parser by suffix.
ROUTES = {".pdf": "pdf", ".xlsx": "excel", ".xlsm": "excel", ".xls": "excel_legacy", ".docx": "docx"}
#: Fixed value: the first eight bytes of an OLE container, which is what an encrypted Office file is.
OLE_SIGNATURE = "D0CF11E0A1B11AE1"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(?s).(\.[^.]+)$", 1))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*ROUTES) & ~name_of(path).startswith("~$")


def route(path: Column) -> Column:
    """The parser's name, else null."""
    x = suffix(path)
    out = F.lit(None).cast("string")
    for s, parser in ROUTES.items():
        out = F.when(x == s, F.lit(parser)).otherwise(out)
    return F.when(is_supported(path), out)


def hidden_below(path: Column, root: str) -> Column:
    """Whether a part of the path below the root starts with a dot."""
    below = F.substring(path, len(root.rstrip("/")) + 2, F.length(path))
    return F.exists(F.split(below, "/"), lambda part: part.startswith("."))


def document_id(path: Column, compose: bool = True) -> Column:
    """From the path, not the content, so that it outlives edits."""
    return F.substring(F.sha1((nfc(path) if compose else path).cast("binary")), 1, 16)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def is_ole(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 8)) == OLE_SIGNATURE


def validation_error(path: Column, length: Column, exists: Column | None = None, is_file: Column | None = None) -> Column:
    """The error type of a file that can't be parsed, else null; the order of the tests is part of the contract."""
    exists = F.lit(True) if exists is None else exists
    is_file = F.lit(True) if is_file is None else is_file
    return F.when(~exists, "ParserError").when(~is_file | ~is_supported(path), "UnsupportedFileError").when(length == 0, "EmptyDocumentError")


def plain_path(path: Column) -> Column:
    """A local file's path without its scheme; other paths stay."""
    return F.regexp_replace(path, "^file:/+", "/")


def as_files(found: DataFrame, root: str) -> DataFrame:
    """(path, length, modified, [content, file_hash,] doc_id, file_type) of the supported files among rows of Spark's ``binaryFile``."""
    files = found.withColumn("path", nfc(plain_path(F.col("path")))).withColumnRenamed("modificationTime", "modified")
    files = files.where(is_supported(F.col("path")) & ~hidden_below(F.col("path"), root.removeprefix("file://")))
    if "content" in files.columns:
        files = files.withColumn("file_hash", content_hash(F.coalesce("content", F.unhex(F.lit("")))))
    return files.withColumn("doc_id", document_id(F.col("path"))).withColumn("file_type", F.substring(suffix(F.col("path")), 2, 10))


def reader(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(path, length, modified, content, file_hash, doc_id, file_type) of the supported files below a folder.

    Spark's listing leaves out names that start with a dot or an underscore.  Without content, no file is opened.
    """
    found = reader(spark, root)
    # empty files are in Spark's listing but never in what it reads
    listed = spark.createDataFrame([(unquote(x),) for x in found.inputFiles()], "path string").select(plain_path(F.col("path")).alias("path"))
    found = found.select(plain_path(F.col("path")).alias("path"), "length", "modificationTime", *(["content"] if content else []))
    empty = listed.join(found.select("path"), "path", "left_anti").withColumn("length", F.lit(0).cast("long"))
    return as_files(found.unionByName(empty, allowMissingColumns=True), root)


def contents(spark: SparkSession, root: str, wanted: DataFrame, few: int = 100_000) -> DataFrame:
    """The files of a scan without content that are wanted (path, length, modified), opened; the reader passes by all older than those.

    File names are sent to every task up to a counted number; beyond it, contents are shuffled by name.
    """
    first, n = wanted.agg(F.min("modified"), F.count("*")).first()
    found = reader(spark, root).select("path", "length", "modificationTime", "content")
    if first is not None:
        found = found.where(F.col("modificationTime") >= F.lit(first))
    names = wanted.select("path")
    opened = as_files(found, root).join(F.broadcast(names) if n <= few else names, "path", "left_semi")
    return opened.unionByName(wanted.where("length = 0").select("path", "length", "modified", "file_hash", "doc_id", "file_type"), allowMissingColumns=True)
