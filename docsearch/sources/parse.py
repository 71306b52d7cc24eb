"""Files to Markdown documents: an operator without a shuffle for .docx and PDF, cell tables and joins for workbooks.

A file that can't be read is a row with its error, so one file never stops the others.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch.config import ParserConfig
from docsearch.errors import ParserError
from docsearch.functions.text import has_meaningful_content, nfc, normalize_text
from docsearch.operators import sheets
from docsearch.sources import ooxml
from docsearch.sources.files import name_of, route, validation_error
from docsearch.sources.pdf import read_pdf
from docsearch.staging import stage

_READ = "path string, markdown string, parser_used string, metadata string, warnings array<string>, error_type string, reason string"
_CELL = "sheet:string,r:int,c:int,kind:string,text:string,number:double,moment:timestamp_ntz,format:string"
_BOOK = f"path string, sheets array<struct<number:int,sheet:string,hidden:boolean>>, cells array<struct<{_CELL}>>, merges array<struct<sheet:string,r1:int,c1:int,r2:int,c2:int>>, error_type string, reason string"
_CELL_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.timestamp("us"), pa.string()]


def _failed(e: BaseException) -> tuple[str, str]:
    return (type(e).__name__ if isinstance(e, ParserError) else "ParserError"), f"{type(e).__name__}: {e}"


def _documents(files: DataFrame, config: ParserConfig) -> DataFrame:
    """.docx and PDF files."""

    def one(path: str, content: bytes) -> tuple:
        try:
            if path.lower().endswith(".docx"):
                return path, ooxml.document(content), "docx", "{}", [], None, None
            text, parser, meta, warnings = read_pdf(content, config)
            return path, text, parser, json.dumps(meta), warnings, None, None
        except Exception as e:
            return path, None, None, None, [], *_failed(e)

    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [one(p, c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])

    return files.select("path", "content").mapInArrow(run, _READ)


def _books(files: DataFrame) -> DataFrame:
    struct = lambda names, kinds: pa.list_(pa.struct(list(zip(names.split(), kinds, strict=True))))
    s_type = struct("number sheet hidden", [pa.int32(), pa.string(), pa.bool_()])
    c_type = struct("sheet r c kind text number moment format", _CELL_KINDS)
    m_type = struct("sheet r1 c1 r2 c2", [pa.string(), *[pa.int32()] * 4])

    def one(path: str, content: bytes) -> tuple:
        try:
            if path.lower().endswith(".xls"):
                raise ParserError("the old workbook format needs a reader that is not installed")
            return path, *ooxml.workbook(content), None, None
        except Exception as e:
            return path, [], [], [], *_failed(e)

    def run(batches):
        for batch in batches:
            rows = [one(p, c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                path, s, c, m, e, why = zip(*rows, strict=True)
                dicts = lambda lists, t: pa.array([[dict(zip([f.name for f in t.value_type], x, strict=True)) for x in xs] for xs in lists], t)
                yield pa.RecordBatch.from_arrays([pa.array(path), dicts(s, s_type), dicts(c, c_type), dicts(m, m_type), pa.array(e, pa.string()), pa.array(why, pa.string())], ["path", "sheets", "cells", "merges", "error_type", "reason"])

    return files.select("path", "content").mapInArrow(run, _BOOK)


def _workbooks(files: DataFrame, config: ParserConfig) -> DataFrame:
    books = stage(_books(files).withColumnRenamed("path", "doc"))
    shown = books.select("doc", F.explode("sheets").alias("s")).select("doc", "s.*")
    if not config.excel_include_hidden_sheets:
        shown = shown.where("not hidden")
    cells = books.select("doc", F.explode("cells").alias("x")).select("doc", "x.*")
    cells = cells.select("doc", "sheet", "r", "c", sheets.cell_text(F.col("kind"), F.col("text"), F.col("number"), F.col("moment"), F.col("format")).alias("v"))
    merges = books.select("doc", F.explode("merges").alias("x")).select("doc", "x.*")
    drawn = stage(sheets.sheet_markdown(cells, merges, config.excel_force_narrative, config.excel_max_header_rows).join(shown, ["doc", "sheet"]))
    text = sheets.workbook_markdown(drawn).join(drawn.groupBy("doc").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("sheet", "mode")))).alias("modes")), "doc")
    skipped = books.select("doc", F.explode("sheets").alias("s")).select("doc", "s.*").join(drawn.select("doc", "sheet", F.lit(True).alias("used")), ["doc", "sheet"], "left").where("used is null")
    notes = skipped.groupBy("doc").agg(F.sort_array(F.collect_list(F.concat(F.when(F.col("hidden"), "hidden sheet skipped: ").otherwise("empty sheet skipped: "), "sheet"))).alias("warnings"))
    out = books.select("doc", "error_type", "reason").join(text, "doc", "left").join(notes, "doc", "left")
    return out.select(F.col("doc").alias("path"), "markdown", F.lit("ooxml").alias("parser_used"), F.col("modes").alias("metadata"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), "error_type", "reason")


def parse(files: DataFrame, config: ParserConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of scanned files (path, length, content, doc_id, ...).

    documents: (doc_id, source, source_path, file_type, parser_used, markdown, metadata, warnings);
    failures: (source_path, error_type, reason).
    """
    config = config or ParserConfig()
    known = files.withColumn("route", route(F.col("path"))).withColumn("bad", validation_error(F.col("path"), F.col("length")))
    good = known.where("bad is null")
    read = _documents(good.where(F.col("route").isin("pdf", "docx")), config).unionByName(_workbooks(good.where(F.col("route").isin("excel", "excel_legacy")), config))
    read = read.withColumn("markdown", normalize_text(F.col("markdown")))
    empty = F.col("error_type").isNull() & ~F.coalesce(has_meaningful_content(F.col("markdown")), F.lit(False))
    read = read.withColumn("error_type", F.when(empty, "EmptyDocumentError").otherwise(F.col("error_type"))).withColumn("reason", F.when(empty, "no content").otherwise(F.col("reason")))
    docs = read.where("error_type is null").join(known.select("path", "doc_id", "file_type"), "path")
    docs = docs.select("doc_id", nfc(name_of(F.col("path"))).alias("source"), F.col("path").alias("source_path"), "file_type", "parser_used", "markdown", "metadata", "warnings")
    invalid = known.where("bad is not null").select(F.col("path").alias("source_path"), F.col("bad").alias("error_type"), F.lit("not a readable file").alias("reason"))
    return docs, invalid.unionByName(read.where("error_type is not null").select(F.col("path").alias("source_path"), "error_type", "reason"))
