"""PDF preflight and routing as Column expressions, and the interface of the libraries that read pages.

No PDF library is part of this package: a deployment registers backends.  A file without one is a failure row, never a crash.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.config import ParserConfig
from docsearch.errors import EmptyDocumentError, ParserError
from docsearch.functions.markdown import restore_headings, strip_inline_code
from docsearch.functions.text import strip

#: Functions of a file's bytes: ``probe`` gives the text of each page (an empty list: no pages) and raises
#: EncryptedDocumentError; ``fast``, ``layout`` and ``plain`` give the Markdown of each page.
Backend = Callable[[bytes], list[str]]
BACKENDS: dict[str, Backend] = {}


def preflight(pages: DataFrame, sample: int = 10) -> DataFrame:
    """(doc, page_count, sampled_pages, sampled_chars, raw_chars, avg_chars) from (doc, page_no from 0, text)."""
    n = pages.groupBy("doc").agg(F.count("*").alias("page_count"))
    step = F.greatest(F.floor(F.col("page_count") / sample), F.lit(1))
    chars = F.length(strip(F.col("text")))
    taken = (F.col("page_no") % step == 0) & (F.col("page_no") / step < sample)
    rows = pages.join(n, "doc")
    out = rows.groupBy("doc", "page_count").agg(F.sum(taken.cast("long")).alias("sampled_pages"), F.sum(F.when(taken, chars).otherwise(0)).alias("sampled_chars"), F.sum(chars).alias("raw_chars"))
    return out.withColumn("avg_chars", F.when(F.col("sampled_pages") > 0, F.col("sampled_chars") / F.col("sampled_pages")).otherwise(0.0))


def pdf_route(pages: Column, mb: Column, avg_chars: Column, layout: bool, config: ParserConfig | None = None) -> Column:
    """struct(reader, reason, error): what reads a PDF, or why nothing does; the order of the tests is part of the contract."""
    c = config or ParserConfig()
    large = (pages > c.large_pdf_page_threshold) | (mb > c.large_pdf_size_mb)
    scanned = avg_chars < c.scanned_chars_per_page
    use = layout and c.use_layout_parser
    none = F.lit(None).cast("string")
    pick = lambda reader, reason: F.struct(F.lit(reader).alias("reader"), F.lit(reason).alias("reason"), none.alias("error"))
    error = F.struct(none.alias("reader"), none.alias("reason"), F.lit("EmptyDocumentError").alias("error"))
    rest = F.when(scanned, pick("layout", "scanned_ocr")).otherwise(pick("layout", "complex_layout")) if use else pick("fast", "layout_unavailable")
    return F.when(scanned & F.lit(not use), error).when(large & ~scanned, pick("fast", "large_pdf")).otherwise(rest)


def enough_text(markdown: Column, raw_chars: Column, scanned: Column, ratio: float = 0.5) -> Column:
    """Whether a layout reader lost too little of the text to be distrusted."""
    kept = F.length(F.regexp_replace(markdown, r"(?U)\s", ""))
    return F.when(scanned, kept > 0).otherwise(kept / F.greatest(raw_chars, F.lit(1)) >= ratio)


def read_pdf(content: bytes, config: ParserConfig) -> tuple[str, str, dict[str, Any], list[str]]:
    """(markdown, parser, metadata, warnings) by the registered backends, with the same routing as ``pdf_route``."""
    probe = BACKENDS.get("probe")
    if probe is None:
        raise ParserError("no PDF backend is registered")
    texts = [t.strip() for t in probe(content)]
    if not texts:
        raise EmptyDocumentError("a PDF without pages")
    step = max(len(texts) // config.preflight_sample_pages, 1)
    taken = texts[::step][: config.preflight_sample_pages]
    scanned = sum(map(len, taken)) / len(taken) < config.scanned_chars_per_page
    large = len(texts) > config.large_pdf_page_threshold or len(content) / 2**20 > config.large_pdf_size_mb
    layout = BACKENDS.get("layout") if config.use_layout_parser else None
    warnings: list[str] = []
    if scanned and layout is None:
        raise EmptyDocumentError("a scanned PDF, and nothing that reads images")
    if layout is None or (large and not scanned):
        reason, pages = "large_pdf" if large else "layout_unavailable", _fast(content, texts, warnings)
        name = "fast"
    else:
        name, reason = "layout", "scanned_ocr" if scanned else "complex_layout"
        try:
            pages = layout(content)
            kept, raw = len("".join("".join(pages).split())), sum(map(len, texts))
            if (scanned and not kept) or (not scanned and kept / max(raw, 1) < config.min_layout_text_ratio):
                raise ParserError("the layout reader lost too much text")
        except Exception as e:
            if scanned:
                raise ParserError(f"the scanned PDF can't be read: {e}") from e
            warnings.append(f"layout reader: {e}; read by the fast one")
            name, reason, pages = "fast", "layout_fallback", _fast(content, texts, warnings)
    text = "\n\n".join(f"<!-- page: {k} -->\n\n{p}" for k, p in enumerate(pages, 1))
    text, stripped = strip_inline_code(text, config.pdf_inline_code_strip)
    stats = {"applied": 0}
    if config.pdf_restore_heading_levels:
        text, stats = restore_headings(text)
    return text, name, {"page_count": len(texts), "route_reason": reason, "inline_code_stripped": stripped, "heading_restore": stats["applied"]}, warnings


def _fast(content: bytes, texts: list[str], warnings: list[str]) -> list[str]:
    fast = BACKENDS.get("fast")
    if fast is not None:
        try:
            return fast(content)
        except Exception as e:
            warnings.append(f"fast reader: {e}; plain text instead")
    return texts
