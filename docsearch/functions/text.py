"""Text and Markdown functions as Column expressions.

All stay in the JVM except Unicode normalisation, which Spark lacks; that runs as an Arrow UDF and only on values with a
character outside ASCII.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns that results depend on.  (?U) makes the Java classes Unicode ones.
PAGE_MARKER = r"(?U)^\s*<!--\s*page:\s*(\d+)\s*-->\s*$"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
IMAGE_LINE = r"(?mU)^\s*<!--\s*image\s*-->\s*$"
NOT_MEANINGFUL = r"(?U)[#|\-:*_>\s`=]"
DECORATION = r"\*\*|__|\*|_|`"
FENCE = r"^(```|~~~)"
HEADING = r"(?U)^(#{1,6})\s+\S"
KOREAN_OR_WORD = r"[가-힣]+|[A-Za-z0-9]+"
CODE_TOKEN = r"[A-Za-z0-9][A-Za-z0-9\-_./]*[A-Za-z0-9]"
TAG_LINE = r"^\[문서명: .*\]$"


@F.arrow_udf(StringType())
def _nfc(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in values.to_pylist()], pa.string())


def nfc(x: Column) -> Column:
    """Canonical composition; pure ASCII is passed by."""
    return F.when(x.rlike(r"[^\x00-\x7F]"), _nfc(x)).otherwise(x)


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_text(x: Column, compose: bool = True) -> Column:
    """NFC, LF line ends, no control characters, plain spaces, no image lines, no trailing blanks, at most one blank line."""
    x = nfc(x) if compose else x
    for pattern, by in (
        (r"\r\n?", "\n"),
        (CONTROL, ""),
        (" ", " "),
        (IMAGE_LINE, ""),
        (r"(?mU)[^\S\n]+$", ""),
        (r"\n{3,}", "\n\n"),
    ):
        x = F.regexp_replace(x, pattern, by)
    return strip(x)


def lines(x: Column) -> Column:
    return F.split(x, "\n")


def page_marker(number: Column) -> Column:
    return F.concat(F.lit("<!-- page: "), number.cast("string"), F.lit(" -->"))


def page_number(line: Column) -> Column:
    """The number of a page-marker line, else null."""
    return F.nullif(F.regexp_extract(line, PAGE_MARKER, 1), F.lit("")).cast("int")


def strip_page_markers(x: Column) -> Column:
    return F.array_join(F.filter(lines(x), lambda s: ~s.rlike(PAGE_MARKER)), "\n")


def has_meaningful_content(x: Column) -> Column:
    return F.length(F.regexp_replace(strip_page_markers(x), NOT_MEANINGFUL, "")) > 0


def clean_header(x: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(x, DECORATION, ""), r"(?U)\s+#+\s*$", ""))


def is_table_row(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*\|")


def is_table_separator(line: Column) -> Column:
    return line.contains("|") & line.contains("-") & line.rlike(r"(?U)^[|\-:\s]*$")


def escape_cell(x: Column) -> Column:
    return strip(F.regexp_replace(F.replace(x, F.lit("|"), F.lit("\\|")), r"(?U)\s*\n\s*", " "))


def table_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, escape_cell), " | "), F.lit(" |"))


def build_table(header: Column, rows: Column) -> Column:
    """A Markdown table of array<string> and array<array<string>>; rows are padded or cut to the header's width."""
    width = F.size(header)
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    return F.array_join(F.concat(F.array(table_line(header), rule), F.transform(rows, lambda r: table_line(fit(r)))), "\n")


def make_tag(source: Column, section: Column) -> Column:
    return F.concat(F.lit("[문서명: "), source, F.lit(", 섹션: "), section, F.lit("]"))


def strip_tag_line(x: Column) -> Column:
    """Without the first line if that is a tag, and then without white space at the ends."""
    first = F.substring_index(x, "\n", 1)
    rest = F.substring(x, F.length(first) + 2, F.length(x))
    return F.when(first.rlike(TAG_LINE), strip(rest)).otherwise(strip(x))


def xml_attribute(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def pages_label(first: Column, last: Column) -> Column:
    """``3`` or ``3-5``; null without pages."""
    last = F.coalesce(last, first)
    return F.when(first == last, first.cast("string")).when(first.isNotNull(), F.concat(first.cast("string"), F.lit("-"), last.cast("string")))


def tokenize(x: Column, compose: bool = True) -> Column:
    """Search tokens: Hangul runs and ASCII words in lower case, then code-like tokens once more."""
    x = nfc(x) if compose else x
    found = F.concat(F.regexp_extract_all(x, F.lit(f"({KOREAN_OR_WORD})"), 1), F.regexp_extract_all(x, F.lit(f"({CODE_TOKEN})"), 1))
    return F.transform(found, F.lower)
