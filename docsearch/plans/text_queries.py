"""Queries of the file, text and Markdown operators, with the SQL that gives the same rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch.functions import markdown as M
from docsearch.functions import text as T
from docsearch.operators.chunking import label as section_label
from docsearch.sources import files as S

#: A file table made of documents: paths in folders, with every kind of suffix.
_SUFFIXES = (".pdf", ".XLSX", ".docx", ".txt", ".xls", ".xlsm", "")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def file_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, path, length, text): invented paths; some hidden, some lock files, some empty."""
    d = read(spark, sf, "documents")
    kinds = F.array(*map(F.lit, _SUFFIXES))
    folder = F.when(F.col("doc_id") % 11 == 3, F.lit("/data/.trash/")).otherwise(F.concat(F.lit("/data/"), "source", F.lit("/")))
    name = F.concat(F.when(F.col("doc_id") % 13 == 5, "~$").otherwise(""), F.lit("f"), F.col("doc_id").cast("string"), F.get(kinds, (F.col("doc_id") % len(_SUFFIXES)).cast("int")))
    length = F.when(F.col("doc_id") % 17 == 7, 0).otherwise(F.octet_length("text")).cast("long")
    return d.select("doc_id", F.concat(folder, name).alias("path"), length.alias("length"), "text")


_FILES = """
files AS (SELECT doc_id, (CASE WHEN doc_id % 11 = 3 THEN '/data/.trash/' ELSE '/data/' || source || '/' END)
  || (CASE WHEN doc_id % 13 = 5 THEN '~$' ELSE '' END) || 'f' || doc_id
  || (['.pdf', '.XLSX', '.docx', '.txt', '.xls', '.xlsm', ''])[(doc_id % 7 + 1)::INT] AS path,
  CASE WHEN doc_id % 17 = 7 THEN 0 ELSE octet_length(encode(text)) END::BIGINT AS length, text FROM documents),
kinds AS (SELECT *, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS suffix, regexp_extract(path, '[^/]*$') AS name FROM files),
known AS (SELECT *, suffix IN ('.pdf', '.xlsx', '.xlsm', '.xls', '.docx') AND name NOT LIKE '~$%' AS ok FROM kinds)
"""


def doc_id_path_hash(spark, sf):
    return file_rows(spark, sf).select("doc_id", S.document_id(F.col("path"), compose=False).alias("file_id"))


def file_sha256(spark, sf):
    return read(spark, sf, "documents").select("doc_id", S.content_hash(F.col("text").cast("binary")).alias("file_hash"))


def scan_filter(spark, sf):
    return file_rows(spark, sf).where(S.is_supported(F.col("path")) & ~S.hidden_below(F.col("path"), "/data")).select("doc_id", "path")


def route_by_extension(spark, sf):
    return file_rows(spark, sf).select("doc_id", S.route(F.col("path")).alias("parser"))


def validate_file_errors(spark, sf):
    f = file_rows(spark, sf)
    bad = S.validation_error(F.col("path"), F.col("length"), F.col("doc_id") % 19 != 2, F.col("doc_id") % 23 != 4)
    return f.select("doc_id", bad.alias("error_type"))


def ole_signature_filter(spark, sf):
    d = read(spark, sf, "documents")
    content = F.when(F.col("doc_id") % 5 == 0, F.concat(F.unhex(F.lit(S.OLE_SIGNATURE)), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return d.select("doc_id", content.alias("content")).where(S.is_ole(F.col("content"))).select("doc_id")


def noisy(spark, sf):
    d = read(spark, sf, "documents")
    text = F.concat(F.lit("\r\n  "), F.replace(F.col("text"), F.lit(". "), F.lit(".\u0001 \t \r\n\r\n\r\n\r\n<!-- image -->\n ")), F.lit("\u000c \n\n"))
    return d.select("doc_id", text.alias("text"))


def normalize_text(spark, sf):
    return noisy(spark, sf).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


def marked(spark, sf):
    """Documents of which some have page markers between lines, some nothing but marks."""
    d = read(spark, sf, "documents")
    body = F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n <!-- page: "), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" -->\n")))
    return d.select("doc_id", F.when(F.col("doc_id") % 10 == 4, F.lit("<!-- page: 3 -->\n# | - * = `\n\n---")).otherwise(body).alias("text"))


def meaningful_content(spark, sf):
    return marked(spark, sf).select("doc_id", T.has_meaningful_content(F.col("text")).alias("meaningful"))


def page_marker_strip(spark, sf):
    return marked(spark, sf).select("doc_id", T.strip_page_markers(F.col("text")).alias("text"))


def page_marker_extract(spark, sf):
    rows = marked(spark, sf).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.page_number(F.col("line")).alias("page")).where("page is not null")


def clean_header(spark, sf):
    p = read(spark, sf, "part")
    raw = F.concat(F.lit("**"), "p_name", F.lit("**  `"), "p_brand", F.lit("` __"), "p_type", F.lit("__ ##  "))
    return p.select("p_partkey", T.clean_header(raw).alias("title"))


def table_flags(spark, sf):
    p = read(spark, sf, "part")
    k = F.col("p_partkey") % 6
    line = F.when(k == 0, F.concat(F.lit("  | "), "p_name", F.lit(" |"))).when(k == 1, "|---|:--:|").when(k == 2, " | --- | ---: | ").when(k == 3, "-----").when(k == 4, "| a-b |").otherwise(F.col("p_name"))
    return p.select("p_partkey", T.is_table_row(line).alias("is_row"), T.is_table_separator(line).alias("is_separator"))


def escape_cell(spark, sf):
    p = read(spark, sf, "part")
    return p.select("p_partkey", T.escape_cell(F.concat(F.lit(" "), "p_name", F.lit(" | "), "p_brand", F.lit(" \n \n"), "p_type", F.lit("\n"))).alias("cell"))


def build_markdown_table(spark, sf):
    n = read(spark, sf, "nation")
    row = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.col("n_nationkey").cast("string"), "n_name", F.lit("more"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.col("n_nationkey").cast("string"))).otherwise(F.array(F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit("|x"))))
    g = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).getField("row").alias("rows"))
    return g.select("n_regionkey", T.build_table(F.array(F.lit("key"), F.lit("name")), F.col("rows")).alias("markdown"))


def ticked(spark, sf):
    d = read(spark, sf, "documents")
    text = F.concat(F.lit("`10` `a1` `#x` b `->`\n```\n`9`\n```\n`# h` `|` "), F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" `the` ")), F.lit(" of "), F.lit(" `(` ")))
    return d.select("doc_id", text.alias("text"))


def inline_code_symbolic(spark, sf):
    return ticked(spark, sf).select("doc_id", M.inline_code(F.col("text"), "symbolic").alias("x")).select("doc_id", "x.text", F.col("x.removed").cast("long").alias("removed"))


def inline_code_all(spark, sf):
    return ticked(spark, sf).select("doc_id", M.inline_code(F.col("text"), "all").alias("x")).select("doc_id", "x.text", F.col("x.removed").cast("long").alias("removed"))


def heading_restore(spark, sf):
    n = F.col("doc_id").cast("string")
    p = read(spark, sf, "documents")
    text = F.concat(
        F.lit("## Title "), n, F.lit("\n\n## Preface\n\n## **1장. A**\n\nx\n\n## 1. First\n\n## Plain "), n, F.lit("\n\n## 2부. Part\n\n## It is so:\n\n## 2장. B\n\n"),
        F.when(F.col("doc_id") % 4 == 0, "# Other\n\n### Third\n\n").otherwise(""), F.lit("## Chapter 3 of\n```\n# code\n```\nend"),
    )
    return p.select("doc_id", M.headings(text).alias("x")).select("doc_id", "x.text", F.col("x.stats")["applied"].cast("long").alias("applied"), F.coalesce(F.col("x.stats")["sections"], F.lit(0)).cast("long").alias("sections"))


def tokenize_fallback(spark, sf):
    d = read(spark, sf, "documents")
    text = F.concat(F.lit("가격 A4-12/b v1.2 "), "text")
    return d.select("doc_id", F.array_join(T.tokenize(text), " ").alias("tokens"))


def token_stats(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("lang", F.explode(T.tokenize(F.col("text"), compose=False)).alias("term")).groupBy("lang").agg(F.count("*").alias("tokens"), F.count_distinct("term").alias("terms"))


def strip_tag(spark, sf):
    d = read(spark, sf, "documents")
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[문서명: "), "source", F.lit(", 섹션: a]\n"))).otherwise(""), "text")
    return d.select("doc_id", T.strip_tag_line(text).alias("text"))


def xml_attr(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.xml_attribute(F.concat(F.lit('<"'), F.col("url"), F.lit('">'))).alias("value"))


def group_label(spark, sf):
    @F.arrow_udf("string")
    def label_of(x: pa.Array) -> pa.Array:
        return pa.array([section_label(v) for v in x.to_pylist()], pa.string())

    k = F.col("doc_id") % 6
    a = lambda *xs: F.array(*(F.lit(x) for x in xs))
    none = F.array().cast("array<string>")
    paths = (
        F.when(k == 0, F.array(a("A"), a("A", "1"), a("A", "2")))
        .when(k == 1, F.array(a("A", "1"), a("A", "2"), a("A", "3"), a("A", "4"), a("A", "5")))
        .when(k == 2, F.array(none))
        .when(k == 3, F.array(none, none))
        .when(k == 4, F.array(a("A"), a("B")))
        .otherwise(F.array(a("A", "1"), a("A", "1")))
    )
    return read(spark, sf, "documents").select("doc_id", label_of(paths).alias("label"))


_MARKED = """marked AS (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN '<!-- page: 3 -->' || chr(10) || '# | - * = `' || chr(10) || chr(10) || '---'
  ELSE replace(text, chr(10), chr(10) || ' <!-- page: ' || (doc_id % 9 + 1) || ' -->' || chr(10)) END AS text FROM documents),
bare AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT regexp_full_match(s, '\\s*<!--\\s*page:\\s*\\d+\\s*-->\\s*')), chr(10)) AS text FROM marked)"""

_NORMAL = r"""WITH a AS (SELECT doc_id, chr(13) || chr(10) || '  ' || replace(text, '. ', '.' || chr(1) || ' ' || chr(9) || ' ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || '<!-- image -->' || chr(10) || chr(160)) || chr(12) || ' ' || chr(10) || chr(10) AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(nfc_normalize(t), '\r\n?', chr(10), 'g') AS t FROM a),
c AS (SELECT doc_id, replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), chr(160), ' ') AS t FROM b),
d AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda s: CASE WHEN regexp_full_match(s, '\s*<!--\s*image\s*-->\s*') THEN '' ELSE rtrim(s, ' ' || chr(9)) END) AS l FROM c),
e AS (SELECT doc_id, regexp_replace(array_to_string(l, chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM d)
SELECT doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS text FROM e"""

_TICKS = r"""WITH RECURSIVE src AS (SELECT doc_id, '`10` `a1` `#x` b `->`' || chr(10) || '```' || chr(10) || '`9`' || chr(10) || '```' || chr(10) || '`# h` `|` ' || replace(replace(text, ' the ', ' `the` '), ' of ', ' `(` ') AS t FROM documents),
cut AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM src)"""

SQL = {
    "doc_id_path_hash": f"WITH {_FILES} SELECT doc_id, substr(sha1(path), 1, 16) AS file_id FROM files",
    "file_sha256": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
    "scan_filter": f"WITH {_FILES} SELECT doc_id, path FROM known WHERE ok AND path NOT LIKE '/data/.%'",
    "route_by_extension": f"WITH {_FILES} SELECT doc_id, CASE WHEN ok THEN CASE suffix WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.xls' THEN 'excel_legacy' ELSE 'excel' END END AS parser FROM known",
    "validate_file_errors": f"WITH {_FILES} SELECT doc_id, CASE WHEN doc_id % 19 = 2 THEN 'ParserError' WHEN doc_id % 23 = 4 OR NOT ok THEN 'UnsupportedFileError' WHEN length = 0 THEN 'EmptyDocumentError' END AS error_type FROM known",
    "ole_signature_filter": "SELECT doc_id FROM documents WHERE doc_id % 5 = 0",
    "normalize_text": _NORMAL,
    "meaningful_content": f"WITH {_MARKED} SELECT doc_id, length(regexp_replace(text, '[#|\\-:*_>\\s`=]', '', 'g')) > 0 AS meaningful FROM bare",
    "page_marker_strip": f"WITH {_MARKED} SELECT doc_id, text FROM bare",
    "page_marker_extract": f"WITH {_MARKED}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM marked) SELECT doc_id, line_no::BIGINT AS line_no, regexp_extract(line, '^\\s*<!--\\s*page:\\s*(\\d+)\\s*-->\\s*$', 1)::INT AS page FROM l WHERE regexp_full_match(line, '\\s*<!--\\s*page:\\s*\\d+\\s*-->\\s*')",
    "clean_header": "SELECT p_partkey, trim(regexp_replace(replace(p_name, '_', '') || ' ' || replace(p_brand, '_', '') || ' ' || replace(p_type, '_', ''), '\\s+', ' ', 'g')) AS title FROM part",
    "table_flags": "SELECT p_partkey, p_partkey % 6 IN (0, 1, 2, 4) AS is_row, p_partkey % 6 IN (1, 2) AS is_separator FROM part",
    "escape_cell": "SELECT p_partkey, p_name || ' \\| ' || p_brand || ' ' || p_type AS cell FROM part",
    "build_markdown_table": "SELECT n_regionkey, '| key | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN '' ELSE n_name || '\\|x' END || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey",
    "inline_code_symbolic": "SELECT doc_id, '10 `a1` `#x` b ->' || chr(10) || '```' || chr(10) || '`9`' || chr(10) || '```' || chr(10) || '`# h` `|` ' || replace(replace(text, ' the ', ' `the` '), ' of ', ' ( ') AS text, (2 + (length(replace(text, ' the ', ' `the` ')) - length(replace(replace(text, ' the ', ' `the` '), ' of ', ''))) / 4)::BIGINT AS removed FROM documents",
    "inline_code_all": "SELECT doc_id, '10 a1 #x b ->' || chr(10) || '```' || chr(10) || '`9`' || chr(10) || '```' || chr(10) || '`# h` `|` ' || replace(text, ' of ', ' ( ') AS text, (4 + (length(text) - length(replace(text, ' the ', ''))) / 5 + (length(replace(text, ' the ', ' `the` ')) - length(replace(replace(text, ' the ', ' `the` '), ' of ', ''))) / 4)::BIGINT AS removed FROM documents",
    "tokenize_fallback": "SELECT doc_id, array_to_string(list_transform(list_concat(regexp_extract_all(t, '[가-힣]+|[A-Za-z0-9]+'), regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9\\-_./]*[A-Za-z0-9]')), lambda x: lower(x)), ' ') AS tokens FROM (SELECT doc_id, nfc_normalize('가격 A4-12/b v1.2 ' || text) AS t FROM documents)",
    "token_stats": "SELECT lang, count(*) AS tokens, count(DISTINCT term) AS terms FROM (SELECT lang, lower(unnest(list_concat(regexp_extract_all(text, '[가-힣]+|[A-Za-z0-9]+'), regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\\-_./]*[A-Za-z0-9]')))) AS term FROM documents) GROUP BY lang",
    "strip_tag": "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents",
    "xml_attr": """SELECT page_id, '&lt;&quot;' || replace(replace(replace(replace(url, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') || '&quot;&gt;' AS value FROM pages""",
    "group_label": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'A (1, 2 포함)' WHEN 1 THEN 'A > 1, 2, 3 외 2개' WHEN 2 THEN '본문' WHEN 3 THEN '본문' WHEN 4 THEN 'A, B' ELSE 'A > 1' END AS label FROM documents",
    "heading_restore": """SELECT doc_id, CASE WHEN flat THEN '# Title ' || doc_id || x || chr(10) || '# Preface' || x || chr(10) || '# 1장. A' || x || chr(10) || 'x' || x || '### 1. First' || x || chr(10) || '## Plain ' || doc_id || x || chr(10) || '**2부. Part**' || x || chr(10) || '**It is so:**' || x || chr(10) || '# 2장. B' || x || chr(10) || '# Chapter 3 of' || x || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || 'end'
  ELSE '## Title ' || doc_id || x || '## Preface' || x || '## **1장. A**' || x || 'x' || x || '## 1. First' || x || '## Plain ' || doc_id || x || '## 2부. Part' || x || '## It is so:' || x || '## 2장. B' || x || '# Other' || x || '### Third' || x || '## Chapter 3 of' || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || 'end' END AS text, flat::INT::BIGINT AS applied, flat::INT::BIGINT AS sections FROM (SELECT doc_id, doc_id % 4 <> 0 AS flat, chr(10) || chr(10) AS x FROM documents)""",
}
QUERIES = {name: globals()[name] for name in SQL}
