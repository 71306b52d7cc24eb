"""Queries of the sync, spreadsheet, PDF and DOCX operators, with the SQL that gives the same rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from docsearch.operators import sheets, sync
from docsearch.plans.text_queries import read
from docsearch.sources import pdf
from docsearch.sources.ooxml import heading_level, table_text


def manifests(spark, sf):
    """(files, manifest) of a folder: some files changed, some new, some gone since."""
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("/data/"), "source", F.lit("/f"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    files = d.where("doc_id % 7 <> 1").select("doc_id", "path", F.col("h").alias("file_hash"))
    manifest = d.where("doc_id % 5 <> 2").select("doc_id", "path", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("h")).alias("file_hash"))
    return files, manifest


def manifest_diff(spark, sf):
    return sync.diff(*manifests(spark, sf)).select("doc_id", "status")


def removed_files_anti(spark, sf):
    return sync.removed(*manifests(spark, sf), "/data/src1").select("doc_id", "path")


def ingest_report(spark, sf):
    return sync.report(sync.diff(*manifests(spark, sf)))


def upsert_replace(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return sync.replace(d, d.where("doc_id % 4 = 1").withColumn("n_chars", -F.col("n_chars")), d.where("doc_id % 9 = 2"))


def delete_document(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source")
    return sync.delete(d, d.where("doc_id % 4 = 1"))


def duplicate_child_guard(spark, sf):
    d = read(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("child_id"))
    return sync.duplicate_children(d)


def manifest_children(spark, sf):
    d = read(spark, sf, "documents").groupBy("source").agg(F.collect_list("doc_id").alias("child_ids"))
    return sync.count_children(d)


def grid(spark, sf):
    """A sheet for each brand: parts down, attributes across, with empty rows and columns between."""
    p = read(spark, sf, "part").select("p_brand", "p_partkey", "p_name", "p_size")
    row = F.col("p_partkey") % 50 * 2
    cell = lambda c, v: F.struct(F.lit(c).alias("c"), v.alias("v"))
    cells = p.groupBy("p_brand", row.cast("int").alias("r")).agg(F.min("p_name").alias("n"), F.min("p_size").cast("string").alias("s"))
    return cells.select(F.lit("book").alias("doc"), F.col("p_brand").alias("sheet"), "r", F.explode(F.array(cell(0, F.col("n")), cell(2, F.col("s")), cell(3, F.lit("")))).alias("x")).select("doc", "sheet", "r", "x.c", "x.v")


_GRID = """cells AS (SELECT 'book' AS doc, p_brand AS sheet, (p_partkey % 50 * 2)::INT AS r, min(p_name) AS n, min(p_size)::VARCHAR AS s FROM part GROUP BY ALL)"""


def merge_fill(spark, sf):
    cells = grid(spark, sf)
    merges = cells.where("r % 8 = 0 and c = 0").select("doc", "sheet", F.col("r").alias("r1"), F.lit(0).alias("c1"), (F.col("r") + 1).alias("r2"), F.lit(1).alias("c2"))
    return sheets.fill_merges(cells, merges)


def trim_empty(spark, sf):
    return sheets.trim_empty(grid(spark, sf)).withColumn("row", F.col("row").cast("int")).drop("column")


def title_rows(spark, sf):
    lead = grid(spark, sf).where("c = 0").select("doc", "sheet").distinct()
    top = lead.select("doc", "sheet", F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit("T" if r == 0 else "").alias("v")) for r in (0, 1) for c in (0, 1)))).alias("x")).select("doc", "sheet", "x.*")
    body = grid(spark, sf).where("c in (0, 2)").select("doc", "sheet", (F.col("r") + 2).alias("r"), (F.col("c") / 2).cast("int").alias("c"), "v")
    return sheets.title_rows(top.unionByName(body))


def header_cells(spark, sf):
    """Three columns and two header levels for each region, the first merged over the last two columns."""
    n = read(spark, sf, "nation")
    key = n.select(F.lit("book").alias("doc"), F.col("n_regionkey").cast("string").alias("sheet")).distinct()
    head = [(0, 0, "구분"), (0, 1, "가격"), (0, 2, "가격"), (1, 0, "구분"), (1, 1, "단가"), (1, 2, "합계")]
    top = key.select("doc", "sheet", F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(v).alias("v")) for r, c, v in head))).alias("x")).select("doc", "sheet", "x.*")
    row = (F.rank().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) + 1).alias("r")
    body = n.select(F.lit("book").alias("doc"), F.col("n_regionkey").cast("string").alias("sheet"), row, F.array("n_name", F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise("")).alias("vs"))
    body = body.select("doc", "sheet", "r", F.posexplode("vs").alias("c", "v"))
    merges = key.where("sheet <> '4'").select("doc", "sheet", F.lit(0).alias("r1"), F.lit(1).alias("c1"), F.lit(0).alias("r2"), F.lit(2).alias("c2"))
    return top.unionByName(body), merges


def header_depth(spark, sf):
    return sheets.header_rows(*header_cells(spark, sf))


def flatten_headers(spark, sf):
    cells, merges = header_cells(spark, sf)
    return sheets.flatten_headers(cells, sheets.header_rows(cells, merges))


def narrative_rows(spark, sf):
    cells, merges = header_cells(spark, sf)
    h = sheets.header_rows(cells, merges)
    return sheets.narrative(cells.withColumn("row", F.col("r") + 1), sheets.flatten_headers(cells, h), h)


def excel_markdown_table(spark, sf):
    cells, merges = header_cells(spark, sf)
    h = sheets.header_rows(cells, merges.where("false"))
    return sheets.markdown_table(cells, sheets.flatten_headers(cells, h), h)


def sheet_modes(spark, sf):
    return sheets.sheet_markdown(*header_cells(spark, sf))


def cell_to_str(spark, sf):
    li = read(spark, sf, "lineitem")
    k = F.col("l_orderkey") % 5
    kind = F.when(k == 0, "number").when(k == 1, "number").when(k == 2, "datetime").when(k == 3, "bool").otherwise("string")
    text = sheets.cell_text(kind, F.concat(F.lit(" a \t"), "l_returnflag", F.lit("\n b ")), F.when(k == 0, F.col("l_quantity")).when(k == 1, F.col("l_discount")).otherwise(F.col("l_orderkey") % 2), F.col("l_shipdate").cast("timestamp"), F.when(k == 1, "0.00%").otherwise("General"))
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min(text).alias("cell"))


def pdf_pages(spark, sf):
    """The lines of a document as the pages of a file."""
    return read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("page_no", "text"))


def pdf_preflight(spark, sf):
    """Pages with white space of all kinds around them, which doesn't count."""
    return pdf.preflight(pdf_pages(spark, sf).withColumn("text", F.concat(F.lit("\t\n"), "text", F.lit(" \r\n\n"))))


def pdf_route(spark, sf):
    d = read(spark, sf, "documents")
    r = pdf.pdf_route(F.col("doc_id") % 600, F.lit(1.0), F.col("n_chars") / 20.0, layout=True)
    plain = pdf.pdf_route(F.col("doc_id") % 600, F.lit(1.0), F.col("n_chars") / 20.0, layout=False)
    return d.select("doc_id", r.alias("r"), plain.alias("p")).select("doc_id", "r.reader", "r.reason", "r.error", F.col("p.reason").alias("plain_reason"), F.col("p.error").alias("plain_error"))


def layout_ratio(spark, sf):
    d = read(spark, sf, "documents")
    ok = pdf.enough_text(F.col("text"), F.col("n_chars") * (F.col("doc_id") % 4), F.col("doc_id") % 10 == 0)
    return d.select("doc_id", ok.alias("ok"))


def docx_heading_level(spark, sf):
    """Paragraph styles of documents, by the reader's own rule as an Arrow UDF."""
    @F.arrow_udf("int")
    def level(styles: pa.Array, outline: pa.Array) -> pa.Array:
        return pa.array([heading_level(s, o) for s, o in zip(styles.to_pylist(), outline.to_pylist(), strict=True)], pa.int32())

    style = F.get(F.array(*map(F.lit, ("Title", "heading 2", "제목 3", "Normal", "제목", "Heading9"))), (F.col("doc_id") % 6).cast("int"))
    outline = F.when(F.col("doc_id") % 4 == 1, (F.col("doc_id") % 12).cast("int"))
    return read(spark, sf, "documents").select("doc_id", level(style, outline).alias("level"))


def docx_table_shape(spark, sf):
    """The lines of each order as a table of one to three columns, every fourth row empty, by the reader's own function."""

    @F.arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        return pa.array([table_text(rows) for rows in x.to_pylist()], pa.string())

    li = read(spark, sf, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")))
    cells = F.array(F.col("l_partkey").cast("string"), F.concat("l_returnflag", F.lit("|"), "l_linestatus"), F.when(F.col("n") % 2 == 0, F.lit("")).otherwise(F.col("l_suppkey").cast("string")))
    row = F.slice(F.transform(cells, lambda x: F.when(F.col("n") % 4 == 0, "").otherwise(x)), F.lit(1), (F.col("l_orderkey") % 3 + 1).cast("int"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", row.alias("row")))).getField("row").alias("rows")).select("l_orderkey", text("rows").alias("text"))


SQL = {
    "manifest_diff": "SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'new' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents WHERE doc_id % 7 <> 1",
    "removed_files_anti": "SELECT doc_id, '/data/' || source || '/f' || doc_id AS path FROM documents WHERE doc_id % 7 = 1 AND doc_id % 5 <> 2 AND source = 'src1'",
    "ingest_report": "SELECT CASE WHEN doc_id % 5 = 2 THEN 'new' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status, count(*) AS files FROM documents WHERE doc_id % 7 <> 1 GROUP BY 1",
    "upsert_replace": "SELECT doc_id, source, CASE WHEN doc_id % 4 = 1 THEN -n_chars ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 4 = 1 OR doc_id % 9 <> 2",
    "delete_document": "SELECT doc_id, source FROM documents WHERE doc_id % 4 <> 1",
    "duplicate_child_guard": "SELECT sha256(text) AS child_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "manifest_children": "SELECT count(*) AS children FROM documents",
    "merge_fill": f"WITH {_GRID} SELECT doc, sheet, r, c, CASE WHEN c IN (0, 1) AND r % 8 = 0 THEN n WHEN c = 0 THEN n WHEN c = 2 THEN s ELSE '' END AS v FROM cells, (VALUES (0), (1), (2), (3)) AS k(c) WHERE c <> 1 OR r % 8 = 0 UNION ALL SELECT doc, sheet, r + 1, c, n FROM cells, (VALUES (0), (1)) AS k(c) WHERE r % 8 = 0",
    "trim_empty": f"WITH {_GRID} SELECT doc, sheet, (dense_rank() OVER (PARTITION BY sheet ORDER BY r) - 1)::INT AS r, c, CASE c WHEN 0 THEN n ELSE s END AS v, (r + 1)::INT AS row FROM cells, (VALUES (0), (1)) AS k(c)",
    "title_rows": "SELECT DISTINCT 'book' AS doc, p_brand AS sheet, 1 AS titles FROM part",
    "header_depth": "SELECT DISTINCT 'book' AS doc, n_regionkey::VARCHAR AS sheet, CASE WHEN n_regionkey = 4 THEN 1 ELSE 2 END AS headers FROM nation",
    "flatten_headers": "SELECT DISTINCT 'book' AS doc, n_regionkey::VARCHAR AS sheet, c, CASE WHEN c = 0 THEN '구분' WHEN n_regionkey = 4 THEN CASE c WHEN 1 THEN '가격' ELSE '가격_2' END WHEN c = 1 THEN '가격_단가' ELSE '가격_합계' END AS name FROM nation, (VALUES (0), (1), (2)) AS k(c)",
    "narrative_rows": """WITH b AS (SELECT n_regionkey, n_nationkey, rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 2 AS row, n_name FROM nation),
  l AS (SELECT n_regionkey, row, '[행' || row || '] 구분: ' || n_name || ', 가격' || CASE n_regionkey WHEN 4 THEN '' ELSE '_단가' END || ': ' || n_nationkey || CASE n_nationkey % 2 WHEN 0 THEN ', 가격_' || CASE n_regionkey WHEN 4 THEN '2' ELSE '합계' END || ': x' ELSE '' END AS x FROM b
    UNION ALL SELECT 4, 2, '[행2] 구분: 구분, 가격: 단가, 가격_2: 합계')
  SELECT 'book' AS doc, n_regionkey::VARCHAR AS sheet, string_agg(x, chr(10) || chr(10) ORDER BY row) AS text FROM l GROUP BY n_regionkey""",
    "excel_markdown_table": """SELECT 'book' AS doc, n_regionkey::VARCHAR AS sheet, '| 구분 | 가격 | 가격_2 |' || chr(10) || '|---|---|---|' || chr(10) || '| 구분 | 단가 | 합계 |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' | ' || CASE n_nationkey % 2 WHEN 0 THEN 'x' ELSE '' END || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""",
    "cell_to_str": """SELECT l_orderkey, l_linenumber, min(CASE l_orderkey % 5 WHEN 0 THEN l_quantity::BIGINT::VARCHAR WHEN 1 THEN round(l_discount * 100)::BIGINT || '%' WHEN 2 THEN CASE WHEN l_shipdate::TIME = TIME '00:00:00' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M') END WHEN 3 THEN CASE l_orderkey % 2 WHEN 0 THEN 'FALSE' ELSE 'TRUE' END ELSE 'a ' || l_returnflag || ' b' END) AS cell FROM lineitem GROUP BY ALL""",
    "pdf_preflight": """WITH p AS (SELECT doc_id AS doc, regexp_replace(chr(9) || chr(10) || unnest(string_split(text, chr(10))) || ' ' || chr(13) || chr(10) || chr(10), '^\\s+|\\s+$', '', 'g') AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
  q AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM p), s AS (SELECT *, greatest(n // 10, 1) AS step FROM q)
  SELECT doc, n AS page_count, sum((k % step = 0 AND k / step < 10)::INT)::BIGINT AS sampled_pages, sum(CASE WHEN k % step = 0 AND k / step < 10 THEN length(t) ELSE 0 END)::BIGINT AS sampled_chars, sum(length(t))::BIGINT AS raw_chars,
  sum(CASE WHEN k % step = 0 AND k / step < 10 THEN length(t) ELSE 0 END) / sum((k % step = 0 AND k / step < 10)::INT) AS avg_chars FROM s GROUP BY doc, n""",
    "pdf_route": """SELECT doc_id, CASE WHEN big AND NOT scanned THEN 'fast' ELSE 'layout' END AS reader, CASE WHEN big AND NOT scanned THEN 'large_pdf' WHEN scanned THEN 'scanned_ocr' ELSE 'complex_layout' END AS reason, NULL::VARCHAR AS error,
  CASE WHEN scanned THEN NULL WHEN big THEN 'large_pdf' ELSE 'layout_unavailable' END AS plain_reason, CASE WHEN scanned THEN 'EmptyDocumentError' END AS plain_error FROM (SELECT doc_id, doc_id % 600 > 300 AS big, n_chars / 20.0 < 50 AS scanned FROM documents)""",
    "layout_ratio": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN kept > 0 ELSE kept / greatest(n_chars * (doc_id % 4), 1) >= 0.5 END AS ok FROM (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) AS kept FROM documents)",
    "docx_heading_level": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 9 ELSE CASE WHEN doc_id % 4 = 1 AND doc_id % 12 <= 8 THEN (doc_id % 12 + 1)::INT END END AS level FROM documents",
    "docx_table_shape": """WITH l AS (SELECT *, l_orderkey % 3 + 1 AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS n FROM lineitem),
  c AS (SELECT l_orderkey, w, n, l_partkey::VARCHAR AS a, l_returnflag || '|' || l_linestatus AS b, CASE n % 2 WHEN 0 THEN '' ELSE l_suppkey::VARCHAR END AS c FROM l WHERE n % 4 <> 0),
  r AS (SELECT l_orderkey, w, n, a, '| ' || a || ' | ' || replace(b, '|', '\\|') || CASE w WHEN 3 THEN ' | ' || c ELSE '' END || ' |' AS line, a || ' | ' || b || CASE WHEN w = 3 AND c <> '' THEN ' | ' || c ELSE '' END AS plain FROM c)
  SELECT l_orderkey, CASE WHEN w = 1 THEN string_agg(a, chr(10) || chr(10) ORDER BY n) WHEN count(*) = 1 THEN any_value(plain)
    ELSE min(line) FILTER (n = 1) || chr(10) || '|' || repeat('---|', w) || chr(10) || string_agg(line, chr(10) ORDER BY n) FILTER (n > 1) END AS text FROM r GROUP BY l_orderkey, w""",
}
SQL["sheet_modes"] = f"""SELECT doc, sheet, CASE sheet WHEN '4' THEN 'markdown_table' ELSE 'narrative' END AS mode, CASE sheet WHEN '4' THEN t.text ELSE n.text END AS text
  FROM ({SQL["narrative_rows"]}) n JOIN ({SQL["excel_markdown_table"]}) t USING (doc, sheet)"""
QUERIES = {name: globals()[name] for name in SQL}
