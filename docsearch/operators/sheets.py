"""Spreadsheets as long tables of cells, turned into Markdown by joins, windows and aggregates.

cells: (doc, sheet, r, c, v) with 0-based rows and columns and text values; merges: (doc, sheet, r1, c1, r2, c2), inclusive.
A sheet is keyed by (doc, sheet), so many workbooks are one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsearch.functions.text import build_table, squeeze
from docsearch.staging import stage

KEY = ["doc", "sheet"]


def cell_text(kind: Column, text: Column, number: Column, moment: Column, number_format: Column) -> Column:
    """The text of a typed cell; kind: string, bool, number, datetime, date, time or null.

    Percentages follow the number format; whole numbers lose their fraction, others are rounded to ten places.
    """
    hundred = number * 100
    whole = lambda x: x == F.floor(x)
    plain = lambda x, places: F.regexp_replace(F.regexp_replace(F.round(x, places).cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    percent = F.coalesce(number_format.contains("%"), F.lit(False))
    midnight = F.date_format(moment, "HH:mm:ss") == "00:00:00"
    return (
        F.when(kind == "bool", F.when(number != 0, "TRUE").otherwise("FALSE"))
        .when((kind == "date") | ((kind == "datetime") & midnight), F.date_format(moment, "yyyy-MM-dd"))
        .when(kind == "datetime", F.date_format(moment, "yyyy-MM-dd HH:mm"))
        .when(kind == "time", F.date_format(moment, "HH:mm"))
        .when((kind == "number") & F.isnan(number), "")
        .when((kind == "number") & percent & whole(hundred.cast("decimal(30,6)")), F.concat(hundred.cast("decimal(30,0)").cast("string"), F.lit("%")))
        .when((kind == "number") & percent, F.concat(plain(hundred, 4), F.lit("%")))
        .when((kind == "number") & whole(number), number.cast("decimal(38,0)").cast("string"))
        .when(kind == "number", plain(number, 10))
        .when(kind == "string", squeeze(text))
        .otherwise("")
    )


def fill_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Every cell of a merged range gets the value of its top left one.

    A range is exploded into its cells, which makes an equi-join of what would be a range join.
    """
    spread = merges.select(*KEY, F.col("r1"), F.col("c1"), F.explode(F.sequence("r1", "r2")).alias("r"), "c2").select(*KEY, "r1", "c1", "r", F.explode(F.sequence("c1", "c2")).alias("c"))
    first = cells.select(*KEY, F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("v").alias("top"))
    values = spread.join(first, [*KEY, "r1", "c1"], "left").groupBy(*KEY, "r", "c").agg(F.max(F.coalesce("top", F.lit(""))).alias("top"), F.lit(True).alias("merged"))
    both = cells.join(values, [*KEY, "r", "c"], "full")
    return both.select(*KEY, "r", "c", F.when(F.col("merged"), F.col("top")).otherwise(F.coalesce("v", F.lit(""))).alias("v"))


def trim_empty(cells: DataFrame) -> DataFrame:
    """Cells without the empty rows and columns of their sheet, numbered anew; ``row`` keeps the sheet's own row number (from 1), ``column`` its column (from 0)."""
    full = cells.where("v <> ''")
    rows, cols = full.select(*KEY, "r").distinct(), full.select(*KEY, "c").distinct()
    rows = rows.withColumn("nr", F.row_number().over(Window.partitionBy(*KEY).orderBy("r")) - 1)
    cols = cols.withColumn("nc", F.row_number().over(Window.partitionBy(*KEY).orderBy("c")) - 1)
    grid = rows.join(cols, KEY)
    out = grid.join(cells, [*KEY, "r", "c"], "left")
    return out.select(*KEY, F.col("nr").alias("r"), F.col("nc").alias("c"), F.coalesce("v", F.lit("")).alias("v"), (F.col("r") + 1).alias("row"), F.col("c").alias("column"))


def title_rows(cells: DataFrame, most: int = 3) -> DataFrame:
    """(doc, sheet, titles): how many leading rows hold one distinct value only, on sheets of several columns and rows."""
    per = cells.groupBy(*KEY, "r").agg(F.count_distinct(F.nullif("v", F.lit(""))).alias("kinds"))
    shape = cells.groupBy(*KEY).agg((F.max("r") + 1).alias("n"), (F.max("c") + 1).alias("width"))
    first = per.where("kinds <> 1").groupBy(*KEY).agg(F.min("r").alias("stop"))
    run = F.least(F.coalesce("stop", F.col("n")), F.lit(most), F.col("n") - 1)
    return shape.join(first, KEY, "left").select(*KEY, F.when(F.col("width") > 1, run).otherwise(0).cast("int").alias("titles"))


def header_rows(cells: DataFrame, merges: DataFrame, most: int = 3) -> DataFrame:
    """(doc, sheet, headers): one header row, and one more as long as the last has a horizontal merge over different full cells."""
    shape = cells.groupBy(*KEY).agg((F.max("r") + 1).alias("n"))
    wide = merges.where("r1 = r2 and c2 > c1").select(*KEY, F.col("r1").alias("level"), "c1", "c2")
    below = wide.join(cells.select(*KEY, (F.col("r") - 1).alias("level"), "c", "v"), [*KEY, "level"]).where("c between c1 and c2")
    opens = below.groupBy(*KEY, "level", "c1", "c2").agg(F.min(F.length("v")).alias("least"), F.count_distinct("v").alias("kinds"), F.count("*").alias("cells")).where("least > 0 and kinds > 1 and cells = c2 - c1 + 1")
    levels = opens.groupBy(*KEY).agg(F.collect_set("level").alias("levels"))
    depth = F.aggregate(F.sequence(F.lit(0), F.lit(most - 2)), F.lit(1), lambda d, k: F.when((d == k + 1) & (d < F.least(F.lit(most), F.col("n") - 1)) & F.array_contains("levels", k), d + 1).otherwise(d))
    return shape.join(levels, KEY, "left").select(*KEY, F.when(F.col("levels").isNull(), 1).otherwise(depth).cast("int").alias("headers"))


def flatten_headers(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc, sheet, c, name): the header levels of a column joined by ``_``; empty ones get a number, repeated ones a count."""
    head = cells.join(headers, KEY).where("r < headers").groupBy(*KEY, "c").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("levels"))
    parts = F.aggregate(F.transform("levels", lambda x: x["v"]), F.array().cast("array<string>"), lambda a, v: F.when((v == "") | (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) == v), a).otherwise(F.concat(a, F.array(v))))
    named = head.select(*KEY, "c", F.coalesce(F.nullif(F.array_join(parts, "_"), F.lit("")), F.concat(F.lit("열"), (F.col("c") + 1).cast("string"))).alias("base"))
    k = F.row_number().over(Window.partitionBy(*KEY, "base").orderBy("c"))
    return named.withColumn("k", k).select(*KEY, "c", F.when(F.col("k") > 1, F.concat("base", F.lit("_"), F.col("k").cast("string"))).otherwise(F.col("base")).alias("name"))


def narrative(cells: DataFrame, names: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc, sheet, text): ``[행N] name: value, ...`` for each body row with values, rows apart by a blank line."""
    body = cells.join(headers, KEY).where("r >= headers and v <> ''").join(names, [*KEY, "c"])
    line = body.groupBy(*KEY, "r", "row").agg(F.array_sort(F.collect_list(F.struct("c", F.concat("name", F.lit(": "), "v").alias("x")))).alias("xs"))
    line = line.select(*KEY, F.struct("r", F.concat(F.lit("[행"), F.col("row").cast("string"), F.lit("] "), F.array_join(F.col("xs.x"), ", ")).alias("x")).alias("x"))
    return line.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list("x")).getField("x"), "\n\n").alias("text"))


def markdown_table(cells: DataFrame, names: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc, sheet, text): the body as a Markdown table under the flattened header."""
    head = names.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("c", "name"))).getField("name").alias("head"))
    body = cells.join(headers, KEY).where("r >= headers").groupBy(*KEY, "r").agg(F.array_sort(F.collect_list(F.struct("c", F.regexp_replace("v", " +", " ").alias("v")))).getField("v").alias("vs"))
    rows = body.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("r", "vs"))).getField("vs").alias("rows"))
    empty = F.array().cast("array<array<string>>")
    return head.join(rows, KEY, "left").select(*KEY, build_table(F.col("head"), F.coalesce("rows", empty)).alias("text"))


def sheet_markdown(cells: DataFrame, merges: DataFrame, force_narrative: bool = False, most_headers: int = 3) -> DataFrame:
    """(doc, sheet, mode, text) of each sheet with values: a table where it is simple, else one sentence for each row.

    Title rows become paragraphs before it; merges that reach into the body, several header rows or the setting
    make it narrative; a sheet of headers only is their list.  Intermediate tables are staged.
    """
    grid = stage(trim_empty(fill_merges(cells, merges)))
    rows = grid.select(*KEY, "r", (F.col("row") - 1).alias("old")).distinct()
    cols = grid.select(*KEY, F.col("column").alias("old"), "c").distinct()
    kept = stage(_moved(merges, rows, cols))
    titles = title_rows(grid)
    body = grid.join(titles, KEY)
    lead = body.where("r < titles and v <> ''").groupBy(*KEY, "r").agg(F.first("v").alias("v")).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("r", "v"))).getField("v").alias("lead"))
    body = stage(body.where("r >= titles").select(*KEY, (F.col("r") - F.col("titles")).alias("r"), "c", "v", "row"))
    kept = kept.join(titles, KEY).select(*KEY, *((F.col(x) - F.col("titles") if x[0] == "r" else F.col(x)).alias(x) for x in ("r1", "c1", "r2", "c2"))).where("r2 >= 0")
    headers = stage(header_rows(body, kept, most_headers))
    names = stage(flatten_headers(body, headers))
    reach = kept.join(headers, KEY).groupBy(*KEY).agg(F.max(F.col("r2") - F.col("headers")).alias("reach"))
    shape = body.groupBy(*KEY).agg((F.max("r") + 1).alias("n")).join(headers, KEY).join(reach, KEY, "left")
    only = names.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list(F.struct("c", "name"))).getField("name"), ", ").alias("only"))
    told = F.lit(force_narrative) | (F.col("headers") > 1) | F.coalesce(F.col("reach") >= 0, F.lit(False))
    out = shape.join(only, KEY).join(narrative(body, names, headers).withColumnRenamed("text", "told"), KEY, "left").join(markdown_table(body, names, headers).withColumnRenamed("text", "drawn"), KEY, "left").join(lead, KEY, "left")
    text = F.when(F.col("n") <= F.col("headers"), F.col("only")).when(told, F.coalesce("told", F.lit(""))).otherwise(F.col("drawn"))
    parts = F.concat(F.coalesce("lead", F.array().cast("array<string>")), F.array(text))
    return out.select(*KEY, F.when(told, "narrative").otherwise("markdown_table").alias("mode"), F.array_join(F.filter(parts, lambda x: x != ""), "\n\n").alias("text"))


def _moved(merges: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Merged ranges in the numbers of the trimmed grid."""
    m = merges.withColumn("id", F.monotonically_increasing_id())
    r = m.join(rows.withColumnRenamed("r", "nr"), KEY).where("old between r1 and r2").groupBy(*KEY, "id").agg(F.min("nr").alias("r1"), F.max("nr").alias("r2"))
    c = m.join(cols.withColumnRenamed("c", "nc"), KEY).where("old between c1 and c2").groupBy(*KEY, "id").agg(F.min("nc").alias("c1"), F.max("nc").alias("c2"))
    return r.join(c, [*KEY, "id"]).select(*KEY, "r1", "c1", "r2", "c2")


def workbook_markdown(sheets: DataFrame) -> DataFrame:
    """(doc, markdown) from (doc, number, sheet, text): a second-level heading and the text of each sheet, in order."""
    part = F.struct("number", F.concat(F.lit("## 시트: "), "sheet", F.lit("\n\n"), "text").alias("x"))
    return sheets.where("text <> ''").groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(part)).getField("x"), "\n\n").alias("markdown"))
