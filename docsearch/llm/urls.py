"""URL filter: fixed rules, and a path-template tree for what no rule decides.

Per host, paths are a tree of segments.  Digit runs and long hexadecimal segments become typed wildcards at once.  Then, level
by level from the root, a node with more than ``MAX_CHILDREN`` different segments keeps those with at least its
1 / MAX_CHILDREN-th share of pages and those whose labels (``SMOOTHING`` at least) differ significantly, for so many siblings,
from their siblings', and the others become ``*``.  Below ``LEVELS`` segments a node goes on, at any depth, while it has several
paths and good and bad labels, which more segments could tell apart; under one without the rest becomes ``**``.  Templates
that differ in one segment are merged along their order by purity while neighbours do not differ significantly in
a two-proportion test.  A template is rejected if the purity of its labelled pages, smoothed towards its host's and that towards the
overall purity, is under ``LEAST_PURITY``.  All counts are aggregates with map-side combining; one window
sees ``MAX_CHILDREN`` segments and those that labels told apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsearch.llm.common import materialise, release, small

MAX_CHILDREN, LEVELS, SMOOTHING, LEAST_PURITY, Z = 50, 4, 10.0, 0.5, 1.96
#: The rules (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null and for what has no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    pick = lambda value: reduce(lambda c, r: c.when(fits(r), value(r)), ordered[1:], F.when(fits(ordered[0]), value(ordered[0])))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def typed(path: Column) -> Column:
    """Segments with digit runs and long hexadecimal strings as wildcards."""
    x = F.transform(F.split(path, "/"), lambda s: F.when(s.rlike("^[0-9a-fA-F-]{8,}$") & s.rlike("[0-9]") & s.rlike("[a-fA-F]"), "{x}").otherwise(F.regexp_replace(s, "[0-9]+", "{n}")))
    return F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1)))


def _differ(g: Column, k: Column, g0: Column, k0: Column) -> Column:
    """z of a two-proportion test, g of k against g0 of k0."""
    p = (g + g0 + 1) / (k + k0 + 2)
    return F.abs((g + 0.5) / (k + 1) - (g0 + 0.5) / (k0 + 1)) / F.sqrt(p * (1 - p) * (1 / (k + 1) + 1 / (k0 + 1)))


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, typed, template, n_good, n_labelled, purity) of each typed path; pages: (page_id, host, path)."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.min("quality").alias("quality"))
    rows = pages.join(marks, "page_id", "left").select("host", typed(F.col("path")).alias("typed"), "quality")
    t = rows.groupBy("host", "typed").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"), F.count("quality").alias("labelled"))
    t = materialise(t.withColumn("tpl", F.array().cast("array<string>")).withColumn("open", F.lit(True)), "paths")
    depth = 0
    while True:
        live = F.col("open") & (F.size("typed") > depth)
        if depth >= LEVELS:
            mixed = t.where(live).groupBy("host", "tpl").agg(F.sum("good").alias("g"), F.sum("labelled").alias("k"), F.count("*").alias("paths"))
            mixed = mixed.where((F.col("g") > 0) & (F.col("g") < F.col("k")) & (F.col("paths") > 1)).select("host", "tpl", F.lit(True).alias("mixed"))
            ends = live & F.col("mixed").isNull()
            before, t = t, t.join(mixed, ["host", "tpl"], "left")
            t = materialise(t.select("host", "typed", "n", "good", "labelled", F.when(ends, F.concat("tpl", F.array(F.lit("**")))).otherwise(F.col("tpl")).alias("tpl"), (F.col("open") & ~ends).alias("open")), f"open-{depth}")
            release(before)
        if t.where(live).isEmpty():
            break
        kids = t.where(live).groupBy("host", "tpl", F.col("typed")[depth].alias("seg")).agg(F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum("labelled").alias("k"))
        fan = kids.groupBy("host", "tpl").agg(F.count("*").alias("fan"), F.sum("n").alias("total"), F.sum("g").alias("gs"), F.sum("k").alias("ks")).where(F.col("fan") > MAX_CHILDREN)
        z = _differ(F.col("g"), F.col("k"), F.col("gs") - F.col("g"), F.col("ks") - F.col("k"))
        apart = (F.col("k") >= SMOOTHING) & (z > F.greatest(F.lit(Z), F.sqrt(2 * F.log(F.col("fan").cast("double")))))
        wild = kids.join(fan, ["host", "tpl"]).where((F.col("n") * MAX_CHILDREN < F.col("total")) & ~apart).select("host", "tpl", "seg", F.lit(True).alias("wild"))
        before, t = t, t.withColumn("seg", F.get("typed", F.lit(depth))).join(wild, ["host", "tpl", "seg"], "left")
        t = t.withColumn("tpl", F.when(live, F.concat("tpl", F.array(F.when(F.col("wild"), "*").otherwise(F.col("seg"))))).otherwise(F.col("tpl"))).drop("seg", "wild")
        t = materialise(t, f"level-{depth}")
        release(before)
        depth += 1
    nodes = t.groupBy("host", F.col("tpl").alias("leaf")).agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled")).withColumn("tpl", F.col("leaf"))
    for d in range(depth):
        # one row for each merged template; its neighbours differ in segment d alone
        merged = nodes.groupBy("host", "tpl").agg(F.sum("good").alias("g"), F.sum("labelled").alias("k"))
        others = F.concat(F.slice("tpl", F.lit(1), F.lit(d)), F.array(F.lit("?")), F.slice("tpl", d + 2, depth + 1))
        merged = merged.where(F.size("tpl") > d).select("host", "tpl", "g", "k", others.alias("others"))
        w = Window.partitionBy("host", "others").orderBy(F.coalesce(F.col("g") / F.nullif("k", F.lit(0)), F.lit(-1.0)), "tpl")
        g0, k0 = F.lag("g").over(w), F.lag("k").over(w)
        z = _differ(F.col("g"), F.col("k"), g0, k0)
        cut = merged.withColumn("new", F.coalesce((z > Z).cast("int"), F.lit(1))).withColumn("cluster", F.sum("new").over(w))
        # a name only; a very long one, which all its templates would carry, is shortened behind its least segments
        to = cut.groupBy("host", "others", "cluster").agg(F.array_sort(F.collect_set(F.col("tpl")[d])).alias("x"))
        to = to.withColumn("to", F.when(F.size("x") > 2 * MAX_CHILDREN, F.concat(F.array_join(F.slice("x", 1, MAX_CHILDREN), "|"), F.lit("|..."))).otherwise(F.array_join("x", "|"))).drop("x")
        named = cut.join(to, ["host", "others", "cluster"]).select("host", "tpl", "to")
        nodes = nodes.join(named, ["host", "tpl"], "left").withColumn("tpl", F.when(F.col("to").isNotNull(), F.concat(F.slice("tpl", F.lit(1), F.lit(d)), F.array("to"), F.slice("tpl", d + 2, depth + 1))).otherwise(F.col("tpl"))).drop("to")
        nodes = materialise(nodes, f"merged-{d}")
    pool = nodes.groupBy("host", "tpl").agg(F.sum("good").alias("n_good"), F.sum("labelled").alias("n_labelled"))
    by_host = nodes.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("labelled").alias("hk"))
    total = nodes.agg(F.sum("good"), F.sum("labelled")).first()
    overall = ((total[0] or 0) + 1) / ((total[1] or 0) + 2)
    prior = (F.col("hg") + SMOOTHING * overall) / (F.col("hk") + SMOOTHING)
    pool = pool.join(by_host, "host").withColumn("purity", (F.col("n_good") + SMOOTHING * prior) / (F.col("n_labelled") + SMOOTHING))
    leaves = nodes.select("host", "leaf", "tpl").join(pool, ["host", "tpl"]).select("host", F.col("leaf").alias("l"), F.concat(F.lit("/"), F.array_join("tpl", "/")).alias("template"), "n_good", "n_labelled", "purity")
    return t.select("host", "typed", F.col("tpl").alias("l")).join(leaves, ["host", "l"]).drop("l")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages; labels: (doc_id, quality) of pages by their id.

    A null url, and one without ``://``, has an empty host and path, which no rule fits.  Null page_ids stay and have no
    label; repeated rows count and are judged as often as they come; a label other than 0 and 1 is none; empty
    tables give an empty result (without labels every template has the overall purity of 0.5, which is kept).
    """
    host, path = parts(F.col("url"))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    bad = materialise(templates(src, labels).where(F.col("purity") < LEAST_PURITY).select("host", "typed", F.lit("block").alias("by_template")), "rejected")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    out = src.withColumn("typed", typed(F.col("path"))).join(small(bad), ["host", "typed"], "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "by_template", F.lit("allow")).alias("verdict"))
