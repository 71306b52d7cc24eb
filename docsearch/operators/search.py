"""Hybrid retrieval: exact vector search, BM25 on posting lists, rank fusion, reranking and parent promotion.

All functions take many queries at once (rows of ``query_id``); one question is a table with one row.  Statistics are
additive, so an index update touches the postings of changed documents only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsearch.functions.text import tokenize

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: A query set is broadcast in blocks of about so many queries at most, and so many of their terms.
MOST_QUERIES, MOST_TERMS = 10_000, 200_000


def where_clause(conditions: dict[str, object] | None, columns: list[str]) -> Column:
    """All conditions as equalities; one on an unknown key holds only where the value asked for is None."""
    tests = [(F.col(k).eqNullSafe(F.lit(v)) if k in columns else F.lit(v is None)) for k, v in (conditions or {}).items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top(scored: DataFrame, k: int, score: str = "score", tie: str = "child_id", rank: str = "rank") -> DataFrame:
    """The k best of each query with their ranks; Spark prunes groups before and after the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def dense(queries: DataFrame, vectors: DataFrame, k: int = 20, where: dict | None = None) -> DataFrame:
    """(query_id, child_id, score, rank): nearest unit vectors by cosine, filtered before the ranking.

    The query set, never the corpus, is sent to every task: counted first, and in blocks by hash where it is large.
    """
    blocks = 1 + 2 * queries.count() // MOST_QUERIES
    rows = vectors.where(where_clause(where, vectors.columns)).select("child_id", "vector")

    def nearest(some: DataFrame) -> DataFrame:
        pairs = rows.join(F.broadcast(some.select("query_id", F.col("vector").alias("q"))), how="cross")
        return top(pairs.select("query_id", "child_id", F.round(dot(F.col("vector"), F.col("q")), 9).alias("score")), k)

    parts = [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) for n in range(blocks)]
    return reduce(DataFrame.unionAll, map(nearest, parts))


def postings(children: DataFrame, text: str = "text", compose: bool = True) -> DataFrame:
    """(term, child_id, tf, dl) from one pass over the texts; dl is the number of the child's tokens, a child without any has no row.

    Texts are shuffled by child before they are cut, as they are smaller than their tokens; the counts need no further shuffle.
    """
    tokens = children.select("child_id", text).repartition("child_id").select("child_id", tokenize(F.col(text), compose).alias("ts"))
    rows = tokens.select("child_id", F.size("ts").cast("long").alias("dl"), F.explode("ts").alias("term"))
    return rows.groupBy("term", "child_id", "dl").agg(F.count("*").alias("tf"))


def frequencies(post: DataFrame) -> DataFrame:
    """(term, df); additive over sets of children."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def totals(post: DataFrame, children: DataFrame) -> DataFrame:
    """One row: n children, token-less ones included, and their tokens; additive as well."""
    n, tokens = children.agg(F.count("*").alias("n")), post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
    return n.join(F.broadcast(tokens), how="cross")  # one row with one row


def term_weights(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) from ``frequencies`` and ``totals``: a negative idf becomes EPSILON times the mean of all raw ones."""
    raw = df.join(F.broadcast(stats.select("n")), how="cross").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), how="cross").select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def sparse(queries: DataFrame, post: DataFrame, terms: DataFrame, stats: DataFrame, k: int = 20, where: dict | None = None, children: DataFrame | None = None, compose: bool = True) -> DataFrame:
    """(query_id, child_id, score, rank) by BM25 from ``postings``, ``term_weights`` and ``totals``.

    Query terms count as often as they come; only their postings are touched, and those are not shuffled before they are
    scored while the query terms are few enough to be sent to every task.  The filter acts on scored children, never on statistics.
    """
    asked = queries.select("query_id", F.explode(tokenize(F.col("text"), compose)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    sent = F.broadcast if asked.count() <= MOST_TERMS else lambda df: df
    weighed = terms.join(sent(asked), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    hits = post.join(sent(weighed), "term").join(F.broadcast(stats.select(F.try_divide("tokens", "n").alias("avgdl"))), how="cross")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # nine places, so that equal scores tie in whatever order they were summed
    scored = hits.groupBy("query_id", "child_id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    if where:
        scored = scored.join(children.where(where_clause(where, children.columns)).select("child_id"), "child_id", "left_semi")
    return top(scored, k)


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, weights: tuple[float, float] = (0.5, 0.5), rrf_k: int = RRF_K, dense_k: int = 20) -> DataFrame:
    """(query_id, child_id, score, ord, retrievers): reciprocal rank fusion; ties go to what came first, dense before sparse."""
    side = lambda hits, name, w, shift: hits.select("query_id", "child_id", F.lit(name).alias("name"), (w / (rrf_k + F.col("rank"))).alias("part"), (F.col("rank") + shift).alias("ord"))
    both = side(dense_hits, "dense", weights[0], 0).unionByName(side(sparse_hits, "sparse", weights[1], dense_k))
    return both.groupBy("query_id", "child_id").agg(F.sum("part").alias("score"), F.min("ord").alias("ord"), F.array_sort(F.collect_set("name")).alias("retrievers"))


def rerank(fused: DataFrame, scorer: Column, candidates: int = 40) -> DataFrame:
    """Scores of the best candidates replaced by a scorer's; the others leave.  The scorer runs on the candidates only."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    best = fused.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= candidates)
    return best.withColumn("score", scorer).withColumn("retrievers", F.concat("retrievers", F.array(F.lit("rerank"))))


def promote(scored: DataFrame, parent_of: DataFrame, top_n: int = 5, min_score: float | None = None) -> DataFrame:
    """(query_id, parent_id, score, rank, children, retrievers): a parent has its best child's score.

    The cut at min_score comes after the limit, so it never lets a worse parent in.
    """
    rows = scored.join(parent_of, "child_id")
    by = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", "child_id", "retrievers")))
    parents = rows.groupBy("query_id", "parent_id").agg(F.max("score").alias("score"), by.alias("hits"))
    parents = parents.withColumn("first", F.element_at("hits", 1)["ord"])
    ranked = parents.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first"))).where(F.col("rank") <= top_n)
    if min_score:
        ranked = ranked.where(F.col("score") >= min_score)
    return ranked.select("query_id", "parent_id", "score", "rank", F.transform("hits", lambda h: h["child_id"]).alias("children"), F.array_distinct(F.flatten(F.transform("hits", lambda h: h["retrievers"]))).alias("retrievers"))


def with_parents(promoted: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found with their content, missing): parents that the store lacks are told apart, not dropped in silence."""
    joined = promoted.join(parents.withColumn("present", F.lit(True)), "parent_id", "left")
    return joined.where("present").drop("present"), joined.where("present is null").select("query_id", "parent_id")


def retriever_csv(x: Column) -> Column:
    return F.array_join(x, ",")
