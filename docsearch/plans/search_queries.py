"""Queries of retrieval and answering, with the SQL that gives the same rows.

Fixture: a document is a child chunk, four documents a parent; vectors of the ``embeddings`` table belong to the child of
the same number.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from docsearch.functions.text import strip_tag_line
from docsearch.operators import answer as A
from docsearch.operators import search as R
from docsearch.plans.text_queries import read
from docsearch.staging import stage

_QUESTION = "the nation of reed and thing"


def children(spark, sf):
    d = read(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("child_id"), F.floor(F.col("doc_id") / 4).cast("long").alias("parent_id"), "text", "lang", "source")


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("child_id"), F.col("embedding").alias("vector"), "label")


def asked(spark, sf, every=False):
    """Queries: one for each benchmark item with its text and the vector of its number, or number 0 with the fixed question only."""
    b = read(spark, sf, "benchmark").where(F.lit(every) | (F.col("item_id") == 0)).select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") == 0, _QUESTION).otherwise(F.col("text")).alias("text"))
    v = vectors(spark, sf).select(F.col("child_id").alias("query_id"), "vector")
    return b.join(v, "query_id")


def _round(df, *keep):
    return df.select("query_id", *keep, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _statistics(spark, sf):
    """(postings, term weights, totals): the texts are read and tokenised once, as in an index."""
    c = children(spark, sf)
    post = stage(R.postings(c, compose=False))
    stats = R.totals(post, c)
    return post, R.term_weights(R.frequencies(post), stats), stats


def _sparse(spark, sf, every=False, k=20, where=None):
    return R.sparse(asked(spark, sf, every), *_statistics(spark, sf), k, where, children(spark, sf), compose=False)


def _fused(spark, sf, every=False):
    return R.fuse(R.dense(asked(spark, sf, every), vectors(spark, sf)), _sparse(spark, sf, every))


def bm25_stats(spark, sf):
    _, terms, _ = _statistics(spark, sf)
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf):
    return _round(_sparse(spark, sf), "child_id")


def bm25_where(spark, sf):
    return _round(_sparse(spark, sf, True, where={"lang": "en", "source": "src1"}), "child_id")


def dense_topk(spark, sf):
    return _round(R.dense(asked(spark, sf), vectors(spark, sf)), "child_id")


def dense_topk_where(spark, sf):
    return _round(R.dense(asked(spark, sf, True), vectors(spark, sf), 5, {"label": 3}), "child_id")


def dense_batch(spark, sf):
    return _round(R.dense(asked(spark, sf, True), vectors(spark, sf), 3), "child_id")


def rrf_fuse(spark, sf):
    f = _fused(spark, sf, True)
    return f.select("query_id", "child_id", F.round("score", 9).alias("score"), F.col("ord").cast("long").alias("ord"), R.retriever_csv(F.col("retrievers")).alias("retrievers"))


def _keyword_score(text):
    return F.when(text.contains("reed"), 0.9).otherwise(0.2)


def rerank_keyword(spark, sf):
    texts = _fused(spark, sf, True).join(children(spark, sf).select("child_id", "text"), "child_id")
    r = R.rerank(texts, _keyword_score(F.col("text")), 10)
    return r.select("query_id", "child_id", "score", F.col("ord").cast("long").alias("ord"), R.retriever_csv(F.col("retrievers")).alias("retrievers"))


def _promoted(spark, sf, every=False, **options):
    return R.promote(_fused(spark, sf, every), children(spark, sf).select("child_id", "parent_id"), **options)


def parent_max(spark, sf):
    p = _promoted(spark, sf, True)
    return p.select("query_id", "parent_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"), F.array_join(F.col("children").cast("array<string>"), ",").alias("children"), R.retriever_csv(F.col("retrievers")).alias("retrievers"))


def parent_min_score(spark, sf):
    texts = _fused(spark, sf, True).join(children(spark, sf).select("child_id", "text"), "child_id")
    p = R.promote(R.rerank(texts, _keyword_score(F.col("text"))), children(spark, sf).select("child_id", "parent_id"), 8, 0.5)
    return p.select("query_id", "parent_id", "score", F.col("rank").cast("long").alias("rank"))


def hybrid_e2e(spark, sf):
    """Flagship: from a question to the content of its best parents."""
    promoted = stage(_promoted(spark, sf))  # a few rows; only their parents' texts are put together
    parents = children(spark, sf).join(F.broadcast(promoted.select("parent_id").distinct()), "parent_id", "left_semi").groupBy("parent_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("child_id", "text"))).getField("text"), "\n\n").alias("content"))
    found, _ = R.with_parents(promoted, parents)
    return found.select("query_id", "parent_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"), F.md5("content").alias("content_md5"))


def hybrid_batch(spark, sf):
    p = _promoted(spark, sf, True, top_n=3)
    return p.select("query_id", "parent_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def retrievers_csv(spark, sf):
    return _fused(spark, sf, True).groupBy("query_id", R.retriever_csv(F.col("retrievers")).alias("retrievers")).agg(F.count("*").alias("hits"))


def context_rows(spark, sf):
    """A question for every ten documents, which are its parents in order of their number."""
    d = read(spark, sf, "documents")
    question = F.floor(F.col("doc_id") / 10).cast("long")
    row = F.row_number().over(Window.partitionBy(question).orderBy("doc_id"))
    tagged = F.concat(F.lit("[문서명: "), "source", F.lit(", 섹션: s]\n"), "text")
    return d.select(question.alias("query_id"), row.alias("rank"), F.col("doc_id").alias("parent_id"), F.concat("source", F.lit('<"&>')).alias("source"), F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("section"), F.when(F.col("doc_id") % 2 == 0, F.lit("3-4")).alias("pages"), F.col("source").alias("source_path"), tagged.alias("content"))


def context_budget(spark, sf):
    c = A.contexts(context_rows(spark, sf), 9000)
    return c.select("query_id", F.explode("citations").alias("c")).select("query_id", F.col("c.index").cast("long").alias("number"), "c.parent_id")


def context_xml(spark, sf):
    return A.contexts(context_rows(spark, sf), 9000).select("query_id", "xml", F.size("left_out").cast("long").alias("left_out"))


def user_message(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", A.user_message(F.concat(F.lit("<documents>\n"), F.col("item_id").cast("string"), F.lit("\n</documents>")), F.col("text")).alias("message"))


def answers(spark, sf):
    """Assistant turns with citations put in: good ones, mixed ones, and ones of nothing."""
    c = read(spark, sf, "conversations").where("role = 'assistant'")
    k = F.col("conv_id") % 5
    tail = F.when(k == 0, " a [1] b [9].").when(k == 1, " x [2, 9] y [3，1] z [2024].").when(k == 2, " [3][3][1]").when(k == 3, "").otherwise("  [7] \t[8].")
    text = F.when((k == 3) & (F.col("turn") % 4 == 3), F.lit(A.NO_ANSWER)).otherwise(F.concat(F.regexp_replace("text", r"\s+", " "), tail))
    return c.select("conv_id", "turn", text.alias("text"))


def citation_validate(spark, sf):
    a = answers(spark, sf).select("conv_id", "turn", A.cited(F.col("text"), F.lit(3)).alias("c"))
    return a.select("conv_id", "turn", "c.text", F.array_join(F.col("c.valid").cast("array<string>"), ",").alias("valid"), F.array_join(F.transform("c.invalid", lambda x: x.cast("string")), ",").alias("invalid"))


def grounded_flags(spark, sf):
    a = answers(spark, sf).select("conv_id", "turn", A.cited(F.col("text"), F.lit(3)).alias("c")).select("conv_id", "turn", A.verdict(F.col("c.text"), F.col("c.valid")).alias("v"))
    return a.select("conv_id", "turn", "v.grounded", "v.uncited", F.array_join(F.col("v.citations").cast("array<string>"), ",").alias("citations"))


def citation_format(spark, sf):
    d = read(spark, sf, "documents")
    label = A.citation_label((F.col("doc_id") % 7 + 1).cast("int"), F.col("source"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.lit("1-2")))
    return d.select("doc_id", label.alias("label"))


def answer_format(spark, sf):
    """Assistant turns with citations and warnings below them, as an answer shows them."""

    @F.arrow_udf("string")
    def shown(text: pa.Array, citations: pa.Array, warnings: pa.Array) -> pa.Array:
        return pa.array([A.formatted(*x) for x in zip(text.to_pylist(), citations.to_pylist(), warnings.to_pylist(), strict=True)], pa.string())

    c = read(spark, sf, "conversations").where("role = 'assistant'")
    k = (F.col("conv_id") % 3).cast("int")
    label = A.citation_label(F.lit(1), F.concat(F.lit("f"), F.col("conv_id").cast("string")), F.when(k == 2, F.lit("s")), F.when(k == 2, F.lit("3")))
    some = lambda x, n: F.array_repeat(x, n)
    return c.select("conv_id", "turn", F.md5(shown(F.coalesce("text", F.lit("")), some(label, k), some(F.lit("w"), (F.col("turn") % 2 + k % 2).cast("int") - F.lit(1)))).alias("text_md5"))


def tag_bodies(spark, sf):
    return context_rows(spark, sf).select("parent_id", F.length(strip_tag_line(F.col("content"))).cast("long").alias("chars"))


_TOKENS = "list_transform(list_concat(regexp_extract_all(text, '[가-힣]+|[A-Za-z0-9]+'), regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\\-_./]*[A-Za-z0-9]')), lambda x: lower(x))"
_BM25 = f"""kids AS (SELECT doc_id AS child_id, doc_id // 4 AS parent_id, text, lang, source, {_TOKENS} AS ts FROM documents),
post AS (SELECT child_id, term, count(*) AS tf FROM (SELECT child_id, unnest(ts) AS term FROM kids) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM kids),
raws AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, stats GROUP BY term),
weights AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws),
questions AS (SELECT item_id AS query_id, CASE WHEN item_id = 0 THEN '{_QUESTION}' ELSE text END AS text FROM benchmark WHERE %s),
terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS}) AS term FROM questions) GROUP BY ALL),
scored AS (SELECT query_id, child_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))), 9) AS score FROM terms JOIN post USING (term) JOIN weights USING (term) JOIN kids USING (child_id), stats GROUP BY ALL HAVING round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))), 9) > 0),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM scored QUALIFY rank <= 20)"""
_DENSE = """near AS (SELECT q.vec_id AS query_id, v.vec_id AS child_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings v, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark WHERE %s) %s),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM near QUALIFY rank <= %d)"""
_FUSED = "fused AS (SELECT query_id, child_id, sum(0.5 / (60 + rank)) AS score, min(rank + shift) AS ord, string_agg(name, ',' ORDER BY name) AS retrievers FROM (SELECT query_id, child_id, rank, 0 AS shift, 'dense' AS name FROM dense UNION ALL SELECT query_id, child_id, rank, 20, 'sparse' FROM sparse) GROUP BY ALL)"

_ONE, _ALL = "item_id = 0", "true"


def _hybrid(n):
    return f"WITH {_BM25 % n}, {_DENSE % (n, '', 20)}, {_FUSED}"


_PARENTS = "best AS (SELECT query_id, parent_id, max(f.score) AS score, min(ord) FILTER (ord IS NOT NULL) AS o, string_agg(child_id, ',' ORDER BY f.score DESC, ord) AS children, list(retrievers ORDER BY f.score DESC, ord) AS rs, arg_min(ord, (-f.score, ord)) AS first FROM fused f JOIN kids USING (child_id) GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM best)"

_CONTEXT = """WITH RECURSIVE c AS (SELECT doc_id // 10 AS query_id, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS rank, doc_id AS parent_id, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents),
f AS (SELECT query_id, 1::BIGINT AS rank, length(body)::BIGINT AS used, 1::BIGINT AS n, 1::BIGINT AS number FROM c WHERE rank = 1
UNION ALL SELECT c.query_id, c.rank, CASE WHEN used + length(body) <= 9000 THEN used + length(body) ELSE used END, CASE WHEN used + length(body) <= 9000 THEN n + 1 ELSE n END, CASE WHEN used + length(body) <= 9000 THEN n + 1 END FROM f JOIN c ON c.query_id = f.query_id AND c.rank = f.rank + 1)"""

_ANSWERS = f"""a AS (SELECT conv_id, turn, conv_id % 5 AS k, conv_id % 5 = 3 AND turn % 4 = 3 AS none, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'assistant')"""

SQL = {
    "bm25_stats": f"WITH {_BM25 % _ONE} SELECT term, df, round(idf, 6) AS idf FROM weights",
    "bm25_topk": f"WITH {_BM25 % _ONE} SELECT query_id, child_id, round(score, 6) AS score, rank FROM sparse",
    "bm25_where": f"WITH {_BM25 % _ALL} SELECT query_id, child_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM scored JOIN kids USING (child_id) WHERE lang = 'en' AND source = 'src1' QUALIFY rank <= 20",
    "dense_topk": f"WITH {_DENSE % (_ONE, '', 20)} SELECT query_id, child_id, round(score, 6) AS score, rank FROM dense",
    "dense_topk_where": f"WITH {_DENSE % (_ALL, 'AND v.label = 3', 5)} SELECT query_id, child_id, round(score, 6) AS score, rank FROM dense",
    "dense_batch": f"WITH {_DENSE % (_ALL, '', 3)} SELECT query_id, child_id, round(score, 6) AS score, rank FROM dense",
    "rrf_fuse": f"{_hybrid(_ALL)} SELECT query_id, child_id, round(score, 9) AS score, ord, retrievers FROM fused",
    "rerank_keyword": f"{_hybrid(_ALL)} SELECT query_id, child_id, CASE WHEN contains(text, 'reed') THEN 0.9 ELSE 0.2 END::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY fused.score DESC, fused.ord) AS ord, retrievers || ',rerank' AS retrievers FROM fused JOIN kids USING (child_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused.score DESC, fused.ord) <= 10",
    "parent_max": f"{_hybrid(_ALL)}, {_PARENTS} SELECT query_id, parent_id, round(score, 9) AS score, rank, children, array_to_string(list_distinct_ordered, ',') AS retrievers FROM (SELECT *, list_filter(string_split(array_to_string(rs, ','), ','), lambda x, i: list_position(string_split(array_to_string(rs, ','), ','), x) = i) AS list_distinct_ordered FROM ranked) WHERE rank <= 5",
    "parent_min_score": f"{_hybrid(_ALL)}, r AS (SELECT parent_id, query_id, CASE WHEN contains(text, 'reed') THEN 0.9 ELSE 0.2 END::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY fused.score DESC, fused.ord) AS ord FROM fused JOIN kids USING (child_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused.score DESC, fused.ord) <= 40), b AS (SELECT query_id, parent_id, max(score) AS score, arg_min(ord, (-score, ord)) AS first FROM r GROUP BY ALL) SELECT query_id, parent_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM b QUALIFY rank <= 8 AND score >= 0.5",
    "hybrid_e2e": f"{_hybrid(_ONE)}, {_PARENTS}, bodies AS (SELECT parent_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY child_id)) AS content_md5 FROM kids GROUP BY ALL) SELECT query_id, parent_id, round(score, 9) AS score, rank, content_md5 FROM ranked JOIN bodies USING (parent_id) WHERE rank <= 5",
    "hybrid_batch": f"{_hybrid(_ALL)}, {_PARENTS} SELECT query_id, parent_id, round(score, 9) AS score, rank FROM ranked WHERE rank <= 3",
    "retrievers_csv": f"{_hybrid(_ALL)} SELECT query_id, retrievers, count(*) AS hits FROM fused GROUP BY ALL",
    "context_budget": f"{_CONTEXT} SELECT query_id, number, parent_id FROM f JOIN c USING (query_id, rank) WHERE number IS NOT NULL",
    "context_xml": f"""{_CONTEXT} SELECT query_id, '<documents>' || chr(10) || string_agg('<document index="' || number || '" source="' || source || '&lt;&quot;&amp;&gt;" section="S' || parent_id || '"' || CASE parent_id % 2 WHEN 0 THEN ' pages="3-4"' ELSE '' END || '>' || chr(10) || body || chr(10) || '</document>', chr(10) ORDER BY rank) FILTER (number IS NOT NULL) || chr(10) || '</documents>' AS xml, count(*) FILTER (number IS NULL) AS left_out FROM f JOIN c USING (query_id, rank) GROUP BY query_id""",
    "user_message": "SELECT item_id, '<documents>' || chr(10) || item_id || chr(10) || '</documents>' || chr(10) || chr(10) || '질문: ' || text AS message FROM benchmark",
    "citation_validate": f"WITH {_ANSWERS} SELECT conv_id, turn, CASE WHEN none THEN '{A.NO_ANSWER}' ELSE t || CASE k WHEN 0 THEN ' a [1] b.' WHEN 1 THEN ' x [2] y [3][1] z.' WHEN 2 THEN ' [3][3][1]' WHEN 3 THEN '' ELSE '.' END END AS text, CASE k WHEN 0 THEN '1' WHEN 1 THEN '2,3,1' WHEN 2 THEN '3,1' ELSE '' END AS valid, CASE k WHEN 0 THEN '9' WHEN 1 THEN '9,2024' WHEN 4 THEN '7,8' ELSE '' END AS invalid FROM a",
    "grounded_flags": f"WITH {_ANSWERS} SELECT conv_id, turn, k IN (0, 1, 2) AS grounded, k IN (3, 4) AND NOT none AS uncited, CASE k WHEN 0 THEN '1' WHEN 1 THEN '1,2,3' WHEN 2 THEN '1,3' ELSE '' END AS citations FROM a",
    "citation_format": "SELECT doc_id, '[' || (doc_id % 7 + 1) || '] ' || source || CASE WHEN doc_id % 3 > 0 THEN ' | ' || lang ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' | p.1-2' ELSE '' END AS label FROM documents",
    "answer_format": """SELECT conv_id, turn, md5(coalesce(text, '') || CASE conv_id % 3 WHEN 0 THEN '' ELSE chr(10) || chr(10) || '참고 문서' || repeat(chr(10) || '- [1] f' || conv_id || CASE conv_id % 3 WHEN 2 THEN ' | s | p.3' ELSE '' END, (conv_id % 3)::INT) END || CASE WHEN turn % 2 + conv_id % 3 % 2 > 1 THEN chr(10) || chr(10) || '경고' || chr(10) || '- w' ELSE '' END) AS text_md5 FROM conversations WHERE role = 'assistant'""",
    "tag_bodies": "SELECT doc_id AS parent_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS chars FROM documents",
}
QUERIES = {name: globals()[name] for name in SQL}
