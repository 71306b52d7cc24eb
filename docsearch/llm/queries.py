"""The operators' queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docsearch.llm import bpe, chat, decontam, hmm, html, neardup, quality, repeats, urls, warc
from docsearch.llm.common import table


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of a public tokenizer; read on the driver and sent to the executors."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer()
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, pattern)


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(chat.example(spark)))


def op6_nb_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repetition(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_distinct_word_bpe": op1_distinct_word_bpe,
    "op2_warc_salvage": op2_warc_salvage,
    "op3_hidden_markov": op3_hidden_markov,
    "op4_template_decontamination": op4_template_decontamination,
    "op5_budgeted_windows": op5_budgeted_windows,
    "op6_nb_support_vectors": op6_nb_support_vectors,
    "op7_site_style_tree": op7_site_style_tree,
    "op8_path_templates": op8_path_templates,
    "op9_suffix_repetition": op9_suffix_repetition,
    "op10_signature_join": op10_signature_join,
    "pipeline": pipeline,
}

_WORDS = "list_filter(regexp_split_to_array(coalesce(%s, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB SQL for what SQL can express: plain versions, quadratic where the operators are not.
SQL: dict[str, str] = {
    "op2_warc_salvage": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h || '0', (5 * i) // 4 + 1, 2))::INT >> (3 - (5 * i) % 4)) & 31) + 1, 1)), '') AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, 0::BIGINT AS n_gaps FROM q""",
    "op9_suffix_repetition": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS % "text"} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, (VALUES (3), ({repeats.MIN_REPEAT}), ({repeats.LONGEST + 1})) AS n(k) WHERE len(w) >= k),
r AS (SELECT doc_id, k, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k, array_to_string(w[i:i + k - 1], ' ')) > 1),
c AS (SELECT doc_id, k, count(DISTINCT p) AS n FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM r) GROUP BY ALL),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
coalesce(sum(n) FILTER (k = 3), 0)::BIGINT AS n_repeat_words, coalesce(sum(n) FILTER (k = {repeats.MIN_REPEAT}), 0) AS covered, coalesce(sum(n) FILTER (k = {repeats.LONGEST + 1}), 0) AS long FROM d LEFT JOIN c USING (doc_id) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {repeats.MIN_WORDS} OR 100 * n_repeat_words > {repeats.MOST_REPEATED} * n_words AS base_failed,
NOT (n_words < {repeats.MIN_WORDS} OR 100 * n_repeat_words > {repeats.MOST_REPEATED} * n_words) AND covered <= {repeats.MOST_COVERED} * n_words AND long = 0 AS kept FROM m""",
    "op10_signature_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS % _LOWERED} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
u AS (SELECT doc_id, unnest(g) AS x, len(g) AS n FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, c AS component_id, c = s.doc_id AS kept FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = s.doc_id""",
}
