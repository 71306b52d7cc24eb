"""Ingestion of a folder and answers to questions, made of the operators.

Embedding, reranking and language models are injected: an embedder maps an array of texts to vectors within an Arrow UDF, a
scorer maps (question, text) to a number, a client answers a request.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch.config import Config
from docsearch.errors import ConfigError, GenerationError, RetrievalError
from docsearch.index import Index
from docsearch.operators import answer as A
from docsearch.operators import search, sync
from docsearch.operators.chunking import CHUNK_SCHEMA, chunk
from docsearch.sources.files import as_files, contents, scan
from docsearch.sources.parse import parse
from docsearch.staging import stage

Embedder = Callable[[list[str]], list[list[float]]]
_HITS = "query_id int, child_id string, score double, rank int"


def hashed_embedder(size: int = 256) -> Embedder:
    """A deterministic stand-in without a model: hashed character trigrams, as unit vectors."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            s = " ".join(t.lower().split())
            for k in range(max(len(s) - 2, 1)):
                h = xxhash.xxh3_64_intdigest(s[k : k + 3])
                v[h % size] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def self_test(embed: Embedder) -> float:
    """The least cosine of texts embedded alone and in a batch; a device that spoils single items shows here."""
    texts = ["가격은 100원입니다.", "The delivery takes three days.", "규정 제3조 할인"]
    batch = embed(texts)
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / ((math.hypot(*a) * math.hypot(*b)) or 1.0)
    return min(cosine(b, embed([t])[0]) for t, b in zip(texts, batch, strict=True))


def scorer_self_test(spark: SparkSession, scorer: Callable) -> float:
    """The largest difference between scores of pairs in one batch and alone."""
    pairs = [("배송은 며칠 걸리나요?", "The delivery takes three days."), ("할인 규정", "규정 제3조 할인"), ("가격", "날씨가 맑다.")]
    scores = lambda some: [r.score for r in spark.createDataFrame(some, "question string, text string").coalesce(1).select(scorer(F.col("question"), F.col("text")).alias("score")).collect()]
    return max(abs(scores([p])[0] - s) for p, s in zip(pairs, scores(pairs), strict=True))


def sound(models: list, test: Callable, good: Callable[[float], bool], what: str) -> tuple[Any, list[str]]:
    """The first model (the one in use, then a spare one, such as the same on another device) that passes its test, and what to warn of."""
    found = []
    for m in filter(None, models):
        value = test(m)
        if good(value):
            return m, found
        found.append(f"the {what} model gives single items other results than batches ({value:.3f})")
    raise ConfigError("; ".join(found))


def embed_udf(embed: Embedder):
    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(embed([t or "" for t in texts.to_pylist()]), pa.list_(pa.float32()))

    return run


@dataclass
class Report:
    """What became of the files, as a table (path, status, error_type, reason); only the counts are here, names are read when asked for."""

    files: DataFrame

    def __post_init__(self) -> None:
        self.counts = {r.status: r.n for r in self.files.groupBy("status").agg(F.count("*").alias("n")).collect()}

    def _names(self, status: str) -> list[str]:
        return [r.path for r in self.files.where(F.col("status") == status).select("path").orderBy("path").collect()]

    @property
    def indexed(self) -> list[str]:
        return self._names("indexed")

    @property
    def unchanged(self) -> list[str]:
        return self._names("unchanged")

    @property
    def removed(self) -> list[str]:
        return self._names("removed")

    @property
    def failures(self) -> list[tuple[str, str, str]]:
        return [tuple(r) for r in self.files.where("status = 'failed'").select("path", "error_type", "reason").orderBy("path").collect()]

    def summary(self) -> str:
        return ", ".join(f"{k} {self.counts.get(k, 0)}" for k in ("indexed", "unchanged", "removed", "failed"))


_MANIFEST = "path string, file_hash string, doc_id string, parent_ids array<string>, child_ids array<string>, indexed_at timestamp"


class Pipeline:
    def __init__(self, spark: SparkSession, config: Config | None = None, embed: Embedder | None = None, client: A.Client | None = None, scorer: Callable | None = None, spare_embed: Embedder | None = None, spare_scorer: Callable | None = None) -> None:
        self.spark, self.config, self.client = spark, (config or Config()).validate(), client
        self._embedders, self._scorers, self.model_warnings = [embed or hashed_embedder(), spare_embed], [scorer, spare_scorer], []
        self.index = Index(spark, self.config.store.persist_dir, self.config.store.embedding_model)

    @cached_property
    def embed(self) -> Embedder:
        """The embedding model, tested before its first use."""
        model, warnings = sound(self._embedders, self_test, lambda cosine: cosine >= 0.99, "embedding")
        self.model_warnings += warnings
        return model

    @cached_property
    def scorer(self) -> Callable | None:
        """The reranking model, tested before its first use; None without one."""
        if self._scorers[0] is None:
            return None
        model, warnings = sound(self._scorers, lambda m: scorer_self_test(self.spark, m), lambda difference: difference <= 0.01, "reranking")
        self.model_warnings += warnings
        return model

    def ingest(self, folder: str) -> Report:
        """Brings the index in line with a folder; files that fail keep what is stored of them.

        Files are read once to hash them, and those that changed once more to parse them, so that no content is stored on the way.
        """
        if "://" in folder:  # any store that Spark reads
            root = folder.rstrip("/")
        elif Path(folder).is_dir():
            root = str(Path(folder).resolve())
        else:
            raise ConfigError("not a folder", folder)
        manifest = self._manifest()
        listed = stage(sync.diff(scan(self.spark, root).drop("content"), manifest))
        opened = contents(self.spark, root, listed.where("status <> 'unchanged'"))
        return self._update(listed, opened, sync.removed(listed, manifest, root))

    def ingest_files(self, found: DataFrame, folder: str) -> Report:
        """Adds or replaces the files of some rows of Spark's ``binaryFile``, as a stream has them; nothing is removed."""
        files = as_files(found, folder)
        listed = stage(sync.diff(files.drop("content"), self._manifest()))
        changed = listed.where("status <> 'unchanged'").select("path")
        return self._update(listed, files.join(changed, "path", "left_semi"), self._manifest().limit(0))

    def _manifest(self) -> DataFrame:
        stored = self.index.table("manifest")
        return stored if stored is not None else self.spark.createDataFrame([], _MANIFEST)

    def _update(self, listed: DataFrame, opened: DataFrame, gone: DataFrame) -> Report:
        docs, failures = parse(opened, self.config.parser)
        chunks = stage(chunk(docs, self.config.chunker))
        gone = stage(gone.select("path", "doc_id"))
        lost = chunks.where("level = 'failure'").select("source_path", "error_type", F.lit("no chunks").alias("reason"))
        none = F.lit(None).cast("string")
        side = lambda df, path, status: df.select(F.col(path).alias("path"), F.lit(status).alias("status"), none.alias("error_type"), none.alias("reason"))
        report = Report(
            stage(
                side(chunks.where("level = 'parent'").select("source_path").distinct(), "source_path", "indexed")
                .unionByName(side(listed.where("status = 'unchanged'"), "path", "unchanged"))
                .unionByName(side(gone, "path", "removed"))
                .unionByName(failures.unionByName(lost).select(F.col("source_path").alias("path"), F.lit("failed").alias("status"), "error_type", "reason"))
            )
        )
        if report.counts.keys() & {"indexed", "removed"} or not self.index.pointer():
            self._publish(chunks, listed, gone)
            self.index.expire()
        return report

    def _publish(self, chunks: DataFrame, listed: DataFrame, gone: DataFrame) -> None:
        parents, children = chunks.where("level = 'parent'"), chunks.where("level = 'child'")
        sync.check_children(children)
        ids = chunks.where("level <> 'failure'").groupBy("doc_id", "source_path").agg(F.sort_array(F.collect_set("parent_id")).alias("parent_ids"), F.sort_array(F.collect_set("child_id")).alias("child_ids"))
        now = F.lit(dt.datetime.now(dt.timezone.utc).replace(microsecond=0))
        post = stage(search.postings(children).join(children.select("child_id", "doc_id"), "child_id").select("doc_id", "term", "child_id", "tf", "dl"))
        fresh = {
            "parents": parents,
            "children": children,
            "vectors": children.select("doc_id", "child_id", "source", embed_udf(self.embed)("text").alias("vector")),
            "postings": post,
            "manifest": ids.join(listed.select(F.col("path").alias("source_path"), "file_hash"), "source_path").select(F.col("source_path").alias("path"), "file_hash", "doc_id", "parent_ids", "child_ids", now.alias("indexed_at")),
        }
        touched = stage(ids.select("doc_id").unionByName(gone.select("doc_id")).distinct())
        buckets = self.index.touched(touched)
        old = {k: self.index.table(k, buckets) for k in fresh}
        tables = {k: new if old[k] is None else sync.delete(old[k], touched).unionByName(new) for k, new in fresh.items()}
        frequencies, totals = search.frequencies(post), search.totals(post, children)
        if old["postings"] is not None:  # both are additive: what leaves is subtracted, other buckets are not read
            left = {k: old[k].join(touched, "doc_id", "left_semi") for k in ("postings", "children")}
            minus = search.frequencies(left["postings"]).withColumn("df", -F.col("df"))
            frequencies = self.index.table("terms").select("term", "df").unionByName(frequencies).unionByName(minus).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
            out = search.totals(left["postings"], left["children"]).select((-F.col("n")).alias("n"), (-F.col("tokens")).alias("tokens"))
            totals = self.index.table("totals").unionByName(totals).unionByName(out).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
        totals = stage(totals)
        self.index.publish(tables | {"terms": search.term_weights(frequencies, totals), "totals": totals}, buckets)

    def retrieve(self, question: str, where: dict | None = None, warnings: list[str] | None = None) -> DataFrame:
        """The best parents of a question, with their content; what went wrong on the way is added to the warnings."""
        warnings = [] if warnings is None else warnings
        c = self.config.retriever
        t = {k: self.index.table(k) for k in ("parents", "children", "vectors", "postings", "terms", "totals")}
        if t["children"] is None:
            return self.spark.createDataFrame([], "query_id int, parent_id string, score double, rank int, children array<string>, retrievers array<string>, " + CHUNK_SCHEMA.replace("parent_id string, ", "", 1))
        asked = self.spark.createDataFrame([(0, question, self.embed([question])[0])], "query_id int, text string, vector array<float>")
        keep = t["children"].where(search.where_clause(where, t["children"].columns)).select("child_id")
        hits, errors = {}, []
        for name, plan in (
            ("dense", lambda: search.dense(asked, t["vectors"].join(keep, "child_id", "left_semi"), c.dense_k)),
            ("sparse", lambda: search.sparse(asked, t["postings"], t["terms"], t["totals"], c.sparse_k, where, t["children"])),
        ):
            try:  # an action, as that is where a search fails; a few rows
                hits[name] = self.spark.createDataFrame(plan().select("query_id", "child_id", "score", "rank").collect(), _HITS)
            except Exception as e:
                errors.append(f"{name}: {e}")
                hits[name] = self.spark.createDataFrame([], _HITS)
        if len(errors) == 2:
            raise RetrievalError("; ".join(errors))
        warnings += [f"one search failed: {e}" for e in errors]
        scored = search.fuse(hits["dense"], hits["sparse"], (c.dense_weight, c.sparse_weight), c.rrf_k, c.dense_k)
        least = None
        if self.scorer is not None:
            texts = scored.join(t["children"].select("child_id", "text"), "child_id")
            try:
                judged = search.rerank(texts, self.scorer(F.lit(question), F.col("text")), c.rerank_candidates).drop("text")
                scored, least = self.spark.createDataFrame(judged.collect(), judged.schema), c.rerank_min_score
            except Exception as e:  # the fused order stands
                least = None
                warnings.append(f"reranking failed: {e}")
        best = stage(search.promote(scored, t["children"].select("child_id", "parent_id"), c.top_n, least))  # top_n rows
        found, missing = search.with_parents(best, t["parents"].join(F.broadcast(best.select("parent_id")), "parent_id", "left_semi"))
        warnings += [f"a parent is missing from the store, index its document again: {r.parent_id}" for r in missing.collect()]
        return found.orderBy("rank")

    def query(self, question: str, where: dict | None = None) -> A.Answer:
        if not question.strip():
            return A.Answer(question, A.NO_ANSWER, warnings=["the question is empty"])
        warnings: list[str] = []
        try:
            parents = self.retrieve(question.strip(), where, warnings).withColumnRenamed("text", "content")
            row = A.contexts(parents, self.config.generation.max_context_chars).first()
        except RetrievalError as e:
            return A.Answer(question, A.NO_ANSWER, warnings=[f"retrieval failed: {e}"])
        if row is None:
            return A.Answer(question, A.NO_ANSWER, warnings=[*warnings, "nothing was found"])
        contexts = [c.asDict() for c in row.citations]
        warnings += [f"left out of the context: {s}" for s in row.left_out]
        try:
            if self.client is None:
                raise GenerationError("no language model is configured")
            reply = A.call(self.client, self.config.generation, f"{row.xml}\n\n질문: {question.strip()}")
        except GenerationError as e:
            return A.Answer(question, "답변을 생성하지 못했습니다. 관련 문서:", contexts, contexts, warnings=[*warnings, f"generation failed: {e}"])
        return self._checked(question, reply, contexts, warnings)

    def _checked(self, question: str, reply: A.Reply, contexts: list[dict], warnings: list[str]) -> A.Answer:
        base = {"contexts": contexts, "model": reply.model or self.config.generation.model, "stop_reason": reply.stop_reason, "usage": reply.usage}
        if reply.stop_reason == "refusal":
            return A.Answer(question, "모델이 답변을 거절한 질문입니다.", warnings=[*warnings, f"refused ({reply.category})"], **base)
        if reply.stop_reason == "max_tokens":
            warnings = [*warnings, "the answer was cut off at max_tokens"]
        if reply.fell_back:
            warnings = [*warnings, f"another model answered: {reply.model}"]
        df = self.spark.createDataFrame([(reply.text.strip(), len(contexts))], "raw string, n int").select(A.cited(F.col("raw"), F.col("n")).alias("c")).select("c.*")
        got = df.select("invalid", A.verdict(F.col("text"), F.col("valid")).alias("v")).first()
        if got.invalid:
            warnings = [*warnings, f"citations of nothing removed: {sorted({int(x) for x in got.invalid})}"]
        if got.v.uncited:
            warnings = [*warnings, "an answer without citations"]
        return A.Answer(question, got.v.answer, [contexts[k - 1] for k in got.v.citations], grounded=got.v.grounded, warnings=warnings, **base)
