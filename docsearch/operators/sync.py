"""Incremental synchronisation of an index with a folder: what is new, changed, unchanged, failed or gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.errors import IndexConfigMismatchError, IndexingError


def diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (path, file_hash, ...) with ``status``: new, changed or unchanged against the manifest (path, file_hash)."""
    known = manifest.select("path", F.col("file_hash").alias("known_hash"))
    status = F.when(F.col("known_hash").isNull(), "new").when(F.col("known_hash") == F.col("file_hash"), "unchanged").otherwise("changed")
    return files.join(known, "path", "left").withColumn("status", status).drop("known_hash")


def under(path: Column, root: str) -> Column:
    return path.startswith(root.rstrip("/") + "/")


def removed(files: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """Manifest rows below the root whose file was not seen; files that failed to parse were seen."""
    return manifest.where(under(F.col("path"), root)).join(files.select("path"), "path", "left_anti")


def report(statuses: DataFrame) -> DataFrame:
    """(status, files) with a row for each status."""
    return statuses.groupBy("status").agg(F.count("*").alias("files"))


def replace(stored: DataFrame, fresh: DataFrame, gone: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The table after an upsert: rows of replaced and gone documents leave, fresh rows come."""
    out = fresh.select(key) if gone is None else fresh.select(key).unionByName(gone.select(key))
    return stored.join(out.distinct(), key, "left_anti").unionByName(fresh)


def delete(stored: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def duplicate_children(children: DataFrame) -> DataFrame:
    """(child_id, copies) of ids that come more than once."""
    return children.groupBy("child_id").agg(F.count("*").alias("copies")).where("copies > 1")


def check_children(children: DataFrame) -> None:
    found = duplicate_children(children).limit(3).collect()
    if found:
        raise IndexingError(f"repeated child ids: {[r.child_id for r in found]}")


def check_model(manifest: DataFrame | None, built_with: str | None, model: str, where: str | None = None) -> None:
    """An index with documents can't be searched or extended with another embedding model."""
    if manifest is not None and built_with and built_with != model and not manifest.isEmpty():
        raise IndexConfigMismatchError(f"the index was built with {built_with!r}, not {model!r}", where)


def count_children(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.coalesce(F.sum(F.size("child_ids")), F.lit(0)).cast("long").alias("children"))
