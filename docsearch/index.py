"""The stored index: Parquet tables cut into buckets by document, and a pointer that says which folder holds each bucket.

An update writes the buckets of changed documents into a new folder and then replaces the pointer, so that a document's replacement
and all that goes with it become visible together, or not at all; other buckets stay where they are.  Files are reached
through Hadoop's interface only, so the folder may be on any store that Spark reaches.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsearch.errors import IndexingError
from docsearch.operators import sync

#: Tables with a ``doc_id``, cut into buckets, and the small ones of the whole corpus.
BY_DOCUMENT = ("parents", "children", "vectors", "postings", "manifest")
WHOLE = ("terms", "totals")
#: Buckets of a new index; an index keeps the number it was made with.
BUCKETS = 64


class Files:
    """Small files and listings on whatever file system a path belongs to."""

    def __init__(self, spark: SparkSession) -> None:
        self._hadoop, self._conf, self._gateway = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self._hadoop.Path(path)
        fs = p.getFileSystem(self._conf)
        return fs, fs.makeQualified(p)

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        source = fs.open(p)
        try:
            return bytes(source.readAllBytes()).decode("utf-8")
        finally:
            source.close()

    def replace(self, path: str, text: str) -> None:
        """Written aside and renamed over the old file, in one step where the file system has one."""
        fs, p = self._at(path)
        draft = self._hadoop.Path(f"{p.toString()}.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        kind = getattr(self._hadoop, "Options$Rename")
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self._hadoop.FileContext.getFileContext(fs.getUri(), self._conf).rename(draft, p, how)

    def folders(self, path: str) -> dict[str, int]:
        """Names of the folders in a folder, with the milliseconds of their last change."""
        fs, p = self._at(path)
        return {x.getPath().getName(): x.getModificationTime() for x in fs.listStatus(p) if x.isDirectory()} if fs.exists(p) else {}

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Index:
    """Tables below a folder; the pointer file also names the embedding model."""

    def __init__(self, spark: SparkSession, folder: str, model: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.model, self.files = spark, folder.rstrip("/"), model, Files(spark)
        built = self.pointer()
        self.buckets = built.get("buckets", buckets)
        sync.check_model(self.table("manifest"), built.get("embedding_model"), model, folder)

    def pointer(self) -> dict:
        """embedding_model, buckets, schemas by table, and places: by table the folder of each bucket (of "" for a whole table)."""
        path = f"{self.folder}/CURRENT"
        try:
            text = self.files.read(path)
            value = json.loads(text) if text is not None else {}
            return {k: value[k] for k in ("embedding_model", "buckets", "schemas", "places")} if text is not None else {}
        except (ValueError, KeyError, TypeError, Py4JJavaError) as e:
            raise IndexingError(f"the pointer to the current tables is damaged: {e}", path) from e

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def touched(self, documents: DataFrame) -> list[int]:
        """The buckets of some documents: ``self.buckets`` numbers at most."""
        return [r.b for r in documents.select(self.bucket().alias("b")).distinct().collect()]

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A current table, or some buckets of it; None before the first update."""
        now = self.pointer()
        if not now:
            return None
        schema = StructType.fromJson(now["schemas"][name])
        chosen = None if buckets is None else set(map(str, buckets))
        paths = [f"{self.folder}/{at}/{name}" + (f"/bucket={b}" if b else "") for b, at in now["places"][name].items() if chosen is None or b in chosen]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, tables: dict[str, DataFrame], buckets: list[int]) -> str:
        """Writes new contents of some buckets and of the whole tables, then points to them."""
        if missing := {*BY_DOCUMENT, *WHOLE} - set(tables):
            raise IndexingError(f"an update needs {sorted(missing)}")
        name, now = uuid.uuid4().hex, self.pointer()
        old, replaced, places = now.get("places", {}), set(map(str, buckets)), {}
        for k in BY_DOCUMENT:
            # large buckets become several files, small ones share a task
            tables[k].withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}/{k}")
            written = [x.removeprefix("bucket=") for x in self.files.folders(f"{self.folder}/{name}/{k}") if x.startswith("bucket=")]
            places[k] = {b: at for b, at in old.get(k, {}).items() if b not in replaced} | dict.fromkeys(written, name)
        for k in WHOLE:
            tables[k].write.parquet(f"{self.folder}/{name}/{k}")
            places[k] = {"": name}
        schemas = {k: tables[k].schema.jsonValue() for k in tables}
        self.files.replace(f"{self.folder}/CURRENT", json.dumps({"embedding_model": self.model, "buckets": self.buckets, "schemas": schemas, "places": places}))
        return name

    def expire(self, hours: float = 24.0) -> list[str]:
        """Removes folders that nothing points to and that were written some hours ago; readers of older tables have that long."""
        used = {at for by in self.pointer().get("places", {}).values() for at in by.values()}
        least = (time.time() - hours * 3600) * 1000
        gone = [x for x, changed in self.files.folders(self.folder).items() if len(x) == 32 and x not in used and changed <= least]
        for x in gone:
            self.files.remove(f"{self.folder}/{x}")
        return gone
