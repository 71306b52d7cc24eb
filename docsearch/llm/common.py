"""What the operators share: tables in the shared folder, joins with a checked broadcast, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that a Python operator gets at once; texts are long, so fewer than Spark's default.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
#: A side is broadcast up to so many bytes of values (summed up, not estimated); beyond it the join is shuffled.
BROADCAST_BYTES = 8 << 20
#: From so many edges on, each side of a join in ``components`` is a table.
SPLIT_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the batches of this session's Python operators by rows and by bytes (a single longer row is a batch)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="docsearch-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def give_back() -> None:
    """Returns freed memory to the system; a Python worker waits for its next task with what it has."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives freed memory back when it ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back_driver(spark: SparkSession) -> bool:
    """Returns what the driver's JVM has freed outside its heap to the system, if its JVM and C library can (JDK 17.0.9, glibc).

    Compilers, collectors and network threads allocate there, and the C library keeps what hundreds of threads have freed.
    """
    try:
        gateway = spark.sparkContext._gateway
        jvm, known = gateway.jvm, gateway.jvm.java.lang.Class.forName
        # through the interface, as the server's own class is not open to reflection
        kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = known(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        known("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Exception:  # another JVM, or the session has ended
        return False
    return True


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage.

    Unlike ``checkpoint()`` it is columnar and compressed, and unlike ``localCheckpoint`` it outlives executors.
    It is removed by ``release``, or when the driver's Python ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/docsearch-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    give_back_driver(spark)
    atexit.register(remove, spark, folder)
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out._scratch = folder
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables that ``materialise`` has made and that nothing will read again."""
    for df in tables:
        if folder := getattr(df, "_scratch", None):
            remove(df.sparkSession, folder)


def _bytes(name: str, kind: T.DataType) -> Column:
    """Bytes of a value, counting nested ones by their text."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.ArrayType, T.MapType, T.StructType)):
        return 8 * F.greatest(F.size(name), F.lit(1))
    return F.lit(8) if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(8))


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the sum of its values shows that the table is small, else the table as it is (a shuffled join)."""
    n = df.agg(F.sum(reduce(Column.__add__, (_bytes(f.name, f.dataType) for f in df.schema.fields)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is not among the ids (a column doc_id of longs); a null doc_id stays."""
    name = f"_{uuid.uuid4().hex}"  # clashes with no column of docs
    return docs.join(small(ids.toDF(name)), docs["doc_id"].cast("long") == F.col(name), "left_anti")


def crc_mod(column: Column, mod: int) -> Column:
    """crc32 of a value as text, modulo mod; a null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(mod))


def _stars(e: DataFrame) -> tuple[int, bool]:
    """Number of edges (a, b), a > b, and whether each a has one edge and no b is an a: then b is the least node of its component."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, more = nodes.agg(F.sum("up"), F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return n or 0, not more


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for all nodes of the edges (a, b).

    Alternating large-star and small-star steps; each is an aggregate with map-side combining and a join, which Spark can split where a
    hub has very many edges.  Each step's edges are a table in the shared folder.
    Ends when every component is a star around its least node, which takes about log2 of the longest path and no step where the edges are such stars.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    n, stars = _stars(e)
    for _ in range(most):
        if stars:
            break
        # a join with an aggregate can't be split where a hub has very many edges, one with a table can
        settled = (lambda df: materialise(df, name)) if n > SPLIT_ROWS else (lambda df: df)
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = settled(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = settled(large.groupBy("a").agg(F.min("b").alias("m")))
        step = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        before, e = e, materialise(step, name)
        release(before, least, large, low)
        n, stars = _stars(e)
    if not stars:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
