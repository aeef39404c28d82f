"""Tables, shared work folder and small Spark helpers of the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bound of an Arrow batch between Spark and Python; batches are cut finer inside the tasks.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT = "67108864b"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, with only the columns that are named.

    Batches for Python are bounded in bytes first: a batch of 10,000 long texts would be built
    whole in the JVM and in the worker.  A bound that the user has set stays.
    """
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (tests), a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.scoremon.test.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="scoremon-llm-")
        spark.conf.set("spark.scoremon.test.dir", folder)
    return folder.rstrip("/")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage."""
    return stored(df, label)[0]


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``store``, with the folder, for large copies that are removed when they are done with."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored frame that nothing unfinished reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a narrow frame; Spark's cleaner removes it when it is unused."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and checkpoints of frames out of scope."""
    spark.sparkContext._jvm.System.gc()


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return the free memory of this worker, which other tasks use again, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int
) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text each; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(batch.schema.get_field_index(column))
        ends = pc.cumulative_sum(
            pc.cast(
                pc.fill_null(pc.binary_length(size), 0), pa.int64()
            )
        ).to_numpy(zero_copy_only=False)
        start, base = 0, 0
        while start < batch.num_rows:
            stop = int(ends.searchsorted(base + limit, side="right"))
            stop = min(max(stop, start + 1), batch.num_rows, start + 60_000)
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])
    give_back()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph, component being the smallest node reached.

    Alternates large-star and small-star steps until nothing changes; each step is a
    grouped minimum (combined before the shuffle) and a join that adaptive execution can
    split at a hub.  Nodes without an edge to another node do not appear.
    """
    e = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).where("u <> v").distinct()
    e = cut(e)
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")
        )
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            )).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        e = cut(small)
        state = e.agg(
            F.count("*"),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)),
        ).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    nodes = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("u"), F.col("v").alias("component"))
    return nodes.union(roots).groupBy(F.col("u").alias("node")).agg(
        F.min("component").alias("component")
    )


BUCKET_ROWS = 20_000


def hash_bucket(buckets: int, *columns: str) -> F.Column:
    """Which of ``buckets`` equal ranges of a 31-bit hash a row falls in."""
    h = F.shiftrightunsigned(F.xxhash64(*columns), 33)
    return F.shiftright(h * buckets, 31).cast("int")


def running(rows: DataFrame, group: str, order: Sequence[str], value: F.Column, name: str) -> DataFrame:
    """``rows`` (stored) with the sum of ``value`` over the rows before them in their group.

    Rows stand in the order of a hash of ``order``, cut into hash ranges of about
    ``BUCKET_ROWS`` rows of the whole table: sums of ranges give each its base, and a window
    works inside one range of one group, so a group may hold any share of the rows.
    """
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumns({"_v": value, "_b": hash_bucket(buckets, *order)})
    sums = rows.groupBy(group, "_b").agg(F.sum("_v").alias("_s"))
    over = Window.partitionBy(group).orderBy("_b")
    base = sums.select(
        F.col(group).alias("_g"), F.col("_b").alias("_c"), (F.sum("_s").over(over) - F.col("_s")).alias("_base")
    )
    inside = Window.partitionBy(group, "_b").orderBy(F.xxhash64(*order), *order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c"))
    return rows.join(base, same).withColumn(
        name, F.col("_base") + F.coalesce(F.sum("_v").over(inside), F.lit(0))
    ).drop("_v", "_b", "_g", "_c", "_base")


def twins(rows: DataFrame, columns: Sequence[str], tie: str, name: str = "twin") -> DataFrame:
    """``rows`` (stored) with a number among the rows that agree in ``columns``, 0 for single ones.

    ``tie`` tells rows apart.  It follows the file layout, and so does which twin gets which
    number; an order by ``columns`` and this number is the same for every layout but for
    twins changing places.  A row may stand any number of times.
    """
    keyed = rows.withColumn("_key", F.xxhash64(*columns))
    several = cut(keyed.groupBy("_key").count().where("count > 1").select("_key"))
    if several.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    single = keyed.join(several, "_key", "left_anti").withColumn(name, F.lit(0).cast("long"))
    again = store(keyed.join(several, "_key", "left_semi"), "twins")
    again = running(again, "_key", [tie], F.lit(1).cast("long"), name)
    return store(single.unionByName(again).drop("_key"), "numbered-twins")


def place_in(bounds: Sequence[float], value: F.Column) -> F.Column:
    """How many of the sorted ``bounds`` are below or at ``value``: binary search in a constant."""
    if not len(bounds):
        return F.lit(0)
    levels = len(bounds).bit_length()
    known = F.array(*[F.lit(b) for b in bounds])
    jumps = F.array(*[F.lit(1 << k) for k in range(levels - 1, -1, -1)])
    return F.aggregate(
        jumps, F.lit(0),
        lambda low, jump: F.when(
            (low + jump <= len(bounds)) & (F.get(known, low + jump - 1) <= value), low + jump
        ).otherwise(low),
    )
