"""Catalog tables, delimited extracts, snapshots and exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A catalog table, or a Parquet path when ``name`` looks like one."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return df.select(*columns) if columns else df


def distinct_snapshot(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """De-duplicated rows; project first, because DISTINCT blocks column pruning."""
    return (df.select(*columns) if columns else df).distinct()


def read_extract(
    spark: SparkSession, path: str, schema: StructType | str, sep: str = ";"
) -> DataFrame:
    """Delimited file set with a header and a declared schema (no inference pass).

    A value that does not fit its type fails the read instead of turning null.
    """
    return (
        spark.read.schema(schema)
        .option("header", True).option("sep", sep).option("mode", "FAILFAST")
        .csv(path)
    )


# -- replacement -------------------------------------------------------------
#
# A replaced folder or table keeps its old version until the new one is written whole: the new
# rows may be computed from it, and a run that dies leaves it as it was.  One writer at a time.


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes paths of it."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _beside(path: str, tag: str) -> str:
    """A hidden folder next to ``path``, which readers of the parent folder skip."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/.{name}.{tag}"


def recover(spark: SparkSession, path: str) -> None:
    """Finish what a run that died has left: the old version back, or away if the new one stands."""
    fs, make = _files(spark, path)
    target, previous = make(path), make(_beside(path, "previous"))
    if fs.exists(previous):
        if fs.exists(target):
            fs.delete(previous, True)
        else:
            _move(fs, previous, target)


def _move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a staged folder, then put it in the place of ``path``.

    The staged folder counts only with the marker that Spark sets after its last task.  The
    swap is two renames; if the second fails the first is undone, and if the driver dies
    between them ``recover`` (called by the next reader or writer here) undoes it.  Meant for
    file systems with a cheap rename; tables in object stores are better replaced in the
    catalog by ``save_table``.
    """
    recover(spark, path)
    fs, make = _files(spark, path)
    staged_name = _beside(path, f"staged-{uuid.uuid4().hex}")
    staged, target, previous = make(staged_name), make(path), make(_beside(path, "previous"))
    try:
        write(staged_name)
        if not fs.exists(make(f"{staged_name}/_SUCCESS")):
            raise OSError(f"no commit marker in {staged_name}")
        replaced = fs.exists(target)
        if replaced:
            _move(fs, target, previous)
        try:
            _move(fs, staged, target)
        except Exception:
            if replaced:
                _move(fs, previous, target)
            raise
    finally:
        fs.delete(staged, True)
    fs.delete(previous, True)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a folder written by ``replace_folder``."""
    recover(spark, path)
    return spark.read.parquet(path)


def write_extract(df: DataFrame, path: str, sep: str = ";", compression: str = "none") -> None:
    """Delimited export with a header, one part file per task, no driver hop."""
    replace_folder(df.sparkSession, path, lambda staged: (
        df.write.option("header", True).option("sep", sep).option("compression", compression).csv(staged)
    ))


def write_folder(df: DataFrame, path: str) -> None:
    """Parquet folder, replaced as a whole; ``df`` may read the version it replaces."""
    replace_folder(df.sparkSession, path, lambda staged: df.write.parquet(staged))


def write_partitioned(df: DataFrame, path: str, by: str = "codmes") -> None:
    """Parquet partitioned by month, replaced as a whole.

    The rebalance hint lets adaptive execution split a month that outgrows
    the advisory size and merge the small ones, so neither a hot month nor a
    flood of tiny files comes out of it.
    """
    replace_folder(df.sparkSession, path, lambda staged: (
        df.hint("rebalance", F.col(by)).write.partitionBy(by).parquet(staged)
    ))


def save_table(df: DataFrame, table: str, path: str | None = None, by: str | None = None) -> None:
    """Replace a catalog table; its versions lie below ``path`` or the warehouse folder.

    The new version is written whole under a name of its own, so ``df`` may read the table
    that it replaces.  A table of the same columns without partitions then gets the new
    location in one step of the catalog; otherwise names are swapped, and swapped back if that
    fails.  The folder of the old version goes last.
    """
    spark = df.sparkSession
    root = (path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table}-versions").rstrip("/")
    mark = uuid.uuid4().hex
    version, staged, previous = f"{root}/v-{mark}", f"{table}__staged_{mark}", f"{table}__previous_{mark}"
    out = df.hint("rebalance", F.col(by)) if by else df
    writer = out.write.format("parquet").option("path", version)
    try:
        (writer.partitionBy(by) if by else writer).saveAsTable(staged)
        if not spark.catalog.tableExists(table):
            spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
            return
        old = _location(spark, table)
        plain = not by and not _partitioned(spark, table) and spark.table(table).schema == spark.table(staged).schema
        if plain:
            spark.sql(f"DROP TABLE {staged}")
            spark.sql(f"ALTER TABLE {table} SET LOCATION '{version}'")
            spark.catalog.refreshTable(table)
        else:
            spark.sql(f"ALTER TABLE {table} RENAME TO {previous}")
            try:
                spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
            except Exception:
                spark.sql(f"ALTER TABLE {previous} RENAME TO {table}")
                raise
            spark.sql(f"DROP TABLE {previous}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        fs, make = _files(spark, version)
        fs.delete(make(version), True)
        raise
    if old and old.rstrip("/").rpartition("/")[2].startswith("v-"):
        fs, make = _files(spark, old)
        fs.delete(make(old), True)


def _location(spark: SparkSession, table: str) -> str | None:
    rows = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").collect()
    return rows[0].data_type if rows else None


def _partitioned(spark: SparkSession, table: str) -> bool:
    return any(c.isPartition for c in spark.catalog.listColumns(table))


def keep(df: DataFrame) -> DataFrame:
    """Keep a frame that feeds several actions; partitions spill to disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def label_table(
    spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]
) -> DataFrame:
    """Literal dimension table of the program text, all columns text."""
    schema = StructType([StructField(c, StringType(), True) for c in columns])
    return spark.createDataFrame(list(rows), schema)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder every executor can reach.

    It lies below ``spark.checkpoint.dir``, or where that is unset below the
    warehouse folder of the session, where the tables themselves are.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    )
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_stored: dict[str, list[str]] = {}


def store(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write a derived frame once and read it back, for several passes over it.

    The copy stays until ``clear_stored``.
    """
    spark = df.sparkSession
    path = path or work_dir(spark, label)
    df.write.mode("overwrite").parquet(path)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.parquet(path)


def is_stored(spark: SparkSession, path: str) -> bool:
    return path in _stored.get(spark.sparkContext.applicationId, [])


def clear_stored(spark: SparkSession) -> None:
    """Remove what ``store`` has written in this application; its frames end with it."""
    jvm = spark.sparkContext._jvm
    for path in _stored.pop(spark.sparkContext.applicationId, []):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
