"""Writers for report outputs.

CSV options reproduce the application's export (header, no index, UTF-8,
doubled quotes, empty field for NULL and for ''): Spark's defaults would
quote empty strings and escape quotes with a backslash.  Floats are written
by Spark's formatter (``1.0E20`` where Python writes ``1e+20``); format them
to text first (``innsight.functions.formats``) where the exact text matters.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_writer(df: DataFrame, single_file: bool = False):
    """A configured ``DataFrameWriter``; ``single_file`` only for bounded report outputs."""
    out = df.coalesce(1) if single_file else df
    return (
        out.write.option("header", True)
        .option("escape", '"')
        .option("quote", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("encoding", "UTF-8")
    )


# Columns that hold a report's order; the application's files have the order but not the columns.
ORDER_COLUMNS = ("is_total", "position", "Rank")


def partition_folder(column: str, value: str) -> str:
    """``column=value`` as a folder name."""
    return f"{column}={quote(value, safe=' !$&()+,-.;<>@[]_~')}"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False,
              partition_by: Sequence[str] = (), order: Sequence[Column] = (), rows_per_file: int = 0) -> None:
    """Write ``df`` as CSV with the application's conventions, in its order and without :data:`ORDER_COLUMNS`.

    ``order`` sorts a large report while it is written: rows are range-partitioned
    by it, one range a task, and part files are named by range, so the files read
    one after the other in name order are the report.  ``rows_per_file`` cuts a
    range into several files, in order as well.
    """
    if order:
        df = df.orderBy(*order)
    df = df.drop(*ORDER_COLUMNS)
    w = csv_writer(df, single_file).mode(mode)
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def read_ordered_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A report written by :func:`write_csv` with its rows' ``position`` (from 0) over all files in name order.

    Each file is read whole by one task, so files should be cut by ``rows_per_file``;
    fields must hold no line breaks.  Files are numbered by their line counts, a
    table of one row a file; the rows themselves are not sorted.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.csv").select(F.col("_metadata.file_name").alias("file"), "value")
    lines = F.split(F.regexp_replace("value", "\n$", ""), "\n")
    sizes = files.groupBy("file").agg(F.sum(F.size(lines) - 1).alias("n"))  # without the header
    starts = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("start"))
    rows = files.select("file", F.posexplode(lines).alias("line", "text")).where("line > 0").join(starts, "file")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"escape": '"', "quote": '"', "nullValue": ""}
    parsed = rows.select((F.col("start") + F.col("line") - 1).alias("position"), F.from_csv("text", ddl, options).alias("r"))
    return parsed.select("position", "r.*")


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ("tenant",), rebalance: bool = False) -> None:
    """Write ``df`` as Parquet, replacing only the partitions present in ``df``.

    Dynamic partition overwrite (a per-write option, safe with concurrent
    writers of other tenants) leaves the other tenants' partitions in place,
    and a rerun of one tenant is idempotent.  ``rebalance`` (for frames that
    hold many tenants) groups rows by the partition columns before writing,
    so each task writes few tenant directories; adaptive execution splits a
    tenant too large for one task, so a hot tenant does not become one huge
    task either.  Within a file rows follow the report's order columns.
    """
    if rebalance and partition_by:
        order = [c for c in ORDER_COLUMNS if c in df.columns]
        df = df.hint("rebalance", *partition_by).sortWithinPartitions(*partition_by, *order)
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_by).parquet(path))


def write_empty(like: DataFrame, folders: Sequence[str], scratch: str) -> None:
    """Replace each of ``folders`` by one that holds an empty Parquet file of ``like``'s columns.

    One Spark write of the empty file (in ``scratch``); the copies are file
    operations, so the number of folders does not add Spark jobs.
    """
    if not folders:
        return
    spark = like.sparkSession
    like.limit(0).coalesce(1).write.parquet(scratch)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    made = hadoop.Path(scratch)
    source_fs = made.getFileSystem(conf)
    empty = next(f.getPath() for f in source_fs.listStatus(made) if f.getPath().getName().endswith(".parquet"))

    def replace(folder: str) -> None:
        path = hadoop.Path(folder)
        fs = path.getFileSystem(conf)
        fs.delete(path, True)
        fs.mkdirs(path)
        hadoop.FileUtil.copy(source_fs, empty, fs, hadoop.Path(path, "part-00000.parquet"), False, conf)

    with ThreadPoolExecutor(max_workers=16) as pool:
        list(pool.map(replace, folders))
