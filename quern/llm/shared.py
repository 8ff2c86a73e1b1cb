"""Tables that all executors can read, and ids for work units."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a local session gets one of its own; a cluster's executors share none, so there it raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def filesystem(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the function that makes its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


#: Bytes of a table beyond which its files are taken as they are.
SMALL = 1 << 28


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A small one in fewer files than there are cores is dealt to all of them, as one file may be one task."""
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if len(rows.inputFiles()) < cores:
        files, make = filesystem(spark, path)
        if files.getContentSummary(make(path)).getLength() < SMALL:
            return rows.repartition(cores)
    return rows


#: Tasks that write a table at most: so many for each core, or a share of the shuffle partitions, which grow with the input, if that is more.
WRITERS, SHARE = 4, 8


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: lineage ends, and a lost executor costs no recomputation. Small tables don't fall into a file for each partition."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    tasks = max(WRITERS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARE)
    df.coalesce(tasks).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def drop(*saved: DataFrame) -> None:
    """Delete tables made by :func:`save` that no later plan reads."""
    for df in saved:
        path = getattr(df, "saved_path", None)
        if path:
            files, make = filesystem(df.sparkSession, path)
            files.delete(make(path), True)


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that none of ``columns`` has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def crc_bucket(column: str, n: int) -> Column:
    """crc32 of the value written as text, modulo n; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
