"""Session helpers: staging of shared intermediates and small guarded broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_staged: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is empty, a folder in the warehouse stands in; on a
    cluster it has to name a file system that all machines share, as a plain
    path would be another disk on each of them.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master
    one_machine = master.startswith("local") and not master.startswith("local-cluster")
    if not one_machine and not re.match(r"(?!file:)[a-zA-Z][\w+.-]*:", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse.rstrip("/") + "/_tapeloom"


def shared_path(spark: SparkSession) -> str:
    """A new path below the shared folder, removed when the program ends."""
    path = f"{shared_root(spark)}/stage/{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def discard(path: str) -> None:
    """Remove a folder that :func:`shared_path` named."""
    context = SparkContext._active_spark_context
    if context is None or path not in _staged:
        return
    _staged.remove(path)
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def release() -> None:
    """Remove every staged table of this program."""
    for path in list(_staged):
        with contextlib.suppress(Exception):
            discard(path)


atexit.register(release)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several later passes read the same intermediate.  The written
    table survives lost executors, keeps column pruning and pushdown for its
    readers and cuts the lineage.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(df: DataFrame) -> int:
    """How many ordered buckets a distributed scan uses per group."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


#: Rows that one task of a scan by key holds, with room for a few sorts of wide rows.
TASK_ROWS = 150_000


def dealt(df: DataFrame, key: str | list[str], rows: int) -> DataFrame:
    """``df`` by ``key``, in as many tasks as ``rows``, a bound on its rows, needs.

    Exchanges that Spark adds by itself are put together by their compressed
    size, so a chain of windows over wide rows sorts on disk once the table is
    large; here the number of tasks grows with the table and a task's rows do not.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(tasks, *([key] if isinstance(key, str) else key))


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate) to every row.

    Planned as a scalar subquery, so nothing is joined and a second row is an
    error.
    """
    packed = row.select(F.struct("*")).scalar()
    return df.withColumn("_row", packed).select("*", "_row.*").drop("_row")

