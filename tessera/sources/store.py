"""What driver and executors share: tables in a common folder, and this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine (master local, as in tests) a folder of its own if the session names none."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir("/tmp/checkpoints")
        path = context.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again.

    Its lineage ends there: what uses it twice computes it once, and a lost executor costs no rerun of what lies before.
    """
    path = f"{shared_dir(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_page(df: DataFrame, name: str) -> DataFrame:
    """written(), for tables that are joined by page: they grow with the corpus, so no join sends one to the driver.

    Parquet holds many like pages in a fraction of what they take in memory; a size on disk says nothing of a broadcast's.
    """
    return written(df, name).hint("merge")


def dealt(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """pages over three tasks for each core, 24 at least, and no more than a shuffle has: a small file holds more pages than one task can read in time.

    Pages stream through a task, so tasks may be long; but each makes the columns' code anew, so there are not many.
    """
    spark = pages.sparkSession
    return pages.repartition(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(24, 3 * spark.sparkContext.defaultParallelism))), key)


def discard(table: DataFrame) -> None:
    """Deletes a table that written() made. Nothing that is still to be computed may read it."""
    spark = table.sparkSession
    base = f"{shared_dir(spark)}/tessera/"
    files = table.inputFiles()
    if files and (at := files[0].find("/tessera/")) >= 0:
        folder = base + files[0][at + len("/tessera/") :].split("/")[0]
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a column of this name: each row's place, from 0, in the order of a column.

    Ranges of rows are numbered where they lie; how many rows come before a range is summed up over the ranges alone.
    """
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(width, column).sortWithinPartitions(column)
    dealt = written(dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")), "numbered")
    parts = dealt.groupBy("__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")  # a row for each range
    parts = parts.select("__part", (before - F.col("__first")).alias("__shift"))
    return dealt.join(F.broadcast(parts), "__part").select(*df.columns, (F.col("__row") + F.col("__shift")).alias(name))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application: their Python need not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
