"""An extension: pages that arrive as a stream, parsed as they come, or converted whole into tables that keep each page's last version.

Pages are independent, so no state is kept. A batch of a conversion writes a folder of its own in each table, in place of
what an earlier try of the same batch left there, and at last the list of its pages, which makes it count: a batch that is
replayed changes nothing, one that broke off is not seen. A page that comes again is in a later batch, which replaces what
earlier ones have of it, also with nothing, if it can't be converted now.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.engine import Options, convert
from tessera.sources.html import dom_nodes
from tessera.sources.store import shared_dir, ship, written


def parsed(stream: DataFrame) -> DataFrame:
    return dom_nodes(stream)


def stream_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Runs what is there now through a stream into a table in the shared folder; page_id and number of elements that a page names, for each page."""
    folder, glob = path.rsplit("/", 1)
    schema = ship(spark).read.parquet(path).schema
    target = f"{shared_dir(spark)}/tessera/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", glob if not _is_folder(spark, path) else "*.parquet").parquet(folder if not _is_folder(spark, path) else path)
    query = parsed(source).writeStream.format("parquet").option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start(target)
    query.awaitTermination()
    return spark.read.parquet(target).where("kind = 'element' and not implied").groupBy("page_id").agg(F.count("*").alias("n_elements"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


#: Tables of a conversion, and what each takes from a document.
TABLES = {
    "documents": lambda d: d.export(),
    "nodes": lambda d: d.tokens["tree"].select("page_id", "node_id", "parent_ir", "ord", "ir_type", "name", "characters", "component_id", "instance_of", "instance_id", "fill_style_id", "text_style_id", "effect_style_id"),
    "components": lambda d: d.detected["components"],
    "paints": lambda d: d.tokens["paints"].select("page_id", "style_id", "hex", "total"),
    "texts": lambda d: d.tokens["texts"].select("page_id", "style_id", "n"),
    "stats": lambda d: d.stats,
    "failures": lambda d: d.failures,
}
LIST = "pages"


def converted(batch: DataFrame, batch_id: int, target: str, options: Options | None = None) -> None:
    """One batch of pages (page_id, url, html) into the tables below target. Of rows with one page_id the one with the greatest html is taken."""
    pages = batch.groupBy("page_id").agg(F.max(F.struct("html", "url")).alias("p")).select("page_id", "p.url", "p.html")
    doc = convert(written(pages, "batch"), options)
    folder = lambda name: f"{target}/{name}/batch={batch_id:019d}"
    for name, take in TABLES.items():
        take(doc).write.mode("overwrite").parquet(folder(name))
    doc.pages.select("page_id").write.mode("overwrite").parquet(folder(LIST))


def convert_stream(stream: DataFrame, target: str, options: Options | None = None) -> StreamingQuery:
    """Converts a stream of pages into the tables below target, a folder that driver and executors share. What is there now is taken, in batches."""
    ship(stream.sparkSession)
    work = lambda batch, batch_id: converted(batch, batch_id, target, options)
    return stream.select("page_id", "url", "html").writeStream.foreachBatch(work).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A table of a conversion with each page's last version."""
    last = spark.read.option("basePath", f"{target}/{LIST}").parquet(f"{target}/{LIST}").groupBy("page_id").agg(F.max(F.col("batch").cast("long")).alias("last"))
    rows = spark.read.option("basePath", f"{target}/{name}").parquet(f"{target}/{name}").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(last.withColumnRenamed("page_id", "of"), (F.col("page_id") == F.col("of")) & (F.col("batch") == F.col("last"))).drop("of", "last", "batch")
