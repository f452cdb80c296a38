"""Lines that occur in several documents stay in the first one only, with DataFrame functions alone.

A line's key is the line without white space at its ends, in lower case (A-Z); keys of fewer than `least_chars` code
points are left alone. Keys travel as hashes of 128 bits. What has been seen is kept in levels of sorted runs: tables in
buckets of the hash, sorted in each. A batch of documents is reduced to one row a key (combined before the shuffle), which
a merge join holds against every run; keys that none of them has make the batch's own run, with the document that owns
them. Runs share no key; when a level has `fanout` of them they are put together into one of the next level, so that a
batch meets few runs, and their buckets lie as the join needs them, so runs are not shuffled again. A line stays if its
document owns its key; that join is by key and document, so a line that every document has is spread like any other.

Defined cases: a null or empty text is one empty line, which stays; a very long text is cut whole, and its lines are
looked up by their places; rows with one doc_id are one document, so that their lines don't drop each other, and each row
is answered; rows without a doc_id are together one document, after all others (as is the id 2^63 - 1); equal lines of
one document all stay or all go; extra columns, whatever their names, are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, shuffle_width, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)  # there lower() does the same, faster
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def order_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1))


def keyed_lines(docs: DataFrame, least_chars: int = 10) -> DataFrame:
    """h1, h2, doc, copy, pos: a row for each line whose key is long enough. copy tells texts of one doc_id apart."""
    cut = docs.select(order_of(F.col("doc_id")).alias("doc"), F.xxhash64("text").alias("copy"), F.posexplode(F.transform(lines_of(F.col("text")), key_of)).alias("pos", "key"))
    cut = cut.where(F.char_length("key") >= least_chars)
    return cut.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "copy", "pos")


class LineRuns:
    """Levels of sorted runs (h1, h2, doc: the key's owner) in the shared folder.

    buckets, the same for all runs: as many as shuffles have partitions, unless named.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or shuffle_width(spark)
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _save(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        sorted_keys = keys.select(*KEY, "doc").repartition(self.buckets, *KEY)
        sorted_keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{shared_dir(self.spark)}/tessera/{name}").saveAsTable(name)
        return name

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            full = self.levels[level]
            if len(full) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                both = self.spark.table(full[0])
                for t in full[1:]:
                    both = both.unionByName(self.spark.table(t))
                self.levels[level + 1].append(self._save(both))
                self.levels[level] = []
                self._forget(full)
            level += 1

    def _forget(self, tables: list[str]) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE {t}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/tessera/{t}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, lines: DataFrame) -> DataFrame:
        """Those of a batch's lines (as keyed_lines gives them) that stay in none of its documents; the batch's new keys become a run."""
        self._compact()
        firsts = lines.groupBy(*KEY).agg(F.min("doc").alias("doc"))
        for run in self.runs():
            firsts = firsts.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        own = self._save(firsts)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(own)
        return lines.join(self.spark.table(own), [*KEY, "doc"], "left_anti")

    def discard(self) -> None:
        """Deletes the runs. Nothing that is still to be computed may read them."""
        self._forget([t for level in self.levels for t in level])
        self.levels = []


def without_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept (what remains of the text) in place of all columns but doc_id. dropped: doc, copy, pos."""
    places = dropped.groupBy("doc", "copy").agg(F.collect_set("pos").alias("places"))  # no more than the lines of one text
    rows = docs.select("doc_id", "text", order_of(F.col("doc_id")).alias("doc"), F.xxhash64("text").alias("copy")).join(places, ["doc", "copy"], "left")
    rows = rows.select("doc_id", "text", "places", lines_of(F.col("text")).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.when(F.col("places").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, least_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: a row for each document. It goes in as this many batches in the order of doc_id, as days of a crawl would."""
    lines = written(keyed_lines(docs, least_chars), "lines")
    cuts = lines.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    edges = sorted(set(cuts or []))
    runs, dropped = LineRuns(docs.sparkSession, fanout), None
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        batch = lines if low is None else lines.where(F.col("doc") > low)
        batch = batch if high is None else batch.where(F.col("doc") <= high)
        gone = written(runs.add(batch).select("doc", "copy", "pos"), "lines-dropped")
        dropped = gone if dropped is None else dropped.unionByName(gone)
    runs.discard()
    return without_lines(docs, dropped)
