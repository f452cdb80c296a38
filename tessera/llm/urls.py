"""URL filter by a sort-merge range join.

A host is written backwards, label by label and with a closing dot ("net.example.blog."), so that a rule's host and all
its subdomains are one interval of the sorted keys. Pages and rules are cut into ranges of keys at the quantiles of a
bounded sample; a rule goes to each range that its interval meets. Every range is sorted and swept once with a stack of
the rules whose intervals are still open; these are nested, so the stack holds what fits the host at hand, and a rule on
it wins if it is the longest whose path is a prefix of the page's: an entry of the stack knows its rules by path and the
lengths of these, so a page costs as many look-ups as there are different lengths, not rules. Pages of one host are dealt over ranges by a hash, so
a hot host, even a hot url, is spread over tasks.

Defined cases: a url that is null or has no "://" has empty host and path and fits no rule; repeated rows are judged
each; rules that tie in length are ordered by the longer host, then block before allow; an empty rule list gives every
page the default verdict; a very long url is judged whole; extra columns, whatever their names, are ignored; an empty table gives
an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_width, thinned

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    after = F.substring(url, F.length(F.substring_index(url, "://", 1)) + 4, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) == 0, "").otherwise(F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER))


def url_path(url: Column) -> Column:
    after = F.substring(url, F.length(F.substring_index(url, "://", 1)) + 4, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) == 0, "").otherwise(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1))


def host_key(host: Column) -> Column:
    """The labels in reverse order, each with a closing dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def rules_frame(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, action) with action allow or block."""
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, action string")


class Open:
    """The rules of an open interval's host: by path, and how long their paths are, longest first."""

    def __init__(self, key: str):
        self.key, self.paths, self.lengths = key, {}, []

    def add(self, host: str, path: str, action: str) -> None:
        if path not in self.paths or action == "block":  # of rules that tie, block
            self.paths[path] = (host, action)
        if (n := -len(path)) not in self.lengths:
            insort(self.lengths, n)

    def longest(self, path: str) -> str | None:
        return next((path[:-n] if n else "" for n in self.lengths if -n <= len(path) and (path[:-n] if n else "") in self.paths), None)


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []  # each entry's key is a prefix of the next one's
        for batch in batches:
            out = []
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for pid, key, kind, page_id, host, path, action in zip(*cols, strict=True):
                if pid != at:
                    at, stack = pid, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(Open(key))
                    stack[-1].add(host, path, action)
                    continue
                rule, verdict, most = None, default, (-1, -1)
                for entry in stack if host else ():
                    if (p := entry.longest(path)) is not None:
                        own, action = entry.paths[p]
                        if (size := (len(own) + len(p), len(own))) > most:
                            rule, verdict, most = own + p, action, size
                out.append((page_id, host, path, rule, verdict))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["page_id", "host", "path", "rule", "verdict"])

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", sample: int = 8192) -> DataFrame:
    """page_id, host, path, rule, verdict: a row for each page. sample bounds the keys that fix the ranges."""
    url = F.col("url")
    left = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), F.monotonically_increasing_id().alias("row"))
    left = left.select(host_key(F.col("host")).alias("key"), F.xxhash64("page_id", "row").alias("h"), "page_id", "host", "path")
    right = rules.where("host is not null and host <> ''").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lower("action").alias("action")).distinct()
    right = right.select(host_key(F.col("host")).alias("key"), "host", "path", "action")
    width = shuffle_width(pages.sparkSession)
    keys = left.select("key", "h", F.xxhash64("h").alias("o"))
    drawn = sorted((r.key, r.h) for r in thinned(keys, F.col("o"), sample, pages.count()).orderBy("o").limit(sample).collect())
    bounds = [drawn[len(drawn) * i // width] for i in range(1, width)] if len(drawn) >= width else drawn

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, h = batch.column("key").to_pylist(), batch.column("h").to_pylist()
            pid = pa.array([bisect_right(bounds, x) for x in zip(keys, h, strict=True)], pa.int32())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pid, batch.column("key"), pa.array([1] * n, pa.int32()), *(batch.column(c) for c in ("page_id", "host", "path")), pa.nulls(n, pa.string())], names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(pid, key, 0, None, host, path, action) for key, host, path, action in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "path", "action")), strict=True) for pid in range(bisect_left(bounds, (key, -(1 << 63))), bisect_left(bounds, (key[:-1] + "/", -(1 << 63))) + 1)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = ["pid", "key", "kind", "page_id", "host", "path", "action"]
    types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
    schema = "pid int, key string, kind int, page_id long, host string, path string, action string"
    both = left.mapInArrow(place, schema).unionByName(right.mapInArrow(spread, schema))
    return both.repartition(width, "pid").sortWithinPartitions("pid", "key", "kind").mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")
