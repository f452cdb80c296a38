"""Approximate nearest neighbours: inverted lists, scanned dimension block by dimension block.

Index. Vectors are turned by a random rotation and put in the list of their nearest centroid (k-means on a bounded
sample; every row is indexed). Equal vectors are kept once, with their smallest ids: only as many as a result can hold.
Lists are packed onto shelves of a bounded number of vectors; a larger list is spread over several by a hash.

Search. A query goes once to each shelf that holds any of its nearest lists, and is compared with these lists there. Their
vectors lie by columns; partial distances are updated a column block at a time. After d of D rotated dimensions, a
candidate whose partial squared distance exceeds (d/D) (1 + eps/sqrt(d))^2 times the squared distance of the k-th best so
far is given up: under a random rotation it is then unlikely to be nearer. The first bound comes from the sample, whose
rows are rows of the index too. Survivors are measured again on the original vectors, in double precision.

Work. A query is compared with `probes` of the rows, so that work grows with queries times rows. Where vectors are spread
evenly over many dimensions no lists avoid that (the figures are in the README); where they cluster, a small share will do.

Defined cases: vectors that are null, zero, hold a null or a non-finite number, or differ in length from most (of the
lengths that are most frequent, the longest) take no part, as rows with a null id; a repeated row counts once, and rows
that share an id but not a vector are candidates and queries each; with fewer candidates than k, all; ties go to the smaller
id; extra columns, whatever their names, are ignored; empty in, empty out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_width, thinned, written


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return good.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def centroids_of(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_lists(sample, centers, 1)[:, 0]
        sums, counts = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, sample)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
        if (~full).any():
            centers[~full] = sample[rng.choice(len(sample), int((~full).sum()), replace=True)]
    return centers


def nearest_lists(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """Indices of each row's n nearest centers, in no order."""
    norms, out = (centers**2).sum(1), []
    for i in range(0, len(x), 1024):
        d = norms - 2 * (x[i : i + 1024] @ centers.T)
        out.append(np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centers) else np.tile(np.arange(len(centers)), (len(d), 1)))
    return np.concatenate(out) if out else np.zeros((0, n), int)


def scan_block(columns: np.ndarray, query: np.ndarray, k: int, bound: float, step: int, eps: float) -> np.ndarray:
    """Rows of a block (dimensions by vectors) that may be among the k nearest within the squared distance bound."""
    dims, n = columns.shape
    alive = np.arange(n)
    # a first few in full, for a bound of the block's own
    if n > 4 * k:
        head = ((columns[:, : 2 * k] - query[:, None]) ** 2).sum(0)
        bound = min(bound, float(np.partition(head, k - 1)[k - 1]))
    partial = np.zeros(n)
    for d in range(0, dims, step):
        part = columns[d : d + step] if len(alive) == n else columns[d : d + step, alive]
        partial += ((part - query[d : d + step, None]) ** 2).sum(0)
        done = min(dims, d + step)
        limit = bound * (done / dims) * (1 + eps / math.sqrt(done)) ** 2 if done < dims else bound
        near = partial <= limit * (1 + 1e-9)
        if not near.all():
            alive, partial = alive[near], partial[near]
            if not len(alive):
                break
    if len(alive) > k:
        kth = np.partition(partial, k - 1)[k - 1]
        alive = alive[partial <= kth * (1 + 1e-9)]
    return alive


def shelved(sizes: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """For each list its shelves, first to end: small lists share one up to block vectors, a larger one has several of its own."""
    out, shelf, filled = {}, 0, 0
    for c, n in sorted(sizes.items()):
        if n > block:
            shelf += filled > 0
            out[c] = (shelf, shelf + math.ceil(n / block))
            shelf, filled = out[c][1], 0
            continue
        if filled + n > block:
            shelf, filled = shelf + 1, 0
        out[c] = (shelf, shelf + 1)
        filled += n
    return out


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, probes: float = 0.33, least_probes: int = 72, sample: int = 16_384, max_lists: int = 4096, block: int = 4096, step: int = 8, eps: float = 2.1, seed: int = 7) -> DataFrame:
    """query_id, rank, <id_col>, score: the k nearest found of each row that is_query (on the column id) holds for.

    probes is the share of the lists a query visits (least_probes of them at least); a list has 16 vectors, or as many as max_lists and the sample allow.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col), "ann-rows")
    total = rows.count()
    out_schema = f"query_id long, rank int, {id_col} long, score double"
    if not total:
        return spark.createDataFrame([], out_schema)
    drawn = thinned(rows, F.xxhash64("id", F.lit(seed)), sample, total).orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).select("v").toArrow()["v"].to_pylist()
    # numbers are kept as they come, so that distances are those of the original vectors
    kind = np.dtype("<f4" if "array<float>" in dict(vectors.dtypes)[vector_col] else "<f8")
    distinct = np.unique(np.array(drawn, kind).astype(np.float64), axis=0)
    dims, turn = distinct.shape[1], rotation(distinct.shape[1], seed)
    turned = distinct @ turn
    lists = max(1, min(max_lists, total // 16, len(turned) // 8 or 1))
    centers = centroids_of(turned, lists, 8, seed)
    lists, keep = len(centers), k + 1
    visit = min(lists, max(least_probes, math.ceil(lists * probes)))

    def reduce_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In front of the shuffle: for each vector of a batch its smallest ids, and its queries in pieces."""
        for b in batches:
            seen: dict[bytes, tuple[list, list]] = {}
            raw = np.array(b.column("v").to_pylist(), kind).reshape(b.num_rows, dims) + kind.type(0)
            for x, i, q in zip(raw, b.column("id").to_pylist(), b.column("q").to_pylist(), strict=True):
                own = seen.setdefault(x.tobytes(), ([], []))
                own[0].append(i)
                if q:
                    own[1].append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([sorted(set(x[0]))[:keep] for x in seen.values()], pa.list_(pa.int64())), pa.array([sorted(set(x[1])) for x in seen.values()], pa.list_(pa.int64()))], ["x", "ids", "queries"])

    parts = rows.withColumn("q", is_query).mapInArrow(reduce_ids, "x binary, ids array<long>, queries array<long>")
    parts = written(parts, "ann-parts")
    once = parts.groupBy("x").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"), F.max(F.size("queries") > 0).alias("asked"))

    def enlist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), kind).reshape(-1, dims).astype(np.float64) @ turn
            near = nearest_lists(x, centers, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("ids"), b.column("asked"), pa.array(near, pa.int32())], ["x", "ids", "asked", "list"])

    index = written(once.mapInArrow(enlist, "x binary, ids array<long>, asked boolean, list int"), "ann-index")
    sizes = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}  # a row for each list, max_lists at most
    shelves = shelved(sizes, block)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("x").to_pylist()
            x = np.frombuffer(b"".join(raw), kind).reshape(-1, dims).astype(np.float64) @ turn
            near, rows = nearest_lists(x, centers, visit), []
            for i in range(len(raw)):
                d = ((turned - x[i]) ** 2).sum(1)
                bound = float(np.partition(d, keep - 1)[keep - 1]) if len(d) > keep else float("inf")
                # the nearest lists are searched without that bound until they hold enough for a full result
                seen, bounds, asked = 0, {}, {}
                for c in near[i][np.argsort(((centers[near[i]] - x[i]) ** 2).sum(1), kind="stable")].tolist():
                    for shelf in range(*shelves.get(c, (0, 0))):
                        bounds[shelf] = max(bounds.get(shelf, 0.0), bound * (1 + 1e-9) if seen >= keep else float("inf"))
                        asked.setdefault(shelf, []).append(c)
                    seen += sizes.get(c, 0)
                rows += [(raw[i], bounds[shelf], sorted(lists), shelf) for shelf, lists in asked.items()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.float64(), pa.list_(pa.int32()), pa.int32()), strict=True)], ["x", "bound", "lists", "shelf"])

    def scan(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("list", kind="stable")
            raw = np.frombuffer(b"".join(right["x"]), kind).reshape(-1, dims).astype(np.float64)
            columns = np.ascontiguousarray((raw @ turn).T)
            ids, own = list(right["ids"]), right["list"].to_numpy()
            for x, bound, wanted in zip(left["x"], left["bound"], left["lists"], strict=True):
                q = np.frombuffer(x, kind).astype(np.float64)
                begins, ends = np.searchsorted(own, wanted), np.searchsorted(own, wanted, side="right")
                some = np.concatenate([np.arange(i, j) for i, j in zip(begins, ends, strict=True)])
                whole = len(some) == len(own)
                found = scan_block(columns if whole else columns[:, some], q @ turn, keep, bound, step, eps)
                found = found if whole else some[found]
                exact = np.sqrt(((raw[found] - q) ** 2).sum(1))
                best = sorted((float(e), int(i)) for e, j in zip(exact, found, strict=True) for i in ids[j])[:keep]
                out.append((x, [b[1] for b in best], [b[0] for b in best]))
        return pd.DataFrame(out, columns=["x", "ids", "scores"])

    asked = index.where("asked").select("x").mapInArrow(ask, "x binary, bound double, lists array<int>, shelf int")
    place = F.create_map(*[F.lit(y) for c, (first, end) in shelves.items() for y in (c, (end - first) << 32 | first)])[F.col("list")]
    held = index.withColumn("shelf", (place.bitwiseAND(F.lit((1 << 32) - 1)) + F.pmod(F.xxhash64("x"), F.shiftright(place, 32))).cast("int")).select("x", "ids", "list", "shelf")
    width = shuffle_width(spark)
    found = asked.repartition(width, "shelf").groupBy("shelf").cogroup(held.repartition(width, "shelf").groupBy("shelf")).applyInPandas(scan, "x binary, ids array<long>, scores array<double>")
    best = found.groupBy("x").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("scores").alias("score"), F.col("ids").alias("id"))))), 1, keep).alias("near"))
    best = written(best, "ann-best")
    queries = parts.where(F.size("queries") > 0).select("x", F.explode("queries").alias("query_id")).distinct()
    own = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k)
    return queries.join(best, "x").select("query_id", F.posexplode(own).alias("pos", "n")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.id").alias(id_col), F.col("n.score").alias("score"))
