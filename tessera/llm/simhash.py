"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has bit i set if more than half of its word shingles' hashes have it set. Equal fingerprints are
one node. Nodes that can be within the radius meet in buckets; in a bucket, fingerprints are stored by bit plane, and the
distances of one fingerprint to 64 others are counted at once in carry-save counters held in machine words: plane by
plane, the differing bits ripple through the counter's words, a last word remembers what passed the radius, and a block
of comparisons is abandoned as soon as it is full.

Small radius (fingerprint_groups). By the pigeonhole principle two fingerprints within r bits agree on all but r of
their blocks, so each is filed under every choice of blocks. A bucket with many nodes is filed again under finer
choices of its remaining bits, down to keys that leave at most 2^16 different fingerprints: no bucket is unbounded
and none is cut short. Buckets emit the edges of a spanning forest, not all pairs.

Similarity (similar_groups). For a Jaccard similarity of word shingles as low as 0.8, 64-bit fingerprints differ in up
to a quarter of their bits, too many for the pigeonhole: there, nodes meet in MinHash bands of the same shingles (28
of five rows: they find a pair of similarity 0.8 with a chance of 0.99998). A first round, over some of the bands, pairs
each with its bucket's smallest node and with its two nearest by bit-sliced comparison, and verifies by exact Jaccard
similarity: this links most of what belongs together. Of all bands, buckets whose nodes are then still in several classes are decided whole: every pair of different
classes is verified, after a bound on the similarity (sizes, and bits in which maps of the sets' parities differ) that
never refuses a pair that reaches it. So whatever shares a band and is similar enough is linked.

Defined cases: no words (null or blank text) gives fingerprint zero and is linked like any other; fewer words than a
shingle make one shingle; a very long text is read whole; repeated rows get the same class; nearest fingerprints that tie
go by node; a null doc_id takes part in linking but never names a
class; extra columns are ignored (or passed through by keep_representatives); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, shuffle_width, written
from tessera.llm.components import connected_components

SEED = 42
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the ASCII white space that bytes.split() knows: 0x20 and 0x09 to 0x0D."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - n + 1].tolist()
    stops = (ends[n - 1 :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 planes by words of 64 fingerprints; the last word is padded with zeros."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros(((n + 63) // 64 * 64, 64), np.uint8)
    padded[:n] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view("<u8").reshape(64, -1)


def within_radius(queries: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """Bit masks (queries by words) of the fingerprints within the radius of each query.

    Bit-sliced: counters[k] holds bit k of 64 distances; what overflows the radius sticks in `over`.
    """
    bits = max(1, radius.bit_length())
    rows, lanes = len(queries), planes.shape[1]
    live = np.arange(rows)
    over = np.zeros((rows, lanes), np.uint64)
    start = (1 << bits) - 1 - radius  # counters start here, so that they overflow just beyond the radius
    counters = [np.full((rows, lanes), FULL if start >> k & 1 else 0, np.uint64) for k in range(bits)]
    result = np.zeros((rows, lanes), np.uint64)
    for p in range(64):
        bit = (queries[live] >> np.uint64(p)) & np.uint64(1)
        carry = planes[p][None, :] ^ np.where(bit[:, None] == 1, FULL, np.uint64(0))
        for k in range(bits):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 8 == 7 and p < 63:  # abandon the queries whose every lane is beyond the radius
            some = (over != FULL).any(axis=1)
            if not some.any():
                return result
            if not some.all():
                live, over = live[some], over[some]
                counters = [c[some] for c in counters]
    result[live] = ~over
    return result


def forest(fps: np.ndarray, radius: int, tile: int = 512) -> list[tuple[int, int]]:
    """Edges (indices) of a spanning forest of the fingerprints within the radius of each other."""
    n = len(fps)
    labels, edges = np.arange(n), []

    def join(i: int, near: np.ndarray) -> None:
        for root, first in zip(*np.unique(labels[near], return_index=True), strict=True):
            if root != labels[i]:
                edges.append((i, int(near[first])))
                labels[labels == root] = labels[i]

    planes = planes_of(fps)
    last = np.uint64((1 << (n - 1) % 64 + 1) - 1) if n % 64 else FULL
    for at in range(0, n, tile):
        near = within_radius(fps[at : at + tile], planes[:, at // 64 :], radius)
        near[:, -1] &= last
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            js = np.flatnonzero(np.unpackbits(near[i].view(np.uint8), bitorder="little")) + at // 64 * 64
            js = js[js > at + i]
            if len(js):
                join(at + i, js)
    return edges


def _keys(fp: Column, radius: int, blocks: int, bits: int = 64) -> list[Column]:
    """A key for each choice of the blocks that agree, the choice's number in front."""
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        out.append(F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return out


def _bucket_edges(rows: DataFrame, keys: list[str], radius: int, together: int = 1024) -> DataFrame:
    """rows: keys..., fp. Sorted buckets stream through a task; small ones share a set of planes.

    What is within the radius is linked, of one bucket or not: links are decided by distance alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close():
            if len(held) < 2:
                return [], []
            fps = np.array(held, np.int64).view(np.uint64)
            pairs = forest(fps, radius)
            return [held[i] for i, _ in pairs], [held[j] for _, j in pairs]

        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            cols = [batch.column(k).to_pylist() for k in keys]
            for key, fp in zip(zip(*cols, strict=True), batch.column("fp").to_pylist(), strict=True):
                if key != at:
                    if len(held) >= together:
                        x, y = close()
                        a += x
                        b += y
                        held = []
                    at = key
                held.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        x, y = close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])
        give_back()

    width = shuffle_width(rows.sparkSession)
    return rows.repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def fingerprint_edges(nodes: DataFrame, radius: int, blocks: int, full: int) -> DataFrame:
    """Links a, b between different fingerprints (column fp of nodes) within the radius: a spanning forest of each bucket."""
    filed = nodes.select("fp", F.explode(F.array(*_keys(F.col("fp"), radius, blocks))).alias("k")).select("fp", "k.*")
    counts = filed.groupBy("choice", "key").count().where("count > 1")
    filed = written(filed.join(counts, ["choice", "key"]), "simhash-buckets")
    small = _bucket_edges(filed.where(F.col("count") <= full).select("choice", "key", "fp"), ["choice", "key"], radius)
    large = filed.where(F.col("count") > full)
    if large.isEmpty():
        return small
    # within a bucket the fingerprints differ in the blocks left out alone: these are cut finer, with 16 bits left to differ
    fine = large.select("choice", "key", "fp", F.explode(F.array(*_keys(F.col("fp"), radius, 8))).alias("k")).select("choice", "key", F.col("k.choice").alias("finer"), F.col("k.key").alias("fine_key"), "fp")
    again = fine.groupBy("choice", "key", "finer", "fine_key").count().where("count > 1").drop("count")
    fine = written(fine.join(again, ["choice", "key", "finer", "fine_key"]), "simhash-fine").drop("choice", "key").distinct()
    return small.unionByName(_bucket_edges(fine, ["finer", "fine_key"], radius))


def fingerprints(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(words_of(t), shingle_words)) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def fingerprint_groups(docs: DataFrame, shingle_words: int = 3, radius: int = 2, blocks: int | None = None, full: int = 2048) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the fingerprints linked to its own): a row for each document."""
    found = written(fingerprints(docs, shingle_words), "simhash-docs")
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    links = connected_components(fingerprint_edges(nodes, radius, blocks or radius + 2, full), "a", "b").withColumnRenamed("node", "fp")
    linked = nodes.join(links, "fp")
    names = linked.groupBy("component").agg(F.min("least").alias("name"))
    named = linked.join(names, "component").select("fp", "name")
    classes = written(nodes.join(named, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id")), "simhash-classes")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


BANDS, ROWS, FIRST = 28, 5, 6  # the first few bands' buckets are paired before all are decided


def _minhash_factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


FACTORS, TERMS = _minhash_factors()


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of MinHash rows."""
    least = np.full(BANDS * ROWS, FULL, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * FACTORS + TERMS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ rows[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _similar_buckets(nodes: DataFrame) -> DataFrame:
    """band, key, node, fp, n, first: the nodes of each band's buckets of two or more."""
    filed = nodes.select("node", "fp", F.posexplode("bands").alias("band", "key"))
    counts = filed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    return written(filed.join(counts, "key"), "similar-buckets")


def _similar_pairs(filed: DataFrame, radius: int, tile: int, nearest: int = 2) -> DataFrame:
    """The first round's pairs a, b of nodes: each with its bucket's smallest, and with its nearest few in its part of the bucket."""
    filed = filed.where(F.col("band") < FIRST)
    stars = filed.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, fps = None, [], []

        def close():
            if len(ids) < 3:
                return [], []
            x = np.array(fps, np.int64).view(np.uint64)
            a, b, planes = [], [], planes_of(x)
            last = np.uint64((1 << (len(x) - 1) % 64 + 1) - 1) if len(x) % 64 else FULL
            for t in range(0, len(x), 512):
                near = within_radius(x[t : t + 512], planes, radius)
                near[:, -1] &= last
                for i in range(len(near)):
                    bits = np.flatnonzero(np.unpackbits(near[i].view(np.uint8), bitorder="little"))
                    bits = bits[bits != t + i]
                    for j in bits[np.argsort(np.bitwise_count(x[bits] ^ x[t + i]), kind="stable")[:nearest]].tolist():
                        a.append(ids[t + i])
                        b.append(ids[j])
            return a, b

        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for key, part, node, fp in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "node", "fp")), strict=True):
                if (key, part) != at:
                    x, y = close()
                    a += x
                    b += y
                    at, ids, fps = (key, part), [], []
                ids.append(node)
                fps.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        x, y = close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])
        give_back()

    parts = filed.where("n > 2").select("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / tile)).alias("part"), "node", "fp")
    near = parts.repartition(shuffle_width(filed.sparkSession), "key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(run, "a long, b long")
    return stars.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def parities(sets: list[np.ndarray], words: int) -> np.ndarray:
    """A map of 64 * words bits for each set: the parity of the members in each slot. Two maps differ in no more bits than the sets in members."""
    bits = np.stack([np.bincount((s % s.dtype.type(64 * words)).astype(np.int64), minlength=64 * words) & 1 for s in sets]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def similar_forest(sets: list[np.ndarray], labels: np.ndarray, parts: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Edges (indices) between different labels that join all sets of at least this Jaccard similarity. Sets are sorted.

    Every pair is decided, unless edges or labels connect it already; given parts, every pair of different parts.
    """
    labels, edges = labels.copy(), []
    sizes = np.array([len(s) for s in sets])
    maps = parities(sets, max(1, int(sizes.max()) // 8))
    share = (1 - similarity) / (1 + similarity)  # of both sizes: what may differ
    for i in range(len(sets) - 1):
        open_ = labels[i + 1 :] != labels[i]
        if parts is not None:
            open_ &= parts[i + 1 :] != parts[i]
        most = share * (sizes[i + 1 :] + sizes[i]) + 1e-6
        js = np.flatnonzero(open_ & (np.abs(sizes[i + 1 :] - sizes[i]) <= most))
        differ = np.bitwise_count(maps[js + i + 1] ^ maps[i]).sum(axis=1, dtype=np.int64)
        for j in (js[differ <= most[js]] + i + 1).tolist():
            if labels[j] != labels[i]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (sizes[i] + sizes[j] - both):
                    edges.append((i, j))
                    labels[labels == labels[j]] = labels[i]
    return edges


def _rest_of_buckets(filed: DataFrame, sets: DataFrame, found: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Links a, b that the first round's classes (found: node, component) lack, from the buckets that hold several classes.

    Buckets of the same nodes are decided once. A bucket of more than tile nodes is cut into parts, and each node filed
    under every pair of parts that has its own: tasks take bounded groups, and all parts are compared with each other.
    """
    members = filed.where((F.col("n") > 2) | (F.col("band") >= FIRST)).join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    several = members.groupBy("key", "n").agg(F.expr("min(component) <> max(component)").alias("several"), F.expr("bit_xor(xxhash64(node))").alias("same")).where("several")
    several = several.groupBy("n", "same").agg(F.min("key").alias("key")).select("key")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / tile))
    cut = members.join(several, "key").select("key", "node", "component", F.ceil(F.col("n") / tile).alias("cuts"), part.alias("part"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("other")
    rows = cut.join(sets, "node").select("key", "node", "component", "s", "part", other)
    rows = rows.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "component", "s")
    group = ["key", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, labels, parts, held = None, [], [], [], []

        def close():
            if len(ids) < 2:
                return [], []
            across = np.array(parts) if at[1] != at[2] else None
            edges = similar_forest([np.frombuffer(s, "<u8") for s in held], np.array(labels, np.int64), across, similarity)
            return [ids[i] for i, _ in edges], [ids[j] for _, j in edges]

        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for key, low, high, part, node, component, s in zip(*(batch.column(c).to_pylist() for c in (*group, "part", "node", "component", "s")), strict=True):
                if (key, low, high) != at:
                    x, y = close()
                    a += x
                    b += y
                    at, ids, labels, parts, held = (key, low, high), [], [], [], []
                ids.append(node)
                labels.append(component)
                parts.append(part)
                held.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        x, y = close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])
        give_back()

    return rows.repartition(shuffle_width(filed.sparkSession), *group).sortWithinPartitions(*group, "node").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, radius: int = 20, tile: int = 256) -> DataFrame:
    """doc_id, copy (a hash of the text, which tells texts of one doc_id apart), component_id: classes of documents linked by a Jaccard similarity of their sets of word shingles of at least this."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                hashes = shingle_hashes(words, shingle_words)
                out.append((xxhash.xxh64_intdigest(b" ".join(words), 1), fingerprint(hashes), band_keys(hashes).view(np.int64)))
            node, fp, bands = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)), pa.array(list(bands), pa.list_(pa.int64()))], ["doc_id", "copy", "node", "fp", "bands"])
        give_back()

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sets = [], []
            for want, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                own = int(np.int64(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 1)).astype(np.int64)))
                if want is None or own == want:
                    node.append(own)
                    sets.append(np.unique(shingle_hashes(words, shingle_words)).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], ["node", "s"])
        give_back()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        give_back()

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(base.withColumn("copy", F.xxhash64("text")).mapInArrow(sign, "doc_id long, copy long, node long, fp long, bands array<long>"), "similar-docs")
    nodes = written(signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "similar-nodes")
    filed = _similar_buckets(nodes)
    pairs = written(_similar_pairs(filed, radius, tile), "similar-pairs")
    # those too that meet in a later band alone
    active = filed.select("node").distinct().join(nodes.select("node", "least"), "node").select("node", F.col("least").alias("doc_id"))
    named = base.join(active, "doc_id").select("node", "text").mapInArrow(shingle, "node long, s binary")
    # texts that have no doc_id at all are found by their node
    nameless = base.where("doc_id is null").select(F.lit(None).cast("long").alias("node"), "text").mapInArrow(shingle, "node long, s binary")
    nameless = nameless.join(active.where("doc_id is null").select("node"), "node", "left_semi")
    sets = written(named.unionByName(nameless).dropDuplicates(["node"]), "similar-sets")
    both = pairs.join(sets.withColumnRenamed("node", "a"), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
    links = written(both.mapInArrow(verify, "a long, b long"), "similar-links")
    rest = written(_rest_of_buckets(filed, sets, connected_components(links, "a", "b"), similarity, tile), "similar-rest")
    links = connected_components(links.unionByName(rest), "a", "b")
    linked = nodes.select("node", "least").join(links, "node")
    names = linked.groupBy("component").agg(F.min("least").alias("name"))
    named = linked.join(names, "component").select("node", "name")
    classes = written(nodes.select("node", "least").join(named, "node", "left").select("node", F.coalesce("name", "least").alias("component_id")), "similar-classes")
    return signed.select("doc_id", "copy", "node").join(classes, "node").select("doc_id", "copy", "component_id")


def keep_representatives(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names their text's class, equal rows once: of a doc_id with several texts those stay whose own class it names.

    Rows with a null doc_id, which can't name one, all stay.
    """
    chosen = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__of"), F.col("copy").alias("__copy")).distinct()
    named = docs.join(chosen, (F.col("doc_id") == F.col("__of")) & (F.xxhash64("text") == F.col("__copy")), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))
