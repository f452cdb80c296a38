"""Language-model scoring by deleted interpolation.

The chance of a word after another mixes three estimates: the bigram's and the unigram's maximum likelihood, and one over
the number of word types plus one. The weights depend on the bucket (power of two) of how often the context occurs, and
are learned by expectation-maximisation on held-out counts: a tenth of the training texts, whose tokens are scored with
the counts of the rest. Scores then use the counts of all training texts.

Counting. Texts are packed into chunks of a bounded number of tokens, stored as word hashes and local word numbers. A
chunk asks once for each of its different words and bigrams: sorted 64-bit hashes, cut into ranges, shrunk to differences.
A task for each range adds up what the chunks hold and answers each with the totals in the order asked. So a word that
is everywhere is one entry of each chunk, a chunk's answers come back to it alone, and what is shuffled grows with the
different n-grams of the input. Every training token is counted; no table is capped.

Defined cases: a null text is empty: one end token; a very long text is read whole, into the
chunk at hand, which it ends; with no training text the counts are zero and so is every base score; a bucket that tuning
texts never met, and all of them if there are none, weighs bigram, unigram and uniform estimate 0.6, 0.3 and 0.1; repeated rows are counted and scored each; a null doc_id counts as empty text for folds; extra columns,
whatever their names, are ignored; an empty table gives an empty one; scores that tie need no order. Contexts before the first word are a token of their own that is not counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_width, written

#: Kinds of what a chunk asks for.
WORDS, BIGRAMS = 0, 1
END, BEGIN = np.uint64(0x1B873593CC9E2D51), np.uint64(0x52DCE729DA3ED6D3)
LAST_BUCKET = 48
CHUNK = "chunk long, tune boolean, n_words long, n_pairs long, doc_ids array<long>, trains binary, sizes binary, words binary, ids binary"


def pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) + len(x).to_bytes(8, "little") + x.dtype.str.encode().ljust(4)


def unpack(raw: bytes) -> np.ndarray:
    kind, n = np.dtype(raw[-4:].decode().strip()), int.from_bytes(raw[-12:-4], "little")
    return np.frombuffer(pa.decompress(raw[:-12], n * kind.itemsize, "zstd", asbytes=True), kind)


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending hashes as differences of six bytes, or eight if need be."""
    steps = np.diff(x, prepend=np.uint64(0))
    first, rest = int(x[0]), steps[1:]
    wide = len(rest) > 0 and int(rest.max()) >> 48
    body = rest.astype("<u8").tobytes() if wide else np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return bytes([8 if wide else 6]) + first.to_bytes(8, "little") + body


def unpack_sorted(raw: bytes) -> np.ndarray:
    width, body = raw[0], np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[0])
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :width] = body
    return np.cumsum(np.concatenate([[np.frombuffer(raw, "<u8", 1, 1)[0]], steps.view("<u8")[:, 0]]), dtype=np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a << np.uint64(7)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Chunk:
    """Texts of one task: the hashes of their words, of the end and of the begin, ascending, and each token's place among them."""

    def __init__(self, row: dict):
        self.words, self.ids = unpack(row["words"]), unpack(row["ids"]).astype(np.int64)
        self.sizes, self.trains = unpack(row["sizes"]).astype(np.int64), np.frombuffer(row["trains"], bool)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.context = np.concatenate([[0], self.ids[:-1]])
        begin = int(np.searchsorted(self.words, BEGIN))
        self.begin = begin
        self.context[self.first] = begin
        self.pair = self.context << 32 | self.ids
        self.counted = self.trains[self.doc]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes (ascending) of the different bigrams, how often each is in training texts, and each token's among them."""
        unique, inverse = np.unique(self.pair, return_inverse=True)
        hashes = mixed(self.words[unique >> 32], self.words[unique & 0xFFFFFFFF])
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[inverse]
        return hashes[order], np.bincount(at, weights=self.counted, minlength=len(order)).astype(np.int64), at

    def word_counts(self) -> np.ndarray:
        counts = np.bincount(self.ids, weights=self.counted, minlength=len(self.words)).astype(np.int64)
        counts[self.begin] = int(self.trains.sum())
        return counts


def _chunks(docs: DataFrame, held_out: Column, tuned: Column, chunk_tokens: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        held = {k: ([], [], [], [], {}) for k in (False, True)}  # by tune: doc ids, trains, sizes, local ids, words

        def flush(tune: bool):
            nonlocal serial
            names, trains, sizes, ids, local = held[tune]
            held[tune] = ([], [], [], [], {})
            digest = xxhash.xxh64_intdigest
            hashes = np.fromiter((digest(w, 42) for w in local), np.uint64, len(local))
            hashes = np.concatenate([hashes, [END, BEGIN]]).astype(np.uint64)
            ids = np.concatenate(ids)
            ids[ids < 0] = len(local)
            words, back = np.unique(hashes, return_inverse=True)
            ids = back[ids]
            n_pairs = len(ids)
            row = (serial, tune, len(words), n_pairs, names, np.array(trains, bool).tobytes(), pack(narrow(np.array(sizes))), pack(words), pack(narrow(ids)))
            serial += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4), strict=True)], ["chunk", "tune", "n_words", "n_pairs", "doc_ids", "trains", "sizes", "words", "ids"])

        size = {False: 0, True: 0}
        for batch in batches:
            for key, text, out, tune in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "out", "tune")), strict=True):
                names, trains, sizes, ids, local = held[tune]
                words = (text or "").encode().lower().split()
                for w in set(words).difference(local):
                    local[w] = len(local)
                own = np.fromiter(map(local.__getitem__, words), np.int64, len(words))
                names.append(key)
                trains.append(not out)
                sizes.append(len(words) + 1)
                ids.append(np.append(own, -1))
                size[tune] += len(words) + 1
                if size[tune] >= chunk_tokens:
                    yield flush(tune)
                    size[tune] = 0
        for tune in (False, True):
            if held[tune][0]:
                yield flush(tune)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("out"), F.coalesce(tuned & ~held_out, F.lit(False)).alias("tune"))
    return written(rows.mapInArrow(run, CHUNK), "lm-chunks")


def _asked(chunks: DataFrame, ranges: dict[int, int]) -> DataFrame:
    """A row for each chunk, kind and range that it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                hashes, counts, _ = chunk.pairs()
                for kind, h, n in ((WORDS, chunk.words, chunk.word_counts()), (BIGRAMS, hashes, counts)):
                    cuts = [(i << 64) // ranges[kind] for i in range(1, ranges[kind])]
                    edges = [0, *np.searchsorted(h, np.array(cuts, np.uint64)).tolist(), len(h)]
                    rows = [(row["chunk"], row["tune"], kind, r, pack_sorted(h[a:b]), pack(narrow(n[a:b]))) for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "tune", "kind", "range", "hashes", "counts"])

    return chunks.mapInArrow(run, "chunk long, tune boolean, kind int, range int, hashes binary, counts binary")


def _answered(asked: DataFrame) -> DataFrame:
    """For each row asked its totals: over all training texts, and for tuning chunks without the tuning texts too. A row with a null chunk has a range's sums."""

    def run(group: pa.Table) -> pa.Table:
        kind, at = group["kind"][0].as_py(), group["range"][0].as_py()
        chunks, tunes = group["chunk"].to_pylist(), group["tune"].to_pylist()
        hashes = [unpack_sorted(x) for x in group["hashes"].to_pylist()]
        counts = np.concatenate([unpack(x) for x in group["counts"].to_pylist()]).astype(np.int64)
        sizes = [len(x) for x in hashes]
        unique, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        del hashes
        every = np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.int64)
        tune = np.repeat(tunes, sizes)
        kept = every - np.bincount(inverse[tune], weights=counts[tune], minlength=len(unique)).astype(np.int64)
        rows, a = [], 0
        for chunk, tuned, n in zip(chunks, tunes, sizes, strict=True):
            own = inverse[a : a + n]
            rows.append((chunk, kind, at, pack(narrow(every[own])), pack(narrow(kept[own])) if tuned else None, None, None, None, None))
            a += n
        if kind == WORDS:
            real = unique != BEGIN
            rows.append((None, kind, at, None, None, int(every[real].sum()), int((every[real] > 0).sum()), int(kept[real].sum()), int((kept[real] > 0).sum())))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["chunk", "kind", "range", "every", "kept", "n", "v", "n_kept", "v_kept"])

    return written(asked.groupBy("kind", "range").applyInArrow(run, "chunk long, kind int, range int, every binary, kept binary, n long, v long, n_kept long, v_kept long"), "lm-answers")


@dataclass
class Mixture:
    """weights[bucket]: of the bigram, the unigram and the uniform estimate."""

    weights: np.ndarray


def bucket_of(context_counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context_counts + 1.0)), LAST_BUCKET).astype(np.int64)


def estimates(chunk: Chunk, at: np.ndarray, words: np.ndarray, pairs: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the bigram's and the unigram's maximum likelihood and the context's bucket."""
    context = words[chunk.context]
    two = np.divide(pairs[at], context, out=np.zeros(len(at)), where=context > 0)
    return two, words[chunk.ids] / max(1, total), bucket_of(context)


def learn(cells: list[tuple[int, int, int, int]], types: int, step: int, rounds: int = 60) -> Mixture:
    """Expectation-maximisation for each bucket over (bucket, bigram's and unigram's rounded -log2 by step, or -1 for zero, count)."""
    weights = np.tile(np.array([0.6, 0.3, 0.1]), (LAST_BUCKET + 1, 1))
    table = np.array(cells, np.int64).reshape(-1, 4)
    for b in range(LAST_BUCKET + 1):
        own = table[table[:, 0] == b]
        if not len(own):
            continue
        p = np.stack([np.where(own[:, k] < 0, 0.0, 2.0 ** (-own[:, k] / step)) for k in (1, 2)] + [np.full(len(own), 1 / (types + 1))], axis=1)
        n, w = own[:, 3].astype(float), weights[b]
        for _ in range(rounds):
            share = w * p
            share /= share.sum(axis=1, keepdims=True)
            w = (n[:, None] * share).sum(axis=0) / n.sum()
        w = np.maximum(w, [0, 0, 1e-4])  # what tuning never met must stay possible
        weights[b] = w / w.sum()
    weights[0] = [0.0, *(weights[0][1:] / weights[0][1:].sum())]  # an unseen context has no bigram
    return Mixture(weights)


def score_texts(docs: DataFrame, held_out: Column, chunk_tokens: int = 1_000_000, tune_share: float = 0.1, range_entries: int = 1_000_000, most_tasks: int = 20_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each document; learns from those not held_out."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    spark = docs.sparkSession
    tuned = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1000)) < int(1000 * tune_share)
    chunks = _chunks(docs, held_out, tuned, chunk_tokens)
    sums = chunks.agg(F.sum("n_words"), F.sum("n_pairs")).first()
    if sums[0] is None:
        return spark.createDataFrame([], schema)
    # as many ranges as keep a group's entries near range_entries; beyond most_tasks a task takes several, one after the other
    ranges = {kind: max(1, math.ceil(n / range_entries)) for kind, n in zip((WORDS, BIGRAMS), sums, strict=True)}
    answers = _answered(_asked(chunks, ranges).repartition(min(most_tasks, max(shuffle_width(spark), sum(ranges.values()))), "kind", "range"))
    totals = answers.where("chunk is null").agg(*(F.sum(c) for c in ("n", "v", "n_kept", "v_kept"))).first()
    total, types, total_kept, types_kept = (int(x or 0) for x in totals)
    step = 8

    def whole(right: pa.Table, kind: int, column: str) -> np.ndarray:
        rows = sorted((r["range"], r[column]) for r in right.select(["kind", "range", column]).to_pylist() if r["kind"] == kind)
        return np.concatenate([unpack(x) for _, x in rows]).astype(np.int64)

    def tune(left: pa.Table, right: pa.Table) -> pa.Table:
        cells: dict[tuple, int] = {}
        for row in left.to_pylist():
            chunk = Chunk(row)
            _, _, at = chunk.pairs()
            two, one, bucket = estimates(chunk, at, whole(right, WORDS, "kept"), whole(right, BIGRAMS, "kept"), total_kept)
            rounded = [np.where(p > 0, np.round(-np.log2(np.where(p > 0, p, 1)) * step), -1).astype(np.int64) for p in (two, one)]
            unique, n = np.unique(np.stack([bucket, *rounded], axis=1), axis=0, return_counts=True)
            for key, k in zip(map(tuple, unique.tolist()), n.tolist(), strict=True):
                cells[key] = cells.get(key, 0) + k
        cols = list(zip(*((*k, n) for k, n in cells.items()), strict=True)) if cells else [()] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["bucket", "two", "one", "n"])

    joined = lambda where: chunks.where(where).groupBy("chunk").cogroup(answers.where("chunk is not null").select("chunk", "kind", "range", "every", "kept").where("kept is not null" if where == "tune" else "true").groupBy("chunk"))
    cells = joined("tune").applyInArrow(tune, "bucket int, two int, one int, n long").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    mixture = learn([tuple(r) for r in cells.collect()], types_kept, step)  # buckets by two rounded logarithms: bounded

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            chunk = Chunk(row)
            _, _, at = chunk.pairs()
            words = whole(right, WORDS, "every")
            two, one, bucket = estimates(chunk, at, words, whole(right, BIGRAMS, "every"), total)
            w = mixture.weights[bucket]
            p = w[:, 0] * two + w[:, 1] * one + w[:, 2] / (types + 1)
            n = len(chunk.sizes)
            add = lambda x, c=chunk, n=n: np.bincount(c.doc, weights=x, minlength=n)
            base = np.log10((words[chunk.ids] + 0.5) / (total + 0.5 * (types + 1)))
            out.append(pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(~chunk.trains), pa.array(chunk.sizes), pa.array(add(words[chunk.ids] > 0).astype(np.int64)), pa.array(np.full(n, total)), pa.array(add(base)), pa.array(add(np.log10(p)))], [f.split()[0] for f in schema.split(", ")]))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)], [f.split()[0] for f in schema.split(", ")])

    return joined("true").applyInArrow(score, schema)
