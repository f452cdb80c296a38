"""Phrase collocations of each language, by hierarchical naming of pairs.

Texts are packed into chunks of tokens. A chunk asks once for each different word; words that are frequent over all
chunks get a name (an id). Then, length by length, every two adjacent names at places i and i + 1, the (k-1)-grams that
start there, are a pair, and frequent pairs get names of their own: a k-gram's name is that of its first and its last
k - 1 words. A k-gram is frequent only if both of these are, so what is asked for shrinks with k and nothing is lost. The
names' table holds both parents: following them gives a phrase's words, the counts of both sides of every cut, and which
phrases a longer one covers. As a longer phrase is no more frequent than any between, looking one word further is enough.

Where the work is: a word or pair, however frequent, is one row of each chunk; these rows meet by one shuffle, in which a
key's group is no larger than the number of chunks. There it is counted and, if frequent, named by the first place where
it is asked for; only the rows of frequent keys go back to their chunks. Pairs travel in lists, one for each left name of a
chunk; a name that is frequent over all has its right neighbours in buckets, the more the more frequent it is.

Defined cases: a null text is empty and has no words; a null lang is the language `und`; a text is never cut, so a chunk
holds `chunk_tokens` tokens and one text more at most; rows that repeat count each; phrases with equal score and count are
ranked by their bytes; a null doc_id matters nowhere; extra columns, whatever their names, are ignored; an empty table, or
one without frequent pairs, gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import give_back, shuffle_width, written
from tessera.llm.lm import pack, unpack
from tessera.sources.store import discard

#: A byte that UTF-8 never has stands for the end of a piece.
GAP = b"\xff"
ENDS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + GAP * len(ENDS) + b" ")
SLICE = 100_000
#: Places of a chunk whose pairs are sorted at once: what that takes doesn't grow with the chunk.
PART = 500_000
#: A place is a chunk's number over that of a word or pair in it; a chunk's number is its task's over its own in the task.
PLACE_BITS, SERIAL_BITS = 31, 11
WORD_ROWS = "chunk long, size int, seq binary, local int, n long, lang string, word string"
SENT = ["chunk", "size", "seq", "first", "way", "lefts", "rights", "ns"]
#: Rows of pairs that go to Spark at once.
SENT_ROWS = 1000
PAIR_ROWS = "chunk long, size int, seq binary, first int, way int, lefts array<long>, rights array<long>, ns array<int>"
#: A name found over 2^SPLIT_BITS times has its right neighbours in buckets, so that no row or group of a frequent name is large.
SPLIT_BITS, MOST_BITS = 14, 20


def _packed(seq: np.ndarray) -> bytes:
    """Local numbers by planes of bytes, which are alike."""
    return pack(np.ascontiguousarray(seq.astype("<i4").view(np.uint8).reshape(-1, 4).T).ravel())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(raw).reshape(4, -1).T).view("<i4").ravel()


def _own_row(chunk: int, seq: np.ndarray, size: int, asked: dict[str, pa.Array]) -> pa.RecordBatch:
    """A chunk's own row, with the local number at each place (-1: none)."""
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([size], pa.int32()), pa.array([_packed(seq)], pa.binary()), *(pa.nulls(1, x.type) for x in asked.values())], ["chunk", "size", "seq", *asked])


def _asked_rows(chunk: int, asked: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """The rows of what a chunk asks for."""
    n = len(next(iter(asked.values())))
    for a in range(0, n, SLICE):
        m = min(SLICE, n - a)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), *(x.slice(a, m) for x in asked.values())], ["chunk", "size", "seq", *asked])


def _ranges(lefts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of local numbers, one at least, with about PART of the places (or one number's) in each: pairs of a range are told apart by themselves."""
    before = np.cumsum(np.bincount(lefts, minlength=size))
    cuts = np.unique([0, *np.searchsorted(before, np.arange(PART, len(lefts), PART), "left") + 1, max(1, size)])
    yield from zip(cuts.tolist(), cuts[1:].tolist(), strict=False)


def _words(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << SERIAL_BITS
        by_lang: dict[str, dict[bytes, int]] = {}
        langs, words, seqs, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial, by_lang, langs, words, seqs, size
            seq = np.concatenate(seqs)
            n = np.bincount(seq[seq >= 0], minlength=len(words)).astype(np.int64)
            asked = {"local": pa.array(np.arange(len(n), dtype=np.int32)), "n": pa.array(n), "lang": pa.array(langs, pa.string()), "word": pa.array(words, pa.binary()).cast(pa.string())}
            yield _own_row(serial, seq, len(n), asked)
            yield from _asked_rows(serial, asked)
            serial += 1
            by_lang, langs, words, seqs, size = {}, [], [], [], 0

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                local = by_lang.setdefault(lang, {GAP: -1})
                tokens = text.translate(PLAIN).replace(GAP, b" \xff ").split()
                for w in set(tokens).difference(local):
                    local[w] = len(words)
                    words.append(w)
                    langs.append(lang)
                tokens.append(GAP)
                seqs.append(np.fromiter(map(local.__getitem__, tokens), np.int32, len(tokens)))
                size += len(tokens)
                if size >= chunk_tokens:
                    yield from flush()
        if seqs:
            yield from flush()
        give_back()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, WORD_ROWS), "phrases-1")


def _way(left: np.ndarray, bucket: np.ndarray, ways: int) -> np.ndarray:
    mixed = (left.astype(np.uint64) + (bucket.astype(np.uint64) << np.uint64(43))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(ways)).astype(np.int32)


def _paired(left: pa.Table, right: pa.Table, ways: int = 1) -> pa.Table:
    """A chunk's row and answers (see _pairs) to its pairs of the next length: a row for each left name and bucket, way by way in each part.

    Pairs are sorted in parts, so that little is held beside the places themselves.
    """
    row = left.slice(0, 1).to_pylist()[0]
    seq, ids, bits = _unpacked(row["seq"]), np.full(row["size"] + 1, -1, np.int64), np.zeros(row["size"] + 1, np.int8)  # the last is that of places without a number
    ids[right["local"].to_numpy()] = right["id"].to_numpy()
    bits[right["local"].to_numpy()] = right["bits"].to_numpy()
    named = (ids >= 0)[seq]
    both = np.flatnonzero(named[:-1] & named[1:]).astype(np.int32)
    lefts, following, done, parts = seq[both], np.full(len(seq), -1, np.int32), 0, []
    for low, high in _ranges(lefts, row["size"]):
        at = both[(lefts >= low) & (lefts < high)]
        unique, inverse, n = np.unique(seq[at].astype(np.int64) << 32 | seq[at + 1], return_inverse=True, return_counts=True)
        a, b = ids[unique >> 32], ids[unique & 0xFFFFFFFF]
        mixed = (b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        bucket = mixed.astype(np.int64) & ((np.int64(1) << bits[unique >> 32].astype(np.int64)) - 1)
        order = np.lexsort((bucket, unique >> 32, _way(a, bucket, ways)))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(done, done + len(order), dtype=np.int32)
        following[at] = place[inverse]
        a, b, bucket, n = a[order], b[order], bucket[order], n[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (bucket[1:] != bucket[:-1]))) if len(a) else np.zeros(0, np.int64)
        ends = pa.array(np.append(first, len(a)).astype(np.int32))
        parts.append({
            "first": pa.array((first + done).astype(np.int32)), "left": pa.array(a[first]), "bucket": pa.array(bucket[first].astype(np.int32)),
            "rights": pa.ListArray.from_arrays(ends, pa.array(b)), "ns": pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32))),
        })
        done += len(a)
    rows = [_own_row(row["chunk"], following, done, parts[0])]
    for asked in parts:
        rows += _asked_rows(row["chunk"], asked)
    give_back()
    return pa.Table.from_batches(rows)


def _sent(rows: pa.Table, ways: int) -> pa.Table:
    """What _paired makes, with a row for each way of a part: neighbours in a list, the left names beside the right ones."""
    out = []
    for batch in rows.to_batches():
        c = {n: batch.column(n) for n in batch.schema.names}
        if c["seq"].null_count < batch.num_rows:  # the chunk's own
            out.append(pa.RecordBatch.from_arrays([c["chunk"], c["size"], c["seq"], *(pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())))], SENT))
            continue
        left = c["left"].to_numpy()
        sizes = np.diff(c["rights"].offsets.to_numpy())
        way = _way(left, c["bucket"].to_numpy(), ways)
        first = np.flatnonzero(np.append(True, way[1:] != way[:-1])) if len(way) else np.zeros(0, np.int64)
        ends = pa.array(np.append(0, np.cumsum(sizes))[np.append(first, len(way))].astype(np.int32))
        values = (pa.array(np.repeat(left, sizes)), c["rights"].flatten(), c["ns"].flatten())
        asked = {"first": c["first"].take(pa.array(first)), "way": pa.array(way[first]), **{n: pa.ListArray.from_arrays(ends, x) for n, x in zip(SENT[5:], values, strict=True)}}
        for a in range(0, len(first), SENT_ROWS):
            out += _asked_rows(int(c["chunk"][0].as_py()), {n: x.slice(a, SENT_ROWS) for n, x in asked.items()})
    return pa.Table.from_batches(out)


def _pairs(chunks: DataFrame, answers: DataFrame, length: int, ways: int) -> DataFrame:
    """The next length's rows: chunks whose numbers stand for pairs of adjacent names, and these pairs, in a row for each way of a part.

    answers: chunk, local, id, bits (of the number of buckets). Pairs of a row have local numbers one after the other.
    """
    own = chunks.where("seq is not null").select("chunk", "size", "seq")
    return written(own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda left, right: _sent(_paired(left, right, ways), ways), PAIR_ROWS), f"phrases-{length}")


def _asked_pairs(rows: DataFrame, ways: int) -> DataFrame:
    """chunk, local, n, way, left, right: rows travel by way, and are spread out behind the shuffle."""
    packed = rows.where("seq is null").select("chunk", "first", "way", "lefts", "rights", "ns").repartitionById(ways, F.col("way"))
    pair = F.transform("rights", lambda r, i: F.struct(F.get("lefts", i).alias("left"), r.alias("right"), F.get("ns", i).cast("long").alias("n"), (F.col("first") + i).alias("local")))
    return packed.select("chunk", "way", F.inline(pair))


def _named(asked: DataFrame, keys: list[str], least: int, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names: id, keys, f of all keys found least times or more; answers: chunk, local, id, bits of the rows that have such a key; the table of both).

    A key's name is the first place, a chunk and a number in it, where it is asked for: one shuffle counts and names it.
    """
    place = F.shiftleft("chunk", PLACE_BITS).bitwiseOR(F.col("local").cast("long"))
    group = Window.partitionBy(*keys)
    frequent = asked.select("*", F.sum("n").over(group).alias("f"), F.min(place).over(group).alias("id")).where(F.col("f") >= least)
    first, bits = F.col("id") == place, F.least(F.lit(MOST_BITS), F.greatest(F.lit(0), F.floor(F.log2("f")) - SPLIT_BITS)).cast("int")
    frequent = written(frequent.select("chunk", "local", "id", bits.alias("bits"), *(F.when(first, F.col(c)).alias(c) for c in ("f", *keys))), f"phrases-{length}-frequent")
    return written(frequent.where("f is not null").select("id", *keys, "f"), f"phrases-{length}-names"), frequent.select("chunk", "local", "id", "bits"), frequent


def phrases(docs: DataFrame, least: int = 30, most_words: int = 4, chunk_tokens: int = 6_000_000) -> tuple[list[DataFrame], DataFrame]:
    """(for each length from 1: id, left, right, lang, f, phrase, starts, ends; lang, n: words of each language).

    left, right: ids of the phrase's first and last words but one, of the length before. starts, ends: counts of its
    first, and of its last, 1, 2, ... words.
    """
    rows, ways = _words(docs, chunk_tokens), shuffle_width(docs.sparkSession)
    totals = written(rows.where("seq is null").groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    names, answers, frequent = _named(rows.where("seq is null").select("chunk", "local", "n", "lang", "word"), ["lang", "word"], least, 1)
    nothing = F.array().cast("array<long>")
    none = F.lit(None).cast("long")
    levels = [names.select("id", none.alias("left"), none.alias("right"), "lang", "f", F.col("word").alias("phrase"), nothing.alias("starts"), nothing.alias("ends"), F.col("word").alias("last"))]
    for length in range(2, most_words + 1):
        if names.isEmpty():
            break
        done, rows = (rows, frequent), _pairs(rows, answers, length, ways)
        for table in done:  # what they led to is written
            discard(table)
        names, answers, frequent = _named(_asked_pairs(rows, ways), ["way", "left", "right"], least, length)
        before = levels[-1]
        first = before.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.concat("starts", F.array("f")).alias("starts"))
        rest = before.select(F.col("id").alias("right"), F.col("last"), F.concat("ends", F.array("f")).alias("ends"))
        found = names.drop("way").join(first, "left").join(rest, "right")
        found = found.select("id", "left", "right", "lang", "f", F.concat_ws(" ", "head", "last").alias("phrase"), "starts", "ends", "last")
        levels.append(written(found, f"phrases-{length}-words"))
    discard(rows)
    discard(frequent)
    return [x.drop("last") for x in levels], totals


#: The lowest-scoring cut of a phrase of f occurrences: score, k, l, r. Structs compare field by field, so ties go to the smallest k.
CUT = """array_min(transform(sequence(1, size(starts)), k -> struct(
    (cast(2000000 as decimal(7, 0)) * cast(f as decimal(19, 0))) div (cast(starts[k - 1] as decimal(19, 0)) + cast(ends[size(ends) - k] as decimal(19, 0))) as score,
    k, starts[k - 1] as l, ends[size(ends) - k] as r)))"""


def mine(docs: DataFrame, least: int = 30, most_words: int = 4, cover: int = 80, top: int = 2000, chunk_tokens: int = 6_000_000, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases by score, without those that a longer one covers to `cover` hundredths."""
    levels, totals = phrases(docs, least, most_words, chunk_tokens)
    found = None
    for at, level in enumerate(levels[1:], 1):
        if at + 1 < len(levels):
            longer = levels[at + 1]
            longer = longer.select(F.col("left").alias("id"), "f").unionByName(longer.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("most"))
            level = level.join(longer, "id", "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("f")))
        level = level.select("lang", "phrase", F.col("f").alias("a"), F.expr(CUT).alias("cut"))
        found = level if found is None else found.unionByName(level)
    out = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if found is None:
        return docs.sparkSession.createDataFrame([], out)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    # a language's phrases are thinned in parts first: no task ranks them all
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
