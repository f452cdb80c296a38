"""Token ids in binary shards, compressed by a Re-Pair grammar.

Documents are dealt into ranges of doc_id and sorted; a task encodes them with a public tokenizer, closes each with an
end id, and packs whole documents into shards of a bounded number of ids (a longer document has a shard to itself). In a
shard, the most frequent pairs of neighbouring symbols are replaced by new symbols, round by round, never across
documents, until no pair is frequent. A shard stores the pairs (rules), each rule's expanded length, the remaining
symbols, and for each document where its symbols begin and how many ids lie before it, so any document is decoded alone.

A pair is frequent if it occurs `least` times in what is left of its shard (16: a rule takes 12 bytes, and each use of it
saves a symbol of 2 or 3).

Shard layout, little-endian: magic "RPG1", then uint32 base, rules, symbols, documents, width (2, 3 or 4 bytes a symbol);
rules x (left, right) uint32; rules x length uint32; (documents + 1) x uint64 where symbols begin;
(documents + 1) x uint64 ids before; symbols.

Shards are a Parquet table (part, shard, part_start, n_tokens, doc_ids, payload), written by Spark's own writers, so any
store that Spark reaches will do.

Defined cases: a null text is empty and gives the end id alone; a very long text is encoded whole and is a shard of its
own; a null doc_id comes first; rows with one doc_id are in the order of a hash of their texts (ties: in any order), and
repeated rows are each encoded; an empty table gives an empty one; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

MAGIC = b"RPG1"
SHARD_SCHEMA = "part int, shard int, part_start long, n_tokens long, doc_ids array<long>, payload binary"
#: Texts with other characters are encoded as a whole; among these, lower-casing and the kinds of characters are the same here and in the tokenizer.
PRINTED = b"\t\n\r" + bytes(range(32, 127))
OTHER = re.compile("[^\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]")
SPACE, LETTER, DIGIT, MARK = range(4)
#: Kinds of bytes of such texts in UTF-8.
KIND = np.full(256, MARK, np.uint8)
KIND[[9, 10, 13, 32]] = SPACE
KIND[97:123] = KIND[128:] = LETTER
KIND[48:58] = DIGIT


def cut(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokenizer's pieces of a lower-cased text begin and end: runs of letters or marks, single digits, and the contractions 's 't 'm 'd 're 've 'll."""
    kind = KIND[raw]
    before = np.concatenate([[SPACE], kind[:-1]])
    first = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
    at = np.flatnonzero(first & (raw == 39))
    if len(at):
        padded = np.concatenate([raw, [32, 32, 32]])
        one, two = padded[at + 1], padded[at + 2]
        # the quote has to be a piece's first, and its only mark
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for hit, n in ((at[short], 2), (at[long], 3)):
            first[hit + 1] = False
            rest = hit + n
            rest = rest[rest < len(raw)]
            first[rest] |= kind[rest] == LETTER
    begins = np.flatnonzero(first)
    gone = np.flatnonzero(kind == SPACE)
    # a piece ends where the next begins, or at the white space before it
    nexts = np.append(begins[1:], len(raw))
    stop = np.append(gone, len(raw))[np.searchsorted(gone, begins)]
    return begins, np.minimum(nexts, stop)


class Ragged:
    """Rows of numbers, end to end."""

    def __init__(self, kind: type):
        self.flat, self.begin, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.begin[self.n])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.flat[used : used + len(ids)] = ids
        self.begin[self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.n += len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows, end to end, and how many each has."""
        begin = self.begin[rows]
        sizes = self.begin[rows + 1] - begin
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(begin - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes


class WordEncoder:
    """Encodes each different piece once and puts texts together from pieces, by numpy.

    It is exact for the tokenizers that drop white space, lower the case, cut as above, and close each piece's last token
    with "</w>". Other tokenizers, and texts with characters outside those above, are given whole texts. Pieces are looked
    up by a 64-bit polynomial hash and then compared byte by byte with those kept; a text that holds another piece of the
    same hash is given whole, so ids never depend on the hash. At most `kept` pieces are remembered.
    """

    def __init__(self, path: str, kept: int = 300_000, base: int = 0x2545F4914F6CDD1D):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.kept = path, kept
        self.model = Tokenizer.from_file(path)  # for pieces: they are cut and lower-cased already
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        vocabulary = self.model.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.clear()
        probe = ["Ab cd\xe9", " it's\n", "a, b--c! 12", "x  y_z '", "don't'll ''s 're've", "", "'", "a'"]
        self.by_piece = False
        try:
            self.by_piece = all(a is not None and a.tolist() == b.ids for a, b in zip(self.by_pieces(probe), self.tokenizer.encode_batch(probe, add_special_tokens=False), strict=True))
        except (ValueError, AttributeError, TypeError):
            pass
        del self.tokenizer  # few texts need it again

    @cached_property
    def tokenizer(self):
        """For whole texts."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.ids, self.bytes = Ragged(np.uint32), Ragged(np.uint8)

    def hashes(self, raw: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
        while len(self.powers) < len(raw) + 1:
            n = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(self.base, n, 1 << 64))])
            self.inverses = np.concatenate([self.inverses, self.inverses * np.uint64(pow(self.inverse, n, 1 << 64))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], dtype=np.uint64)])
        return (sums[stops] - sums[begins]) * self.inverses[begins]

    def learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        texts = [b" ".join(pieces[i : i + 1000]).decode() for i in range(0, len(pieces), 1000)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        sizes = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
        if len(sizes) != len(pieces):  # a token that closes no piece: each piece alone
            each = [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
            ids, sizes = np.concatenate(each), np.array([len(x) for x in each])
        self.rows.update(zip(hashes, range(len(self.rows), len(self.rows) + len(pieces)), strict=True))
        self.ids.add(ids, sizes)
        self.bytes.add(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]))

    def by_pieces(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text; none for a text with a piece whose hash stands for another."""
        lowered = [t.lower().encode() for t in texts]
        joined = b"\n".join(lowered) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        begins, stops = cut(raw)
        unique, first, back = np.unique(self.hashes(raw, begins, stops), return_index=True, return_inverse=True)
        if len(self.rows) > self.kept:
            self.clear()
        keys = unique.tolist()
        rows = np.fromiter(map(self.rows.get, keys, repeat(-1)), np.int64, len(keys))
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            a, b = begins[first[fresh]].tolist(), stops[first[fresh]].tolist()
            rows[fresh] = len(self.rows) + np.arange(len(fresh))
            self.learn([keys[i] for i in fresh.tolist()], [joined[x:y] for x, y in zip(a, b, strict=True)])
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(texts)))
        edges = np.searchsorted(begins, np.concatenate([[0], text_ends]))
        same = self.same(raw, begins, stops, rows[back])
        ids, sizes = self.ids.take(rows[back])
        ends = np.concatenate([[0], np.cumsum(sizes)])[edges]
        good = np.concatenate([[0], np.cumsum(~same)])[edges]
        return [ids[x:y] if u == v else None for x, y, u, v in zip(ends[:-1].tolist(), ends[1:].tolist(), good[:-1].tolist(), good[1:].tolist(), strict=True)]

    def same(self, raw: np.ndarray, begins: np.ndarray, stops: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which pieces are, byte by byte, those of these rows."""
        same = self.bytes.begin[rows + 1] - self.bytes.begin[rows] == stops - begins
        at = np.flatnonzero(same)
        if len(at):
            kept, sizes = self.bytes.take(rows[at])
            ends = np.cumsum(sizes)
            here = raw[KIND[raw] != SPACE] if len(at) == len(rows) else raw[np.repeat(begins[at] - ends + sizes, sizes) + np.arange(int(ends[-1]))]
            differ = np.flatnonzero(kept != here)
            same[at[np.searchsorted(ends, differ, side="right")]] = False
        return same

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        rest = [t.encode().translate(None, PRINTED) for t in texts]
        plain = [self.by_piece and "<|" not in t and not (r and OTHER.search(r.decode())) for t, r in zip(texts, rest, strict=True)]
        own = iter(self.by_pieces(known) if (known := [t for t, p in zip(texts, plain, strict=True) if p]) else ())
        found = [next(own) if p else None for p in plain]
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if ids is None else ids for t, ids in zip(texts, found, strict=True)]


def bounded(texts: pa.Array, characters: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts (null: empty) of about so many characters, one text at least, with the first one's place."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(sizes[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + characters, side="right")))
        yield at, [t or "" for t in texts.slice(at, stop - at).to_pylist()]
        at = stop


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _starts_of_pairs(hit: np.ndarray) -> np.ndarray:
    """Of positions whose pair is to be replaced, those that are: in a run of neighbours every second."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at
    first = np.concatenate([[True], np.diff(at) > 1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - start) % 2 == 0]


def compress(ids: np.ndarray, ends: np.ndarray, least: int = 16, per_round: int = 4_000) -> bytes:
    """A shard of documents that end (exclusive) at ends. Rounds go on until no pair occurs least times.

    A round counts pairs in the slots of a hash first; only pairs in slots that are full enough are counted one by one,
    and the per_round most frequent of them are replaced; the others wait for the next round.
    """
    slots = 1 << 18
    base = int(ids.max()) + 1 if len(ids) else 1
    seq = ids.astype(np.int64)
    doc_end = np.zeros(len(seq), bool)
    doc_end[ends - 1] = True
    left, right = [], []
    symbols = base
    length_of = np.ones(base, np.int64)
    while len(seq) > 1:
        slot = ((seq[:-1] * 40503 + seq[1:]) * 2654435761 >> 20) & (slots - 1)
        inside = ~doc_end[:-1]
        likely = np.flatnonzero(inside & (np.bincount(slot[inside], minlength=slots) >= least)[slot])
        key = (seq[likely] << 32) | seq[likely + 1]
        pairs, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        best = np.flatnonzero(counts >= least)
        if not len(best):
            break
        best = best[np.lexsort((pairs[best], -counts[best]))][:per_round]
        rule = np.full(len(pairs), -1)
        rule[best] = np.arange(len(best))
        own = rule[back]
        hit = np.zeros(len(seq) - 1, bool)
        hit[likely[own >= 0]] = True
        at = _starts_of_pairs(hit)
        used, new = np.unique(own[np.searchsorted(likely, at)], return_inverse=True)
        a, b = pairs[best[used]] >> 32, pairs[best[used]] & 0xFFFFFFFF
        left.append(a)
        right.append(b)
        length_of = np.concatenate([length_of, length_of[a] + length_of[b]])
        seq[at] = symbols + new
        doc_end[at] |= doc_end[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, doc_end = seq[keep], doc_end[keep]
        symbols += len(used)
    left = np.concatenate(left) if left else np.zeros(0, np.int64)
    right = np.concatenate(right) if right else np.zeros(0, np.int64)
    begins = np.concatenate([[0], np.flatnonzero(doc_end) + 1]).astype("<u8")
    before = np.concatenate([[0], ends]).astype("<u8")
    width = 2 if symbols <= 1 << 16 else 3 if symbols <= 1 << 24 else 4
    packed = np.ascontiguousarray(seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width])
    return b"".join(
        (MAGIC, struct.pack("<5I", base, len(left), len(seq), len(ends), width), np.stack([left, right], 1).astype("<u4").tobytes(), length_of[base:].astype("<u4").tobytes(), begins.tobytes(), before.tobytes(), packed.tobytes())
    )


class Shard:
    """Reads a shard; decode(i) touches the symbols of document i alone."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard")
        self.base, rules, symbols, docs, width = struct.unpack_from("<5I", payload, 4)
        at = 24
        self.rules = np.frombuffer(payload, "<u4", 2 * rules, at).reshape(-1, 2).astype(np.int64)
        self.lengths = np.frombuffer(payload, "<u4", rules, at := at + 8 * rules)
        self.begins = np.frombuffer(payload, "<u8", docs + 1, at := at + 4 * rules)
        self.before = np.frombuffer(payload, "<u8", docs + 1, at := at + 8 * (docs + 1))
        packed = np.frombuffer(payload, np.uint8, symbols * width, at + 8 * (docs + 1)).reshape(-1, width)
        wide = np.zeros((symbols, 4), np.uint8)
        wide[:, :width] = packed
        self.symbols = wide.view("<u4")[:, 0]

    def __len__(self) -> int:
        return len(self.before) - 1

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        seq = seq.astype(np.int64)
        while (pair := seq >= self.base).any():
            at = np.cumsum(1 + pair) - 1 - pair
            out = np.empty(len(seq) + int(pair.sum()), np.int64)
            out[at] = seq
            both = self.rules[seq[pair] - self.base]
            out[at[pair]], out[at[pair] + 1] = both[:, 0], both[:, 1]
            seq = out
        return seq.astype("<u4")

    def all(self) -> np.ndarray:
        return self._expand(self.symbols)

    def decode(self, i: int) -> np.ndarray:
        return self._expand(self.symbols[int(self.begins[i]) : int(self.begins[i + 1])])

    def slice(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of a document; rules outside are skipped by their lengths."""
        seq = self.symbols[int(self.begins[i]) : int(self.begins[i + 1])].astype(np.int64)
        sizes = np.ones(len(seq), np.int64)
        pair = seq >= self.base
        sizes[pair] = self.lengths[seq[pair] - self.base]
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return self._expand(seq[a:b])[start - skipped : stop - skipped]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_ids: int = 1 << 19, at_once: int = 1 << 20) -> DataFrame:
    """The shards of docs in ascending doc_id order, as a written table. at_once bounds the characters encoded together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, start = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list = []
        size = 0

        def flush():
            nonlocal shard, start, held, names, size
            ends = np.cumsum([len(x) for x in held])
            row = (part, shard, start, int(ends[-1]), names, compress(np.concatenate(held), ends))
            shard, start, held, names, size = shard + 1, start + int(ends[-1]), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["part", "shard", "part_start", "n_tokens", "doc_ids", "payload"])

        end = np.array([end_id], np.uint32)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for at, texts in bounded(batch.column("text"), at_once):
                for key, ids in zip(keys[at : at + len(texts)], encoder(tokenizer).encode(texts), strict=True):
                    held.append(np.concatenate([ids, end]))
                    names.append(key)
                    size += len(held[-1])
                    if size >= shard_ids:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return written(ordered.mapInArrow(pack, SHARD_SCHEMA), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard_symbols: a row for each document, from the shards alone."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, names, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "part_start", "doc_ids", "payload")), strict=True):
                shard = Shard(payload)
                ids, before = shard.all(), shard.before.astype(np.int64)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([part] * len(names), pa.int32()), pa.array(before[:-1] + start), pa.array(np.diff(before)), pa.array(crc, pa.int64())], ["doc_id", "part", "within", "n_tokens", "ids_crc32"])

    docs = shards.select("part", "part_start", "doc_ids", "payload").mapInArrow(decode, "doc_id long, part int, within long, n_tokens long, ids_crc32 long")
    # a row for each written partition, whatever the number of documents
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(F.broadcast(totals), "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
