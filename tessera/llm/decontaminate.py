"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Test items are dealt by length into classes of a width (16, 64, 256, ... words, a quarter longer than the item at least). A
training passage is a window of two widths, each overlapping half of the next, so that an item and what an editor adds to
it lie in one. Every passage is a query; its different words are the terms. Every item whose BM25 score reaches its
threshold (a share of the item's score for itself, lowered where the words that a leak may lack could weigh more) is
retrieved.

Search. A class's items are sorted by threshold and cut into blocks; a term has a largest contribution to any item, and
one to each block. A passage keeps a cursor, the next block to look at. In a round its terms are lined up by the next
block in which they occur; the pivot is the first block at which the sum of the terms met so far, at their largest,
reaches the block's least threshold. What lies before the pivot is skipped; with no pivot the passage is done. At the
pivot the block's own maxima are added up; if these reach the threshold too, postings are read and the block's items are
scored. Then the cursor goes past the pivot. All of a batch's passages take a round at once.

A retrieved item is a leak if 0.8 of its word shingles (five words; a shorter item: all its words) stand in the passage,
or of its question's and of its answer's, if the question is a shingle long at least. The question ends with the last
question mark, else after two thirds of the words.

Scale. Frequencies and lengths are those of the whole benchmark, and a passage depends on nothing but the item's class, so
results don't depend on how the index is cut. An index is built on the driver and sent to every task; a benchmark of over
max_items items is searched in shards, one after the other, of which the driver and a task hold one at a time.

Defined cases: a null or empty text has no passage; a very long text has many, all searched; items of any length are
looked for, but for null ones and those without a word (least_words sets another bound); items of one text or one id are
reported each, under its id (null: -1), however the index is cut, and equal rows of one id once; repeated documents are judged each; equal scores need no order, as all that
reach their threshold count; an empty benchmark finds nothing; extra columns, whatever their names, pass through
drop_leaks and are ignored by find_leaks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

WORD = re.compile(r"\w+")
LEAK = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def words_in(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str], n: int) -> set[tuple]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def width_of(words: int) -> int:
    """The width of an item's class: 16 times a power of four, a quarter longer than the item at least."""
    width = 16
    while width < 1.25 * words:
        width *= 4
    return width


@dataclass
class Statistics:
    """Of the whole benchmark: items, their mean length, and in how many of them a word occurs."""

    items: int
    mean: float
    df: dict[str, int]

    @classmethod
    def of(cls, texts: list[list[str]]) -> Statistics:
        return cls(len(texts), sum(map(len, texts)) / max(1, len(texts)), Counter(w for t in texts for w in set(t)))


class Item:
    """A test item, what is wanted of it, and the score that its leaks reach."""

    def __init__(self, key: int, text: str, stats: Statistics, share: float, shingle: int, overlap: float, k1: float, b: float, place: int = 0):
        self.key, self.place, self.words = key, place, words_in(text)
        asked = len(words_in(text[: text.rfind("?") + 1])) if "?" in text else 0
        at = asked if 0 < asked < len(self.words) else max(1, len(self.words) * 2 // 3)
        question, answer = self.words[:at], self.words[at:]
        self.whole, self.question, self.answer = (shingles(w, shingle) for w in (self.words, question, answer))
        self.in_parts = len(question) >= shingle and len(answer) > 0
        idf = lambda w: math.log(1 + (stats.items - stats.df[w] + 0.5) / (stats.df[w] + 0.5))
        damped = k1 * (1 - b + b * len(self.words) / max(1e-9, stats.mean))
        self.gain = {w: idf(w) * n * (k1 + 1) / (n + damped) for w, n in Counter(self.words).items()}
        # of the words, those that may be missing: no more than there are places of missing shingles
        missing = self._missing(self.words, shingle, overlap)
        if self.in_parts:
            missing = max(missing, self._missing(question, shingle, overlap) + self._missing(answer, shingle, overlap))
        gains = sorted(self.gain.values())
        self.need = min(share * sum(gains), sum(gains[: len(gains) - min(missing, len(gains))]))

    @staticmethod
    def _missing(words: list[str], shingle: int, overlap: float) -> int:
        n = min(shingle, len(words))
        places = sorted(Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)).values(), reverse=True) if n else []
        return sum(places[: int((1 - overlap) * len(places) + 1e-9)])

    def leak(self, passage: list[str], overlap: float) -> tuple[float, float] | None:
        """The overlaps of question and answer if the item leaks into the passage."""

        def held(wanted: set) -> float:
            n = len(next(iter(wanted), ()))
            return len(wanted & {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}) / len(wanted) if n else 1.0

        question, answer = held(self.question), held(self.answer)
        good = self.in_parts and min(question, answer) >= overlap or held(self.whole) >= overlap
        return (question, answer) if good else None


class Class:
    """Inverted index of the items of one width. Terms are numbers below n_terms."""

    def __init__(self, width: int, items: list[Item], term: dict[str, int], block: int = 16, most_blocks: int = 64):
        self.width = width
        self.items = sorted(items, key=lambda i: (i.need, i.key))
        self.block = max(block, -(-len(items) // most_blocks))
        self.need = np.array([i.need for i in self.items])
        self.block_need = self.need[:: self.block]  # thresholds ascend: a block's first is its least
        blocks, n_terms = len(self.block_need), len(term) + 1  # the last term is for words of no item
        postings = sorted((j // self.block * n_terms + term[w], j, x) for j, i in enumerate(self.items) for w, x in i.gain.items())
        self.item, self.gain = np.array([p[1] for p in postings], np.int64), np.array([p[2] for p in postings])
        self.keys, self.begin = np.unique(np.array([p[0] for p in postings], np.int64), return_index=True)
        self.block_most = np.zeros((blocks, n_terms), np.float32)
        self.block_most.ravel()[self.keys] = np.maximum.reduceat(self.gain, self.begin)
        self.most = self.block_most.max(axis=0)
        self.begin = np.append(self.begin, len(postings))
        self.next_block = np.full((blocks + 1, n_terms), blocks, np.uint8)
        for k in range(blocks - 1, -1, -1):
            self.next_block[k] = np.where(self.block_most[k] > 0, k, self.next_block[k + 1])
        self.n_terms = n_terms

    def retrieve(self, ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, Item, float]]:
        """(text, passage's first word, item, score) of all items that reach their threshold. ids: the texts' words as terms, end to end."""
        half, n_terms, blocks = self.width, self.n_terms, len(self.block_need)
        halves = np.maximum(1, -(-sizes // half))
        first_half, first_word = np.cumsum(halves) - halves, np.cumsum(sizes) - sizes
        at = np.flatnonzero(self.most[ids] > 0)
        text = np.searchsorted(first_word, at, side="right") - 1
        pairs = np.unique((first_half[text] + (at - first_word[text]) // half) * n_terms + ids[at])
        of, term = pairs // n_terms, pairs % n_terms
        # passages: a half with the next one of its text; the last half has none, unless it is the only one
        total = np.bincount(of, weights=self.most[term], minlength=int(halves.sum()) + 1)
        alone, last = np.zeros(len(total), bool), np.zeros(len(total), bool)
        last[first_half + halves - 1] = True
        alone[first_half[halves == 1]] = True
        bound = total + np.where(last, 0, np.append(total[1:], 0))
        bound[last & ~alone] = -1
        start = np.flatnonzero(bound >= self.block_need[0] - 1e-3)
        if not len(start):
            return
        # the terms of these passages, each once
        begin = np.searchsorted(of, np.arange(len(total) + 1))
        stop = begin[np.minimum(np.where(last[start], start + 1, start + 2), len(total))]
        n = stop - begin[start]
        span = np.repeat(begin[start] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        pairs = np.unique(np.repeat(np.arange(len(start)), n) * n_terms + term[span])
        own, term = pairs // n_terms, pairs % n_terms
        most = self.most[term].astype(np.float64)
        live, cursor = np.arange(len(start)), np.zeros(len(start), np.int64)
        while len(live):
            # own: the place in live of each term's passage
            nexts = self.next_block[cursor[own], term]
            sums = np.bincount(own * (blocks + 1) + nexts, weights=most, minlength=len(live) * (blocks + 1)).reshape(len(live), -1)[:, :blocks]
            reach = np.cumsum(sums, axis=1) >= self.block_need - 1e-3
            reach &= sums > 0
            pivot = np.where(reach.any(axis=1), reach.argmax(axis=1), blocks)
            go = pivot < blocks
            if not go.all():
                live, pivot = live[go], pivot[go]
                keep = go[own]
                own, term, most = (np.cumsum(go) - 1)[own[keep]], term[keep], most[keep]
                if not len(live):
                    return
            bound = np.bincount(own, weights=self.block_most[pivot[own], term], minlength=len(live))
            if (hit := bound >= self.block_need[pivot] - 1e-3).any():
                mine = hit[own]
                for passage, item, score in self._scored(own[mine], term[mine], pivot, len(live)):
                    h = int(start[live[passage]])
                    t = int(np.searchsorted(first_half, h, side="right")) - 1
                    yield t, (h - int(first_half[t])) * half, self.items[item], score
            cursor = pivot + 1

    def _scored(self, own: np.ndarray, term: np.ndarray, pivot: np.ndarray, n: int) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score): postings of the pivots' blocks added up."""
        key = pivot[own] * self.n_terms + term
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        met = self.keys[where] == key
        own, where = own[met], where[met]
        n_post = self.begin[where + 1] - self.begin[where]
        span = np.repeat(self.begin[where] - np.cumsum(n_post) + n_post, n_post) + np.arange(int(n_post.sum()))
        passages, place = np.unique(own, return_inverse=True)
        scores = np.bincount(np.repeat(place, n_post) * self.block + self.item[span] % self.block, weights=self.gain[span], minlength=len(passages) * self.block).reshape(-1, self.block)
        items = pivot[passages, None] * self.block + np.arange(self.block)
        need = np.where(items < len(self.need), self.need[np.minimum(items, len(self.need) - 1)], np.inf)
        for i, j in zip(*np.nonzero((scores >= need - 1e-9) & (scores > 0)), strict=True):
            yield int(passages[i]), int(items[i, j]), float(scores[i, j])


class Index:
    """All items of a shard: a class for each width, over one vocabulary."""

    def __init__(self, items: list[tuple[int, str]], stats: Statistics | None = None, share: float = 0.7, shingle: int = 5, overlap: float = 0.8, k1: float = 1.2, b: float = 0.75, block: int = 16):
        stats = stats or Statistics.of([words_in(t) for _, t in items])
        made = [Item(key, text, stats, share, shingle, overlap, k1, b, place) for place, (key, text) in enumerate(items)]
        self.overlap = overlap
        self.term = {w: i for i, w in enumerate(sorted({w for i in made for w in i.gain}))}
        by_width: dict[int, list[Item]] = {}
        for i in made:
            if i.words:
                by_width.setdefault(width_of(len(i.words)), []).append(i)
        self.classes = [Class(w, own, self.term, block) for w, own in sorted(by_width.items())]

    def retrieve(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, Item, float]]:
        """(text, passage's first word, end, item, score) of all that reach their threshold."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter(map(self.term.get, chain.from_iterable(texts), repeat(len(self.term))), np.int64, int(sizes.sum()))
        if not len(ids):
            return
        for c in self.classes:
            for text, at, item, score in c.retrieve(ids, sizes):
                yield text, at, at + 2 * c.width, item, score

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float]]]:
        """For each text (item, score, question overlap, answer overlap) of the items that leak into it, from the best passage of each."""
        words = [words_in(t) for t in texts]
        found: list[dict[tuple[int, int], tuple[float, float, float]]] = [{} for _ in texts]  # by item, not by id: texts may share one
        for text, a, b, item, score in self.retrieve(words):
            if (parts := item.leak(words[text][a:b], self.overlap)) is not None:
                own = (item.key, item.place)
                found[text][own] = max(found[text].get(own, (0.0, 0.0, 0.0)), (score, *parts))
        return [[(own[0], *f[own]) for own in sorted(f)] for f in found]

    def leaks_in(self, column: pa.Array, at_once: int = 1 << 20) -> Iterator[list]:
        """The same for a column, about at_once bytes of text together."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(sizes, (int(sizes[at - 1]) if at else 0) + at_once, side="right")))
            yield from self.leaks(column.slice(at, stop - at).to_pylist())
            at = stop


def indexes(benchmark: DataFrame, max_items: int, least_words: int = 1, **options) -> Iterator[Index]:
    """An index for each shard of about max_items items, one after the other."""
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1).cast("long")).alias("item_id"), "text").distinct()
    shards = max(1, math.ceil(items.count() / max_items))
    long_enough = lambda rows: sorted((r.item_id, r.text) for r in rows if len(words_in(r.text)) >= max(1, least_words))
    if shards == 1:
        yield Index(long_enough(items.collect()), **options)
        return

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_in(t) for t in batch.column("text").to_pylist()]
            keep = pa.array([len(w) >= max(1, least_words) for w in words], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string())), pa.array([len(w) for w in words], pa.int64())], ["item_id", "text", "words", "n"]).filter(keep)

    # the whole benchmark's frequencies, of which a shard is given those of its own words
    items = written(items.mapInArrow(spelled, "item_id long, text string, words array<string>, n long").withColumn("shard", F.pmod(F.xxhash64("text", "item_id"), F.lit(shards))), "bench-items")
    total = items.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
    df = written(items.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "bench-words")
    for i in range(shards):
        own = items.where(F.col("shard") == i)
        rows = own.select("item_id", "text").collect()
        known = df.join(own.select(F.explode("words").alias("word")).distinct(), "word").collect()
        if rows:
            yield Index(sorted((r.item_id, r.text) for r in rows), Statistics(total.n, total.words / total.n, {r.word: r.df for r in known}), **options)


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_items: int = 20_000, **options) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each document and each test item that leaks into it."""
    context = docs.sparkSession.sparkContext

    def search(index: Index) -> tuple[DataFrame, object]:
        sent = context.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(key, *leak) for key, leaks in zip(batch.column("doc_id").to_pylist(), sent.value.leaks_in(batch.column("text")), strict=True) for leak in leaks]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.float64()] * 3), strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LEAK), sent

    out, last = None, None
    for index in indexes(benchmark, max_items, **options):
        if last is not None:  # over one shard: each is searched, and let go, before the next is built
            done = written(last[0], "leaks")
            last[1].destroy()
            out = done if out is None else out.unionByName(done)
        last = search(index)
    return docs.sparkSession.createDataFrame([], LEAK) if last is None else last[0] if out is None else out.unionByName(last[0])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_items: int = 20_000, **options) -> DataFrame:
    """The rows of docs, all their columns as they are, into which no test item leaks."""
    context, at, out, last = docs.sparkSession.sparkContext, docs.columns.index("text"), docs, None
    for index in indexes(benchmark, max_items, **options):
        if last is not None:
            out = written(out, "leak-free")
            last.destroy()
        last = context.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not leaks for leaks in sent.value.leaks_in(batch.column(at))], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
