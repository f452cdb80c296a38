"""Quality classifier by co-training.

Two views of a document are fitted apart: its text (hashed words and pairs of words, word shapes, length and repetition)
and its page metadata (source, language, length). In each round every document without a label is scored by both views,
and each view labels those that it is surest of for the other. Both views are then calibrated on labelled rows that
neither has seen, and a two-weight logistic model, fitted on rows that played no part in either, joins the calibrated
log-odds.

Fitting takes at most max_labelled labelled rows, in the order of a hash of doc_id; unlabelled rows aren't sampled. Every
text is read once for its features, which are written as sparse rows; a round reads these. What a round shuffles is an id
and two numbers for each document. Scoring reads every whole text once, in batches, without a shuffle.

Defined cases: a null or blank text has no text features, only the view's bias; a very long text is read whole; null
metadata has a bucket of its own; labels that contradict each other for one doc_id, or are null, are left out; of rows
that share a doc_id one is fitted on, the one with the least features, and each is scored; rows without a doc_id are
scored, not fitted on; ties in confidence go to the smaller hash of doc_id; each kind of label is
dealt over fitting, calibration and joining by itself, and one with fewer than three rows takes part in all; with no labels
of both kinds, or none of both whose documents are there, nothing can be learned: every document gets score 1 and is kept; extra columns, whatever their names, pass through keep_quality and
are ignored by score_quality; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column_or_null, give_back, thinned, written

WORDS, SHAPES, RATIOS = 2048, 256, 6
SOURCES, LANGS, LENGTHS = 64, 16, 24
TEXT_DIMS = WORDS + SHAPES + RATIOS
META_DIMS = SOURCES + LANGS + LENGTHS + 1
COLUMNS = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}


class Rows:
    """Sparse rows: places and values, end to end, and how many each row has."""

    def __init__(self, at: np.ndarray, x: np.ndarray, sizes: np.ndarray):
        self.at, self.x, self.sizes = at, x, sizes
        self.row = np.repeat(np.arange(len(sizes)), sizes)

    @classmethod
    def of(cls, packed: list[bytes]) -> Rows:
        """Of places (uint16), then values (float16)."""
        sizes = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
        at = np.frombuffer(b"".join(p[: len(p) // 2] for p in packed), "<u2").astype(np.int64)
        return cls(at, np.frombuffer(b"".join(p[len(p) // 2 :] for p in packed), "<f2").astype(np.float64), sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at] * self.x, minlength=len(self))

    def back(self, r: np.ndarray, dims: int) -> np.ndarray:
        """The transpose times r."""
        return np.bincount(self.at, weights=r[self.row] * self.x, minlength=dims)

    def pick(self, rows: np.ndarray) -> Rows:
        begin = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[rows]
        span = np.repeat(begin[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        return Rows(self.at[span], self.x[span], sizes)

    def with_(self, more: Rows) -> Rows:
        return Rows(np.concatenate([self.at, more.at]), np.concatenate([self.x, more.x]), np.concatenate([self.sizes, more.sizes]))


@dataclass
class View:
    """A linear model with Platt's slope and offset."""

    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: Rows) -> np.ndarray:
        return x.times(self.weights[:-1]) + self.weights[-1]

    def logit(self, x: Rows) -> np.ndarray:
        return self.slope * self.raw(x) + self.offset


@dataclass
class Model:
    text: View
    meta: View
    join: np.ndarray  # weights of both calibrated log-odds, then a bias
    rounds: list[dict]

    def scores(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(text), self.meta.logit(meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.join[0] * a + self.join[1] * b + self.join[2])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


_known: dict[str, int] = {}


def _word(word: str) -> int:
    """A word's 32-bit hash and, above it, the bucket of its shape: classes of its characters, runs of letters or digits shortened to one."""
    if (found := _known.get(word)) is None:
        out, last = [], ""
        for c in word[:256]:
            kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if kind != last or kind not in "Aa0":
                out.append(kind)
                if len(out) == 12:
                    break
            last = kind
        if len(_known) > 150_000:
            _known.clear()
        found = _known[word] = (zlib.crc32("".join(out).encode("utf-8", "replace")) % SHAPES) << 32 | zlib.crc32(word.lower().encode("utf-8", "replace"))
    return found


def text_features(text: str | None) -> bytes:
    """Packed as Rows.of reads it. Words, pairs and shapes are square roots of their shares of the text's words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return b""
    found = list(map(_known.get, words))
    if None in found:
        found = list(map(_word, words))
    both = np.array(found, np.int64)
    hashed = (both & 0xFFFFFFFF).astype(np.uint64)
    pairs = (hashed[:-1] * np.uint64(0x9E3779B1) ^ hashed[1:]) * np.uint64(0x85EBCA6B) >> np.uint64(16)
    at = np.concatenate([hashed % np.uint64(WORDS), pairs % np.uint64(WORDS), (both >> 32).astype(np.uint64) + np.uint64(WORDS)]).astype(np.int64)
    counts = np.bincount(at, minlength=WORDS + SHAPES)
    full = np.flatnonzero(counts)
    different, often = np.unique(hashed, return_counts=True)
    d = len(different)
    ratios = (d / n, int(often.max()) / n, float((hashed[1:] == hashed[:-1]).sum()) / n, min(1.0, len(text) / n / 20), math.log1p(n) / 10, d / math.sqrt(n) / 10 if n > 100 else 0.5)
    return np.concatenate([full, np.arange(WORDS + SHAPES, TEXT_DIMS)]).astype("<u2").tobytes() + np.concatenate([np.sqrt(counts[full] / n), ratios]).astype("<f2").tobytes()


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> bytes:
    at = (
        zlib.crc32(source.encode("utf-8", "replace")) % (SOURCES - 1) if source is not None else SOURCES - 1,
        SOURCES + (zlib.crc32(lang.encode("utf-8", "replace")) % (LANGS - 1) if lang is not None else LANGS - 1),
        SOURCES + LANGS + (min(LENGTHS - 2, max(0, n_chars).bit_length()) if n_chars is not None else LENGTHS - 1),
        META_DIMS - 1,
    )
    return np.array(at, "<u2").tobytes() + np.array((1, 1, 1, math.log1p(max(0, n_chars or 0)) / 20), "<f2").tobytes()


def _features(batch: pa.RecordBatch) -> tuple[list[bytes], list[bytes]]:
    text, source, lang, n_chars = (batch.column(batch.schema.get_field_index(c)) for c in COLUMNS)
    meta = [meta_features(*row) for row in zip(source.to_pylist(), lang.to_pylist(), n_chars.to_pylist(), strict=True)]
    return [text_features(t.as_py()) for t in text], meta


def _fitted(x: Rows, y: np.ndarray, dims: int, ridge: float, weight: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Weights, then a bias, of a logistic regression: Newton's method, each step by conjugate gradients."""
    w, penalty = np.zeros(dims + 1) if start is None else start.copy(), np.full(dims + 1, ridge)
    penalty[-1] = 1e-6
    weight = np.ones(len(y)) if weight is None else weight
    back = lambda r: np.append(x.back(r, dims), r.sum())
    for _ in range(25):
        p = _sigmoid(x.times(w[:-1]) + w[-1])
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        residual = back(weight * (y - p)) - penalty * w
        scale = np.maximum(np.append(np.bincount(x.at, weights=(curve[x.row] * x.x * x.x), minlength=dims), curve.sum()) + penalty, 1e-9)
        step, z = np.zeros(dims + 1), residual / scale
        direction, rho, first = z.copy(), float(residual @ z), float(residual @ residual)
        for _ in range(40):
            if rho < 1e-14 or float(residual @ residual) < 1e-4 * first:
                break
            curved = back(curve * (x.times(direction[:-1]) + direction[-1])) + penalty * direction
            alpha = rho / float(direction @ curved)
            step += alpha * direction
            residual = residual - alpha * curved
            z = residual / scale
            rho, old = float(residual @ z), rho
            direction = z + rho / old * direction
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _dense(columns: np.ndarray) -> Rows:
    n, d = columns.shape
    return Rows(np.tile(np.arange(d), n), columns.ravel().astype(np.float64), np.full(n, d))


def _calibrated(weights: np.ndarray, x: Rows, y: np.ndarray) -> View:
    """Platt's calibration on rows that the view wasn't fitted on."""
    raw = View(weights).raw(x)[:, None]
    targets = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    spread = max(1e-9, float(raw.std()))
    fitted = _fitted(_dense(raw / spread), targets, 1, 1e-3)
    return View(weights, max(0.0, fitted[0] / spread), fitted[1])


def _rows_of(features: DataFrame, keys: DataFrame) -> tuple[list[int], Rows, Rows]:
    """doc_ids and features of a bounded list of keys, one row for each doc_id, in the order of a hash."""
    one = features.join(F.broadcast(keys), "doc_id").groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("x"))
    rows = sorted(one.select("doc_id", "x.a", "x.b").toArrow().to_pylist(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return [r["doc_id"] for r in rows], Rows.of([r["a"] for r in rows]), Rows.of([r["b"] for r in rows])


def _prepared(docs: DataFrame) -> list:
    return [column_or_null(docs, c, kind).alias(c) for c, kind in COLUMNS.items()]


def _surest(features: DataFrame, known: DataFrame, views: list[View], sure: float, per_round: int, given: list[dict[int, int]]) -> list[list[tuple[int, int]]]:
    """For each view (doc_id, label) of the unlabelled documents that it is surest of, per_round of each label, beyond those already given."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [view.logit(Rows.of(batch.column(c).to_pylist())) for view, c in zip(views, "ab", strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(o, pa.float64()) for o in own)], ["doc_id", "a", "b"])

    least = math.log(sure / (1 - sure))
    scored = features.where("doc_id is not null").mapInArrow(score, "doc_id long, a double, b double").where((F.abs("a") >= least) | (F.abs("b") >= least))
    once = scored.groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("x")).join(known.select("doc_id"), "doc_id", "left_anti")
    once = written(once.select("doc_id", "x.a", "x.b"), "quality-sure")
    out: list[list[tuple[int, int]]] = []
    for v, c in enumerate("ab"):
        found = []
        for label, sign in ((1, 1), (0, -1)):
            most = per_round + len(given[1 - v])  # those already given may be among the surest
            best = once.where(F.col(c) * sign >= least).orderBy(F.col(c) * -sign, F.xxhash64("doc_id")).limit(most).select("doc_id").collect()
            found += [(r["doc_id"], label) for r in best if r["doc_id"] not in given[1 - v]][:per_round]
        out.append(found)
    return out


def roles(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows to fit on, to calibrate by and to join by: of five of each label three, one and one. Of a label with fewer than three rows each has all parts."""
    parts: list[list[int]] = [[], [], []]
    for label in np.unique(y):
        own = np.flatnonzero(y == label)
        for k, i in enumerate(own):
            for part in range(3) if len(own) < 3 else ((0, 1, 2, 0, 0)[k % 5],):
                parts[part].append(i)
    return tuple(np.array(sorted(p), np.int64) for p in parts)


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 4_000, rounds: int = 2, per_round: int = 500, sure: float = 0.95, ridge: float = 1.0) -> Model | None:
    """Fits on at most max_labelled labelled documents and the surest of all others; None if the labels don't hold both kinds."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                a, b = _features(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["doc_id", "a", "b"])
        give_back()

    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
    agreed = known.where("y = z and y in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"))
    chosen = thinned(agreed, F.xxhash64("doc_id"), max_labelled, agreed.count()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    answer = {r["doc_id"]: r["y"] for r in chosen.collect()}
    if len(set(answer.values())) < 2:
        return None
    features = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_prepared(docs)).mapInArrow(extract, "doc_id long, a binary, b binary"), "quality-features")
    key_frame = lambda ids: docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    ids, *labelled = _rows_of(features, key_frame(answer))
    y = np.array([answer[i] for i in ids])
    if len(set(y.tolist())) < 2:  # labels of documents that aren't there
        return None
    fits, calibrates, joins = roles(y)
    given: list[dict[int, int]] = [{}, {}]  # pseudo-labels that a view has received from the other
    views: list[View] = []
    weights: list = [None, None]
    told = []
    for step in range(rounds + 1):
        views = []
        for v, dims in ((0, TEXT_DIMS), (1, META_DIMS)):
            x, target, weight = labelled[v].pick(fits), y[fits].astype(float), np.ones(len(fits))
            if given[v]:
                own, *more = _rows_of(features, key_frame(given[v]))
                x, target, weight = x.with_(more[v]), np.concatenate([target, [given[v][i] for i in own]]), np.concatenate([weight, np.full(len(own), 0.5)])
            weights[v] = _fitted(x, target, dims, ridge, weight, weights[v])
            views.append(_calibrated(weights[v], labelled[v].pick(calibrates), y[calibrates]))
        if step == rounds:
            break
        fresh = _surest(features, known, views, sure, per_round, given)
        for v in (0, 1):
            given[1 - v].update(fresh[v])
        told.append({"round": step + 1, "to_text": len(given[0]), "to_meta": len(given[1])})
        if not any(fresh):
            break
    logits = np.stack([views[v].logit(labelled[v].pick(joins)) for v in (0, 1)], axis=1)
    return Model(views[0], views[1], _fitted(_dense(logits), y[joins].astype(float), 2, 1e-2), told)


def _scored(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(0, batch.num_rows, 1024):
        yield model.scores(*map(Rows.of, _features(batch.slice(i, 1024))))


def score_quality(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, score (the chance of good quality), keep: a row for each document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones = np.ones(batch.num_rows)
            parts = [np.concatenate(p) for p in zip(*_scored(batch, model), strict=True)] if model and batch.num_rows else [ones, ones, ones]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p, pa.float64()) for p in parts), pa.array(parts[2] >= threshold)], ["doc_id", "text_score", "meta_score", "score", "keep"])
        give_back()

    return docs.select("doc_id", *_prepared(docs)).mapInArrow(score, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def keep_quality(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns as they are, that score_quality keeps."""
    if model is None:
        return docs
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = pa.RecordBatch.from_arrays([batch.column(names.index(c)).cast(kind) if c in names else pa.nulls(batch.num_rows, kind) for c, kind in (("text", pa.string()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()))], list(COLUMNS))
            yield batch.filter(pa.array(np.concatenate([p[2] for p in _scored(view, model)] or [np.zeros(0)]) >= threshold, pa.bool_()))
        give_back()

    return docs.mapInArrow(keep, docs.schema)
