"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text are hashed to a fixed number of dimensions. Document
frequencies are counted over all training rows. The model is trained by follow-the-regularised-leader (FTRL-proximal) with
an elastic net: the L1 part leaves weights at zero, the L2 part shrinks the rest. It is fitted on a sample of at most
max_rows training rows (one at least of each language), dealt evenly over languages in the order of a hash of doc_id and
text; a slice of the sample that it isn't fitted on sets the temperature that calibrates its probabilities. Prediction
reads whole texts, however long, and nothing but the text.

Defined cases: a null text or one without a letter (numbers such as a half or a Roman numeral sign aren't letters) is
"und" with score 0; rows with a null text or language aren't learned from; rows with a null doc_id are drawn like others,
and repeated rows count each, within the bound; with no training rows every text is "und"; with one language that one is
predicted with score 1; languages that tie go by name; repeated rows are predicted each; extra columns, whatever their
names, are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # dimensions by languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    bits: int


def grams(text: str, bits: int) -> np.ndarray:
    """How often each hashed n-gram occurs."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(31) + c[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(31) + c[2:] * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - bits)
    hashes = np.concatenate([(one ^ (one >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, (two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, (three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift])
    return np.bincount(hashes, minlength=1 << bits)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, (x / max(1e-12, np.sqrt((x * x).sum()))).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, classes: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
    rng = np.random.default_rng(seed)

    def weights(at):
        s = z[at]
        return np.where(np.abs(s) <= l1, 0.0, -(s - np.sign(s) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], dims), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = np.outer(x, p)
            old = n[at]
            sigma = (np.sqrt(old + g * g) - np.sqrt(old)) / alpha
            z[at] += g - sigma * w
            n[at] = old + g * g
    w = weights(np.arange(dims + 1))
    return w[:-1].astype(np.float32), w[-1]


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The one that makes y likeliest, by golden-section search on its logarithm."""

    def loss(t):
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()

    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit_langid(docs: DataFrame, trains: Column, max_rows: int = 6_000, bits: int = 14, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 2, seed: int = 11) -> Model | None:
    """Learns from the rows for which trains holds and lang isn't null."""
    train = docs.where(trains & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    dims = 1 << bits

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(dims, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen += grams(text, bits) > 0
                rows += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], rows))], ["at", "n"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t, bits) for t in batch.column("text").to_pylist()]
            at = [np.flatnonzero(x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array([a.astype("<u2" if bits <= 16 else "<u4").tobytes() for a in at], pa.binary()), pa.array([x[a].astype("<u4").tobytes() for x, a in zip(found, at, strict=True)], pa.binary())], ["h", "lang", "at", "n"])

    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    langs = sorted(counts)
    each = max(1, max_rows // len(langs))
    # a few more than each are drawn by the hash, and of these the first are taken
    share = F.coalesce(F.create_map(*[F.lit(y) for lang in langs for y in (lang, min(1.0, (each + 6 * each**0.5 + 20) / counts[lang]))])[F.col("lang")], F.lit(0.0))
    keyed = train.withColumn("h", F.xxhash64("doc_id", "text", F.lit(seed))).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    drawn = keyed.select("h", "text", "lang").mapInArrow(extract, "h long, lang string, at binary, n binary")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "at", "n"))
    sample = drawn.withColumn("nth", nth).where(F.col("nth") <= each).drop("nth").toArrow().sort_by([("h", "ascending"), ("lang", "ascending"), ("at", "ascending"), ("n", "ascending")])
    totals = train.select("text").mapInArrow(frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # dims rows at most
    df, rows = np.zeros(dims), 1
    for at, n in totals:
        if at < 0:
            rows = n
        else:
            df[at] = n
    idf = np.log((1 + rows) / (1 + df)) + 1
    x = []
    for a, n in zip(sample["at"].to_pylist(), sample["n"].to_pylist(), strict=True):
        at, k = np.frombuffer(a, "<u2" if bits <= 16 else "<u4").astype(np.int64), np.frombuffer(n, "<u4")
        v = (1 + np.log(k)) * idf[at]
        x.append((at, (v / max(1e-12, np.sqrt((v * v).sum()))).astype(np.float32)))
    y = np.array([langs.index(v) for v in sample["lang"].to_pylist()], int)
    if not len(y):
        return None
    if len(langs) == 1:
        return Model(langs[:1], np.zeros((dims, 1), np.float32), np.zeros(1), idf, 1.0, bits)
    held = np.random.default_rng(seed).random(len(y)) < 0.2
    w, b = ftrl([v for v, h in zip(x, held, strict=True) if not h], y[~held], dims, len(langs), alpha, beta, l1, l2, epochs, seed)
    model = Model(langs, w, b, idf, 1.0, bits)
    if held.any():
        model.temperature = temperature_of(np.stack([v @ w[at] + b for (at, v), h in zip(x, held, strict=True) if h]), y[held])
    return model


def predict_langid(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score: a row for each document."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for text in batch.column("text").to_pylist():
                if model is None or text is None or not any(map(str.isalpha, text)):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at, x = tf_idf(grams(text, model.bits), model.idf)
                p = softmax((x @ model.weights[at] + model.bias) / model.temperature)
                best = int(p.argmax())
                lang.append(model.langs[best])
                score.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
