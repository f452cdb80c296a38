"""Collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations

SCHEMA = "doc_id long, text string, lang string"
TABLE = {c: c + 32 for c in range(65, 91)}


def brute(docs: list[tuple], least: int = 30, most_words: int = 4, cover: int = 80, top: int = 2000) -> list[tuple]:
    by_lang: dict = {}
    for _, text, lang in docs:
        f = by_lang.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(TABLE)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, most_words + 1):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in by_lang.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        covered = set()
        for q, c in candidates.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    p = q[i : i + k]
                    if 100 * c >= cover * f[p]:
                        covered.add(p)
        rows = []
        for p, a in candidates.items():
            if p not in covered:
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(df, **options) -> list[tuple]:
    return sorted(tuple(r) for r in collocations.mine(df, **options).collect())


@pytest.mark.parametrize("chunk_tokens", [300, 2_000_000])
def test_phrases(spark, chunk_tokens):
    draw = random.Random(5)
    pool = ["the", "The", "of", "a", "New", "york", "city", "hall", "é", "É", "x\x1cy", " ", "日本"]
    fixed = ["new york city hall", "in spite of", "a a a a a", "of the", "machine learning", "as well as"]
    ends = [". ", ", ", "\n", " ", "\t", " ! ", "\r\n", ";", ":", "?", "\x0b", "\x0c", "  "]
    docs = []
    for i in range(300):
        parts = [draw.choice(fixed) if draw.random() < 0.4 else draw.choice(pool) for _ in range(draw.randrange(60))]
        docs.append((i, "".join(p + (draw.choice(ends) if draw.random() < 0.3 else " ") for p in parts), draw.choice(["en", "en", "de", None])))
    want = brute(docs)
    assert len(want) > 40
    assert {len(r[2].split(" ")) for r in want} == {2, 3, 4}
    assert found(spark.createDataFrame(docs, SCHEMA).repartition(3), chunk_tokens=chunk_tokens) == want
    assert found(spark.createDataFrame(docs, SCHEMA), least=10, most_words=3, cover=60, top=7, salts=2) == brute(docs, 10, 3, 60, 7)


def test_frequent_names_are_split(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SPLIT_BITS", 3)
    draw = random.Random(8)
    docs = [(i, " ".join(draw.choice(["the", "the", "of"] + [f"w{k}" for k in range(30)]) for _ in range(200)), "en") for i in range(60)]
    rows = collocations._words(spark.createDataFrame(docs, SCHEMA).repartition(2), 4000).where("seq is null")
    _, answers, _ = collocations._named(rows.select("chunk", "local", "n", "lang", "word"), ["lang", "word"], 30, 1)
    assert answers.where("bits > 5").count() > 0 and answers.where("bits < 6").count() > 0
    assert found(spark.createDataFrame(docs, SCHEMA).repartition(3), chunk_tokens=3000) == brute(docs)


def test_ties_and_counts_beyond_64_bits(spark):
    docs = [(i, "b a. c a. a b a. " + "z " * 40, "en") for i in range(40)]
    assert found(spark.createDataFrame(docs, SCHEMA)) == brute(docs)
    big = spark.createDataFrame([(9_000_000_000_000_000, [9_200_000_000_000_000_000], [9_100_000_000_000_000_000])], "f long, starts array<long>, ends array<long>")
    assert tuple(big.select(F.expr(collocations.CUT).alias("c")).first()["c"]) == (2000000 * 9_000_000_000_000_000 // 18_300_000_000_000_000_000, 1, 9_200_000_000_000_000_000, 9_100_000_000_000_000_000)


def test_defined_cases(spark):
    docs = [(None, None, None), (1, "", "en"), (2, "...", "en"), (3, "New York " * 5000, "en"), (4, "few words", None), *[(5, "said so. said so", None)] * 40]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"n": F.lit("x"), "local": F.lit(1), "chunk": F.lit(2), "word": F.lit(None).cast("string"), "f": F.lit(0)})
    assert found(df) == brute(docs)
    assert found(df.limit(0)) == []
    assert found(df.where("doc_id = 4")) == []


def test_pairs_of_a_large_chunk_take_little_memory():
    """What is held beside a chunk's places, and the pairs' number, doesn't grow with the chunk: executors have little for Python."""
    import tracemalloc

    n, size = 3_000_000, 2_000
    draw = np.random.default_rng(1)
    seq = (draw.zipf(1.3, n) % size).astype(np.int32)
    seq[::50] = -1
    named = np.flatnonzero(np.arange(size) % 7 != 3)
    left = pa.table({"chunk": pa.array([5]), "size": pa.array([size], pa.int32()), "seq": pa.array([collocations._packed(seq)], pa.binary())})
    right = pa.table({"chunk": pa.array(np.full(len(named), 5)), "local": pa.array(named.astype(np.int32)), "id": pa.array(named + 10**9), "bits": pa.array((named < 3).astype(np.int32) * 2)})
    tracemalloc.start()
    rows = collocations._paired(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * n
    own, asked = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
    after = collocations._unpacked(own["seq"])
    known = np.isin(seq, named)
    assert ((after >= 0) == np.append(known[:-1] & known[1:], False)).all()
    pairs = {}
    for r in asked.to_pylist():
        for i, (right_id, k) in enumerate(zip(r["rights"], r["ns"])):
            pairs[r["first"] + i] = (r["left"], right_id, k)
    assert sorted(pairs) == list(range(own["size"]))
    at = np.flatnonzero(after >= 0)
    counts = np.bincount(after[at], minlength=own["size"])
    assert all(pairs[j][2] == counts[j] for j in pairs) and len({p[:2] for p in pairs.values()}) == len(pairs)
    assert all(pairs[after[i]][:2] == (seq[i] + 10**9, seq[i + 1] + 10**9) for i in at[:: max(1, len(at) // 5000)])


def test_rows_of_pairs_grow_no_faster_than_chunks():
    """A frequent left name has its right neighbours in more buckets in a larger corpus; a chunk sends no more rows for that, and no pair is lost."""
    n, size, ways = 400_000, 3_000, 50
    draw = np.random.default_rng(2)
    seq = (draw.zipf(1.2, n) % size).astype(np.int32)
    left = pa.table({"chunk": pa.array([7]), "size": pa.array([size], pa.int32()), "seq": pa.array([collocations._packed(seq)], pa.binary())})
    found = []
    for bits in (0, 8):
        right = pa.table({"chunk": pa.array(np.full(size, 7)), "local": pa.array(np.arange(size, dtype=np.int32)), "id": pa.array(np.arange(size) + (3 << 31)), "bits": pa.array(np.full(size, bits, np.int32))})
        rows = collocations._sent(collocations._paired(left, right, ways), ways)
        assert rows.schema.names == collocations.SENT
        own, asked = rows.slice(0, 1).to_pylist()[0], rows.slice(1).to_pylist()
        assert len(asked) <= ways + 1
        pairs = {r["first"] + i: (a, b, k, r["way"]) for r in asked for i, (a, b, k) in enumerate(zip(r["lefts"], r["rights"], r["ns"], strict=True))}
        assert sorted(pairs) == list(range(own["size"]))
        after = collocations._unpacked(own["seq"])[:-1]
        counts = np.bincount(after, minlength=own["size"])
        assert all(pairs[j][2] == counts[j] for j in pairs)
        assert all(pairs[after[i]][:2] == (int(seq[i]) + (3 << 31), int(seq[i + 1]) + (3 << 31)) for i in range(0, n - 1, 97))
        assert max(np.bincount([p[3] for p in pairs.values()])) < len(pairs) / 5
        found.append({p[:3] for p in pairs.values()})
    assert found[0] == found[1] and len(found[0]) == own["size"]
