"""The Merkle manifest against a tree built by hand."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(x: str) -> str:
    return sha256(x.encode()).hexdigest()


def leaf(d: tuple, more: int = 0) -> str:
    doc_id, text, lang, source, n_chars = d
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, None if n_chars is None else n_chars + more, text)))


def paths(hashes: list[str], fan: int) -> tuple[str, list[list[tuple[list[str], int]]]]:
    """The root, and each node's list of (its run, its place in it) from below."""
    up, at, found = hashes, list(range(len(hashes))), [[] for _ in hashes]
    while len(up) > 1:
        runs = [up[i : i + fan] for i in range(0, len(up), fan)]
        for i, place in enumerate(at):
            found[i].append((runs[place // fan], place % fan))
        at, up = [p // fan for p in at], [h("".join(r)) for r in runs]
    return up[0], found


def brute(docs: list[tuple], fan: int = 2) -> list[tuple]:
    by: dict = {}
    for d in docs:
        by.setdefault(d[2], []).append(d)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees[lang] = paths([leaf(d) for d in by[lang]], fan)
    root, above = paths([trees[x][0] for x in langs], fan)
    out = []
    for k, lang in enumerate(langs):
        for d, path in zip(by[lang], trees[lang][1], strict=True):
            path = path + above[k]
            claimed = leaf(d, 1 if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 else 0)
            beside = "".join("".join(x for i, x in enumerate(run) if i != at) for run, at in path)
            for run, at in path:
                claimed = h("".join([*run[:at], claimed, *run[at + 1 :]]))
            out.append((d[0], leaf(d), trees[lang][0], root, h(beside), claimed, claimed == root))
    return sorted(out, key=repr)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def claimed():
    return queries.claimed_leaf()


@pytest.mark.parametrize(("n", "fan", "levels"), [(1, 2, 2), (2, 2, 2), (5, 2, 2), (64, 2, 3), (65, 2, 2), (200, 2, 8), (131, 3, 2)])
def test_trees_of_any_size(spark, n, fan, levels):
    draw = random.Random(n)
    docs = [(i, f"text {i}", draw.choice(["en", "en", "en", "de", None, "é"]), draw.choice(["a", "", None]), draw.choice([None, i, 10 * i])) for i in range(n)]
    draw.shuffle(docs)
    found = merkle.manifest(spark.createDataFrame(docs, SCHEMA), {"claimed": claimed()}, fan=fan, levels=levels).withColumn("f", merkle.folded(F.col("claimed"), F.col("path")))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))), "f", F.col("f") == F.col("root"))
    assert rows(found) == brute(docs, fan)


def test_defined_cases(spark):
    docs = [(None, None, None, None, None), (None, "", None, None, None), (7, "a", "en", "s", None), (7, "a", "en", "s", None), (7, "b", "en", "s", 1), (3, "x" * 200_000, "en", "ü", 5), (14, "c", "en", "s", 9), (1, "d", "de", "s", 1)]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"pos": F.lit(1), "n": F.lit("x"), "root": F.lit(2), "hash": F.lit(None).cast("string"), "g": F.lit(3)})
    assert rows(merkle.verify(df, claimed())) == brute(docs)
    assert merkle.verify(df.limit(0), claimed()).count() == 0


def test_one_lang_holds_all(spark):
    docs = [(i % 50, "same", "en", "s", 1) for i in range(300)] + [(None, str(i), "en", None, i) for i in range(100)]
    assert rows(merkle.verify(spark.createDataFrame(docs, SCHEMA), claimed())) == brute(docs)
