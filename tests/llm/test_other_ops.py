"""Vectors, urls, components and the pipeline against brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, urls
from tessera.llm.components import connected_components
from tessera.llm.queries import RULES


def nearest(rows, query, k):
    q = np.array(query[1], np.float32).astype(float)
    d = [(float(np.sqrt(((np.array(v, np.float32).astype(float) - q) ** 2).sum())), i) for i, v in rows if i != query[0]]
    return sorted(d)[:k]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((400, 16)).astype(np.float32)
    base[300:] = base[7]
    rows = [(i, base[i].tolist()) for i in range(400)]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0] * 5), (None, [1.0] * 16), (1004, [None] * 16), (300, rows[300][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, score string")
    found = {}
    for r in ann.search(frame, F.col("id") % 100 == 0, k=10, block=64).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(found) == {0, 100, 200, 300}
    hits = 0
    for q, got in found.items():
        got.sort()
        want = nearest(rows, rows[q], 10)
        assert [g[0] for g in got] == list(range(1, 11)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
        exact = {i: s for s, i in nearest(rows, rows[q], 400)}
        assert all(s == pytest.approx(exact[i]) for _, s, i in got)
        hits += len({i for _, i in want} & {g[2] for g in got})
    assert hits >= 36
    assert [g[2] for g in found[300]] == [7, *range(301, 310)]


def test_shelves_hold_what_they_should():
    rng = random.Random(4)
    sizes = {c: rng.choice([1, 3, 20, 64, 65, 300]) for c in range(200)}
    shelves, held = ann.shelved(sizes, 64), {}
    for c, (first, end) in shelves.items():
        assert end - first == (1 if sizes[c] <= 64 else -(-sizes[c] // 64))
        for shelf in range(first, end):
            held.setdefault(shelf, []).append(sizes[c] / (end - first))
    assert max(map(sum, held.values())) <= 64 and sorted(held) == list(range(len(held)))
    assert all(len(own) == 1 for own in held.values() if max(own) > 32 and sum(own) > 64)


def test_distances_are_those_of_double_vectors(spark):
    rows = [(i, [1.0 + i * 1e-12, 2.0]) for i in range(20)]
    got = [tuple(r) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, k=3).orderBy("rank").collect()]
    assert [r[2] for r in got] == [1, 2, 3] and got[0][3] == pytest.approx(1e-12, rel=1e-3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_recall_at_the_default(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], np.float32).astype(float)
    ids = np.array([r["vec_id"] for r in rows])
    got = {}
    for r in ann.search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(ids[np.argsort(d, kind="stable")[:10]].tolist()) & got[ids[q]])
        total += 10
    assert hits >= 0.9 * total, hits / total


def test_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [4.0, 4.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.search(few, F.col("id") == 0).orderBy("rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(few.limit(0), F.col("id") == 0).count() == 0


def judged(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None) if host else None
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_urls(spark):
    rng = random.Random(2)
    hosts = ["example.com", "a.example.com", "EXAMPLE.net", "x.y.example.net", "org", "b.org", "com", "notexample.com", "example.com.", "net", ""]
    rows = [f"http{'s' * (i % 2)}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/7', '/en/70?x#y', '/de/8', '/es/', '?q=/en/', '#f'])}" for i in range(400)]
    rows += ["http://example.com/en/7" + "x" * 200_000 + "?q", "http://" + "a." * 20_000 + "example.net/de/8", None, "", "no scheme", "://", "a://b://c/en/", "http://É.com/en/ü", *["http://example.com/en/71"] * 300]
    rules = [*RULES, ("example.com", "", "block"), ("x.y.example.net", "/de/", "block"), ("y.example.net", "", "allow"), ("EXAMPLE.com", "/en/7", "block"), *[("example.com", f"/en/{i}", "block") for i in range(70, 90)], ("x.y.example.net", "/de/8", "allow")]
    rules = [(h.lower(), p, a) for h, p, a in rules]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(rows)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.filter_urls(pages, urls.rules_frame(spark, rules), sample=64).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(rows)}
    assert urls.filter_urls(pages.limit(0), urls.rules_frame(spark, rules)).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(pages, urls.rules_frame(spark, []), default="block").collect()} == {"block"}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(frame, "a", "b").collect()} == label
    assert connected_components(frame.limit(0), "a", "b").count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline(spark):
    import corpus_pipeline
    from tessera.llm.queries import table
    from tessera.sources.store import written

    docs, seen = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        seen.append((docs, out))
        docs = out
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in seen[0][1].collect()}
    wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
    assert len(wrong) <= 0.03 * len(labels)
    assert {r["doc_id"] for r in seen[3][1].collect()} == {r["doc_id"] for r in seen[2][1].collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()[0] == last.agg(F.sum("n_tokens")).first()[0]
