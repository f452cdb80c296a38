"""The pipeline's stages in a row, on rows of every awkward kind, each against brute force on its own input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_ops import classes, clean, is_leak, junk, windows, words

import corpus_pipeline
from tessera.llm import quality
from tessera.llm.queries import tokenizer_path
from tessera.sources.store import written

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, mix_epoch string, keep string, h long"


def folder(spark, tmp_path, labels, items):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, "mine", "k", 1) for i, t, s in rows], COLUMNS)


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    item = "what is the tallest tower of the old town? the bell tower by the river"
    rows = [(i, junk(rng) if i % 5 == 0 else clean(rng), f"s{i % 3}" if i % 7 else None) for i in range(300)]
    base = " ".join(clean(rng) for _ in range(4)).split()
    for k in range(6):  # near copies
        own = list(base)
        own[rng.randrange(len(own))] = "changed"
        rows.append((400 + k, " ".join(own), "s1"))
    rows += [(420, rows[3][1], "s0"), (421, clean(rng) + " " + item.upper() + " " + clean(rng), "s2"), (422, None, "s0"), (423, "", "s0"), (424, clean(rng) * 200, "s9"), (None, clean(rng), "s0"), (None, None, None), (301, rows[1][1], "s0"), (301, rows[1][1], "s0")]
    sf = folder(spark, tmp_path, [(i, int(i % 5 != 0), 0) for i in range(200)] + [(300, 0, 0), (300, 1, 0), (None, 1, 0), (9999, 1, 0)], [(1, item), (2, None), (3, "not here at all")])
    docs, seen = frame(spark, rows), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf), f"test-{name}")
        assert out.columns == docs.columns
        seen.append((docs.collect(), out.collect()))
        docs = out
    ids = lambda found: sorted((r["doc_id"] for r in found), key=str)
    # 1: what the classifier scores, and the labels
    given, kept = seen[0]
    scored = quality.score_quality(frame(spark, rows), quality.fit_quality(frame(spark, rows), spark.read.parquet(f"{sf}/labels.parquet"))).where("keep").collect()
    assert ids(scored) == ids(kept) and sum((i in {r["doc_id"] for r in kept}) == (i % 5 != 0) for i in range(300)) >= 295
    # 2: one of each class by all pairs; rows without a doc_id stay
    given, kept = seen[1]
    named = [r for r in given if r["doc_id"] is not None]
    sets = [{tuple(words(r["text"])[i : i + 5]) for i in range(max(1, len(words(r["text"])) - 4))} for r in given]
    links = [(i, j) for i in range(len(given)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = classes(len(given), links)
    least = {c: min((given[i]["doc_id"] for i in range(len(given)) if label[i] == c and given[i]["doc_id"] is not None), default=None) for c in label}
    assert ids(kept) == sorted([*(v for v in least.values() if v is not None), *[None] * (len(given) - len(named))], key=str)
    # 3: no leak by the rule
    given, kept = seen[2]
    assert ids(kept) == ids(r for r in given if not any(is_leak(item, w) for w in windows(r["text"] or "", item))) and 421 not in ids(kept)
    # 4: every document, once or twice, as it was
    given, kept = seen[3]
    assert {tuple(r) for r in kept} == {tuple(r) for r in given} and all(1 <= n / given.count(r) <= 2 for r, n in ((r, kept.count(r)) for r in given))
    # 5: the tokenizer's ids, in the order of doc_id
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = sorted((tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()), key=lambda r: r[1])
    order = sorted(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    at = 0
    for r, found in zip(order, got, strict=True):
        own = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert found == (r["doc_id"], at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "", "s"), (None, "", "s")]])
def test_stages_take_little(spark, tmp_path, rows):
    docs = frame(spark, rows)
    sf = folder(spark, tmp_path, [], [])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf), f"test-{name}")
        assert out.columns == docs.columns and (out.count() > 0) == (len(rows) > 0)
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
