"""Results that must not depend on how much there is, or on how it is cut."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import decontaminate, quality, simhash


def test_two_items_of_one_id_in_one_document(spark):
    first, second = "where do the quick brown foxes of the north sleep when winter comes early", "which of the seven rivers of the old kingdom runs through the valley of stones"
    items = [(7, first), (7, second), (None, first), (None, second + " again"), (7, first), *[(100 + i, f"an unrelated item number {i} with words w{i} x{i} y{i} z{i} and more of v{i}") for i in range(30)]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"some words before. {first} in between {second} again and after"), (2, second), (3, "nothing of it at all")], "doc_id long, text string")
    rows = lambda **o: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.find_leaks(docs, bench, **o).collect())
    whole = rows()
    assert [r[:2] for r in whole].count((1, 7)) == 2 and [r[:2] for r in whole].count((1, -1)) == 2
    for most in (1, 3, 11, 20):
        assert rows(max_items=most) == whole


def test_roles_hold_both_labels():
    for n, m in ((57, 3), (2, 50), (1, 1), (5, 5), (100, 4)):
        y = np.array([1] * n + [0] * m)
        parts = quality.roles(y)
        assert all(set(y[p].tolist()) == {0, 1} for p in parts)
        if n > 2 and m > 2:
            assert sorted(np.concatenate(parts).tolist()) == list(range(n + m))


def test_few_labels_of_one_kind_are_enough(spark):
    good = "The committee met on Tuesday to discuss the new library, and most of its members spoke in favour of the plan. "
    junk = "$$$ ### BUY 999 | NOW!!! @@@ ### $$$ "
    docs = [(i, (junk if i % 10 == 0 else good) * (3 + i % 4) + f" {i}", "en", "bad" if i % 10 == 0 else "ok", 100) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 60) if i % 10] + [(i, 0) for i in (10, 20, 30)] + [(i, None) for i in range(300, 390)] + [(5000 + i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = quality.fit_quality(frame, labels)
    assert model is not None
    kept = {r.doc_id for r in quality.keep_quality(frame, model).collect()}
    assert kept == {i for i in range(400) if i % 10}
    assert quality.fit_quality(frame, labels.where("doc_id >= 5000")) is None


def test_the_bound_counts_labels_that_agree(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 5, "en", "s", 10) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int").unionByName(spark.range(4000).select((F.col("id") + 1000).alias("doc_id"), F.lit(None).cast("int").alias("quality")))
    asked = []
    own = quality._rows_of
    quality._rows_of = lambda features, keys: asked.append(keys.count()) or own(features, keys)
    try:
        quality.fit_quality(docs, labels, max_labelled=100)
    finally:
        quality._rows_of = own
    assert asked[0] == 100


def test_two_texts_of_one_id(spark):
    one, two = " ".join(f"word{i}" for i in range(60)), " ".join(f"other{i}" for i in range(60))
    docs = spark.createDataFrame([(1, one), (5, one), (5, two), (5, two), (None, one), (7, two + " more")], "doc_id long, text string")
    kept = simhash.keep_representatives(docs, simhash.similar_groups(docs))
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(1, one), (5, two), (None, one)]))
