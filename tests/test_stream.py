"""A stream of pages converted in batches."""

import pytest

from tessera.plans.engine import Options, convert
from tessera.sources.store import ship
from tessera.streaming import ingest

SCHEMA = "page_id long, url string, html string"
CARD = "<div class=card><p>{}</p></div>"


@pytest.fixture(scope="module")
def spark_(spark):
    return ship(spark)


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_batches_and_one_go_agree(spark_, tmp_path):
    spark, o = spark_, Options(layout=False)
    first = [(i, f"u{i}", "".join(CARD.format(k) for k in range(3 + i % 2))) for i in range(4)] + [(9, "u9", None)]
    second = [(1, "u1", "<p>now only this"), (3, "u3", None), (9, "u9", CARD.format("x") * 4), (20, "u20", "<p>new"), (20, "u20", "<p>a")]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(first, SCHEMA).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    ingest.convert_stream(stream(), target, o).awaitTermination()
    assert {r.page_id for r in ingest.current(spark, target, "documents").collect()} == {0, 1, 2, 3}
    spark.createDataFrame(second, SCHEMA).write.mode("append").parquet(source)
    ingest.convert_stream(stream(), target, o).awaitTermination()

    merged = {r[0]: r for r in first} | {r[0]: r for r in sorted(second, key=lambda r: (r[0], r[2] or ""))}
    doc = convert(spark.createDataFrame(list(merged.values()), SCHEMA), o)
    for name, take in ingest.TABLES.items():
        assert rows(ingest.current(spark, target, name)) == rows(take(doc)), name
    assert {r.page_id for r in ingest.current(spark, target, "failures").collect()} == {3}

    # the second batch again changes nothing; one that broke off before its list is not seen
    before = rows(ingest.current(spark, target, "nodes"))
    ingest.converted(spark.createDataFrame(second, SCHEMA), 1, target, o)
    assert rows(ingest.current(spark, target, "nodes")) == before
    spark.createDataFrame([(0, 5)], "page_id long, node_id int").write.parquet(f"{target}/nodes/batch={7:019d}")
    assert rows(ingest.current(spark, target, "nodes")) == before
