"""Components found in one pass over a page against the joins that find the same."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import components
from tessera.plans.engine import Options, convert


def markup(r: random.Random, depth: int = 0) -> str:
    if depth > 3 or r.random() < 0.3:
        return r.choice(["<hr>", "<p>x</p>", "<p>y</p>", "<img>"])
    return f'<div class="{r.choice("abc")}">' + "".join(markup(r, depth + 1) for _ in range(r.randint(1, 3))) + "</div>"


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(4)
    rows = [(i, "u", "<body>" + "".join(r.choice([m, m, markup(r)]) for m in (markup(r),) * 12) + "</body>") for i in range(20)]
    return spark.createDataFrame([*rows, (20, "u", None), (21, "u", "")], "page_id long, url string, html string")


@pytest.mark.parametrize("options", [{}, {"font_fallback": "Arial"}, {"component_threshold": 2}, {"component_threshold": 0}])
def test_found_in_one_pass(spark, pages, options):
    doc = convert(pages, Options(layout=False, **options))
    found, instances = components.plan(doc.placed, doc.options.component_threshold, components.subtree_hashes(doc.placed))
    for got, want in ((doc.detected["components"], found), (doc.detected["instances"], instances)):
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert (doc.detected["components"].count() > 20) == (doc.options.component_threshold > 0)


def test_components_take_no_room_for_what_isnt_asked(spark, pages):
    """Components need neither the other design nodes nor the tree after detection, and no shape is written."""
    doc = convert(pages, Options(layout=False))
    assert doc.detected["components"].where(F.col("occurrences") < 3).count() == 0
    assert "ir" not in doc.__dict__ and "tree" not in doc.detected._made and "shape" not in doc._hashes.columns


DRAWINGS = '<body><svg style="color:#0000ff" fill="currentColor"><circle r="2"/><rect width="2" height="3"/></svg><svg></svg><noscript><img><svg></svg></noscript><div><img><svg><g><path d="M0 0"/></g></svg></div></body>'


def test_drawings_are_made_once(spark, monkeypatch):
    """Shapes and markup are used by several joins: the design nodes read them again and don't make them again."""
    from tessera.plans import engine

    plans, keep = {}, engine.by_page
    monkeypatch.setattr(engine, "by_page", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and keep(df, name))
    looks = convert(spark.createDataFrame([(1, "u", DRAWINGS)], "page_id long, url string, html string"), Options(layout=False)).looks
    assert "MapInArrow" not in plans["looks"] and plans["shapes"].count("MapInArrow") == 1 == plans["markup"].count("MapInArrow")
    found = [r.svg_source for r in looks.where("svg_source is not null").orderBy("node_id").collect()]
    assert found[0] == '<svg style="color:#0000ff" fill="#0000ff"><circle r="2"></circle><rect width="2" height="3"></rect></svg>' and len(found) == 2


def test_warnings_look_only_at_pictures(spark):
    """Of a page's nodes those that can be warned of are asked whether they are drawn, not all."""
    from tessera.operators import nodes
    from tessera.sources.html import dom_nodes

    page = DRAWINGS + "<p>x</p>" * 50
    told = nodes.warnings(dom_nodes(spark.createDataFrame([(1, page)], "page_id long, html string")))
    assert sorted(r.warning for r in told.collect()) == ["image without a source", "vector without shapes"]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    asked = [line for line in plan.splitlines() if "Filter" in line and "svg" in line and "img" in line]
    assert asked


def test_large_pages_are_let_go():
    """What a page was put together of isn't held while the page is worked on, and its rows go on in pieces."""
    import weakref

    import pyarrow as pa

    from tessera.operators import page

    refs = []

    def given():
        for _ in range(3):
            batch = pa.record_batch({"node_id": pa.array([0, 1, 2])})
            refs.append(weakref.ref(batch))
            yield batch

    found = page.whole_pages(given())
    assert next(found).num_rows == 3 and refs[0]() is None and [t.num_rows for t in found] == [3, 3]
    rows = pa.table({"node_id": pa.array(range(2 * page.IN_PIECE + 1))})
    assert [b.num_rows for b in page.in_pieces(rows)] == [page.IN_PIECE, page.IN_PIECE, 1]
