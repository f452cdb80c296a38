"""A page that fails, at any stage, is told of and leaves all others as they are."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import components, document, faults, page
from tessera.plans.engine import Options, convert
from tessera.sources.css import read_css
from tessera.sources.html import outcome_lines, shortened
from tessera.sources.store import ship

HTML = "<style>p{color:red}</style><div class=card><p>one</p></div><div class=card><p>two</p></div><div class=card><p>three</p></div>"


@pytest.fixture(scope="module")
def pages(spark):
    ship(spark)
    return spark.createDataFrame([(i, f"p{i}", HTML + (" bad" if i == 2 else "")) for i in range(4)], "page_id long, url string, html string")


def bad(where: str, step):
    def run(*given):
        rows = given[0]
        text = rows if isinstance(rows, str) else "".join((r["text"] if isinstance(r, dict) else r[8]) or "" for r in rows)
        if "bad" in text:
            raise KeyError(where)
        return step(*given)

    return run


def plain(df):
    return sorted(map(repr, df.drop("stage", "error").collect()))


@pytest.mark.parametrize("stage", ["parse", "cascade", "layout", "shape"])
def test_a_stage_of_the_page(spark, pages, stage):
    first = (bad(stage, page.parsed) if stage == "parse" else page.parsed, bad(stage, page.cascaded) if stage == "cascade" else page.cascaded)
    last = (bad(stage, page.page_layout) if stage == "layout" else page.page_layout, bad(stage, page.shaped) if stage == "shape" else page.shaped)

    def whole(steps, more):
        rows = page.styled(pages, steps=steps)
        rows = rows.select(*(c for c in rows.columns if c != "raw_style"), F.col("raw_style").alias("style")).withColumn("boxed", F.lit(False))
        rows = rows.withColumn("shots", F.lit(None).cast("array<string>")).withColumn("measured", F.lit(None).cast("array<struct<mid:string,width:double,height:double>>"))
        return page.placed(rows, 800.0, 600.0, steps=more)

    found = whole(first, last)
    told = found.where("error is not null").select("page_id", "stage", "error").collect()
    assert [tuple(r) for r in told] == [(2, stage, f"KeyError: '{stage}'")]
    want = whole((page.parsed, page.cascaded), (page.page_layout, page.shaped)).where("page_id <> 2")
    assert plain(found.where("error is null")) == plain(want)


def test_a_stage_behind_the_page(spark):
    def build(group: pa.Table) -> pa.Table:
        key = group["page_id"][0].as_py()
        if key == 3:
            raise ValueError("x" * 9000)
        return pa.table({"page_id": [key], "n": pa.array([group.num_rows], pa.int32())})

    run = faults.guarded(build, pa.schema([("page_id", pa.int64()), ("n", pa.int32())]))
    rows = spark.createDataFrame([(i, k) for i in range(6) for k in range(i + 1)], "page_id long, k int")
    found = {r.page_id: (r.n, r.error) for r in rows.groupBy("page_id").applyInArrow(run, "page_id long, n int, error string").collect()}
    assert found[3] == (None, ("ValueError: " + "x" * 9000)[: faults.MOST])
    assert {k: v for k, v in found.items() if k != 3} == {i: (i + 1, None) for i in range(6) if i != 3}


def test_documents_that_cant_be_put_together(spark, pages, monkeypatch):
    doc = convert(pages, Options(layout=False))
    spoilt = doc._parts().withColumn("json", F.when((F.col("page_id") == 1) & (F.col("part") == "root"), "{").otherwise(F.col("json")))
    made = {r.page_id: (r.json, r.error) for r in document.nested(spoilt, "Page").collect()}
    good = {r.page_id: r.json for r in doc.export().collect()}
    assert made[1][0] is None and made[1][1].startswith("JSONDecodeError")
    assert {k: v[0] for k, v in made.items() if k != 1} == {k: v for k, v in good.items() if k != 1}


def test_components_of_a_page_that_cant_be_hashed(spark, pages):
    doc = convert(pages, Options(layout=False))
    want = {(r.page_id, r.component_id) for r in doc.detected["components"].collect()}
    assert want == {(i, "card") for i in range(4)}
    other = convert(pages, Options(layout=False))
    lost = components.hashed(other.placed).where("page_id <> 3").unionByName(spark.createDataFrame([(3, None, None, None, "KeyError: 'x'")], "page_id long, node_id int, hash string, shape string, error string"))
    other.__dict__["_hashed"] = lost
    assert {(r.page_id, r.component_id) for r in other.detected["components"].collect()} == want - {(3, "card")}
    assert {r.page_id for r in other.export().collect()} == {0, 1, 2}
    ended = {r.page_id: (r.ok, r.stage, r.message, r.nodes) for r in other.outcomes().collect()}
    assert ended[3] == (False, "components", "KeyError: 'x'", None)
    assert all(ended[i][0] and ended[i][3] > 0 for i in (0, 1, 2))


def test_outcomes_of_a_corpus(spark):
    wide = '<div style="display:grid;grid-template-columns:repeat(99999999999999999999,1fr)"><i>x</i></div>'
    rows = spark.createDataFrame([(1, "in/a.html", "<p>hi</p><img>"), (2, None, None), (3, "in/" + "c" * 60, wide), (4, "d", "")], "page_id long, url string, html string")
    doc = convert(rows)
    ended = doc.outcomes()
    found = {r.page_id: (r.ok, r.stage, r.message, r.nodes, r.warnings) for r in ended.collect()}
    assert found == {1: (True, None, None, 2, 1), 2: (False, "read", "no html", None, None), 3: (False, "layout", "ValueError: more than 10000 tracks", None, None), 4: (True, None, None, 0, 0)}
    assert {r.page_id for r in doc.export().collect()} == {1, 4}
    lines = {r.page_id: r.line for r in outcome_lines(ended, "in/").collect()}
    assert lines[1] == "  ✓ " + "a.html".ljust(40) + "  " + "2 nodes".ljust(12) + "  " + "0c × 0i".ljust(14) + "  " + "1p × 1t × 0e".ljust(16) + "  1 warning"
    assert lines[2] == "  ✗ " + " " * 40 + "  ERROR: no html"
    assert lines[3] == "  ✗ …" + "c" * 39 + "  ERROR: ValueError: more than 10000 tracks"


def test_names_are_cut_from_the_left(spark):
    df = spark.createDataFrame([("abc",), ("abcdef",), ("abcdefg",), ("",)], "x string")
    assert [r[0] for r in df.select(shortened(F.col("x"), 6)).collect()] == ["abc   ", "abcdef", "…cdefg", "      "]


def test_sheets_of_a_folder(spark, tmp_path):
    for name, text in (("a/x.css", "p{color:#010101}"), ("b/x.CSS", "p{color:#020202}"), ("b/y.txt", "p{}"), ("a/p.html", '<link rel=stylesheet href="x.css?1"><p>t'), ("b/p.html", '<link rel=stylesheet href="./x.CSS"><p>t'), ("b/q.html", '<link rel=stylesheet href="../a/x.css"><link rel=stylesheet href=z.css><p>t')):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    from tessera.sources.html import read_html

    assert read_css(spark, str(tmp_path / "none")).count() == 0
    sheets = read_css(spark, str(tmp_path))
    assert sorted(r.css for r in sheets.collect()) == ["p{color:#010101}", "p{color:#020202}"]
    doc = convert(read_html(spark, str(tmp_path)), Options(layout=False, stylesheets=sheets))
    colors = doc.dom.where("tag = 'p'").select("page_id", "node_id").join(doc.styles, ["page_id", "node_id"])
    assert {r.page_id: r.c for r in colors.select("page_id", F.col("style")["color"].alias("c")).collect()} == {0: "#010101", 1: "#020202", 2: None}
    assert sorted((r.page_id, r.warning) for r in doc.warnings.collect()) == [(2, "stylesheet refused: ../a/x.css"), (2, "stylesheet unresolved: z.css")]
    assert {r.page_id: r.prop for r in doc.rules.select("page_id", F.explode("decls").alias("d")).select("page_id", F.col("d.value").alias("prop")).collect()} == {0: "#010101", 1: "#020202"}


def test_pages_of_a_stage_come_together(spark):
    """Many pages go through one call, whole, however batches are cut; one that fails is told of alone."""
    def build(page):
        assert len(set(page["page_id"])) == 1 and page["node_id"] == sorted(page["node_id"])
        if page["page_id"][0] == 3:
            raise ValueError("x" * 9000)
        return page["node_id"][-1:], [len(page["node_id"])]

    schema = pa.schema([("page_id", pa.int64()), ("last", pa.int32()), ("n", pa.int32())])
    rows = ship(spark) and spark.createDataFrame([(i, k) for i in range(200) for k in range(i % 9, -1, -1)], "page_id long, node_id int")
    made = faults.by_pages(rows, build, schema, "page_id long, last int, n int")
    found = {r.page_id: (r.last, r.n, r.error) for r in made.collect()}
    assert found[3] == (None, None, ("ValueError: " + "x" * 9000)[: faults.MOST])
    assert {k: v for k, v in found.items() if k != 3} == {i: (i % 9, i % 9 + 1, None) for i in range(200) if i != 3}
    batches = [pa.RecordBatch.from_pydict({"page_id": pa.array(ids, pa.int64())}) for ids in ([1, 1], [], [1], [1, 2, 3], [3], [4])]
    assert [(c["page_id"], at) for c, at in faults.whole_groups(iter(batches))] == [([1, 1, 1, 1, 2], [0, 4, 5]), ([3, 3], [0, 2]), ([4], [0, 1])]
    for plan in (made, components.hashed(spark.createDataFrame([], components_schema()))):
        assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()


def components_schema() -> str:
    return "page_id long, node_id int, parent_ir int, ir_type string, name string, layout string, fills string, strokes string, effects string, corner_radius double, svg_source string, text_style string, image_ref string, vector_path string"
