"""Whole pages in, design documents out; and the relational cascade against a plain recursion."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import cascade, components
from tessera.operators.layout import page_layout
from tessera.plans.engine import Options, convert
from tessera.sources.html import Node, parse, rows_of
from tessera.sources.html import read_html as load_html


def outline(node: Node) -> str:
    if node.kind == "text":
        return repr(node.text)
    return f"{node.tag}({','.join(outline(c) for c in node.children if c.kind != 'comment')})"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<p>b", "p('a'),p('b')"),
        ("<ul><li>a<li>b</ul>", "ul(li('a'),li('b'))"),
        ("<p><b>a<br><p>c</b>d", "p(b('a',br())),p(b('c'),'d')"),
        ("<script>var x='</p><b>';</script>y", "script(\"var x='</p><b>';\"),'y'"),
        ("a &amp; b &lt;", "'a & b <'"),
        ("<table><tr><td>1<td>2</table>", "table(tbody(tr(td('1'),td('2'))))"),
        ("<div><!-- <b> --><img src=x>t</div>", "div(img(),'t')"),
        ("", ""),
    ],
)
def test_tree(page, want):
    root = parse(page)
    found = [c for c in root.children if c.tag == "body"][0]
    head = [c for c in root.children if c.tag == "head"][0]
    assert ",".join(outline(c) for c in [*head.children, *found.children]) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/pbdiv \"'=!-ax&;", max_size=80))
def test_parser_takes_anything(text):
    rows = rows_of(parse(text))
    assert [r[0] for r in rows] == list(range(len(rows)))


PAGE = """<!DOCTYPE html><html><head><style>
:root{--brand:#ff0000} .card{background:#fff;padding:16px;border:1px solid var(--brand);width:200px}
.card h3{font-size:20px;color:#333} .row{display:flex;gap:10px} p{margin:0;margin:9px} @media print{i{color:blue}}
</style></head><body><div class="row"><div class="card"><h3>One</h3><p>Text <b style="font-weight:bold">bold</b> tail</p></div>
<div class="card"><h3>Two</h3><p>Text <b style="font-weight:bold">bold</b> tail</p></div><div class="card"><h3>Three</h3><p>Other <b style="font-weight:bold">bold</b> tail</p></div></div><img alt="x"></body></html>"""


@pytest.fixture(scope="module")
def document(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", None)], "page_id long, url string, html string")
    return convert(pages, Options(component_threshold=3))


def test_styles(document):
    d = document.dom.join(document.styles, ["page_id", "node_id"]).where("page_id = 1")
    style = {r["tag"]: r["style"] for r in d.collect()}
    assert style["h3"]["color"] == "#333" and style["div"]["border-left-color"] == "#ff0000"
    assert style["p"]["margin"] == "0" and "padding" not in style["p"]
    assert style["b"]["font-weight"] == "bold" and "border" not in style["div"]


def test_components(document):
    assert [tuple(r) for r in document.detected["components"].select("component_id", "name", "occurrences").collect()] == [("card", "Card", 3)]
    found = {(r["instance_id"], r["master_id"], r["characters"]) for r in document.detected["overrides"].collect()}
    assert found == {("instance-2", "card.text-0", "Two"), ("instance-3", "card.text-0", "Three"), ("instance-3", "card.text-1", "Other bold tail")}


def test_runs(document):
    row = document.ir.where("characters = 'Other bold tail'").first()
    assert [(r["start"], r["end"], r["text_style"]["font_style"]) for r in row["runs"]] == [(0, 6, "Regular"), (6, 10, "Bold"), (10, 15, "Regular")]


def test_tokens(document):
    paints = {(r["hex"], r["style_id"], r["total"]) for r in document.tokens["paints"].where("page_id = 1").collect()}
    assert paints == {("ffffff", "color/white", 1), ("ff0000", "brand/primary", 1), ("333333", "ink/primary", 1), ("000000", "color/black", 1)}
    assert {r["style_id"] for r in document.tokens["texts"].where("page_id = 1").collect()} == {"heading/md", "body/lg"}


def test_geometry(document):
    boxes = {r["node_id"]: r for r in document.ir.where("page_id = 1 and ir_type = 'FRAME'").collect()}
    assert [(b["geometry"]["x"], b["geometry"]["width"]) for _, b in sorted(boxes.items()) if b["name"] == "Card"] == [(0.0, 200.0), (210.0, 200.0), (420.0, 200.0)]


def test_stats_and_warnings(document):
    s = document.stats.where("page_id = 1").first()
    assert (s["components"], s["instances"], s["warnings"]) == (1, 3, 1)
    assert '"version":1' in document.export().where("page_id = 1").first()["json"]


def test_folder_of_pages(spark, tmp_path):
    assert load_html(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.HTML").write_text("<p>é")
    (tmp_path / "y.txt").write_text("no")
    assert [r["html"] for r in load_html(spark, str(tmp_path)).collect()] == ["<p>é"]


def boxes(page: str, width: float = 800.0) -> dict:
    rows = []
    for r in rows_of(parse(page)):
        attrs = dict(r[7])
        style = dict(p.split(":", 1) for p in attrs.get("style", "").split(";") if ":" in p)
        rows.append({"node_id": r[0], "parent_id": r[1], "kind": r[5], "tag": r[6], "text": r[8] or "", "attrs": attrs, "style": style})
    found = {n: (x, y, w, h) for n, x, y, w, h in page_layout(rows, width, 600.0)}
    return {r["attrs"]["id"]: found[r["node_id"]] for r in rows if "id" in r["attrs"]}


def test_layout_rules():
    assert boxes('<div id=a style="height:20px"></div><div id=b style="height:30px"></div>') == {"a": (0, 0, 800, 20), "b": (0, 20, 800, 30)}
    row = boxes('<div style="display:flex;justify-content:space-between;align-items:center;height:50px"><i id=a style="display:flex;width:100px;height:10px"></i><i id=b style="display:flex;width:100px;height:20px"></i></div>')
    assert row == {"a": (0, 20, 100, 10), "b": (700, 15, 100, 20)}
    grow = boxes('<div style="display:flex;gap:10px;width:310px"><div id=a style="flex-grow:1;height:5px"></div><div id=b style="flex-grow:2;height:5px"></div></div>')
    assert grow == {"a": (0, 0, 100, 5), "b": (110, 0, 200, 5)}
    assert boxes('<div id=a style="max-width:300px;margin:0 auto;height:5px"></div>') == {"a": (250, 0, 300, 5)}
    grid = boxes('<div style="display:grid;grid-template-columns:1fr 3fr;gap:8px"><div id=a style="height:5px"></div><div id=b style="height:5px"></div><div id=c style="height:5px"></div></div>', 408)
    assert grid == {"a": (0, 0, 100, 5), "b": (108, 0, 300, 5), "c": (0, 13, 100, 5)}
    wrapped = boxes('<div style="display:flex;flex-wrap:wrap;width:250px">' + "".join(f'<div id={c} style="width:100px;height:10px"></div>' for c in "abc") + "</div>")
    assert [wrapped[c][:2] for c in "abc"] == [(0, 0), (100, 0), (0, 10)]
    assert boxes('<div style="position:relative;height:100px;padding:10px"><div id=a style="position:absolute;right:0;top:5px;width:20px;height:20px"></div></div>') == {"a": (780, 5, 20, 20)}
    assert boxes('<div id=a style="width:200px;aspect-ratio:2"></div>')["a"] == (0, 0, 200, 100)


def test_inheritance_against_recursion(spark):
    rng = random.Random(3)
    rows, won, want = [], [], {}
    for page in range(8):
        styles: dict[int, dict] = {}
        paths: dict[int, list[int]] = {}
        for n in range(12):
            parent = rng.randrange(n) if n else None
            paths[n] = [*(paths[parent] if n else []), n]
            own = {p: rng.choice(["1", "2", "inherit", "unset"]) for p in ("color", "width", "--x") if rng.random() < 0.5}
            above = styles[parent] if n else {}
            now = {k: v for k, v in above.items() if k in ("color", "--x")}
            for k, v in own.items():
                if v in ("inherit", "unset"):
                    if k in above:
                        now[k] = above[k]
                else:
                    now[k] = v
            styles[n] = now
            rows.append((page, n, paths[n], "element"))
            won += [(page, n, k, v) for k, v in own.items()]
            want[page, n] = now
    nodes = spark.createDataFrame(rows, "page_id long, node_id int, path array<int>, kind string")
    found = cascade.computed(nodes, spark.createDataFrame(won, "page_id long, node_id int, prop string, value string"))
    assert {(r["page_id"], r["node_id"]): r["style"] for r in found.collect()} == want


def test_references():
    env = {"--a": "var(--b, red)", "--c": "var(--c)"}
    assert cascade.resolve("1px var(--a)", env) == "1px red"
    assert cascade.resolve("var(--none)", env) == ""
    assert "var(--c)" in cascade.resolve("var(--c)", env)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 2), st.integers(0, 5)), min_size=1, max_size=12, unique=True))
def test_winner(spark, rows):
    df = spark.createDataFrame([(1, 1, "p", str(i), imp, spec, order, 0) for i, (imp, spec, order) in enumerate(rows)], "page_id long, node_id int, prop string, value string, important boolean, s int, rule_order int, decl_idx int")
    got = cascade.winners(df.withColumn("specificity", F.struct("s"))).first()["value"]
    assert rows[int(got)] == max(rows)


def test_no_join_by_page_is_broadcast(spark):
    """Tables that are joined by page grow with the corpus: none is sent to the driver, however small it looks."""
    frame = lambda kinds: spark.createDataFrame([], kinds)
    placed = frame("page_id long, node_id int, ir_type string, name string, characters string, ir_path array<int>, ir_steps array<string>, fills array<int>, strokes array<int>, effects array<int>")
    found = frame("page_id long, component_id string, name string, master int")
    instances = frame("page_id long, node_id int, hash string, component_id string, name string, instance_id string")
    hashes = frame("page_id long, node_id int, hash string, shape string")
    for df in (*components.plan(placed, 3, hashes), components.overrides(placed, found, instances), components.rewritten(placed, found, instances)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_texts_are_made_without_drawings(spark, monkeypatch):
    """Texts are the same alone as among all design nodes, and no drawing is read for them."""
    from tessera.operators import svg

    html = '<body class="card">bare <p>one <b>two</b></p><svg><circle r="2"/><text>in</text></svg><div><svg><rect/><rect/></svg><i>x</i></div><img></body>'
    pages = spark.createDataFrame([(1, "u", html), (2, "u", "<p>y</p>"), (3, "u", None)], "page_id long, url string, html string")
    every = convert(pages, Options(font_fallback="Arial")).ir.where("ir_type = 'TEXT'")
    want = sorted(map(repr, every.collect()))

    def not_asked(*_):
        raise AssertionError("drawings were read")

    monkeypatch.setattr(svg, "vectors", not_asked)
    found = convert(pages, Options(font_fallback="Arial")).texts
    assert found.columns == every.columns and sorted(map(repr, found.collect())) == want and len(want) == 4
