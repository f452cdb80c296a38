"""The page kernel against the relational cascade, deep pages, and the parts that SQL can't say."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import cascade, classify, page
from tessera.operators.layout import page_layout
from tessera.sources import css as css_source
from tessera.sources.html import MOST_DEPTH, dom_nodes, parse, parse_outcomes, read_html, rows_of
from tessera.sources.store import ship

SELECTORS = ["p", "*", ".a", ".b.a", "#x", "div p", "div > p", ".a .b", "div > .a > p", "body p:first-child", "p:last-of-type", ":root", "i:only-child", ".a > *", "div[x]", "p::before", ".a + .b", "#x .a p", "b:empty"]
VALUES = ["color:red", "width:5px", "--v:1px", "color:inherit", "width:inherit", "margin:var(--v)", "border:1px solid var(--w, blue)", "color:var(--c) !important", "--c:var(--v)", "font-size:20px !important", "width:unset", "padding:0"]


def random_page(rng):
    rules = [f"{', '.join(rng.sample(SELECTORS, rng.randrange(1, 3)))}{{{';'.join(rng.sample(VALUES, rng.randrange(1, 4)))}}}" for _ in range(rng.randrange(0, 9))]

    def body(depth):
        out = []
        for _ in range(rng.randrange(1, 4)):
            tag = rng.choice(["div", "p", "b", "i", "span"])
            attrs = (f' class="{rng.choice(["a", "b", "a b", ""])}"' if rng.random() < 0.6 else "") + (' id="x"' if rng.random() < 0.1 else "") + (f' style="{";".join(rng.sample(VALUES, 2))}"' if rng.random() < 0.3 else "")
            out.append(f"<{tag}{attrs}>{body(depth - 1) if depth and rng.random() < 0.7 else rng.choice(['', 'text', ' '])}</{tag}>")
        return "".join(out)

    return f"<html><head><style>{' '.join(rules)}</style></head><body>{body(4)}<style>.b{{color:green}}</style></body></html>"


def test_kernel_agrees_with_the_relational_cascade(spark):
    rng = random.Random(1)
    pages = ship(spark) and spark.createDataFrame([(i, random_page(rng)) for i in range(60)], "page_id long, html string")
    rows = page.page_nodes(pages, layout=False).cache()
    dom = dom_nodes(pages)
    rules = css_source.css_rules(css_source.stylesheets(dom))
    matched = cascade.matches(dom, rules).select("page_id", "node_id", "rule_order", "specificity")
    got = rows.select("page_id", "node_id", F.inline("matched"))
    assert sorted(map(str, got.collect())) == sorted(map(str, matched.collect())) and got.count() > 300
    won = cascade.winners(cascade.candidates(dom, rules))
    assert {tuple(r) for r in rows.select("page_id", "node_id", F.explode("won")).collect()} == {tuple(r) for r in won.collect()}
    styles = {(r["page_id"], r["node_id"]): r["style"] for r in cascade.computed(dom, won).collect()}
    assert {(r["page_id"], r["node_id"]): r["style"] for r in rows.where("kind = 'element'").select("page_id", "node_id", "style").collect()} == styles
    # names of rules' specificity are those of the column expression
    both = rules.select("selector", page.css.specificity(F.col("selector")).alias("s")).distinct().collect()
    assert all(tuple(r["s"]) == page.specificity_of(r["selector"]) for r in both)
    # texts and what is ignored
    plain = classify.text_only(classify.drawn(dom)).where("text_only").select("page_id", "node_id")
    texts = rows.where("ir_type = 'TEXT' and kind = 'element'").select("page_id", "node_id")
    assert texts.join(plain, ["page_id", "node_id"], "left_anti").count() == 0 and texts.count() > 20


def test_pages_stay_whole_across_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    pages = ship(spark) and spark.createDataFrame([(i, f"<div><p>{i}</p></div>" * (i % 7)) for i in range(50)], "page_id long, html string").coalesce(1)
    want = sorted(map(str, page.page_nodes(pages).select("page_id", "node_id", "ir_type", "ir_path", "ir_steps", "box").collect()))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert sorted(map(str, page.page_nodes(pages).select("page_id", "node_id", "ir_type", "ir_path", "ir_steps", "box").collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_deep_pages_are_kept(spark):
    html = "<div>" * 20_000 + "deep" + "<b>" * 600
    root = parse(html)
    rows = rows_of(root)
    assert root.flattened and len(rows) == 20_000 + 600 + 4 and max(r[3] for r in rows) <= MOST_DEPTH and any(r[8] == "deep" for r in rows)
    pages = ship(spark) and spark.createDataFrame([(1, "<div>" * 3000 + "deep"), (2, None), (3, "<p>x")], "page_id long, html string")
    nodes = page.page_nodes(pages)
    assert {r["page_id"]: r["n"] for r in nodes.groupBy("page_id").agg(F.count("*").alias("n")).collect()} == {1: 3004, 2: 1, 3: 5}
    assert nodes.where("page_id = 1 and text = 'deep' and ir_type = 'TEXT'").count() == 1
    assert {r["page_id"]: (r["ok"], r["error"]) for r in parse_outcomes(pages).collect()} == {1: (True, f"nested deeper than {MOST_DEPTH}"), 2: (False, "no html"), 3: (True, None)}


def test_deep_layout_takes_its_time_once():
    rows = [{"node_id": i, "parent_id": i - 1 if i else None, "kind": "element", "tag": "div", "text": "", "attrs": {}, "style": {"padding": "1px", "display": "flex" if i % 2 else "block"}} for i in range(200)]
    found = page_layout(rows, 800.0, 600.0)
    assert len(found) == 200 and found[0][3] == 800


def test_references():
    env = {"--a": "1px", "--b": "var(--a) solid", "--self": "x var(--self)", "--e": ""}
    assert cascade.resolve("var(--b) var(--none, red )", env) == "1px solid red"
    assert cascade.resolve("var( --a )var(--none)var(--e)", env) == "1px"
    assert cascade.resolve("var(a) var(--a", env) == "var(a) var(--a"
    assert cascade.resolve("var(--none, var(--a))", env) == "var(--a)" or cascade.resolve("var(--none, var(--a))", env).endswith(")")
    assert "var(--self)" in cascade.resolve("var(--self)", env)


def test_folder_is_sorted(spark, tmp_path):
    for name in ("b/z.html", "a.HTML", "b/a.html", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"<p>{name}")
    found = read_html(spark, str(tmp_path))
    assert "Exchange rangepartitioning" not in found._jdf.queryExecution().toString()  # contents aren't sorted
    got = sorted(found.collect())
    assert [(r["page_id"], r["url"].rsplit(str(tmp_path))[-1]) for r in got] == [(0, "/a.HTML"), (1, "/b/a.html"), (2, "/b/z.html")]
    with pytest.raises(Exception):  # noqa: B017  a scheme that isn't known is no empty folder
        read_html(spark, "nowhere://x/y").count()


def test_pages_of_one_small_file_are_read_by_all_tasks(spark, tmp_path):
    spark.range(64).selectExpr("id as page_id", "'<p>x' as html").coalesce(1).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    tasks = page.page_nodes(pages, layout=False).select("page_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.page_id for r in tasks}) == len(tasks) == 64 and len({r.task for r in tasks}) == 4


def test_tables_by_page_are_not_broadcast(spark):
    from tessera.plans.engine import Options, convert

    doc = convert(spark.createDataFrame([(i, "u", '<div class="a"><p>x</p></div>' * 4) for i in range(3)], "page_id long, url string, html string"), Options(layout=False))
    for table in (doc.dom, doc.placed, doc.detected["components"], doc.detected["tree"], doc.tokens["paints"]):
        df = doc.pages.select("page_id").join(table.where("page_id > 0").select("page_id"), "page_id")
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().simpleString()


def test_deep_pages_take_time_in_proportion(spark):
    """The open elements are not searched for what was never opened, and a count of nodes makes no paths."""
    import time

    from tessera.sources.html import count_of

    def seconds(n: int) -> float:
        html = "<div>" * n
        start = time.process_time()
        for _ in range(30 * 500 // n):
            root = parse(html)
            assert count_of(root) == n + 3
        return time.process_time() - start

    seconds(50)
    assert seconds(500) < 3 * seconds(50)
    for html in ("<p>a<div>b</p><svg><g><rect></svg>c", "<div><p>x<table><tr><td><p>y</table>", "<i>a<b>c</i>d"):
        root = parse(html)
        assert count_of(root) == len(rows_of(root))


def test_equal_pages_are_worked_out_once(spark, tmp_path, monkeypatch):
    """Of equal pages a task reads one, unless what a browser has measured of them differs; pages that fail stay each on its own."""

    def noted(name, step):
        def run(*given):
            import uuid

            (tmp_path / f"{name}-{uuid.uuid4().hex}").touch()
            if name == "layout" and any(r["text"] == "bad" for r in given[0]):
                raise KeyError("bad")
            return step(*given)

        return run

    texts = ["<p data-c2f-mid=m>a</p>", "<style>p{color:red}</style><p>b<i>c</i></p>", "bad", None]
    pages = spark.createDataFrame([(i, texts[i % 4]) for i in range(80)], "page_id long, html string").coalesce(1)
    monkeypatch.setattr(page, "dealt", lambda df: df.coalesce(1))
    rows = page.styled(pages, steps=(noted("parse", page.parsed), noted("cascade", page.cascaded)))
    rows = rows.select(*(c for c in rows.columns if c != "raw_style"), F.col("raw_style").alias("style")).withColumn("boxed", F.lit(False)).withColumn("shots", F.lit(None).cast("array<string>"))
    size = F.when((F.col("node_id") == 0) & (F.col("page_id") % 8 == 0), F.array(F.struct(F.lit("m").alias("mid"), F.lit(50.0).alias("width"), F.lit(9.0).alias("height"))))
    rows = rows.withColumn("measured", size)
    found = page.placed(rows, 800.0, 600.0, steps=(noted("layout", page.page_layout), page.shaped)).collect()
    made = {}
    for r in found:
        made.setdefault(r.page_id, []).append(tuple(r)[1:])
    assert {k: len(v) for k, v in made.items()} == {i: [5, 9, 1, 1][i % 4] for i in range(80)}
    assert all(made[i] == made[i % 8] for i in range(80)) and made[0] != made[4]
    assert [(made[i][0][found[0].__fields__.index("error") - 1]) for i in (2, 3)] == ["KeyError: 'bad'", "no html"]
    taken = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert taken.count("parse") == 3 and taken.count("cascade") == 3 and taken.count("layout") <= 20


def test_inheritance_takes_one_shuffle_by_page(spark):
    """Declarations and elements meet once; ancestors that are no rows themselves still hand on what they declare."""
    nodes = spark.createDataFrame([(k, n, path, "element") for k in range(3) for n, path in ((0, [0]), (2, [0, 2]), (4, [0, 3, 4]), (5, [0, 3, 4, 5]))], "page_id long, node_id int, path array<int>, kind string")
    won = spark.createDataFrame([(k, n, p, v) for k in range(3) for n, p, v in ((0, "color", "red"), (0, "width", "1px"), (2, "width", "inherit"), (3, "color", "var(--c, blue)"), (3, "--c", f"#{k}"), (5, "width", "inherit"))], "page_id long, node_id int, prop string, value string")
    found = cascade.computed(nodes, won)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    want = {0: {"color": "red", "width": "1px"}, 2: {"color": "red", "width": "1px"}}
    for r in found.collect():
        assert r["style"] == want.get(r["node_id"], {"color": f"#{r['page_id']}", "--c": f"#{r['page_id']}"})
    assert found.count() == 12


def test_nodes_that_are_alike_are_worked_out_once(spark):
    """Styles, design nodes and prints of nodes that are alike are made once a page, and come to what each would on its own."""
    from tessera.operators import components, nodes
    from tessera.plans.engine import Options, convert

    css = ".a{background:red;border-radius:50%;width:20px;height:10px} .a p{color:blue} .b{border:1px solid} i:first-child{font-weight:bold} b{color:green}"
    card = lambda k: f'<div class="{"ab"[k % 2]}"><p>t{k}<i>x</i></p><p title="{k}">same<br>{"<b>y</b>" if k % 3 == 0 else ""}</p>bare{k}<img src="{k}.png" alt="{k}"></div>'
    drawing = '<svg><rect width="3" height="3"></rect></svg><svg><path d="M0 0L1 1"></path><path d="M0 0L2 2"></path></svg>'
    pages = [f"<style>{css}</style><div style='display:flex'>{''.join(map(card, range(30)))}</div>{drawing * 2}<div class='a' style='width:{k}px'>z</div>" for k in range(3)]
    rng = random.Random(3)
    pages += [random_page(rng) for _ in range(20)]
    rows = rows_of(parse(pages[0]))
    assert 5 * len({id(x) for x in page.cascaded(rows, {})}) < len(rows)
    given = ship(spark) and spark.createDataFrame([(i, "u", html) for i, html in enumerate(pages)], "page_id long, url string, html string")
    assert "measured" not in page.page_nodes(given)._jdf.queryExecution().analyzed().toString()  # what isn't there isn't sent
    for layout in (True, False):
        doc = convert(given, Options(layout=layout))
        plain = doc._titled(nodes.ir_nodes(doc.nodes, geometry=layout)).where("ir_type <> 'VECTOR'")
        own = doc.ir.join(plain.select("page_id", "node_id"), ["page_id", "node_id"], "left_semi").select(plain.columns)
        assert sorted(map(str, own.collect())) == sorted(map(str, plain.collect()))
        some = "page_id < 3 and ir_type in ('FRAME', 'TEXT')"
        assert 3 * doc.looks.where(some).count() < doc.ir.where(some).count()
        # the same hashes as of all design nodes
        want = components.hashed(doc.placed).select("page_id", "node_id", "hash", "shape")
        assert sorted(map(str, doc._hashed.select(want.columns).collect())) == sorted(map(str, want.collect()))
        assert doc.frames.count() == doc.ir.where("ir_type = 'FRAME'").count()
