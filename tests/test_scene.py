"""Strict matching, subtree rectangles, the order of building and names in the order of a language, against plain Python."""

import random

from pyspark.sql import functions as F

from tessera.operators import cascade, page, scene, tokens
from tessera.plans.engine import Options, convert
from tessera.sources import css as css_source
from tessera.sources.html import dom_nodes, parse, rows_of
from tessera.sources.store import ship


def backtracking(parts, combs, up) -> bool:
    """Compounds before the last against ancestors (root first), trying every one."""
    if not parts:
        return True
    if combs[-1] == ">":
        return bool(up) and page.fits(parts[-1], up[-1]) and backtracking(parts[:-1], combs[:-1], up[:-1])
    return any(page.fits(parts[-1], up[i]) and backtracking(parts[:-1], combs[:-1], up[:i]) for i in range(len(up)))


def element(tag: str, classes: str = "") -> tuple:
    return (tag, None, set(classes.split()), set())


def test_strict_matching_tries_everything():
    rng = random.Random(4)
    differ = 0
    for _ in range(4000):
        up = [element(rng.choice("abc"), rng.choice(["", "x", "y"])) for _ in range(rng.randrange(7))]
        parts = [(rng.choice(["a", "b", "c", None]), None, rng.choice([[], [], ["x"]]), []) for _ in range(rng.randrange(1, 5))]
        combs = [rng.choice(" >") for _ in parts[1:]]
        want = backtracking(parts[:-1], combs, up) if len(parts) > 1 else True
        if len(parts) > 1:
            assert page.above_fits_strictly(parts, combs, up) == want
            differ += page.above_fits(parts, combs, up) != want
    assert differ > 20


def test_strict_matching_as_joins(spark):
    ship(spark)
    rng = random.Random(9)
    sheet = "".join(f"{''.join(rng.choice('ab') + rng.choice([' ', ' > ', ' ']) for _ in range(rng.randrange(1, 4)))}b{{--r{i}:1}}" for i in range(25))
    pages = []
    for k in range(6):
        body = ""
        for _ in range(4):
            tags = [rng.choice(["a", "b", "i"]) for _ in range(7)]
            body += "".join(f"<div class={t}>" for t in tags) + "</div>" * 7
        pages.append((k, f"<style>{sheet.replace('a', '.a').replace('b', '.b')}</style>{body}"))
    df = spark.createDataFrame(pages, "page_id long, html string")
    dom = dom_nodes(df)
    rules = css_source.css_rules(css_source.stylesheets(dom))
    joined = {(r.page_id, r.node_id, r.rule_order) for r in cascade.matches(dom, rules, strict=True).collect()}
    kernel = {(r.page_id, r.node_id, r.rule_order) for r in page.page_nodes(df, layout=False, strict=True).select("page_id", "node_id", F.inline("matched")).collect()}
    greedy = {(r.page_id, r.node_id, r.rule_order) for r in cascade.matches(dom, rules).collect()}
    assert joined == kernel and greedy < joined


def test_rectangles_of_subtrees(spark):
    ship(spark)
    rng = random.Random(2)
    pages, rects, want = [], [], set()
    for k in range(5):
        body = ""
        for _ in range(400 if k == 0 else 30):
            body += rng.choice(['<div data-c2f="snapshot">', "<div>", "<div>", "</div>", "</div>", "text"])
        pages.append((k, body))
        rows = rows_of(parse(body))
        own = {r[0]: tuple(rng.choice([rng.randrange(-500, 500) / 4, 0.0]) for _ in range(2)) + tuple(rng.choice([0.0, rng.randrange(0, 400) / 8]) for _ in range(2)) for r in rows if r[5] == "element"}
        rects += [(k, n, *box) for n, box in own.items()]
        marked = [r for r in rows if dict(r[7]).get("data-c2f") == "snapshot"]
        for i, r in enumerate(marked):
            x, y, w, h = own[r[0]]
            box = [x, y, x + w, y + h]
            for n in range(r[0], r[14] + 1):
                if n in own and own[n][2] > 0 and own[n][3] > 0:
                    a, b, c, d = own[n]
                    box = [min(box[0], a), min(box[1], b), max(box[2], a + c), max(box[3], b + d)]
            if box[2] > box[0] and box[3] > box[1]:
                left, top = box[0] // 1, box[1] // 1
                want.add((k, r[0], f"s{i}", left, top, -((box[0] - box[2]) // 1), -((box[1] - box[3]) // 1), left - x, top - y))
    dom = dom_nodes(spark.createDataFrame(pages, "page_id long, html string"))
    found = scene.subtree_rects(dom, spark.createDataFrame(rects, "page_id long, node_id int, x double, y double, width double, height double"))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 60


def test_places_on_the_page(spark):
    ship(spark)
    df = spark.createDataFrame([(1, '<body><div style="padding:7px"><div style="padding:3px"><div id="in" style="width:10px;height:4px"></div></div></div></body>')], "page_id long, html string")
    nodes = page.page_nodes(df, 800.0, 600.0)
    boxes = nodes.where("box is not null").select("page_id", "node_id", "box.*")
    at = nodes.where("attrs['id'] = 'in'").first()["node_id"]
    assert tuple(scene.absolute_boxes(nodes, boxes).where(F.col("node_id") == at).first()) == (1, at, 10.0, 10.0, 10.0, 4.0)


def test_nothing_is_used_before_it_is_built(spark):
    card = '<div class="card"><p style="font-weight:bold">{}</p></div>'
    html = "<style>.card{background:#ff0000;box-shadow:0 1px 2px red} .row{background:#112233} p{color:#445566}</style><body>" + "".join(card.format(i) for i in range(4)) + '<div class="row"><i>a</i></div>' * 3 + "</body>"
    doc = convert(spark.createDataFrame([(1, "u", html), (2, "v", "<p>x")], "page_id long, url string, html string"), Options(layout=False))
    steps = doc.build_order().collect()
    for key in (1, 2):
        own = sorted((r for r in steps if r.page_id == key), key=lambda r: r.step)
        assert [r.step for r in own] == list(range(1, len(own) + 1))
        stages = [("font", "paint", "text", "effect", "component", "root").index(r.kind) for r in own]
        assert stages == sorted(stages) and stages[-1] == 5
    made = {r.key: r.step for r in steps if r.page_id == 1 and r.kind == "component"}
    tree = [r for r in doc.tokens["tree"].where("page_id = 1").collect()]
    placed = {(r.kind, r.node_id): r.step for r in steps if r.page_id == 1 and r.kind in ("component", "root")}
    for r in tree:
        if r.instance_of:
            assert made[r.instance_of] < placed["component" if r.component_id else "root", r.node_id]
    assert len(made) == 2
    names = [r.key for r in sorted(steps, key=lambda r: r.step) if r.page_id == 1 and r.kind == "paint"]
    assert names == sorted(names, key=str.lower)


def test_names_in_the_order_of_a_language(spark):
    style = "struct<font_family:string,font_style:string,font_size:double>"
    rows = [(1, 5, "zebra"), (1, 5, "Éclair"), (1, 5, "eclair"), (1, 5, "Zebra"), (1, 5, "apple"), (1, 5, "Apfel")]
    df = spark.createDataFrame(rows, "page_id long, n long, text_key string").withColumn("text_style", F.struct(F.col("text_key").alias("font_family"), F.lit("Regular").alias("font_style"), F.lit(16.0).alias("font_size")).cast(style))
    named = {r.text_key: r.style_id for r in tokens.text_names(df).collect()}
    order = sorted(named, key=lambda k: (len(named[k]), named[k]))
    assert order == ["Apfel", "apple", "eclair", "Éclair", "zebra", "Zebra"]
