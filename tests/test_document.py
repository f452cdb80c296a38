"""Nested documents, their check, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.functions import css
from tessera.operators import document
from tessera.operators.layout import tracks_of
from tessera.operators.nodes import short_name
from tessera.plans.engine import Options, convert

CARD = '<div class="card" style="background:linear-gradient(90deg,red,blue);box-shadow:0 1px 2px red;border:1px solid #123"><h3>{}</h3><p>a <b style="font-weight:bold">b</b></p></div>'
PAGE = "<html><body>" + "".join(CARD.format(t) for t in ("One", "Two", "Three")) + '<img src="data:image/png;base64,AA=="><svg><path d="M0 0L1 1"/></svg></body></html>'


@pytest.fixture(scope="module")
def made(spark):
    doc = convert(spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string"), Options(name="x.html"))
    return json.loads(doc.export().first()["json"])


def test_export_is_nested_and_valid(made):
    assert list(document.faults(made)) == []
    root = made["root"]
    assert (root["type"], root["name"], root["id"]) == ("FRAME", "Page", "root") and [c["type"] for c in root["children"]] == ["INSTANCE"] * 3 + ["IMAGE", "VECTOR"]
    assert [c["overrides"]["card.text-0"]["characters"] for c in root["children"][1:3]] == ["Two", "Three"] and "overrides" not in root["children"][0]
    (card,) = made["components"]
    assert card["id"] == "card" and [c["id"] for c in card["root"]["children"]] == ["card.text-0", "card.text-1"]
    assert card["root"]["fills"][0]["type"] == "GRADIENT_LINEAR" and len(card["root"]["fills"][0]["gradientStops"]) == 2 and card["root"]["effectStyleId"] == "shadow/sm"
    assert [r["textStyle"]["fontStyle"] for r in card["root"]["children"][1]["runs"]] == ["Regular", "Bold"]
    assert {"family": "Inter", "style": "Bold"} in made["fonts"] and made["images"][0]["ref"].startswith("data:")
    assert [t["id"] for t in made["styles"]["texts"]] == sorted(t["id"] for t in made["styles"]["texts"])


@pytest.mark.parametrize(
    ("change", "path"),
    [
        (lambda d: d.update(version=2), "version"), (lambda d: d.pop("root"), "root"), (lambda d: d["root"].update(opacity=2), "root.opacity"), (lambda d: d["root"]["children"][0].pop("componentId"), "root.children.0.componentId"),
        (lambda d: d["root"]["children"][3].update(type="PIC"), "root.children.3.type"), (lambda d: d["components"][0]["root"]["children"][0]["textStyle"].update(fontSize=0), "components.0.root.children.0.textStyle.fontSize"),
        (lambda d: d["components"][0]["root"]["fills"][0]["gradientStops"].pop(), "components.0.root.fills.0.gradientStops"), (lambda d: d["components"][0]["root"]["fills"][0].update(gradientTransform=[[1]]), "components.0.root.fills.0.gradientTransform"),
        (lambda d: d["styles"]["paints"][0].update(paints=[]), "styles.paints.0.paints"), (lambda d: d.update(fonts={}), "fonts"), (lambda d: d["fonts"][0].update(family=""), "fonts.0.family"),
        (lambda d: d["components"][0]["root"]["strokes"][0].update(weight=-1), "components.0.root.strokes.0.weight"), (lambda d: d["root"]["children"][1]["overrides"].update(x={"characters": 1}), "root.children.1.overrides.x.characters"),
        (lambda d: d["root"].update(visible="yes"), "root.visible"), (lambda d: d["components"][0]["root"]["children"][1]["runs"][0].update(start=0.5), "components.0.root.children.1.runs.0.start"),
    ],
)
def test_faults(made, change, path):
    spoilt = json.loads(json.dumps(made))
    change(spoilt)
    assert [p for p, _ in document.faults(spoilt)][0] == path


def test_issues_take_anything(spark):
    deep = '{"version":1,"root":' + '{"type":"FRAME","id":"a","children":[' * 3000 + "]}" * 3000 + "}"
    rows = [(1, "{"), (2, None), (3, "[]"), (4, deep), (5, json.dumps({"fonts": [{}] * 9}))]
    got = {}
    for r in document.issues(spark.createDataFrame(rows, "page_id long, json string")).collect():
        got.setdefault(r["page_id"], []).append((r["nth"], r["path"]))
    assert got[1] == got[2] == [(1, "(root)")] and len(got[5]) == 5 and got[5][:2] == [(1, "version"), (2, "root")] and 3 in got


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.html").write_text(PAGE)
    assert main(["convert", str(tmp_path / "in" / "b.html"), "-o", str(tmp_path / "b.json"), "--verbose", "--report", str(tmp_path / "r.json"), "--viewport", "800x600", "--font-fallback", "Arial"], spark) == 0
    out = capsys.readouterr().out
    assert "components × 3 instances" in out and "ir nodes:" in out
    assert list(document.faults(json.loads((tmp_path / "b.json").read_text()))) == [] and json.loads((tmp_path / "r.json").read_text())["stats"]["instances"] == 3
    assert main(["fonts", str(tmp_path / "in")], spark) == 0 and "Inter: Bold, Regular" in capsys.readouterr().out
    (tmp_path / "in" / "a.html").write_text("<p>x")
    assert main(["check", str(tmp_path / "in")], spark) == 0 and "summary: 2 converted, 0 failed, 2 total" in capsys.readouterr().out
    assert main(["check", str(tmp_path / "none")], spark) == 0 and main(["convert", str(tmp_path / "none"), "-o", "x"], spark) == 1


def test_repeats_of_any_depth(spark):
    value = "1fr"
    rows = []
    for depth in range(1, 7):
        value = f"repeat(2, {value})"
        rows.append((depth, value))
    rows += [(10, "repeat(2, minmax(0, 1fr) 10px) 5px"), (11, "repeat(0, 1fr) 2px"), (12, "repeat(3, )"), (13, "xrepeat(2, 1fr)"), (14, "repeat(2, repeat(2, 1fr 2px)) 3px")]
    got = {r["k"]: r["t"] for r in spark.createDataFrame(rows, "k int, v string").select("k", css.grid_tracks(F.col("v")).alias("t")).collect()}
    assert [len(got[d]) for d in range(1, 7)] == [2, 4, 8, 16, 32, 64]
    assert [(t["fr"], t["px"]) for t in got[10]] == [(1, None), (None, 10), (1, None), (None, 10), (None, 5)] and len(got[11]) == 1 and len(got[12]) == 3 and len(got[13]) == 1 and len(got[14]) == 9
    assert {k: [(t["fr"] is None, t["fr"] if t["px"] is None else t["px"]) for t in v] for k, v in got.items()} == {k: [(kind == "px", n) for kind, n in tracks_of(v)] for k, v in rows}


def test_names_are_cut_by_utf16_units(spark):
    texts = ["a" * 40, "\U0001f600" * 20, "a" * 31 + "\U0001f600b", "é" * 33, "short"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(short_name(F.col("t"))).collect()]
    assert got == ["a" * 32, "\U0001f600" * 16, "a" * 31, "é" * 32, "short"]


def test_documents_as_structs(spark):
    from tessera.operators import schemas
    from tessera.plans.engine import Options, convert

    html = '<div class="card" style="background:linear-gradient(red,blue);box-shadow:0 1px 2px red"><p style="font-weight:bold">a <i>b</i></p></div>' * 3 + '<img src="x.png"><svg><rect width="2" height="3"/></svg><div><div><div><hr></div></div></div>'
    doc = convert(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), Options(layout=False))
    text = doc.export().first()["json"]
    want = json.loads(text)

    def known(value, kind="document"):
        """Without what a struct leaves out: null fields and empty objects."""
        if isinstance(value, dict):
            return {k: known(v) for k, v in value.items() if v is not None and known(v) != {}}
        return [known(v) for v in value] if isinstance(value, list) else value

    for depth in (8, 2):
        got = json.loads(doc.export().select(F.to_json(schemas.typed(F.col("json"), depth)).alias("x")).first()["x"])

        def opened(node, level=1, depth=depth):
            if isinstance(node, str):
                return json.loads(node)
            return node | {"children": [opened(c, level + 1) for c in node["children"]]} if "children" in node else node

        for tree in (got, *got["components"]):
            tree["root"] = opened(tree["root"])
        assert known(got) == known(want)
    assert spark.createDataFrame([("{",), (None,)], "j string").select(schemas.typed(F.col("j"))["version"].alias("v")).collect() == [(None,), (None,)]
