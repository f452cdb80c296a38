"""A page's document as one nested text, and checks of such texts.

Columns say how each node is written; a page's nodes are then put into each other, one page at a time. A check walks a
document of any depth by a table of what each kind of node, paint or style may hold.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import kept
from tessera.operators.faults import by_pages


def _color(c: Column) -> Column:
    return F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), c["a"].alias("a"))


def _paints(paints: Column) -> Column:
    return F.transform(paints, lambda p: F.struct(p["type"].alias("type"), F.when(p["color"].isNotNull(), _color(p["color"])).alias("color"), p["gradient"].alias("gradient")))


def _text_style(s: Column) -> Column:
    return F.struct(
        s["font_family"].alias("fontFamily"), s["font_style"].alias("fontStyle"), s["font_size"].alias("fontSize"), s["line_height"].alias("lineHeight"), s["letter_spacing"].alias("letterSpacing"),
        s["align"].alias("textAlign"), s["decoration"].alias("textDecoration"), s["transform"].alias("textCase"),
    )


def _effects(effects: Column) -> Column:
    offset = lambda e: F.when(e["type"].endswith("SHADOW"), F.struct(e["x"].alias("x"), e["y"].alias("y")))
    return F.transform(effects, lambda e: F.struct(e["type"].alias("type"), F.when(e["color"].isNotNull(), _color(e["color"])).alias("color"), offset(e).alias("offset"), e["radius"].alias("radius"), e["spread"].alias("spread"), F.lit(True).alias("visible")))


@kept
def node_json() -> Column:
    """A node as it is written, without what it holds. Gradients are still texts in their paints."""
    kind, layout, child = F.col("ir_type"), F.col("layout"), F.col("child_layout")
    only = lambda kinds, c: F.when(kind.isin(*kinds), c)
    laid = F.when(
        layout.isNotNull(),
        F.struct(
            layout["mode"].alias("layoutMode"), layout["item_spacing"].alias("itemSpacing"), layout["counter_spacing"].alias("counterAxisSpacing"), *(layout[f"padding_{s.lower()}"].alias(f"padding{s}") for s in ("Top", "Right", "Bottom", "Left")),
            layout["primary"].alias("primaryAxisAlignItems"), layout["counter"].alias("counterAxisAlignItems"), layout["wrap"].alias("layoutWrap"), layout["primary_sizing"].alias("primaryAxisSizingMode"), layout["counter_sizing"].alias("counterAxisSizingMode"), layout["clips"].alias("clipsContent"),
        ),
    )
    strokes = F.transform("strokes", lambda s: F.struct(F.struct(F.lit("SOLID").alias("type"), _color(s["color"]).alias("color"), F.lit(1.0).alias("opacity"), F.lit(True).alias("visible")).alias("paint"), s["weight"].alias("weight"), s["align"].alias("align")))
    runs = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), _text_style(r["text_style"]).alias("textStyle"), F.array(F.struct(F.lit("SOLID").alias("type"), _color(r["fill"]).alias("color"))).alias("fills")))
    return F.to_json(
        F.struct(
            kind.alias("type"), F.col("id"), F.coalesce("name", F.lit("")).alias("name"), "geometry",
            F.when(child.isNotNull(), F.struct(child["positioning"].alias("layoutPositioning"), child["grow"].alias("layoutGrow"), child["align"].alias("layoutAlign"))).alias("childLayout"),
            F.coalesce("opacity", F.lit(1.0)).alias("opacity"), F.lit(True).alias("visible"), "rotation",
            only(["FRAME"], laid).alias("layout"), only(["FRAME", "TEXT", "IMAGE", "VECTOR"], _paints(F.col("fills"))).alias("fills"), only(["FRAME", "TEXT", "VECTOR"], F.col("fill_style_id")).alias("fillStyleId"),
            only(["FRAME", "VECTOR"], strokes).alias("strokes"), only(["FRAME", "VECTOR"], F.col("stroke_style_id")).alias("strokeStyleId"), only(["FRAME"], _effects(F.col("effects"))).alias("effects"), only(["FRAME"], F.col("effect_style_id")).alias("effectStyleId"),
            only(["FRAME", "IMAGE"], F.col("corner_radius")).alias("cornerRadius"), only(["FRAME"], F.col("clips_content")).alias("clipsContent"), only(["FRAME", "VECTOR"], F.col("svg_source")).alias("svgSource"),
            only(["TEXT"], F.col("characters")).alias("characters"), only(["TEXT"], _text_style(F.col("text_style"))).alias("textStyle"), only(["TEXT"], F.col("text_style_id")).alias("textStyleId"), only(["TEXT"], runs).alias("runs"),
            only(["IMAGE"], F.col("image_ref")).alias("imageRef"), only(["IMAGE"], F.lit("FILL")).alias("scaleMode"), only(["VECTOR"], F.col("vector_path")).alias("path"),
            F.col("instance_of").alias("componentId"), F.col("overrides"),
        )
    )


def _painted(node: dict) -> dict:
    """Paints with their defaults; a gradient's text becomes its fields."""

    def paint(p: dict) -> dict:
        if "gradient" in p:
            g = json.loads(p["gradient"])
            p = {"type": g["type"], "gradientTransform": g["matrix"], "gradientStops": g["stops"]}
        return p | {"opacity": 1, "visible": True}

    for part in (node, *node.get("runs", ())):
        if "fills" in part:
            part["fills"] = [paint(p) for p in part["fills"]]
    return node


NESTED = pa.schema([("page_id", pa.int64()), ("json", pa.string())])


def nested(rows: DataFrame, name: str) -> DataFrame:
    """page_id, json, error: rows (page_id, part, key, parent, node_id, json) put together; of a page that fails, what went wrong.

    part is "root" or "component" (with key and name of the component) for nodes, else a list of the document (paints,
    texts, effects, fonts), whose entries come in the order of key.
    """

    names = ["part", "key", "node_id", "parent", "json", "title"]

    def build(page: dict[str, list]) -> tuple[list, ...]:
        entries = sorted((dict(zip(names, r, strict=True)) for r in zip(*(page[c] for c in names), strict=True)), key=lambda r: (r["part"], r["key"], r["node_id"]))
        lists: dict[str, list] = {k: [] for k in ("paints", "texts", "effects", "fonts")}
        trees: dict[tuple, dict[int, dict]] = {}
        tops: dict[tuple, dict] = {}
        titles = {}
        for r in entries:
            if r["part"] in lists:
                lists[r["part"]].append(json.loads(r["json"]))
                continue
            tree = trees.setdefault((r["part"], r["key"]), {})
            node = tree[r["node_id"]] = _painted(json.loads(r["json"]))
            if node["type"] == "FRAME":
                node["children"] = []
            above = tree.get(r["parent"])
            if above is None:
                tops.setdefault((r["part"], r["key"]), node)
                titles[r["part"], r["key"]] = r["title"]
            else:
                above.setdefault("children", []).append(node)
        images = sorted({n["imageRef"] for t in trees.values() for n in t.values() if n["type"] == "IMAGE" and n["imageRef"]})
        document = {
            "version": 1, "name": name, "root": next((n for k, n in tops.items() if k[0] == "root"), None), "styles": {k: lists[k] for k in ("paints", "texts", "effects")},
            "components": [{"id": k[1], "name": titles[k], "root": n} for k, n in tops.items() if k[0] == "component"], "fonts": lists["fonts"], "images": [{"ref": i, "source": i} for i in images], "metadata": {},
        }
        return ([json.dumps(document, ensure_ascii=False, separators=(",", ":"))],)

    return by_pages(rows.select("page_id", *names), build, NESTED, "page_id long, json string")


# What values may be. A check gives its complaint, or nothing.


def _text(least: int = 0):
    return lambda v: None if isinstance(v, str) and len(v) >= least else "must be a text" if not isinstance(v, str) else f"must have {least} characters at least"


def _number(least: float | None = None, most: float | None = None, above: float | None = None, whole: bool = False):
    def check(v):
        if isinstance(v, bool) or not isinstance(v, (int, float)) or whole and v != int(v):
            return "must be a whole number" if whole else "must be a number"
        if least is not None and v < least or most is not None and v > most or above is not None and v <= above:
            return f"must be from {least} to {most}" if most is not None else f"must be {least} at least" if above is None else f"must be more than {above}"
        return None

    return check


def _one_of(*values):
    return lambda v: None if v in values else f"must be one of {', '.join(map(str, values))}"


def _flag(v):
    return None if isinstance(v, bool) else "must be true or false"


UNIT = _number(0, 1)
COLOR = {"r!": UNIT, "g!": UNIT, "b!": UNIT, "a": UNIT}
#: What each kind of object holds; "!" marks what has to be there. A list is [kind of its entries, how many at least].
PAINTED = {"opacity": UNIT, "visible": _flag}
GRADIENT = {"type!": _text(), "gradientTransform!": "matrix", "gradientStops!": [{"position!": UNIT, "color!": COLOR}, 2], **PAINTED}
PAINTS = {
    "SOLID": {"color!": COLOR, **PAINTED}, "IMAGE": {"imageRef!": _text(1), "scaleMode": _one_of("FILL", "FIT", "CROP", "TILE"), **PAINTED}, "GRADIENT_LINEAR": GRADIENT, "GRADIENT_RADIAL": GRADIENT,
}
SHADOW = {"color!": COLOR, "offset!": {"x!": _number(), "y!": _number()}, "radius!": _number(0), "spread": _number(), "visible": _flag}
BLUR = {"radius!": _number(0), "visible": _flag}
EFFECTS = {"DROP_SHADOW": SHADOW, "INNER_SHADOW": SHADOW, "LAYER_BLUR": BLUR, "BACKGROUND_BLUR": BLUR}
LINES = {"PIXELS": {"value!": _number(above=0)}, "PERCENT": {"value!": _number(above=0)}, "AUTO": {}}
TEXT_STYLE = {
    "fontFamily!": _text(1), "fontStyle": _text(1), "fontSize!": _number(above=0), "lineHeight": ("unit", LINES), "letterSpacing": {"unit!": _one_of("PIXELS", "PERCENT"), "value!": _number()},
    "textAlign": _one_of("LEFT", "CENTER", "RIGHT", "JUSTIFIED"), "textDecoration": _one_of("NONE", "UNDERLINE", "STRIKETHROUGH"), "textCase": _one_of("ORIGINAL", "UPPER", "LOWER", "TITLE"),
}
LAYOUT = {
    "layoutMode": _one_of("NONE", "HORIZONTAL", "VERTICAL"), **{n: _number() for n in ("itemSpacing", "counterAxisSpacing", "paddingTop", "paddingRight", "paddingBottom", "paddingLeft")}, "primaryAxisAlignItems": _one_of("MIN", "CENTER", "MAX", "SPACE_BETWEEN"),
    "counterAxisAlignItems": _one_of("MIN", "CENTER", "MAX", "BASELINE"), "layoutWrap": _one_of("NO_WRAP", "WRAP"), "primaryAxisSizingMode": _one_of("FIXED", "AUTO"), "counterAxisSizingMode": _one_of("FIXED", "AUTO"), "clipsContent": _flag,
}
PAINT_LIST, STROKES = [("type", PAINTS), 0], [{"paint!": ("type", PAINTS), "weight": _number(0), "align": _one_of("INSIDE", "OUTSIDE", "CENTER")}, 0]
BASE = {
    "id!": _text(1), "name": _text(), "geometry": {"x!": _number(), "y!": _number(), "width!": _number(0), "height!": _number(0)}, "opacity": UNIT, "visible": _flag, "rotation": _number(),
    "childLayout": {"layoutPositioning": _one_of("AUTO", "ABSOLUTE"), "layoutGrow": _number(0), "layoutAlign": _one_of("INHERIT", "STRETCH")},
}
NODES: dict[str, dict] = {
    "FRAME": {**BASE, "layout": LAYOUT, "fills": PAINT_LIST, "fillStyleId": _text(), "strokes": STROKES, "strokeStyleId": _text(), "effects": [("type", EFFECTS), 0], "effectStyleId": _text(), "cornerRadius": _number(0), "clipsContent": _flag, "svgSource": _text()},
    "TEXT": {**BASE, "characters!": _text(), "textStyle!": TEXT_STYLE, "textStyleId": _text(), "fills": PAINT_LIST, "fillStyleId": _text(), "runs": [{"start!": _number(0, whole=True), "end!": _number(0, whole=True), "textStyle!": TEXT_STYLE, "fills": PAINT_LIST}, 0]},
    "IMAGE": {**BASE, "imageRef!": _text(1), "scaleMode": _one_of("FILL", "FIT", "CROP", "TILE"), "cornerRadius": _number(0), "fills": PAINT_LIST},
    "VECTOR": {**BASE, "path!": _text(), "fills": PAINT_LIST, "fillStyleId": _text(), "strokes": STROKES, "strokeStyleId": _text(), "svgSource": _text()},
    "INSTANCE": {**BASE, "componentId!": _text(1), "overrides": "overrides"},
}
NODE = ("type", NODES)
NODES["FRAME"]["children"] = [NODE, 0]
NAMED = {"id!": _text(1), "name!": _text(1), "description": _text()}
DOCUMENT = {
    "version!": _one_of(1), "name": _text(), "root!": NODE,
    "styles": {"paints": [{**NAMED, "paints!": [("type", PAINTS), 1]}, 0], "texts": [{**NAMED, "style!": TEXT_STYLE}, 0], "effects": [{**NAMED, "effects!": [("type", EFFECTS), 1]}, 0]},
    "components": [{**NAMED, "root!": NODE}, 0], "fonts": [{"family!": _text(1), "style": _text(1)}, 0], "images": [{"ref!": _text(1), "source!": _text(1), "mimeType": _text()}, 0],
    "metadata": {"source": _text(), "generator": _text(), "generatedAt": _text()},
}


def faults(document: object) -> Iterator[tuple[str, str]]:
    """(path, message) of everything that is wrong, in document order."""
    work = [("", document, DOCUMENT)]
    while work:
        path, value, kind = work.pop()
        at = lambda name, path=path: f"{path}.{name}" if path else str(name)
        if callable(kind):
            if (message := kind(value)) is not None:
                yield path, message
        elif isinstance(kind, list):
            if not isinstance(value, list):
                yield path, "must be a list"
            elif len(value) < kind[1]:
                yield path, f"must have {kind[1]} entries at least"
            else:
                work += [(at(i), v, kind[0]) for i, v in reversed(list(enumerate(value)))]
        elif kind == "matrix":
            if not (isinstance(value, list) and len(value) == 2 and all(isinstance(r, list) and len(r) == 3 and not any(map(_number(), r)) for r in value)):
                yield path, "must be two rows of three numbers"
        elif not isinstance(value, dict):
            yield path, "must be an object"
        elif kind == "overrides":
            work += [(f"{at(k)}", v, {"characters": _text()}) for k, v in reversed(list(value.items()))]
        elif isinstance(kind, tuple):
            own = kind[1].get(value.get(kind[0])) if isinstance(value.get(kind[0]), str) else None
            if own is None:
                yield at(kind[0]), f"must be one of {', '.join(kind[1])}"
            else:
                work.append((path, value, own))
        else:
            below = []
            for field, own in kind.items():
                name = field.rstrip("!")
                if name in value:
                    below.append((at(name), value[name], own))
                elif field != name:
                    below.append((at(name), None, lambda _: "required"))
            work += reversed(below)


def issues(documents: DataFrame, key: str = "page_id", column: str = "json", most: int = 5) -> DataFrame:
    """page_id, nth, path, message: the first faults of each document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = faults(json.loads(text or ""))
                except (ValueError, RecursionError):
                    found = iter([("(root)", "invalid JSON")])
                rows += [(page, n, *fault) for n, fault in zip(range(1, most + 1), found, strict=False)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["page_id", "nth", "path", "message"])

    return documents.select(F.col(key).cast("long").alias("page_id"), F.col(column).alias("json")).mapInArrow(run, "page_id long, nth int, path string, message string")
