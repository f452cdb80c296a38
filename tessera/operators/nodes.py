"""Design nodes from elements: frames, texts, images and vectors, with paints, strokes, effects and auto-layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import css
from tessera.functions.text import kept, let, number, trimmed
from tessera.operators import classify

PAINT = "struct<type:string,color:struct<r:double,g:double,b:double,a:double>,gradient:string>"
STROKE = "struct<color:struct<r:double,g:double,b:double,a:double>,weight:double,align:string>"
GEOMETRY = "struct<x:double,y:double,width:double,height:double>"


def solid(c: Column) -> Column:
    return F.struct(F.lit("SOLID").alias("type"), c.alias("color"), F.lit(None).cast("string").alias("gradient")).cast(PAINT)


def background_fills(style: Column) -> Column:
    """A gradient of the background, else its colour, else nothing."""
    none = F.array().cast(f"array<{PAINT}>")
    flat = let(css.color(css.first_value(style, "background-color", "background")), lambda c: F.when(c.isNotNull(), F.array(solid(c))).otherwise(none))
    painted = lambda g: F.array(F.struct(g["type"].alias("type"), F.lit(None).cast(css.COLOR).alias("color"), F.to_json(g).alias("gradient")).cast(PAINT))
    return F.when(F.coalesce(style["background"].contains("gradient"), F.lit(False)), let(css.gradient(style["background"]), lambda g: F.when(g.isNotNull(), painted(g)).otherwise(flat))).otherwise(flat)


def display_of(style: Column) -> Column:
    return F.lower(F.coalesce(style["display"], F.lit("")))


def axis_primary(value: Column) -> Column:
    v = css.lowered(F.coalesce(value, F.lit("")))
    return F.when(v.isin("flex-end", "end", "right"), "MAX").when(v == "center", "CENTER").when(v.isin("space-between", "space-around", "space-evenly"), "SPACE_BETWEEN").otherwise("MIN")


def axis_counter(value: Column) -> Column:
    v = css.lowered(F.coalesce(value, F.lit("")))
    return F.when(v.isin("flex-end", "end"), "MAX").when(v == "center", "CENTER").when(v == "baseline", "BASELINE").otherwise("MIN")


def four_zeroed(value: Column, **context) -> Column:
    """Lengths of a padding shorthand by side; what can't be read is zero in its place."""
    p = F.transform(F.split(trimmed(value), r"\s+"), lambda t: F.coalesce(css.pixels(t, **context), F.lit(0.0)))
    at = lambda i, j: F.coalesce(F.get(p, i), j)
    a = at(0, F.lit(0.0))
    b = at(1, a)
    return F.struct(a.alias("top"), b.alias("right"), at(2, a).alias("bottom"), at(3, b).alias("left"))


def auto_layout(style: Column, **context) -> Column:
    """How a flex or grid container lays out its children; null for others."""
    d = display_of(style)
    flex, grid = d.isin("flex", "inline-flex"), d.isin("grid", "inline-grid")
    vertical = ~grid & F.lower(F.coalesce(style["flex-direction"], F.lit("row"))).isin("column", "column-reverse")
    wraps = grid | F.lower(F.coalesce(style["flex-wrap"], F.lit("nowrap"))).isin("wrap", "wrap-reverse")
    short = four_zeroed(style["padding"], **context)
    padding = {s: F.coalesce(css.pixels(style[f"padding-{s}"], **context), short[s], F.lit(0.0)) for s in css.SIDES}
    parts = F.split(trimmed(style["gap"]), r"\s+")
    row, column = css.pixels(F.get(parts, 0), **context), F.when(F.size(parts) > 1, css.pixels(F.get(parts, 1), **context)).otherwise(css.pixels(F.get(parts, 0), **context))
    row = F.coalesce(css.pixels(style["row-gap"], **context), row, F.lit(0.0))
    column = F.coalesce(css.pixels(style["column-gap"], **context), column, F.lit(0.0))
    return F.when(
        flex | grid,
        F.struct(
            F.when(vertical, "VERTICAL").otherwise("HORIZONTAL").alias("mode"),
            F.when(vertical, row).otherwise(column).alias("item_spacing"),
            F.when(vertical, column).otherwise(row).alias("counter_spacing"),
            *(padding[s].alias(f"padding_{s}") for s in css.SIDES),
            axis_primary(style["justify-content"]).alias("primary"),
            axis_counter(style["align-items"]).alias("counter"),
            F.when(wraps, "WRAP").otherwise("NO_WRAP").alias("wrap"),
            F.lit("FIXED").alias("primary_sizing"),
            F.when(wraps, "AUTO").otherwise("FIXED").alias("counter_sizing"),
            F.lit(False).alias("clips"),
        ),
    )


def child_layout(parent: Column, style: Column) -> Column:
    """How a child takes part in its parent's auto-layout; null if the parent has none."""
    d = display_of(parent)
    column = F.lower(F.coalesce(parent["flex-direction"], F.lit("row"))).isin("column", "column-reverse")
    sized = F.when(column, style["width"].isNotNull()).otherwise(style["height"].isNotNull())
    own, items = F.lower(F.coalesce(style["align-self"], F.lit(""))), F.lower(F.coalesce(parent["align-items"], F.lit("stretch")))
    stretches = ~sized & ((own == "stretch") | ((own == "") & items.isin("stretch", "normal")))
    grow = number(F.coalesce(style["flex-grow"], F.lit("0")))
    absolute = F.lower(F.coalesce(style["position"], F.lit("static"))).isin("absolute", "fixed")
    return F.when(d.isin(classify.CONTAINERS), F.struct(F.when(absolute, "ABSOLUTE").otherwise("AUTO").alias("positioning"), F.when(grow > 0, grow).otherwise(0.0).alias("grow"), F.when(stretches, "STRETCH").otherwise("INHERIT").alias("align")))


def clips(style: Column) -> Column:
    return css.lowered(F.coalesce(style["overflow"], F.lit(""))).isin("hidden", "clip", "scroll", "auto")


def text_runs(segments: Column, **context) -> Column:
    """characters and runs of a TEXT: its words with blanks collapsed across its inline elements, and their spans.

    segments: struct<t, style> in document order, without styles if all have the same. runs is null where there is one, or where all look the same.
    """
    run = f"struct<start:int,end:int,text_style:{css.TEXT_STYLE},fill:{css.COLOR}>"

    def step(state: Column, seg: Column) -> Column:
        text = F.regexp_replace(seg["t"], r"\s+", " ")
        had = state["chars"]
        text = F.when((had == "") | had.endswith(" "), F.regexp_replace(text, "^ ", "")).otherwise(text)
        n = F.length(had)
        added = let(text, lambda t: F.struct(F.concat(had, t).alias("chars"), F.when(t == "", state["runs"]).otherwise(F.concat(state["runs"], F.array(F.struct(n.alias("start"), (n + F.length(t)).alias("end"), seg["text_style"].alias("text_style"), seg["fill"].alias("fill")).cast(run)))).alias("runs")))
        return added

    def finish(f: Column) -> Column:
        chars = F.rtrim(f["chars"])
        cut = F.filter(F.transform(f["runs"], lambda r: F.struct(r["start"].alias("start"), F.least(r["end"], F.length(chars)).alias("end"), r["text_style"].alias("text_style"), r["fill"].alias("fill"))), lambda r: r["start"] < r["end"])
        return let(cut, lambda c: F.struct(chars.alias("characters"), F.when(F.size(F.array_distinct(F.transform(c, lambda r: F.struct(r["text_style"], r["fill"])))) > 1, c).alias("runs")))

    looks = F.transform(segments, lambda s: F.struct(s["t"].alias("t"), F.when(s["style"].isNotNull(), css.text_style(s["style"], **context)).alias("text_style"), F.when(s["style"].isNotNull(), css.text_fill(s["style"])).alias("fill")))
    folded = F.aggregate(looks, F.struct(F.lit("").alias("chars"), F.array().cast(f"array<{run}>").alias("runs")), step)
    return F.when(F.size(segments) > 0, let(folded, finish))


def ir_nodes(rows: DataFrame, viewport_width: float = 1440.0, viewport_height: float = 900.0, geometry: bool = True) -> DataFrame:
    """A row for each design node: where it stands, what it is, and how it is drawn. rows: page_nodes."""
    shown = rows.where("ir_type is not null").withColumn("root_px", _root_px())
    for name, column in _prepared(viewport_width, viewport_height, geometry):
        shown = shown.withColumn(name, column)
    return shown.select(*_drawn(viewport_width, viewport_height))


#: Columns of a design node that it has in common with those of its page that are drawn alike.
LOOK = ["opacity", "rotation", "layout", "child_layout", "fills", "strokes", "effects", "corner_radius", "clips_content", "text_style", "image_ref", "vector_path", "svg_source"]


def alike(rows: DataFrame, looks: DataFrame, viewport_width: float = 1440.0, viewport_height: float = 900.0, geometry: bool = True) -> DataFrame:
    """The design nodes among rows that are drawn as another of their page, which is in looks: the same as ir_nodes makes of them, for less."""
    shown = rows.where("drawn_as <> node_id").withColumn("root_px", _root_px())
    for name, column in _prepared(viewport_width, viewport_height, geometry):
        shown = shown.withColumn(name, column)
    own = shown.select(*_placed(viewport_width, viewport_height), "drawn_as")
    return own.join(looks.select("page_id", F.col("node_id").alias("drawn_as"), *LOOK).hint("merge"), ["page_id", "drawn_as"]).select(looks.columns)


@kept
def _root_px() -> Column:
    return F.coalesce(css.pixels(F.col("root_font")), F.lit(16.0))


def _context(viewport_width: float, viewport_height: float) -> dict:
    return {"root_font_size": F.col("root_px"), "viewport_width": viewport_width, "viewport_height": viewport_height}


@kept
def _prepared(viewport_width: float, viewport_height: float, geometry: bool) -> list[tuple[str, Column]]:
    """Where a node stands, what it says, and the style of its text."""
    place = F.lit(None).cast(GEOMETRY)
    if geometry:
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        body, box = F.col("tag") == "body", F.col("box")
        corner = lambda c: F.when(body, 0.0).otherwise(zero(c))
        place = F.when(F.col("kind") == "element", F.struct(corner(box["x"]).alias("x"), corner(box["y"]).alias("y"), zero(box["width"]).alias("width"), zero(box["height"]).alias("height"))).cast(GEOMETRY)
    return [("geometry", place), ("said", text_runs(F.col("segments"), **_context(viewport_width, viewport_height))), ("look", F.coalesce("own_style", "style"))]


@kept
def _placed(viewport_width: float, viewport_height: float) -> list:
    """Of _drawn what is a node's own even if others are drawn alike."""
    own = [c for c in ir_columns() if c not in LOOK]
    made = dict(zip(ir_columns(), _drawn(viewport_width, viewport_height), strict=True))
    return [made[c] for c in own]


def ir_columns() -> list[str]:
    return ["page_id", "node_id", "last_id", "ir_type", "path", "tag", "name", "geometry", *LOOK[:9], "characters", "text_style", "runs", *LOOK[10:], "parent_ir", "ir_path", "ord", "ir_steps"]


@kept
def _drawn(viewport_width: float, viewport_height: float) -> list:
    context, style, bare = _context(viewport_width, viewport_height), F.col("style"), F.col("kind") == "text"
    own, frame, text = F.col("look"), F.col("ir_type") == "FRAME", F.col("ir_type") == "TEXT"
    characters = F.when(bare, trimmed(F.col("text"))).otherwise(F.col("said.characters"))
    fills = F.when(frame, background_fills(style)).when(text, F.array(solid(css.text_fill(own)))).otherwise(F.array().cast(f"array<{PAINT}>"))
    bordered = lambda s: F.when(s.isNotNull(), F.array(F.struct(s["color"].alias("color"), s["weight"].alias("weight"), F.lit("INSIDE").alias("align")).cast(STROKE))).otherwise(F.array().cast(f"array<{STROKE}>"))
    strokes = F.when(frame, let(css.stroke(style, **context), bordered)).otherwise(F.array().cast(f"array<{STROKE}>"))
    no_effects = F.array().cast(f"array<{css.EFFECT}>")
    radius = css.corner_radius(style["border-radius"], F.coalesce(F.col("geometry.width"), F.lit(0.0)), F.coalesce(F.col("geometry.height"), F.lit(0.0)), **context)
    fallback = F.when(text, short_name(F.col("said.characters"))).when(F.col("tag") == "img", F.col("attrs")["alt"])
    name = F.when(bare, short_name(trimmed(F.col("text")))).otherwise(classify.layer_name(fallback))
    return [
        "page_id", "node_id", "last_id", "ir_type", "path", "tag", name.alias("name"), "geometry",
        F.when(bare, 1.0).otherwise(css.opacity(F.coalesce(style["opacity"], F.lit("1")))).alias("opacity"),
        F.when(frame, css.rotation(style["transform"])).alias("rotation"),
        F.when(frame, auto_layout(style, **context)).alias("layout"),
        F.when(~bare, child_layout(F.col("parent_style"), style)).alias("child_layout"),
        fills.alias("fills"), strokes.alias("strokes"), F.when(frame, css.effects(style)).otherwise(no_effects).alias("effects"),
        F.when(frame, radius).alias("corner_radius"), F.when(frame, clips(style)).alias("clips_content"),
        F.when(text, characters).alias("characters"), F.when(text, css.text_style(own, **context)).alias("text_style"), F.when(text & ~bare, F.col("said.runs")).alias("runs"),
        F.when(F.col("ir_type") == "IMAGE", F.coalesce(F.col("attrs")["src"], F.lit(""))).alias("image_ref"),
        F.lit(None).cast("string").alias("vector_path"), F.lit(None).cast("string").alias("svg_source"),
        "parent_ir", "ir_path", "ord", "ir_steps",
    ]


def short_name(c: Column) -> Column:
    """The first 32 UTF-16 units, as scripts count: a character beyond the first plane has two, and isn't cut."""
    units = lambda s: F.length(s) + F.length(F.regexp_replace(s, "[^\\x{10000}-\\x{10FFFF}]", ""))
    return F.when(units(c) == F.length(c), F.substring(c, 1, 32)).otherwise(let(F.substring(c, 1, 32), lambda s: F.get(F.filter(F.transform(F.sequence(F.length(s), F.lit(0), F.lit(-1)), lambda n: F.substring(s, F.lit(1), n)), lambda t: units(t) <= 32), 0)))


def ir_parents(ir: DataFrame) -> DataFrame:
    """ir with parent_ir (the nearest design node above, null for the root), ir_path, its place among its siblings (ord) and the steps to it.

    Rows that come from page_nodes have these already.
    """
    if "ir_steps" in ir.columns:
        return ir
    own = ir.select("page_id", F.col("node_id").alias("up"))
    up = ir.select("page_id", "node_id", F.explode("path").alias("up")).where("up <> node_id").join(own.hint("merge"), ["page_id", "up"])
    nearest = up.groupBy("page_id", "node_id").agg(F.max("up").alias("parent_ir"), F.array_sort(F.collect_list("up")).alias("ir_path"))
    out = ir.join(nearest.hint("merge"), ["page_id", "node_id"], "left")
    out = out.withColumn("ir_path", F.concat(F.coalesce("ir_path", F.array().cast("array<int>")), F.array("node_id")))
    out = out.withColumn("ord", (F.row_number().over(Window.partitionBy("page_id", "parent_ir").orderBy("node_id")) - 1).cast("int"))
    step = F.concat_ws("-", F.when(F.col("ir_type").isin("TEXT", "IMAGE", "VECTOR", "INSTANCE"), F.lower("ir_type")).otherwise("frame"), "ord").alias("step")
    steps = out.select("page_id", F.col("node_id").alias("up"), step)
    below = out.select("page_id", "node_id", F.posexplode("ir_path").alias("level", "up")).join(steps.hint("merge"), ["page_id", "up"]).groupBy("page_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "step"))), lambda x: x["step"]).alias("ir_steps"))
    return out.join(below.hint("merge"), ["page_id", "node_id"])


def ir_ids(ir: DataFrame) -> DataFrame:
    """page_id, node_id, ir_id: numbers in the order in which nodes are finished: a frame after what it holds. The root has none."""
    prefix = F.when(F.col("ir_type") == "FRAME", F.col("tag")).when(F.col("ir_type") == "TEXT", "text").when(F.col("ir_type") == "IMAGE", "image").otherwise("path")
    body = F.col("tag") == "body"
    # after its last descendant, deepest first
    order = F.row_number().over(Window.partitionBy("page_id").orderBy(F.when(body, 1).otherwise(0), "last_id", F.desc("node_id")))
    return ir.select("page_id", "node_id", F.when(body, "root").otherwise(F.concat_ws("-", prefix, order)).alias("ir_id"))


def fonts(ir: DataFrame) -> DataFrame:
    """page_id, family, style: each font once, in the order in which it is first met; Inter Regular is always there."""
    used = ir.where("ir_type = 'TEXT'").select("page_id", F.col("node_id").alias("at"), F.col("text_style.font_family").alias("family"), F.col("text_style.font_style").alias("style"))
    inner = ir.where("runs is not null").select("page_id", F.col("node_id").alias("at"), F.explode("runs").alias("r")).select("page_id", "at", F.col("r.text_style.font_family").alias("family"), F.col("r.text_style.font_style").alias("style"))
    always = ir.select("page_id").distinct().select("page_id", F.lit(-1).alias("at"), F.lit("Inter").alias("family"), F.lit("Regular").alias("style"))
    every = used.unionByName(inner).unionByName(always)
    return every.groupBy("page_id", "family", "style").agg(F.min("at").alias("first_at"))


def substitute_font(ir: DataFrame, family: str) -> DataFrame:
    """Every text in one family; styles stay."""
    runs = F.transform("runs", lambda r: r.withField("text_style", r["text_style"].withField("font_family", F.lit(family))))
    return ir.withColumn("text_style", F.when(F.col("text_style").isNotNull(), F.col("text_style").withField("font_family", F.lit(family)))).withColumn("runs", runs)


def warnings(nodes: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """page_id, node_id, warning: images without a source, vectors without shapes, links that aren't read. linked: as linked_sheets has it, if sheets are known."""
    from tessera.sources.css import link_nodes

    shapes = ["path", "rect", "circle", "ellipse", "line", "polygon", "polyline"]
    shown = classify.drawn(nodes, nodes.where(F.col("tag").isin("svg", "img", *shapes)).select("page_id", "node_id", "path", "tag", "attrs"))
    images = shown.where("tag = 'img'").where(F.coalesce(F.col("attrs")["src"], F.lit("")) == "").select("page_id", "node_id", F.lit("image without a source").alias("warning"))
    inside = shown.where(F.col("tag").isin(shapes)).select("page_id", F.explode("path").alias("node_id")).distinct()
    vectors = shown.where("tag = 'svg'").select("page_id", "node_id").join(inside.hint("merge"), ["page_id", "node_id"], "left_anti").select("page_id", "node_id", F.lit("vector without shapes").alias("warning"))
    links = (link_nodes(nodes) if linked is None else linked).where("status <> 'ok'").select("page_id", "node_id", F.concat(F.lit("stylesheet "), F.col("status"), F.lit(": "), F.col("href")).alias("warning"))
    return images.unionByName(vectors).unionByName(links)


