"""What a drawing host does with a document: checks, references, and the values it is handed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import css

def component_faults(tree: DataFrame) -> DataFrame:
    """page_id, component_id, message: components whose root isn't a frame can't be built. tree: rows after detection."""
    roots = tree.where("component_id is not null").groupBy("page_id", "component_id").agg(F.min_by("ir_type", "node_id").alias("kind"))
    return roots.where("kind <> 'FRAME'").select("page_id", "component_id", F.concat(F.lit("root must be a FRAME, got "), "kind").alias("message"))


def dangling_styles(tree: DataFrame, styles: DataFrame) -> DataFrame:
    """page_id, node_id, role, style_id: references to styles (page_id, style_id) that don't exist; a host passes over them."""
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"{r}_style_id").alias("style_id")) for r in ("fill", "stroke", "text", "effect")))
    used = tree.select("page_id", "node_id", F.inline(roles)).where("style_id is not null")
    return used.join(styles.select("page_id", "style_id").distinct().hint("merge"), ["page_id", "style_id"], "left_anti").select("page_id", "node_id", "role", "style_id")


def dangling(instances: DataFrame, components: DataFrame) -> DataFrame:
    """Instances of components that don't exist: an anti-join."""
    return instances.join(components.select("page_id", "component_id").hint("merge"), ["page_id", "component_id"], "left_anti")


def font_preload(fonts: DataFrame, tree: DataFrame, text_styles: DataFrame) -> DataFrame:
    """page_id, family, style of every font that has to be there before texts are set; runs aren't looked at."""
    pick = lambda df: df.select("page_id", F.col("text_style.font_family").alias("family"), F.col("text_style.font_style").alias("style"))
    return fonts.select("page_id", "family", "style").unionByName(pick(tree.where("ir_type = 'TEXT'"))).unionByName(pick(text_styles)).distinct()


def missing_fonts(preload: DataFrame, installed: DataFrame) -> DataFrame:
    return preload.join(installed.select("family", "style").distinct().hint("merge"), ["family", "style"], "left_anti")


def applied_overrides(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """nodes (page_id, instance_id, ir_id, name, characters) with overrides (page_id, instance_id, key, characters) found by id, else by name."""
    by = lambda out: overrides.select("page_id", "instance_id", F.col("key").alias(out), F.col("characters").alias(f"{out}_text"))
    joined = nodes.join(by("ir_id").hint("merge"), ["page_id", "instance_id", "ir_id"], "left").join(by("name").hint("merge"), ["page_id", "instance_id", "name"], "left")
    return joined.select("page_id", "instance_id", "ir_id", "name", F.coalesce("ir_id_text", "name_text", "characters").alias("characters"))


def host_paint(color: Column, opacity: Column) -> Column:
    """Alpha and opacity in one."""
    return F.struct(color["r"].alias("r"), color["g"].alias("g"), color["b"].alias("b"), (color["a"] * opacity).alias("opacity"))


def host_effects(effects: Column) -> Column:
    """Effects as a host takes them: shadows blend as they are."""
    return F.transform(effects, lambda e: F.struct(e["type"].alias("type"), e["color"].alias("color"), e["x"].alias("x"), e["y"].alias("y"), e["radius"].alias("radius"), e["spread"].alias("spread"), F.when(e["type"].endswith("SHADOW"), "NORMAL").alias("blend_mode")))


def image_paint() -> Column:
    """What stands in for an image fill: a fixed grey."""
    return F.struct(F.lit(0.88).alias("r"), F.lit(0.88).alias("g"), F.lit(0.9).alias("b"), F.lit(1.0).alias("opacity"))


def scene(tree: DataFrame) -> DataFrame:
    """page_id, node_id and what the host sets on each node.

    step: a component's nodes come before the root's (build_order has every step); drawn_as: a frame with markup is imported
    whole, or passed over with a notice if it can't be;
    sizes of at least 0.01, rotation the other way round, first stroke's weight and side, text resizing, runs cut to the
    text (with more than one, style references are passed over), an image's bytes or the grey that stands in.
    """
    clamp = F.filter(F.transform("runs", lambda r: r.withField("end", F.least(r["end"], F.length("characters")))), lambda r: r["start"] < r["end"])
    several = F.coalesce(F.size("runs") > 1, F.lit(False))
    g = F.col("geometry")
    size = lambda c: F.greatest(F.lit(0.01), c)
    drawn, fault = (F.col("ir_type") == "FRAME") & (F.coalesce("svg_source", F.lit("")) != ""), drawing_fault(F.col("svg_source"))
    single = css.single_line(g["height"], F.col("text_style.font_size"))
    return tree.select(
        "page_id", "node_id", "ir_type", "name", g["x"].alias("x"), g["y"].alias("y"), size(g["width"]).alias("width"), size(g["height"]).alias("height"),
        F.when(F.col("rotation") != 0, -F.col("rotation")).alias("rotation"), F.get("strokes", 0)["weight"].alias("stroke_weight"), F.get("strokes", 0)["align"].alias("stroke_align"),
        F.coalesce("clips_content", F.col("layout.clips")).alias("clips_content"),
        F.when(F.col("ir_type") == "TEXT", F.when(F.coalesce(single, F.lit(False)), "WIDTH_AND_HEIGHT").otherwise("HEIGHT")).alias("auto_resize"),
        F.when(F.col("ir_type") == "IMAGE", css.data_uri(F.col("image_ref"))).alias("image_bytes"),
        F.when((F.col("ir_type") == "IMAGE") & css.data_uri(F.col("image_ref")).isNull(), image_paint()).alias("stand_in"),
        F.when(F.col("component_id").isNotNull(), "component").otherwise("root").alias("step"),
        F.when(~drawn, F.col("ir_type")).when(fault.isNull(), "SVG").otherwise("SKIPPED").alias("drawn_as"),
        F.when(drawn & fault.isNotNull(), F.concat(F.lit('Skipped SVG import on "'), F.coalesce("name", F.lit("")), F.lit('": '), fault)).alias("notice"),
        clamp.alias("runs"), F.when(~several, F.col("fill_style_id")).alias("fill_style_id"), F.when(~several, F.col("text_style_id")).alias("text_style_id"),
        host_effects(F.col("effects")).alias("effects"),
    )


def absolute_boxes(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """page_id, node_id, x, y, width, height on the page: boxes (relative to the parent's) added up along each node's path."""
    up = nodes.where("kind = 'element'").select("page_id", "node_id", F.explode("path").alias("up"))
    at = boxes.select("page_id", F.col("node_id").alias("up"), "x", "y")
    moved = up.join(at.hint("merge"), ["page_id", "up"]).groupBy("page_id", "node_id").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return moved.join(boxes.select("page_id", "node_id", "width", "height").hint("merge"), ["page_id", "node_id"])


#: Bits of a node's number within a bin of the interval join.
BIN_BITS = 8


def subtree_rects(nodes: DataFrame, rects: DataFrame) -> DataFrame:
    """page_id, node_id, sid, x, y, width, height, offset_x, offset_y: what a picture of each marked element has to show.

    The whole-pixel clip of the box around the element and all below it that have an area, and its place from the
    element's own. Elements marked data-c2f="snapshot" are numbered s0, s1, ... in document order, also those that show
    nothing and have no row. rects: page_id, node_id, x, y, width, height on the page. A subtree is an interval of node
    numbers: intervals and nodes meet in bins of a page, so a page's nodes are not paired with all its marks.
    """
    marked = nodes.where((F.col("kind") == "element") & (F.col("attrs")["data-c2f"] == "snapshot"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")) - 1
    own = rects.select("page_id", "node_id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")))
    bins = F.sequence(F.shiftright("node_id", BIN_BITS), F.shiftright("last_id", BIN_BITS))
    marked = marked.select("page_id", "node_id", "last_id", F.concat(F.lit("s"), nth).alias("sid")).join(own.hint("merge"), ["page_id", "node_id"])
    below = own.where("width > 0 and height > 0").select("page_id", F.shiftright("node_id", BIN_BITS).alias("bin"), F.col("node_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("x") + F.col("width")).alias("right"), (F.col("y") + F.col("height")).alias("bottom"))
    met = marked.select("page_id", "node_id", "last_id", F.explode(bins).alias("bin")).join(below.hint("merge"), ["page_id", "bin"]).where("b between node_id and last_id")
    around = met.groupBy("page_id", "node_id").agg(F.min("bx").alias("left"), F.min("by").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    both = marked.join(around.hint("merge"), ["page_id", "node_id"], "left")
    left, top = F.least("x", "left"), F.least("y", "top")
    right, bottom = F.greatest(F.col("x") + F.col("width"), F.col("right")), F.greatest(F.col("y") + F.col("height"), F.col("bottom"))
    whole = both.select("page_id", "node_id", "sid", "x", "y", left.alias("l"), top.alias("t"), (right - left).alias("w"), (bottom - top).alias("h")).where("w > 0 and h > 0")
    clip = [F.floor("l").cast("double").alias("x"), F.floor("t").cast("double").alias("y"), F.ceil("w").cast("double").alias("width"), F.ceil("h").cast("double").alias("height")]
    return whole.select("page_id", "node_id", "sid", *clip, (F.floor("l") - F.col("x")).alias("offset_x"), (F.floor("t") - F.col("y")).alias("offset_y"))


def build_order(fonts: DataFrame, components: DataFrame, tokens: dict[str, DataFrame]) -> DataFrame:
    """page_id, step (from 1), kind, key, node_id: in what order a host builds a page's document.

    Fonts are loaded first, then paint, text and effect styles are registered in the order of their language, then each
    component is made, its nodes from the top down, and the root's nodes come last: nothing is used before it is there.
    """
    tree = tokens["tree"]
    columns = ["page_id", "stage", "kind", "rank", "key", "node_id"]
    none, first = F.lit(None).cast("int"), F.lit(0)

    def listed(df: DataFrame, stage: int, kind: str, key: Column, rank: Column = first, node: Column = none) -> DataFrame:
        return df.select("page_id", F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), rank.cast("int").alias("rank"), key.alias("key"), node.alias("node_id")).select(*columns)

    every = listed(font_preload(fonts, tree, tokens["texts"]), 0, "font", F.concat_ws(" ", "family", "style"))
    for stage, kind in enumerate(("paint", "text", "effect"), 1):
        every = every.unionByName(listed(tokens[f"{kind}s"], stage, kind, F.col("style_id")))
    inside = tree.where("component_id is not null").join(components.select("page_id", "component_id", "rank").hint("merge"), ["page_id", "component_id"])
    every = every.unionByName(listed(inside, 4, "component", F.col("component_id"), F.col("rank"), F.col("node_id")))
    every = every.unionByName(listed(tree.where("component_id is null"), 5, "root", F.coalesce("name", F.lit("")), first, F.col("node_id")))
    step = F.row_number().over(Window.partitionBy("page_id").orderBy("stage", "rank", F.col("node_id").asc_nulls_first(), F.collate("key", "UNICODE"), "key"))
    return every.select("page_id", step.alias("step"), "kind", "key", "node_id")


def host_fill(fill: Column, opacity: Column | None = None) -> Column:
    """A paint as hosts take it: type, color, opacity, transform, stops. Gradients keep their transform and stops; an image is a grey."""
    given = F.lit(1.0) if opacity is None else opacity
    solid, grey = host_paint(fill["color"], given), image_paint()
    none = F.lit(None)
    make = lambda kind, color, alpha, transform, stops: F.struct(kind.alias("type"), color.cast("struct<r:double,g:double,b:double>").alias("color"), alpha.cast("double").alias("opacity"), transform.cast("array<array<double>>").alias("transform"), stops.cast(f"array<struct<position:double,color:{css.COLOR}>>").alias("stops"))
    rgb = lambda p: F.struct(p["r"].alias("r"), p["g"].alias("g"), p["b"].alias("b"))
    stops = F.transform(fill["stops"], lambda s: F.struct(s["position"].alias("position"), s["color"].alias("color")))
    graded = make(fill["type"], none, given, fill["matrix"], stops)
    return F.when(fill["type"] == "SOLID", make(fill["type"], rgb(solid), solid["opacity"], none, none)).when(fill["type"].startswith("GRADIENT"), graded).when(fill["type"].isNotNull(), make(F.lit("SOLID"), rgb(grey), given, none, none))


def drawing_fault(source: Column) -> Column:
    """Why a drawing's markup can't be imported, null if it can: what isn't well-formed XML with an svg at its top is passed over."""
    read = F.from_xml(source, "fault string", {"columnNameOfCorruptRecord": "fault", "mode": "PERMISSIVE"})["fault"]
    return F.when(source.isNull() | ~source.rlike(r"(?is)^\s*(<\?xml.*?\?>\s*)?<svg[\s/>]"), "no svg element").when(read.isNotNull(), "not well-formed")


def text_leaves(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, mid: the topmost elements that hold text alone, numbered in document order; those within one aren't looked at."""
    from tessera.operators.classify import TEXT_TAGS, inner_text, text_only

    flat = nodes.where("kind = 'element'").where(F.col("tag").isin(TEXT_TAGS)).select("page_id", "node_id", "path").join(text_only(nodes).hint("merge"), ["page_id", "node_id"]).where("text_only").join(inner_text(nodes).hint("merge"), ["page_id", "node_id"]).where("text <> ''")
    above = flat.select("page_id", F.col("node_id").alias("a"))
    inner = flat.select("page_id", "node_id", F.explode("path").alias("a")).where("a <> node_id").join(above.hint("merge"), ["page_id", "a"], "left_semi").select("page_id", "node_id").distinct()
    top = flat.join(inner.hint("merge"), ["page_id", "node_id"], "left_anti")
    return top.select("page_id", "node_id", F.concat(F.lit("m"), F.row_number().over(Window.partitionBy("page_id").orderBy("node_id"))).alias("mid"))
