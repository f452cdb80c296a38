"""Design tokens: paints, text styles and effect stacks that a page uses, named by role and rank.

Each registry is an aggregation by key within a page, ranking windows for the names, and a left join that stamps the
chosen id on the nodes. The dimension tables are as small as a page's palette; pages are independent, so all of it runs
on one partitioning by page_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import css
from tessera.functions.text import half_up

# The names that a bucket deals out, in order; styles that count as heavy.
SLOTS = {
    "brand": ["brand/primary", "brand/accent", "brand/secondary"],
    "surface": ["surface/primary", "surface/secondary", "surface/tertiary"],
    "ink": ["ink/primary", "ink/muted", "ink/subtle"],
    "border": ["border/default", "border/subtle"],
    "icon": ["icon/primary", "icon/secondary"],
}
HEAVY = ["Bold", "Semi Bold", "Extra Bold", "Black"]
ROLES = ["background", "text", "stroke", "icon"]


def paint_uses(tree: DataFrame) -> DataFrame:
    """page_id, color, role of every solid paint; instances have none of their own."""
    fill_role = F.when(F.col("ir_type") == "TEXT", "text").when(F.col("ir_type") == "VECTOR", "icon").otherwise("background")
    fills = tree.where("ir_type <> 'INSTANCE'").select("page_id", fill_role.alias("role"), F.explode("fills").alias("p")).where("p.type = 'SOLID'").select("page_id", "role", F.col("p.color").alias("color"))
    strokes = tree.where("ir_type in ('FRAME', 'VECTOR')").select("page_id", F.when(F.col("ir_type") == "VECTOR", "icon").otherwise("stroke").alias("role"), F.explode("strokes").alias("s")).select("page_id", "role", F.col("s.color").alias("color"))
    return fills.unionByName(strokes)


def paint_usage(uses: DataFrame) -> DataFrame:
    """A row for each colour of a page: how often it is used in each role."""
    keyed = uses.withColumn("color_key", css.color_key(F.col("color")))
    counts = [F.count_if(F.col("role") == r).alias(r) for r in ROLES]
    return keyed.groupBy("page_id", "color_key").agg(F.min("color").alias("color"), *counts, F.count("*").alias("total"))


def paint_bucket(color: Column, counts: dict[str, Column]) -> Column:
    """brand for what has chroma, else by the role used most; of equals the first of background, text, stroke, icon."""
    high, low = F.greatest(color["r"], color["g"], color["b"]), F.least(color["r"], color["g"], color["b"])
    most = F.greatest(*counts.values())
    return F.when(high - low > 0.15, "brand").when(counts["background"] == most, "surface").when(counts["text"] == most, "ink").when(counts["stroke"] == most, "border").otherwise("icon")


def paint_names(usage: DataFrame) -> DataFrame:
    """usage with hex, bucket and style_id."""
    named = usage.withColumn("hex", css.color_hex(F.col("color")))
    fixed = F.when(F.col("hex") == "ffffff", "color/white").when(F.col("hex") == "000000", "color/black")
    named = named.withColumn("bucket", F.when(fixed.isNull(), paint_bucket(F.col("color"), {r: F.col(r) for r in ROLES})))
    rank = F.row_number().over(Window.partitionBy("page_id", "bucket").orderBy(F.desc("total"), "hex", "color_key"))
    slots = F.create_map(*[x for b, names in SLOTS.items() for x in (F.lit(b), F.array(*map(F.lit, names)))])
    rest = F.concat(F.lit("color/"), "hex", F.when(F.col("color")["a"] == 1, "").otherwise(css.alpha_hex(F.col("color"))))
    return named.withColumn("rank", rank).withColumn("style_id", F.coalesce(fixed, F.get(slots[F.col("bucket")], F.col("rank") - 1), rest)).drop("rank")


def text_key(style: Column) -> Column:
    return F.to_json(style, {"ignoreNullFields": "false"})


def text_usage(tree: DataFrame) -> DataFrame:
    """A row for each text style of a page; runs aren't counted."""
    return tree.where("ir_type = 'TEXT'").groupBy("page_id", text_key(F.col("text_style")).alias("text_key")).agg(F.first("text_style").alias("text_style"), F.count("*").alias("n"))


def text_bucket(size: Column, style: Column) -> Column:
    return F.when(size >= 32, "heading/xl").when(size >= 24, "heading/lg").when(size >= 18, "heading/md").when((size >= 16) & style.isin(HEAVY), "heading/md").when(size >= 16, "body/lg").when(size >= 14, "body/md").when(size >= 12, "body/sm").otherwise("caption")


def text_names(usage: DataFrame) -> DataFrame:
    """usage with bucket and style_id: the bucket alone if no other style shares it, else with the weight, else a number too."""
    s = F.col("text_style")
    named = usage.withColumn("bucket", text_bucket(s["font_size"], s["font_style"]))
    base = F.concat_ws("-", "bucket", F.regexp_replace(F.lower(s["font_style"]), r"\s+", "-"))
    alone = F.count("*").over(Window.partitionBy("page_id", "bucket")) == 1
    nth = F.row_number().over(Window.partitionBy("page_id", "bucket", s["font_style"]).orderBy(F.desc("n"), F.desc(s["font_size"]), F.collate("text_key", "UNICODE"), "text_key"))
    return named.withColumn("nth", nth).withColumn("alone", alone).withColumn("style_id", F.when(F.col("alone"), F.col("bucket")).when(F.col("nth") == 1, base).otherwise(F.concat_ws("-", base, "nth"))).drop("nth", "alone")


def effect_key(effects: Column) -> Column:
    """Order counts; numbers to four places."""
    r = lambda c: half_up(c, 4)
    return F.to_json(F.transform(effects, lambda e: F.struct(e["type"].alias("t"), css.color_key(e["color"]).alias("c"), r(e["x"]).alias("x"), r(e["y"]).alias("y"), r(e["radius"]).alias("r"), r(e["spread"]).alias("s"))))


def effect_usage(tree: DataFrame) -> DataFrame:
    rows = tree.where("ir_type = 'FRAME'").where(F.size("effects") > 0)
    return rows.groupBy("page_id", effect_key(F.col("effects")).alias("effect_key")).agg(F.first("effects").alias("effects"), F.count("*").alias("n"))


def effect_bucket(effects: Column) -> Column:
    r = F.array_max(F.transform(effects, lambda e: e["radius"]))
    shadow = F.exists(effects, lambda e: e["type"].isin("DROP_SHADOW", "INNER_SHADOW"))
    layer = F.exists(effects, lambda e: e["type"] == "LAYER_BLUR")
    back = F.exists(effects, lambda e: e["type"] == "BACKGROUND_BLUR")
    family = F.when(shadow & ~layer & ~back, "shadow").when(~shadow & layer & ~back, "blur").when(~shadow & ~layer & back, "backdrop-blur").otherwise("fx")
    return F.concat_ws("/", family, F.when(r <= 4, "sm").when(r <= 12, "md").when(r <= 24, "lg").otherwise("xl"))


def effect_names(usage: DataFrame) -> DataFrame:
    named = usage.withColumn("bucket", effect_bucket(F.col("effects"))).withColumn("radius", F.array_max(F.transform("effects", lambda e: e["radius"])))
    nth = F.row_number().over(Window.partitionBy("page_id", "bucket").orderBy(F.desc("n"), F.desc("radius"), "effect_key"))
    return named.withColumn("nth", nth).withColumn("style_id", F.when(F.col("nth") == 1, F.col("bucket")).otherwise(F.concat_ws("-", "bucket", "nth"))).drop("nth")


def stamped(tree: DataFrame, paints: DataFrame, texts: DataFrame, effects: DataFrame) -> DataFrame:
    """tree with fill_style_id, stroke_style_id, text_style_id and effect_style_id."""
    first_solid = F.get(F.filter("fills", lambda p: p["type"] == "SOLID"), 0)["color"]
    paintable = F.col("ir_type").isin("FRAME", "TEXT", "VECTOR")
    keyed = tree.withColumn("k_fill", F.when(paintable, css.color_key(first_solid))).withColumn("k_stroke", F.when(F.col("ir_type").isin("FRAME", "VECTOR"), css.color_key(F.get("strokes", 0)["color"])))
    keyed = keyed.withColumn("k_text", F.when(F.col("ir_type") == "TEXT", text_key(F.col("text_style")))).withColumn("k_effect", F.when((F.col("ir_type") == "FRAME") & (F.size("effects") > 0), effect_key(F.col("effects"))))
    for key, dim, column, out in (("k_fill", paints, "color_key", "fill_style_id"), ("k_stroke", paints, "color_key", "stroke_style_id"), ("k_text", texts, "text_key", "text_style_id"), ("k_effect", effects, "effect_key", "effect_style_id")):
        keyed = keyed.join(dim.select("page_id", F.col(column).alias(key), F.col("style_id").alias(out)).hint("merge"), ["page_id", key], "left").drop(key)
    return keyed


def font_families(fonts: DataFrame) -> DataFrame:
    """page_id, family, styles (sorted): what has to be installed."""
    return fonts.groupBy("page_id", "family").agg(F.array_join(F.array_sort(F.collect_set("style")), ", ").alias("styles"))


def corpus_paints(tree: DataFrame) -> DataFrame:
    """An extension: colours over all pages."""
    keyed = paint_uses(tree).withColumn("color_key", css.color_key(F.col("color")))
    return keyed.groupBy("color_key").agg(F.count("*").alias("total"), F.approx_count_distinct("page_id").alias("pages"))
