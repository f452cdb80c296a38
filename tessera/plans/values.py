"""Queries over CSS values made from table columns, and the SQL that says what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import css
from tessera.functions.text import number_text, slug, split_top, title_case
from tessera.operators import nodes, page, scene, svg, tokens
from tessera.sources.css import href_status
from tessera.sources.store import dealt, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = ["l_orderkey", "l_linenumber"]
#: Of each query over values its text and the SQL of its columns.
SPECS: dict[str, tuple[str, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, text: str, columns: Callable[[Column], dict[str, Column]], sql: str, source: str = "lineitem", keys: list[str] = KEYS, read: Callable[[Column], Column] | list | None = None) -> None:
    """text: the value as SQL that both engines read; read: what is made of it first, once; columns: what is taken from that; sql: the same columns, from the table's own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dealt(table(spark, sf_dir, source), keys[0]).selectExpr(*keys, f"{text} AS v")
        for step in read if isinstance(read, list) else [read] if read else []:
            rows = rows.select(*keys, step(F.col("v")).alias("v"))
        return rows.select(*keys, *(c.alias(n) for n, c in columns(F.col("v")).items()))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {', '.join(keys)}, {sql} FROM {source}"
    SPECS[name] = (text, sql)


Q = "cast(l_quantity AS INT)"
N = "l_linenumber"
r6 = lambda c: F.round(c, 6)

_query("parse_px", f"CASE {N} WHEN 1 THEN concat({Q}, 'px') WHEN 2 THEN concat({Q}, 'rem') WHEN 3 THEN concat(' ', {Q}, 'vw ') WHEN 4 THEN concat({Q}, '.5VH') WHEN 5 THEN 'auto' WHEN 6 THEN '0' ELSE concat({Q}, 'em') END", lambda v: {"px": r6(css.pixels(v, 16.0, 1440.0, 900.0)), "px_bare": r6(css.pixels(v))},
       f"round(CASE {N} WHEN 1 THEN {Q} WHEN 2 THEN {Q} * 16.0 WHEN 3 THEN {Q} * 14.4 WHEN 4 THEN ({Q} + 0.5) * 9.0 WHEN 6 THEN 0.0 END::DOUBLE, 6) AS px, round(CASE {N} WHEN 1 THEN {Q} WHEN 2 THEN {Q} * 16.0 WHEN 6 THEN 0.0 END::DOUBLE, 6) AS px_bare")

RGB = ("(l_orderkey % 256)", "(l_partkey % 256)", "(l_suppkey % 256)")
HEX = "concat('#', " + ", ".join(f"lower(lpad(hex(cast({c} AS BIGINT)), 2, '0'))" for c in RGB) + ")"
COLOR = f"CASE {N} WHEN 1 THEN {HEX} WHEN 2 THEN concat('rgb(', {RGB[0]}, ', ', {RGB[1]}, ', ', {RGB[2]}, ')') WHEN 3 THEN concat('rgba(', {RGB[0]}, ' ', {RGB[1]}, ' ', {RGB[2]}, ' / 50%)') WHEN 4 THEN 'Silver' WHEN 5 THEN 'transparent' WHEN 6 THEN '#0f8' ELSE 'hsl(1,2%,3%)' END"


def _channel(i: int, silver: float, short: float) -> str:
    return f"CASE WHEN {N} <= 3 THEN {RGB[i]} / 255.0 WHEN {N} = 4 THEN {silver} / 255.0 WHEN {N} = 5 THEN 0.0 WHEN {N} = 6 THEN {short} / 255.0 END"


_query("parse_color", COLOR, lambda v: {x: r6(v[x]) for x in "rgba"},
       ", ".join(f"round(({_channel(i, 192.0, s)})::DOUBLE, 6) AS {x}" for i, (x, s) in enumerate(zip("rgb", (0.0, 255.0, 136.0), strict=True))) + f", round((CASE WHEN {N} = 3 THEN 0.5 WHEN {N} = 5 THEN 0.0 WHEN {N} <= 6 THEN 1.0 END)::DOUBLE, 6) AS a", read=css.color)
_query("color_key", HEX, lambda v: {"key": css.color_key(v), "hex": css.color_hex(v)},
       f"concat_ws('|', {', '.join(f'''printf('%.4f', floor({c} / 255.0 * 10000 + 0.5) / 10000)''' for c in RGB)}, '1.0000') AS key, concat({', '.join(f'''printf('%02x', {c})''' for c in RGB)}) AS hex", read=css.color)
_query("font_style", f"CASE {N} WHEN 1 THEN 'bold' WHEN 2 THEN 'normal' WHEN 3 THEN 'heavy' ELSE cast({Q} * 20 AS STRING) END", lambda v: {"style": css.font_style(v, F.lit(False)), "italic": css.font_style(v, F.lit(True))},
       f"CASE {N} WHEN 1 THEN 'Bold' WHEN 2 THEN 'Regular' WHEN 3 THEN 'Regular' ELSE w END AS style, CASE {N} WHEN 1 THEN 'Bold Italic' WHEN 2 THEN 'Italic' WHEN 3 THEN 'Italic' ELSE CASE WHEN w = 'Regular' THEN 'Italic' ELSE w || ' Italic' END END AS italic")
ORACLES["font_style"] = ORACLES["font_style"].replace("FROM lineitem", f"FROM (SELECT *, CASE WHEN {Q}*20 <= 100 THEN 'Thin' WHEN {Q}*20 <= 200 THEN 'Extra Light' WHEN {Q}*20 <= 300 THEN 'Light' WHEN {Q}*20 <= 400 THEN 'Regular' WHEN {Q}*20 <= 500 THEN 'Medium' WHEN {Q}*20 <= 600 THEN 'Semi Bold' WHEN {Q}*20 <= 700 THEN 'Bold' WHEN {Q}*20 <= 800 THEN 'Extra Bold' ELSE 'Black' END AS w FROM lineitem)")
_query("font_family", f"CASE {N} WHEN 1 THEN concat('\"Face ', {Q}, '\", serif') WHEN 2 THEN concat('system-ui, Face', {Q}) WHEN 3 THEN 'sans-serif, monospace' ELSE concat(' Plain ', {Q}) END", lambda v: {"family": css.font_family(v)},
       f"CASE {N} WHEN 1 THEN 'Face ' || {Q} WHEN 2 THEN 'Face' || {Q} WHEN 3 THEN NULL ELSE 'Plain ' || {Q} END AS family")
_query("line_height", f"CASE {N} WHEN 1 THEN concat({Q}, 'px') WHEN 2 THEN concat({Q}, '%') WHEN 3 THEN 'normal' WHEN 4 THEN cast({Q} AS STRING) ELSE concat({Q}, 'em') END", lambda v: {"unit": v["unit"], "value": v["value"]},
       f"CASE {N} WHEN 1 THEN 'PIXELS' WHEN 2 THEN 'PERCENT' WHEN 3 THEN 'AUTO' WHEN 4 THEN 'PERCENT' END AS unit, CASE {N} WHEN 1 THEN {Q} WHEN 2 THEN {Q} WHEN 4 THEN {Q} * 100 END::DOUBLE AS value", read=css.line_height)
_query("letter_spacing", f"CASE {N} WHEN 1 THEN concat('-', {Q}, 'px') WHEN 2 THEN concat({Q}, '%') WHEN 3 THEN 'normal' WHEN 4 THEN concat('0.', {Q}, 'em') ELSE concat({Q}, 'rem') END", lambda v: {"unit": v["unit"], "value": r6(v["value"])},
       f"CASE {N} WHEN 1 THEN 'PIXELS' WHEN 2 THEN 'PERCENT' WHEN 3 THEN 'PIXELS' WHEN 4 THEN 'PERCENT' END AS unit, round(CASE {N} WHEN 1 THEN -{Q} WHEN 2 THEN {Q} WHEN 3 THEN 0 WHEN 4 THEN ('0.' || {Q})::DOUBLE * 100 END::DOUBLE, 6) AS value", read=css.letter_spacing)
_query("rotation", f"CASE {N} WHEN 1 THEN concat('rotate(', {Q}, 'deg)') WHEN 2 THEN concat('scale(2) rotate(', {Q}, 'turn)') WHEN 3 THEN concat('rotate( -', {Q}, 'grad )') WHEN 4 THEN concat('rotate(', {Q}, 'rad)') WHEN 5 THEN 'scale(2)' ELSE 'none' END", lambda v: {"degrees": r6(css.rotation(v))},
       f"round(CASE {N} WHEN 1 THEN {Q} WHEN 2 THEN {Q} * 360 WHEN 3 THEN -{Q} * 0.9::DOUBLE WHEN 4 THEN {Q} * 180 / pi() END::DOUBLE, 6) AS degrees")
_query("aspect_ratio", f"CASE {N} WHEN 1 THEN concat({Q}, ' / 4') WHEN 2 THEN cast({Q} AS STRING) WHEN 3 THEN 'auto' WHEN 4 THEN concat({Q}, '/0') ELSE concat('-', {Q}) END", lambda v: {"ratio": css.aspect_ratio(v)}, f"CASE {N} WHEN 1 THEN {Q} / 4.0 WHEN 2 THEN {Q} END::DOUBLE AS ratio")
_query("text_enums", f"CASE {N} WHEN 1 THEN 'start' WHEN 2 THEN 'Justify' WHEN 3 THEN 'underline dotted' WHEN 4 THEN 'line-through' WHEN 5 THEN 'uppercase' WHEN 6 THEN 'none' ELSE 'capitalize' END", lambda v: {"align": css.text_align(v), "decoration": css.text_decoration(v), "transform": css.text_transform(v)},
       f"CASE {N} WHEN 1 THEN 'LEFT' WHEN 2 THEN 'JUSTIFIED' END AS align, CASE {N} WHEN 3 THEN 'UNDERLINE' WHEN 4 THEN 'STRIKETHROUGH' WHEN 6 THEN 'NONE' END AS decoration, CASE {N} WHEN 5 THEN 'UPPER' WHEN 6 THEN 'ORIGINAL' WHEN 7 THEN 'TITLE' END AS transform")
K = "(l_partkey % 5 + 1)"
_query("grid_tracks", f"CASE {N} WHEN 1 THEN concat('repeat(', {K}, ', 1fr)') WHEN 2 THEN concat({Q}, 'px 1.5fr') WHEN 3 THEN concat('repeat(', {K}, ', 10px minmax(1px, 2fr))') WHEN 4 THEN 'none' ELSE 'auto 0 20%' END",
       lambda v: {"n": F.size(v), "fr": F.aggregate(v, F.lit(0.0), lambda a, t: a + F.coalesce(t["fr"], F.lit(0.0))), "px": F.aggregate(v, F.lit(0.0), lambda a, t: a + F.coalesce(t["px"], F.lit(0.0)))},
       f"CASE {N} WHEN 1 THEN {K} WHEN 2 THEN 2 WHEN 3 THEN 2 * {K} WHEN 4 THEN NULL ELSE 3 END::INT AS n, CASE {N} WHEN 1 THEN {K} WHEN 2 THEN 1.5 WHEN 3 THEN {K} WHEN 4 THEN NULL ELSE 3 END::DOUBLE AS fr, CASE {N} WHEN 1 THEN 0 WHEN 2 THEN {Q} WHEN 3 THEN 10 * {K} WHEN 4 THEN NULL ELSE 0 END::DOUBLE AS px", read=css.grid_tracks)
_query("opacity", f"CASE {N} WHEN 1 THEN cast(l_discount AS STRING) WHEN 2 THEN '-1' WHEN 3 THEN '7' WHEN 4 THEN 'x' ELSE '.5' END", lambda v: {"opacity": r6(css.opacity(v))}, f"round(CASE {N} WHEN 1 THEN l_discount WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0.5 END::DOUBLE, 6) AS opacity")
_query("corner_radius", f"CASE {N} WHEN 1 THEN concat({Q}, 'px') WHEN 2 THEN concat({Q}, '%') WHEN 3 THEN '4px 8px' ELSE '1rem' END", lambda v: {"radius": r6(css.corner_radius(v, F.lit(80.0), F.lit(40.0)))}, f"round(CASE {N} WHEN 1 THEN {Q} WHEN 2 THEN 40.0 * {Q} / 100 WHEN 3 THEN NULL ELSE 16 END::DOUBLE, 6) AS radius")
GRADIENT = f"CASE {N} WHEN 1 THEN concat('linear-gradient(', {Q}, 'deg, ', {HEX}, ', white)') WHEN 2 THEN concat('linear-gradient(to bottom right, red 10%, ', {HEX}, ', rgba(0, 0, 255, 0.5) 90%)') WHEN 3 THEN concat('radial-gradient(circle at center, ', {HEX}, ' 0%, black 50px)') WHEN 4 THEN 'linear-gradient(red)' ELSE {HEX} END"
_query("gradient_stops", GRADIENT, lambda v: {"type": v["type"], "n": F.coalesce(F.size(v["stops"]), F.lit(0)), "second_at": r6(F.get(v["stops"], 1)["position"]), "first_at": r6(F.get(v["stops"], 0)["position"])},
       f"CASE WHEN {N} <= 2 THEN 'GRADIENT_LINEAR' WHEN {N} = 3 THEN 'GRADIENT_RADIAL' END AS type, CASE {N} WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END::INT AS n, CASE {N} WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 END::DOUBLE AS second_at, CASE {N} WHEN 1 THEN 0.0 WHEN 2 THEN 0.1 WHEN 3 THEN 0.0 END::DOUBLE AS first_at", read=css.gradient)
ANGLE = f"CASE {N} WHEN 1 THEN {Q}::DOUBLE WHEN 2 THEN 135.0 END::DOUBLE"
_query("gradient_matrix", GRADIENT, lambda v: {"angle": v["angle"], "m00": F.round(v["matrix"][0][0], 4) + F.lit(0.0), "m12": F.round(v["matrix"][1][2], 4) + F.lit(0.0)},
       f"{ANGLE} AS angle, round(CASE WHEN {N} = 3 THEN 0.5 ELSE sin(radians({ANGLE})) END, 4) + 0.0 AS m00, round(CASE WHEN {N} = 3 THEN 0.5 ELSE 0.5 + cos(radians({ANGLE})) / 2 END, 4) + 0.0 AS m12", read=css.gradient)
_query("gradient_angle", f"CASE {N} WHEN 1 THEN concat({Q}, 'deg') WHEN 2 THEN 'to top' WHEN 3 THEN 'to left bottom' WHEN 4 THEN '0.25turn' WHEN 5 THEN cast({Q} AS STRING) ELSE 'red' END", lambda v: {"angle": css.gradient_angle(v)}, f"CASE {N} WHEN 1 THEN {Q} WHEN 2 THEN 0 WHEN 3 THEN 225 WHEN 4 THEN 90 WHEN 5 THEN {Q} END::DOUBLE AS angle")
_query("border", f"CASE {N} WHEN 1 THEN concat({Q}, 'px solid ', {HEX}) WHEN 2 THEN concat('rgb(1, 2, 3) Dashed ', {Q}, 'px') WHEN 3 THEN 'none' WHEN 4 THEN 'thin' ELSE 'red' END", lambda v: {"width": v["width"], "style": v["style"], "color": v["color"]},
       f"CASE {N} WHEN 1 THEN {Q} || 'px' WHEN 2 THEN {Q} || 'px' WHEN 4 THEN 'thin' END AS width, CASE {N} WHEN 1 THEN 'solid' WHEN 2 THEN 'dashed' WHEN 3 THEN 'none' END AS style, CASE WHEN {N} = 1 THEN concat('#', {', '.join(f'''printf('%02x', {c})''' for c in RGB)}) WHEN {N} = 2 THEN 'rgb(1, 2, 3)' WHEN {N} > 4 THEN 'red' END AS color", read=css.border)
_query("box_shadow", f"CASE {N} WHEN 1 THEN concat('0 ', {Q}, 'px 4px rgba(0, 0, 0, .2), inset 1px 2px red') WHEN 2 THEN concat({Q}, 'px 2px') WHEN 3 THEN 'red 1px 2px' ELSE 'none' END",
       lambda v: {"n": F.coalesce(F.size(v), F.lit(0)), "y": F.get(v, 0)["y"], "blur": F.get(v, 0)["blur"], "color": F.get(v, 0)["color"], "last_inset": F.get(v, 1)["inset"]},
       f"CASE {N} WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END::INT AS n, CASE {N} WHEN 1 THEN {Q} WHEN 2 THEN 2 END::DOUBLE AS y, CASE {N} WHEN 1 THEN 4 WHEN 2 THEN 0 END::DOUBLE AS blur, CASE {N} WHEN 1 THEN 'rgba(0, 0, 0, .2)' WHEN 2 THEN 'rgba(0,0,0,1)' END AS color, CASE {N} WHEN 1 THEN TRUE END AS last_inset", read=css.box_shadows)
_query("blur", f"CASE {N} WHEN 1 THEN concat('blur(', {Q}, 'px)') WHEN 2 THEN concat('saturate(2) blur( ', {Q}, ' )') WHEN 3 THEN 'blur(1em)' ELSE 'none' END", lambda v: {"radius": css.blur(v)}, f"CASE {N} WHEN 1 THEN {Q} WHEN 2 THEN {Q} END::DOUBLE AS radius")
_query("place", f"CASE {N} WHEN 1 THEN 'center' WHEN 2 THEN 'start end' ELSE ' ' END", lambda v: {"align": css.place(v)["align"], "justify": css.place(v)["justify"]}, f"CASE {N} WHEN 1 THEN 'center' WHEN 2 THEN 'start' END AS align, CASE {N} WHEN 1 THEN 'center' WHEN 2 THEN 'end' END AS justify")
_query("inline_style", f"concat('color: red; PADDING : ', {Q}, 'px;; bad; color: c', {N}, ';width:')", lambda v: {"color": v["color"], "padding": v["padding"], "n": F.size(F.map_keys(v))}, f"'c' || {N} AS color, {Q} || 'px' AS padding, 2::INT AS n", read=css.declarations)
_query("important", f"CASE {N} WHEN 1 THEN concat({Q}, 'px !important') WHEN 2 THEN concat({Q}, ' !IMPORTANT ') ELSE cast({Q} AS STRING) END", lambda v: {"value": css.without_important(v)["value"], "important": css.without_important(v)["important"]}, f"CASE {N} WHEN 1 THEN {Q} || 'px' ELSE {Q}::VARCHAR END AS value, {N} <= 2 AS important")
_query("specificity", f"concat(repeat('#a', cast(l_orderkey % 3 AS INT)), repeat('.b', cast(l_partkey % 4 AS INT)), ' ', repeat('p > ', cast(l_suppkey % 3 AS INT)), 'a[href]:hover::before *')", lambda v: {x: css.specificity(v)[x] for x in ("id", "cls", "type")}, "(l_orderkey % 3)::INT AS id, (l_partkey % 4 + 2)::INT AS cls, (l_suppkey % 3 + 2)::INT AS type")
_query("viewport", f"CASE {N} WHEN 1 THEN concat({Q}, 'x900') WHEN 2 THEN concat({Q}, 'X', {K}) ELSE concat({Q}, ' x 9') END", lambda v: {"width": css.viewport(v)["width"], "height": css.viewport(v)["height"]}, f"CASE WHEN {N} <= 2 THEN {Q} END AS width, CASE {N} WHEN 1 THEN 900 WHEN 2 THEN {K} END::INT AS height")
_query("data_uri", f"CASE {N} WHEN 1 THEN concat('data:image/png;base64,', base64(encode(concat('bytes ', {Q}), 'utf-8'))) WHEN 2 THEN 'data:text/plain,abc' ELSE 'http://x/y.png' END", lambda v: {"text": F.decode(css.data_uri(v), "utf-8")}, f"CASE {N} WHEN 1 THEN 'bytes ' || {Q} END AS text")
_query("single_line", f"cast({Q} AS DOUBLE)", lambda v: {"single": css.single_line(v, F.lit(16.0))}, f"({Q} > 0 AND {Q} <= 27.2) AS single")
_query("split_top", f"concat('a(1, (2, ', {Q}, ')), b', {N}, ' , c(x y) d')", lambda v: {"n": F.size(split_top(v, ",")), "words": F.size(split_top(v, " ")), "first": F.get(split_top(v, ","), 0)}, f"3::INT AS n, 5::INT AS words, 'a(1, (2, ' || {Q} || '))' AS first")
_query("path_tokens", f"concat('M', {Q}, ',2.5-3e1l.5.5z')", lambda v: {"n": F.size(svg.path_tokens(v)), "second": F.get(svg.path_tokens(v), 1), "fourth": F.get(svg.path_tokens(v), 3)}, f"8::INT AS n, {Q}::VARCHAR AS second, '-3e1' AS fourth")
_query("edges", f"CASE {N} WHEN 1 THEN concat({Q}, 'px') WHEN 2 THEN concat({Q}, 'px 2px') WHEN 3 THEN concat('1px x 2px ', {Q}) WHEN 4 THEN '1 2 3 4' ELSE 'auto' END", lambda v: {s: v[s] for s in css.SIDES},
       f"CASE {N} WHEN 1 THEN {Q} WHEN 2 THEN {Q} WHEN 3 THEN 1 WHEN 4 THEN 1 END::DOUBLE AS top, CASE {N} WHEN 1 THEN {Q} WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 2 END::DOUBLE AS right, CASE {N} WHEN 1 THEN {Q} WHEN 2 THEN {Q} WHEN 3 THEN {Q} WHEN 4 THEN 3 END::DOUBLE AS bottom, CASE {N} WHEN 1 THEN {Q} WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 4 END::DOUBLE AS left", read=css.edges)
_query("axis_enums", f"CASE {N} WHEN 1 THEN 'flex-end' WHEN 2 THEN ' Center ' WHEN 3 THEN 'space-evenly' WHEN 4 THEN 'baseline' ELSE 'stretch' END", lambda v: {"primary_axis": nodes.axis_primary(v), "counter_axis": nodes.axis_counter(v)},
       f"CASE {N} WHEN 1 THEN 'MAX' WHEN 2 THEN 'CENTER' WHEN 3 THEN 'SPACE_BETWEEN' ELSE 'MIN' END AS primary_axis, CASE {N} WHEN 1 THEN 'MAX' WHEN 2 THEN 'CENTER' WHEN 4 THEN 'BASELINE' ELSE 'MIN' END AS counter_axis")
_query("href_policy", f"CASE {N} WHEN 1 THEN concat('css/', {Q}, '.css?v=1') WHEN 2 THEN 'https://x/y.css' WHEN 3 THEN '//x/y.css' WHEN 4 THEN '/abs.css' WHEN 5 THEN 'a/../../b.css' ELSE './a/../b.css' END", lambda v: {"status": href_status(v)}, f"CASE {N} WHEN 2 THEN 'unresolved' WHEN 3 THEN 'unresolved' WHEN 4 THEN 'refused' WHEN 5 THEN 'refused' ELSE 'ok' END AS status")
_query("text_bucket", f"cast({Q} AS DOUBLE)", lambda v: {"bold": tokens.text_bucket(v, F.lit("Bold")), "regular": tokens.text_bucket(v, F.lit("Bold Italic"))},
       ", ".join(f"CASE WHEN {Q} >= 32 THEN 'heading/xl' WHEN {Q} >= 24 THEN 'heading/lg' WHEN {Q} >= 18 THEN 'heading/md' WHEN {Q} >= 16 THEN '{b}' WHEN {Q} >= 14 THEN 'body/md' WHEN {Q} >= 12 THEN 'body/sm' ELSE 'caption' END AS {n}" for n, b in (("bold", "heading/md"), ("regular", "body/lg"))))
_query("effect_bucket", f"CASE {N} WHEN 1 THEN concat('box-shadow:0 0 ', {Q}, 'px red') WHEN 2 THEN concat('filter:blur(', {Q}, 'px)') WHEN 3 THEN concat('backdrop-filter:blur(', {Q}, 'px)') ELSE concat('box-shadow:0 0 ', {Q}, 'px red;filter:blur(1px)') END", lambda v: {"bucket": tokens.effect_bucket(v), "n": F.size(v)},
       f"CASE {N} WHEN 1 THEN 'shadow' WHEN 2 THEN 'blur' WHEN 3 THEN 'backdrop-blur' ELSE 'fx' END || '/' || CASE WHEN {Q} <= 4 THEN 'sm' WHEN {Q} <= 12 THEN 'md' WHEN {Q} <= 24 THEN 'lg' ELSE 'xl' END AS bucket, CASE WHEN {N} <= 3 THEN 1 ELSE 2 END::INT AS n", read=[css.declarations, css.effects])
_query("stroke", f"concat('border-top-width:0;border-top-color:red;border-left-width:', {Q}, 'px;border-left-style:', CASE WHEN {N} = 1 THEN 'none' ELSE 'solid' END, ';border-left-color:', {HEX})", lambda v: {"weight": v["weight"], "hex": css.color_hex(v["color"])},
       f"CASE WHEN {N} > 1 THEN {Q} END::DOUBLE AS weight, CASE WHEN {N} > 1 THEN concat({', '.join(f'''printf('%02x', {c})''' for c in RGB)}) END AS hex", read=[css.declarations, css.stroke])
_query("box_styling", f"CASE {N} WHEN 1 THEN 'padding:0px' WHEN 2 THEN concat('padding-left:', {Q}, 'px') WHEN 3 THEN 'background:none' WHEN 4 THEN 'border-radius:1px' WHEN 5 THEN 'color:red' ELSE 'border-top-width:1px' END", lambda v: {"boxed": css.box_styling(v)}, f"({N} NOT IN (1, 5)) AS boxed", read=css.declarations)
_query("bg_fill", f"CASE {N} WHEN 1 THEN concat('background:', {HEX}) WHEN 2 THEN concat('background:linear-gradient(red,blue);background-color:', {HEX}) WHEN 3 THEN concat('background:white;background-color:', {HEX}) ELSE 'background:url(x)' END", lambda v: {"type": F.get(v, 0)["type"], "hex": css.color_hex(F.get(v, 0)["color"])},
       f"CASE {N} WHEN 1 THEN 'SOLID' WHEN 2 THEN 'GRADIENT_LINEAR' WHEN 3 THEN 'SOLID' END AS type, CASE WHEN {N} IN (1, 3) THEN concat({', '.join(f'''printf('%02x', {c})''' for c in RGB)}) END AS hex", read=[css.declarations, nodes.background_fills])
_query("text_style", f"concat('font-size:', {Q}, 'px;font-weight:', CASE WHEN {N} = 1 THEN 'bold' ELSE '300' END, ';font-family:Arial, serif;line-height:1.5', CASE WHEN {N} = 2 THEN ';font-style:italic' ELSE '' END)",
       lambda v: {"font": v["font_family"], "style": v["font_style"], "size": v["font_size"], "line": v["line_height"]["value"], "align": v["align"]},
       f"'Arial' AS font, CASE {N} WHEN 1 THEN 'Bold' WHEN 2 THEN 'Light Italic' ELSE 'Light' END AS style, {Q}::DOUBLE AS size, 150.0::DOUBLE AS line, 'LEFT' AS align", read=[css.declarations, css.text_style])
_query("auto_layout", f"concat('display:', CASE {N} WHEN 1 THEN 'flex' WHEN 2 THEN 'grid' WHEN 3 THEN 'inline-flex;flex-direction:column;flex-wrap:wrap' ELSE 'block' END, ';gap:', {Q}, 'px 3px;padding:1px 2px;padding-left:', {Q}, 'px;justify-content:space-around')",
       lambda v: {"mode": v["mode"], "item_spacing": v["item_spacing"], "padding_left": v["padding_left"], "padding_right": v["padding_right"], "wrap": v["wrap"], "counter_sizing": v["counter_sizing"]},
       f"CASE WHEN {N} <= 2 THEN 'HORIZONTAL' WHEN {N} = 3 THEN 'VERTICAL' END AS mode, CASE WHEN {N} <= 2 THEN 3 WHEN {N} = 3 THEN {Q} END::DOUBLE AS item_spacing, CASE WHEN {N} <= 3 THEN {Q} END::DOUBLE AS padding_left, CASE WHEN {N} <= 3 THEN 2 END::DOUBLE AS padding_right, CASE {N} WHEN 1 THEN 'NO_WRAP' WHEN 2 THEN 'WRAP' WHEN 3 THEN 'WRAP' END AS wrap, CASE {N} WHEN 1 THEN 'FIXED' WHEN 2 THEN 'AUTO' WHEN 3 THEN 'AUTO' END AS counter_sizing", read=[css.declarations, nodes.auto_layout])
_query("child_layout", f"CASE {N} WHEN 1 THEN 'position:absolute' WHEN 2 THEN concat('flex-grow:', {Q}) WHEN 3 THEN 'height:1px' ELSE 'align-self:center' END", lambda v: {"positioning": (c := nodes.child_layout(css.declarations(F.lit("display:flex")), v))["positioning"], "grow": c["grow"], "align": c["align"]},
       f"CASE WHEN {N} = 1 THEN 'ABSOLUTE' ELSE 'AUTO' END AS positioning, CASE WHEN {N} = 2 THEN {Q} ELSE 0 END::DOUBLE AS grow, CASE WHEN {N} <= 2 THEN 'STRETCH' ELSE 'INHERIT' END AS align", read=css.declarations)
_query("host_paint", COLOR, lambda v: {"r": r6(scene.host_paint(css.color(v), F.lit(0.5))["r"]), "opacity": r6(scene.host_paint(css.color(v), F.lit(0.5))["opacity"])}, f"round(({_channel(0, 192.0, 0.0)})::DOUBLE, 6) AS r, round((CASE WHEN {N} = 3 THEN 0.25 WHEN {N} = 5 THEN 0.0 WHEN {N} <= 6 THEN 0.5 END)::DOUBLE, 6) AS opacity")
HOSTED = lambda v: scene.host_fill(F.struct(v["type"].alias("type"), F.lit(None).cast(css.COLOR).alias("color"), v["matrix"].alias("matrix"), v["stops"].alias("stops")), F.lit(0.5))
_query("host_fill", GRADIENT, lambda v: {"type": v["type"], "opacity": v["opacity"], "n": F.coalesce(F.size(v["stops"]), F.lit(0)), "second_at": r6(F.get(v["stops"], 1)["position"]), "second_alpha": r6(F.get(v["stops"], 1)["color"]["a"]), "m00": F.round(v["transform"][0][0], 4) + F.lit(0.0)},
       f"CASE WHEN {N} <= 2 THEN 'GRADIENT_LINEAR' WHEN {N} = 3 THEN 'GRADIENT_RADIAL' END AS type, CASE WHEN {N} <= 3 THEN 0.5 END::DOUBLE AS opacity, CASE {N} WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END::INT AS n, CASE {N} WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 END::DOUBLE AS second_at, CASE WHEN {N} <= 3 THEN 1.0 END::DOUBLE AS second_alpha, round(CASE WHEN {N} = 3 THEN 0.5 ELSE sin(radians({ANGLE})) END, 4) + 0.0 AS m00", read=[css.gradient, HOSTED])
DRAWING = f"CASE {N} WHEN 1 THEN concat('<svg><circle r=\"', {Q}, '\"/></svg>') WHEN 2 THEN concat('<svg><circle r=\"', {Q}, '\"></svg>') WHEN 3 THEN concat('<b>', {Q}, '</b>') WHEN 4 THEN concat('<svg r=', {Q}, '></svg>') ELSE concat(' <svg>', {Q}, '</svg>') END"
_query("drawing_faults", DRAWING, lambda v: {"fault": scene.drawing_fault(v)}, f"CASE {N} WHEN 2 THEN 'not well-formed' WHEN 3 THEN 'no svg element' WHEN 4 THEN 'not well-formed' END AS fault")
_query("layer_names", "p_name", lambda v: {"title": title_case(v), "slug": slug(v)}, "array_to_string(list_transform(list_filter(regexp_split_to_array(p_name, '[-_\\s]+'), lambda w: w <> ''), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug", "part", ["p_partkey"])
_query("paint_roles", "p_brand", lambda v: {"bucket": tokens.paint_bucket(css.color(F.lit("#888888")), {"background": F.length(v) % 3, "text": F.length(v) % 2, "stroke": F.lit(1), "icon": F.lit(0)})}, "CASE WHEN length(p_brand) % 3 >= greatest(length(p_brand) % 2, 1) THEN 'surface' WHEN length(p_brand) % 2 >= 1 THEN 'ink' ELSE 'border' END AS bucket", "part", ["p_partkey"])


def shape_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("width"), F.col("p_size").cast("string"), F.lit("height"), F.lit("2"), F.lit("r"), F.col("p_size").cast("string"), F.lit("points"), F.concat_ws(" ", F.lit("0,0"), F.col("p_size"), F.lit("5"))).alias("a"))
    return rows.select("p_partkey", svg.shape_path(F.lit("rect"), F.col("a")).alias("rect"), svg.shape_path(F.lit("line"), F.col("a")).alias("line"), svg.shape_path(F.lit("polygon"), F.col("a")).alias("polygon"), F.get(svg.path_tokens(svg.shape_path(F.lit("circle"), F.col("a"))), 1).alias("circle_x"))


QUERIES["shape_path"] = shape_paths
ORACLES["shape_path"] = "SELECT p_partkey, concat('M 0 0 L ', p_size, ' 0 L ', p_size, ' 2 L 0 2 Z') AS rect, 'M0 0 L0 0' AS line, concat('M0 0 L', p_size, ' 5 Z') AS polygon, p_size::VARCHAR AS circle_x FROM part"


def path_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines along an axis become lines and arcs cubics (here half a circle, so two of them); curves stay as they are."""
    size = number_text(F.col("p_size").cast("double"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("M1 2H"), size, F.lit("v3 h-1 Z")).alias("d"), F.concat(F.lit("M0 0a"), size, F.lit(" "), size, F.lit(" 0 0 1 "), number_text(F.col("p_size") * 2.0), F.lit(" 0q1 2 3 4c1 2,3 4,5 6 T1 1s1 2 3 4 1 1 2 2z")).alias("a"))
    rows = svg.normalized(svg.normalized(rows, "d", "path"), "a", "arc")
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace("arc", " q .*$", ""), F.lit(r"-?[\d.]+(?:e-?\d+)?"), F.lit(0)), lambda x: F.round(x.cast("double"), 4) + F.lit(0.0))
    at = {"mid_x": 6, "mid_y": 7, "arm_y": 3, "end_x": 12, "end_y": 13}
    return rows.select("p_partkey", "path", F.regexp_extract("arc", " (q .*)$", 1).alias("rest"), F.size(numbers).alias("n"), *(F.get(numbers, i).alias(c) for c, i in at.items()))


QUERIES["path_norm"] = path_norm
ORACLES["path_norm"] = """SELECT p_partkey, concat('M 1 2 L ', p_size, ' 2 l 0 3 l -1 0 Z') AS path, 'q 1 2 3 4 c 1 2 3 4 5 6 T 1 1 s 1 2 3 4 s 1 1 2 2 z' AS rest, 14::INT AS n,
    p_size::DOUBLE AS mid_x, -p_size::DOUBLE AS mid_y, round(-p_size * 4.0 / 3 * tan(pi() / 8), 4) AS arm_y, 2.0 * p_size::DOUBLE AS end_x, 0.0::DOUBLE AS end_y FROM part"""


def text_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How large the layout makes a text: on one line, and where it has 40 pixels and wraps; and the same of a text in several lines."""
    box = lambda tag, name, text, style="": F.concat(F.lit(f'<div style="display:flex;align-items:flex-start"><{tag} id="{name}"{style}>'), text, F.lit(f"</{tag}></div>"))
    name, lines, narrow = F.col("p_name"), F.translate("p_name", " ", "\n"), ' style="width:40px"'  # a box's bare text keeps its lines
    html = F.concat(F.lit("<body>"), box("p", "one", name), box("p", "one40", name, narrow), box("div", "more", lines), box("div", "more40", lines, narrow), F.lit("</body>"))
    nodes_ = page.page_nodes(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))
    of = lambda name: F.max(F.when(F.col("attrs")["id"] == name, F.col("box"))).alias(name)
    texts = nodes_.where("attrs['id'] is not null").groupBy("page_id").agg(*map(of, ("one", "one40", "more", "more40")))
    one = [F.col("page_id").alias("p_partkey"), "one.width", "one.height", F.col("one40.width").alias("width_at_40"), F.col("one40.height").alias("height_at_40")]
    return texts.select(*one, F.col("more.width").alias("lines_width"), F.floor(F.col("more.height") / 19.2).cast("int").alias("n_lines"), F.col("more40.height").alias("lines_height_at_40"))


QUERIES["text_measure"] = text_measure
ORACLES["text_measure"] = """SELECT p_partkey, ceil(length(p_name) * 8.8::DOUBLE) AS width, 20.0::DOUBLE AS height, 40.0::DOUBLE AS width_at_40, ceil(ceil(length(p_name) * 8.8::DOUBLE / 40) * 19.2::DOUBLE) AS height_at_40,
    ceil(list_max(list_transform(string_split(p_name, ' '), lambda x: length(x))) * 8.8::DOUBLE) AS lines_width, len(string_split(p_name, ' '))::INT AS n_lines,
    ceil(list_sum(list_transform(string_split(p_name, ' '), lambda x: greatest(1, ceil(length(x) * 8.8::DOUBLE / 40)))) * 19.2::DOUBLE) AS lines_height_at_40 FROM part"""
