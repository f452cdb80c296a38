"""Vector drawings: shapes as paths, and paths in absolute, plain commands."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import css
from tessera.functions.text import kept, number, number_text
from tessera.operators.nodes import PAINT, STROKE, solid

#: Fixed value: the length of a control arm that makes a cubic follow a quarter of a circle.
ARM = 0.5522847498307936
SHAPES = ["path", "rect", "circle", "ellipse", "line", "polygon", "polyline"]
TOKEN = r"[MmLlHhVvCcSsQqTtAaZz]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: How many numbers a command takes.
ARGUMENTS = {"m": 2, "l": 2, "t": 2, "h": 1, "v": 1, "s": 4, "q": 4, "c": 6, "a": 7, "z": 0}


def path_tokens(d: Column) -> Column:
    return F.regexp_extract_all(d, F.lit(TOKEN), F.lit(0))


def _said(*parts) -> Column:
    return F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else number_text(p) for p in parts))


def _round(cx: Column, cy: Column, rx: Column, ry: Column) -> Column:
    kx, ky = rx * ARM, ry * ARM
    return _said("M", cx + rx, cy, "C", cx + rx, cy - ky, cx + kx, cy - ry, cx, cy - ry, "C", cx - kx, cy - ry, cx - rx, cy - ky, cx - rx, cy, "C", cx - rx, cy + ky, cx - kx, cy + ry, cx, cy + ry, "C", cx + kx, cy + ry, cx + rx, cy + ky, cx + rx, cy, "Z")


def shape_path(tag: Column, attrs: Column) -> Column:
    """The path of a shape element; null if it has no extent."""
    n = lambda name: number(attrs[name])
    z = lambda name: F.coalesce(n(name), F.lit(0.0))
    x, y, w, h = z("x"), z("y"), n("width"), n("height")
    rx, ry = n("rx"), F.coalesce(n("ry"), n("rx"))
    a, b = F.least(rx, w / 2), F.least(ry, h / 2)
    ka, kb = a * ARM, b * ARM
    sharp = _said("M", x, y, "L", x + w, y, "L", x + w, y + h, "L", x, y + h, "Z")
    soft = _said("M", x + a, y, "L", x + w - a, y, "C", x + w - a + ka, y, x + w, y + b - kb, x + w, y + b, "L", x + w, y + h - b, "C", x + w, y + h - b + kb, x + w - a + ka, y + h, x + w - a, y + h, "L", x + a, y + h, "C", x + a - ka, y + h, x, y + h - b + kb, x, y + h - b, "L", x, y + b, "C", x, y + b - kb, x + a - ka, y, x + a, y, "Z")
    line = F.concat(F.lit("M"), number_text(z("x1")), F.lit(" "), number_text(z("y1")), F.lit(" L"), number_text(z("x2")), F.lit(" "), number_text(z("y2")))
    flat = F.transform(F.filter(F.split(attrs["points"], r"[\s,]+"), lambda p: p != ""), number)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: F.concat_ws(" ", number_text(F.get(flat, 2 * i)), number_text(F.get(flat, 2 * i + 1))))
    poly = F.when(F.size(flat) >= 4, F.concat(F.lit("M"), F.array_join(pairs, " L"), F.when(tag == "polygon", " Z").otherwise("")))
    return (
        F.when(tag == "path", F.when(attrs["d"] != "", attrs["d"]))
        .when(tag == "rect", F.when((w > 0) & (h > 0), F.when((rx > 0) & (ry > 0), soft).otherwise(sharp)))
        .when(tag == "circle", F.when(n("r") > 0, _round(z("cx"), z("cy"), n("r"), n("r"))))
        .when(tag == "ellipse", F.when((n("rx") > 0) & (n("ry") > 0), _round(z("cx"), z("cy"), n("rx"), n("ry"))))
        .when(tag == "line", line)
        .when(tag.isin("polygon", "polyline"), poly)
    )


def _text(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def arc(x1: float, y1: float, rx: float, ry: float, tilt: float, large: bool, sweep: bool, x2: float, y2: float) -> list[tuple[float, ...]]:
    """Cubics along an elliptical arc, none longer than a quarter. In a space where the ellipse is the unit circle the centre lies on the bisector of the chord."""
    if (x1, y1) == (x2, y2):
        return []
    if not rx or not ry:
        return [(x1, y1, x2, y2, x2, y2)]
    rx, ry, turn = abs(rx), abs(ry), complex(math.cos(math.radians(tilt)), math.sin(math.radians(tilt)))

    def unit(p: complex) -> complex:
        q = p / turn
        return complex(q.real / rx, q.imag / ry)

    def world(p: complex) -> complex:
        return complex(p.real * rx, p.imag * ry) * turn

    a, b = unit(complex(x1, y1)), unit(complex(x2, y2))
    half = abs(b - a) / 2
    if half > 1:
        rx, ry, half = rx * half, ry * half, 1.0
        a, b = unit(complex(x1, y1)), unit(complex(x2, y2))
    normal = (b - a) / abs(b - a) * 1j
    centre = (a + b) / 2 + normal * math.sqrt(max(0.0, 1 - half * half)) * (-1 if large == sweep else 1)
    start, end = (math.atan2((p - centre).imag, (p - centre).real) for p in (a, b))
    span = end - start
    if sweep and span < 0:
        span += 2 * math.pi
    elif not sweep and span > 0:
        span -= 2 * math.pi
    n = max(1, math.ceil(abs(span) / (math.pi / 2) - 1e-12))
    step = span / n
    reach, out = 4 / 3 * math.tan(step / 4), []
    for i in range(n):
        p, q = (complex(math.cos(t), math.sin(t)) for t in (start + i * step, start + (i + 1) * step))
        points = [world(centre + v) for v in (p + p * 1j * reach, q - q * 1j * reach, q)]
        out.append(tuple(x for v in points for x in (v.real, v.imag)))
    return out


def plain_path(d: str | None) -> str | None:
    """A path whose horizontal and vertical lines are lines, and whose arcs are cubics; other commands stay, one for each group of numbers."""
    if d is None:
        return None
    out: list[str] = []
    at, begin, command, tokens, i = [0.0, 0.0], [0.0, 0.0], "", re.findall(TOKEN, d), 0
    while i < len(tokens):
        if tokens[i].isalpha():
            command, i = tokens[i], i + 1
            if command in "Zz":
                out.append(command)
                at, command = list(begin), ""
            continue
        if not command:
            out.append(tokens[i])
            i += 1
            continue
        need = ARGUMENTS[command.lower()]
        group = tokens[i : i + need]
        if len(group) < need:
            break
        i += need
        n, relative = [float(g) for g in group], command.islower()
        base = at if relative else [0.0, 0.0]
        kind = command.lower()
        if kind == "h":
            out += ["l" if relative else "L", _text(n[0]), "0" if relative else _text(at[1])]
            at = [base[0] + n[0], at[1]]
        elif kind == "v":
            out += ["l" if relative else "L", "0" if relative else _text(at[0]), _text(n[0])]
            at = [at[0], base[1] + n[0]]
        elif kind == "a":
            to = [base[0] + n[5], base[1] + n[6]]
            for c in arc(*at, n[0], n[1], n[2], bool(n[3]), bool(n[4]), *to):
                out += ["C", *map(_text, c)]
            at = to
        else:
            out += [command, *group]
            at = [base[0] + n[-2], base[1] + n[-1]]
            if kind == "m":
                begin, command = list(at), "l" if relative else "L"
    return " ".join(out)


def normalized(paths: DataFrame, column: str, out: str) -> DataFrame:
    """paths with the plain form of a column: a fold over a path's own state, in Arrow batches."""
    from pyspark.sql.types import StringType, StructField, StructType

    at = paths.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([plain_path(d) for d in b.column(at).to_pylist()], pa.string())], [*b.schema.names, out])

    return paths.mapInArrow(run, StructType([*paths.schema.fields, StructField(out, StringType())]))


@kept
def _raw_path() -> Column:
    return shape_path(F.col("tag"), F.col("attrs"))


@kept
def _paint(name: str) -> Column:
    own = F.coalesce(F.col("attrs")[name], F.col("svg_attrs")[name])
    shown = F.when(F.lower(own) == "currentcolor", F.col("current")).otherwise(own)
    return F.when(shown != "none", css.color(shown))


def _drawings(nodes: DataFrame, styles: DataFrame | None, *more: Column) -> DataFrame:
    """page_id, svg_id, current (the drawing's own colour) of each drawing. styles: if nodes haven't theirs."""
    rows = nodes.where("tag = 'svg'").select("page_id", F.col("node_id").alias("svg_id"), *more, *([F.col("style")["color"].alias("current")] if styles is None else []))
    return rows if styles is None else rows.join(styles.select("page_id", F.col("node_id").alias("svg_id"), F.col("style")["color"].alias("current")).hint("merge"), ["page_id", "svg_id"], "left")


def shapes(nodes: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """page_id, svg_id, node_id, idx, path, fills, strokes: the shapes of each drawing in document order.

    Paints come from the shape, else from its svg; currentColor is the svg's colour; a stroke without a width is 1.
    """
    svg = _drawings(nodes, styles, F.col("attrs").alias("svg_attrs"))
    inner = nodes.where(F.col("tag").isin(SHAPES)).select("page_id", "node_id", "tag", "attrs", F.explode("path").alias("svg_id")).join(svg.hint("merge"), ["page_id", "svg_id"])
    drawn = inner.withColumn("raw_path", _raw_path()).where(F.col("raw_path").isNotNull())
    weight = F.coalesce(*(F.when(a["stroke-width"].isNotNull(), number(a["stroke-width"])) for a in (F.col("attrs"), F.col("svg_attrs"))), F.lit(1.0))
    drawn = drawn.withColumn("fill_color", _paint("fill")).withColumn("stroke_color", _paint("stroke"))
    rows = drawn.select(
        "page_id", "svg_id", "node_id", "raw_path",
        F.when(F.col("fill_color").isNotNull(), F.array(solid(F.col("fill_color")))).otherwise(F.array().cast(f"array<{PAINT}>")).alias("fills"),
        F.when(F.col("stroke_color").isNotNull(), F.array(F.struct(F.col("stroke_color").alias("color"), weight.alias("weight"), F.lit("CENTER").alias("align")).cast(STROKE))).otherwise(F.array().cast(f"array<{STROKE}>")).alias("strokes"),
    )
    from pyspark.sql import Window

    numbered = rows.withColumn("idx", F.row_number().over(Window.partitionBy("page_id", "svg_id").orderBy("node_id")) - 1)
    return normalized(numbered, "raw_path", "path").drop("raw_path")


def sources(nodes: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """page_id, node_id, svg_source: a drawing's markup, currentColor replaced."""
    inner = nodes.select("page_id", "node_id", "last_id", "kind", "tag", "text", F.map_entries("attrs").alias("attrs"), F.explode("path").alias("svg_id"))
    rows = inner.join(_drawings(nodes, styles).hint("merge"), ["page_id", "svg_id"])
    colored = rows.groupBy("page_id", "svg_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "last_id", "kind", "tag", "text", "attrs"))).alias("n"), F.first("current").alias("current"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import html

        for b in batches:
            out = []
            for rows, current in zip(b.column("n").to_pylist(), b.column("current").to_pylist(), strict=True):
                parts: list[str] = []
                open_: list[tuple[int, str]] = []
                for r in rows:
                    while open_ and open_[-1][0] < r["node_id"]:
                        parts.append(f"</{open_.pop()[1]}>")
                    if r["kind"] == "text":
                        parts.append(html.escape(r["text"], quote=False))
                    elif r["kind"] == "element":
                        parts.append(f"<{r['tag']}" + "".join(f' {a["key"]}="{html.escape(a["value"])}"' for a in r["attrs"]) + ">")
                        open_.append((r["last_id"], r["tag"]))
                parts += [f"</{t}>" for _, t in reversed(open_)]
                text = "".join(parts)
                out.append(re.sub("currentcolor", current, text, flags=re.I) if current else text)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("svg_id"), pa.array(out, pa.string())], ["page_id", "node_id", "svg_source"])

    return colored.select("page_id", "svg_id", "n", "current").mapInArrow(run, "page_id long, node_id int, svg_source string")


def vectors(ir: DataFrame, drawn: DataFrame, markup: DataFrame) -> DataFrame:
    """ir with its drawings: none or one shape stays a VECTOR; more become a FRAME that holds one VECTOR each."""
    others = ir.where("ir_type <> 'VECTOR'")
    counts = drawn.groupBy("page_id", F.col("svg_id").alias("node_id")).agg(F.count("*").alias("n"), F.min_by(F.struct("path", "fills", "strokes"), "idx").alias("one"))
    flagged = ir.where("ir_type = 'VECTOR'").join(counts.hint("merge"), ["page_id", "node_id"], "left").join(markup.withColumnRenamed("svg_source", "markup").hint("merge"), ["page_id", "node_id"], "left")
    vector = F.col("ir_type") == "VECTOR"
    single, many = vector & (F.col("n") == 1), vector & (F.col("n") > 1)
    set_to = {
        "ir_type": F.when(many, "FRAME").otherwise(F.col("ir_type")),
        "vector_path": F.when(single, F.col("one.path")).when(vector & F.col("n").isNull(), "").otherwise(F.col("vector_path")),
        "fills": F.when(single, F.col("one.fills")).otherwise(F.col("fills")),
        "strokes": F.when(single, F.col("one.strokes")).otherwise(F.col("strokes")),
        "svg_source": F.when(vector & F.col("n").isNotNull(), F.col("markup")).otherwise(F.col("svg_source")),
        "ir_steps": F.when(many, F.concat(F.slice("ir_steps", F.lit(1), F.size("ir_steps") - 1), F.array(F.concat_ws("-", F.lit("frame"), "ord")))).otherwise(F.col("ir_steps")),
    }
    base = flagged.select(*(set_to.get(c, F.col(c)).alias(c) for c in ir.columns))
    owners = flagged.where(many).select("page_id", F.col("node_id").alias("svg_id"), F.col("path").alias("up"), "geometry", "opacity", F.col("ir_path").alias("ir_up"), set_to["ir_steps"].alias("steps"))
    inner = drawn.join(owners.hint("merge"), ["page_id", "svg_id"])
    types = dict(ir.dtypes)
    values = {
        "page_id": F.col("page_id"), "node_id": F.col("node_id"), "last_id": F.col("node_id"), "ir_type": F.lit("VECTOR"), "path": F.concat("up", F.array("node_id")), "name": F.concat(F.lit("Path "), F.col("idx") + 1), "opacity": F.col("opacity"),
        "geometry": F.when(F.col("geometry").isNotNull(), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("geometry.width").alias("width"), F.col("geometry.height").alias("height"))),
        "fills": F.col("fills"), "strokes": F.col("strokes"), "effects": F.array(), "vector_path": F.col("path"),
        "parent_ir": F.col("svg_id"), "ir_path": F.concat("ir_up", F.array("node_id")), "ord": F.col("idx"), "ir_steps": F.concat("steps", F.array(F.concat_ws("-", F.lit("vector"), "idx"))),
    }
    return others.unionByName(base).unionByName(inner.select(*(values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in ir.columns)))
