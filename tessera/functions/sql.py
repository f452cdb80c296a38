"""The CSS expressions as SQL functions of a session: spark.sql("SELECT css_parse_px('2rem')").

install(spark) makes temporary functions from the very columns that the DataFrame side uses, so both say the same; Spark
puts their bodies in place of the call, and no Python runs. Arguments may be named, those with a default left out; a null
value gives what the column gives for it (mostly null). install_tables(spark) adds the table functions of `sources.tables`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions import css, text
from tessera.operators import cascade, nodes, scene, svg, tokens
from tessera.sources.css import href_status, resolved_href

COLOR, STYLE = css.COLOR, "map<string,string>"
EFFECTS = "array<struct<type:string,color:struct<r:double,g:double,b:double,a:double>,x:double,y:double,radius:double,spread:double>>"


@dataclass
class Function:
    """parameters: name and type, and a default where it may be left out."""

    parameters: list[tuple[str, str] | tuple[str, str, str]]
    body: Callable[..., Column]
    about: str

    def column(self) -> Column:
        return self.body(*(F.col(p[0]) for p in self.parameters))


VALUE = [("value", "STRING")]
SIZES = [("root_font_size", "DOUBLE", "16.0D"), ("viewport_width", "DOUBLE", "CAST(NULL AS DOUBLE)"), ("viewport_height", "DOUBLE", "CAST(NULL AS DOUBLE)")]
OF_STYLE = [("style", STYLE)]

FUNCTIONS: dict[str, Function] = {
    "css_inline_style": Function(VALUE, css.declarations, "a style attribute as a map"),
    "css_important": Function(VALUE, css.without_important, "a value without its !important, and whether it had one"),
    "css_parse_px": Function(VALUE + SIZES, css.pixels, "a length in pixels"),
    "css_parse_color": Function(VALUE, css.color, "a colour"),
    "css_font_style": Function([("weight", "STRING"), ("italic", "BOOLEAN", "false")], css.font_style, "the name of a weight"),
    "css_font_family": Function(VALUE, css.font_family, "the first family that is a font"),
    "css_line_height": Function(VALUE, css.line_height, "a line height"),
    "css_letter_spacing": Function(VALUE, css.letter_spacing, "a letter spacing"),
    "css_rotation": Function(VALUE, css.rotation, "the degrees of the first rotate()"),
    "css_aspect_ratio": Function(VALUE, css.aspect_ratio, "width over height"),
    "css_text_align": Function(VALUE, css.text_align, "how text is aligned"),
    "css_text_decoration": Function(VALUE, css.text_decoration, "how text is decorated"),
    "css_text_transform": Function(VALUE, css.text_transform, "the case of text"),
    "css_grid_tracks": Function(VALUE, css.grid_tracks, "the tracks of a template"),
    "css_opacity": Function(VALUE, css.opacity, "an opacity from 0 to 1"),
    "css_corner_radius": Function([*VALUE, ("width", "DOUBLE"), ("height", "DOUBLE")], css.corner_radius, "a radius; shares are of the smaller side"),
    "css_background_fills": Function(OF_STYLE, nodes.background_fills, "the fills of a background"),
    "css_text_style": Function(OF_STYLE, css.text_style, "how text looks"),
    "css_gradient": Function(VALUE, css.gradient, "a gradient: type, angle, matrix, stops"),
    "css_gradient_angle": Function(VALUE, css.gradient_angle, "the angle of a gradient's first part"),
    "css_border": Function(VALUE, css.border, "width, style and colour of a border"),
    "css_box_shadow": Function(VALUE, css.box_shadows, "the shadows of a list"),
    "css_blur": Function(VALUE, css.blur, "the radius of blur()"),
    "css_place": Function(VALUE, css.place, "the two values of place-*"),
    "css_shorthands": Function(OF_STYLE, cascade.expanded, "a style with its shorthands written out"),
    "css_stroke": Function(OF_STYLE, css.stroke, "the first side that is drawn"),
    "css_effects": Function(OF_STYLE, css.effects, "shadows and blurs"),
    "css_specificity": Function([("selector", "STRING")], css.specificity, "a selector's specificity"),
    "css_color_key": Function([("color", COLOR)], css.color_key, "what makes two colours the same"),
    "css_color_hex": Function([("color", COLOR)], css.color_hex, "a colour's six digits"),
    "css_viewport": Function(VALUE, css.viewport, "WxH"),
    "css_title_case": Function(VALUE, text.title_case, "words with a capital each"),
    "css_slug": Function(VALUE, text.slug, "letters and digits, the rest as one hyphen"),
    "css_single_line": Function([("height", "DOUBLE"), ("font_size", "DOUBLE")], css.single_line, "whether a text has one line"),
    "css_data_uri": Function(VALUE, css.data_uri, "the bytes of a data URI"),
    "css_host_paint": Function([("color", COLOR), ("opacity", "DOUBLE", "1.0D")], scene.host_paint, "a solid paint as hosts take it"),
    "css_split_top": Function([*VALUE, ("separator", "STRING", "','")], lambda v, s: F.when(s == ",", text.split_top(v, ",")).otherwise(text.split_top(v, " ")), "parts outside parentheses, at commas or else at blanks"),
    "css_box_styling": Function(OF_STYLE, css.box_styling, "whether a box can be seen"),
    "css_edges": Function(VALUE, css.edges, "top, right, bottom and left of a shorthand"),
    "css_text_bucket": Function([("font_size", "DOUBLE"), ("font_style", "STRING")], tokens.text_bucket, "the group that a text style is named by"),
    "css_path_tokens": Function(VALUE, svg.path_tokens, "commands and numbers of a path"),
    "css_href_status": Function([("href", "STRING")], href_status, "ok, refused or unresolved"),
    "css_resolved_href": Function([("url", "STRING"), ("href", "STRING")], resolved_href, "the path that a page's link names"),
}

#: A text, a function whose name is an operator, a number with a fraction, or none.
_PIECE = re.compile(r"('(?:[^'\\]|\\.)*')|((?<![\w`)\]])(?:[-=<>!*/+%&|^~]+|\b(?:in|and|or|not|if|div)\b)(?=\())|(?<![\w.])(\d+\.\d+(?:E-?\d+)?)(?![\w.])|\b(NaN)\b", re.S)


def sql_of(column: Column) -> str:
    """A column as SQL. Names of operators are quoted, so that they are called as functions; fractions stay doubles."""
    return _PIECE.sub(lambda m: m[1] or (f"`{m[2]}`" if m[2] else f"{m[3]}D" if m[3] else "double('NaN')"), column._jc.node().sql())


def install(spark: SparkSession, names: list[str] | None = None) -> list[str]:
    """Makes these functions (all, if none are named) for this session, and names them."""
    names = list(FUNCTIONS) if names is None else names
    for name in names:
        f = FUNCTIONS[name]
        given = ", ".join(f"{p[0]} {p[1].upper()}" + (f" DEFAULT {p[2]}" if len(p) > 2 else "") for p in f.parameters)
        empty = spark.range(0).select(*(F.lit(None).cast(p[1]).alias(p[0]) for p in f.parameters))
        kind = empty.select(f.column().alias("x")).schema["x"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} COMMENT '{f.about.replace(chr(39), chr(39) * 2)}' RETURN {sql_of(f.column())}")
    return names
