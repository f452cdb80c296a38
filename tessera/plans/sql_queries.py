"""Queries that SQL users write: the css_* functions and the table functions of a session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.sql import install
from tessera.plans import pages
from tessera.plans.values import KEYS, SPECS, table
from tessera.sources.store import dealt
from tessera.sources.tables import install_tables

QUERIES, ORACLES = {}, {}


def _named(columns: str, prefix: str) -> str:
    """SQL of columns with a prefix before each column's name."""
    return re.sub(r" AS (\w+)(?=, |$)", rf" AS {prefix}_\1", columns)


def _functions(name: str, picks: dict[str, tuple[str, str]]) -> None:
    """picks: for each query over values the function that reads its text ({v}), and the columns taken from that ({r})."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        install(spark, sorted(set(re.findall(r"css_\w+", str(picks)))))
        dealt(table(spark, sf_dir, "lineitem"), KEYS[0]).createOrReplaceTempView("tessera_lines")
        keys = ", ".join(KEYS)
        texts = ", ".join(f"{SPECS[q][0]} AS v_{q}" for q in picks)
        read = ", ".join(f"{call.format(v=f'v_{q}')} AS r_{q}" for q, (call, _) in picks.items())
        taken = ", ".join(_named(columns.format(r=f"r_{q}"), q) for q, (_, columns) in picks.items())
        return spark.sql(f"SELECT {keys}, {taken} FROM (SELECT {keys}, {read} FROM (SELECT {keys}, {texts} FROM tessera_lines))")

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {', '.join(KEYS)}, {', '.join(_named(SPECS[q][1], q) for q in picks)} FROM lineitem"


_functions("sql_lengths", {
    "parse_px": ("struct(css_parse_px({v}, 16, 1440, 900) AS a, css_parse_px(value => {v}) AS b)", "round({r}.a, 6) AS px, round({r}.b, 6) AS px_bare"),
    "line_height": ("css_line_height({v})", "{r}.unit AS unit, {r}.value AS value"),
    "letter_spacing": ("css_letter_spacing({v})", "{r}.unit AS unit, round({r}.value, 6) AS value"),
    "rotation": ("css_rotation({v})", "round({r}, 6) AS degrees"),
    "aspect_ratio": ("css_aspect_ratio({v})", "{r} AS ratio"),
    "opacity": ("css_opacity({v})", "round({r}, 6) AS opacity"),
    "corner_radius": ("css_corner_radius({v}, width => 80, height => 40)", "round({r}, 6) AS radius"),
    "blur": ("css_blur({v})", "{r} AS radius"),
    "edges": ("css_edges({v})", "{r}.top AS top, {r}.right AS right, {r}.bottom AS bottom, {r}.left AS left"),
    "single_line": ("css_single_line({v}, 16)", "{r} AS single"),
})
_functions("sql_colors", {
    "parse_color": ("css_parse_color({v})", "round({r}.r, 6) AS r, round({r}.g, 6) AS g, round({r}.b, 6) AS b, round({r}.a, 6) AS a"),
    "color_key": ("css_parse_color({v})", "css_color_key({r}) AS key, css_color_hex({r}) AS hex"),
    "host_paint": ("css_host_paint(css_parse_color({v}), 0.5)", "round({r}.r, 6) AS r, round({r}.opacity, 6) AS opacity"),
    "gradient_stops": ("css_gradient({v})", "{r}.type AS type, coalesce(size({r}.stops), 0) AS n, round(get({r}.stops, 1).position, 6) AS second_at, round(get({r}.stops, 0).position, 6) AS first_at"),
    "gradient_angle": ("css_gradient_angle({v})", "{r} AS angle"),
    "border": ("css_border({v})", "{r}.width AS width, {r}.style AS style, {r}.color AS color"),
    "box_shadow": ("css_box_shadow({v})", "coalesce(size({r}), 0) AS n, get({r}, 0).y AS y, get({r}, 0).blur AS blur, get({r}, 0).color AS color, get({r}, 1).inset AS last_inset"),
    "bg_fill": ("css_background_fills(css_inline_style({v}))", "get({r}, 0).type AS type, css_color_hex(get({r}, 0).color) AS hex"),
    "stroke": ("css_stroke(css_inline_style({v}))", "{r}.weight AS weight, css_color_hex({r}.color) AS hex"),
    "box_styling": ("css_box_styling(css_inline_style({v}))", "{r} AS boxed"),
})
_functions("sql_texts", {
    "font_family": ("css_font_family({v})", "{r} AS family"),
    "text_enums": ("{v}", "css_text_align({r}) AS align, css_text_decoration({r}) AS decoration, css_text_transform({r}) AS transform"),
    "text_style": ("css_text_style(css_inline_style({v}))", "{r}.font_family AS font, {r}.font_style AS style, {r}.font_size AS size, {r}.line_height.value AS line, {r}.align AS align"),
    "important": ("css_important({v})", "{r}.value AS value, {r}.important AS important"),
    "inline_style": ("css_inline_style({v})", "{r}['color'] AS color, {r}['padding'] AS padding, size({r}) AS n"),
    "specificity": ("css_specificity({v})", "{r}.id AS id, {r}.cls AS cls, {r}.type AS type"),
    "split_top": ("{v}", "size(css_split_top({r})) AS n, size(css_split_top({r}, separator => ' ')) AS words, get(css_split_top({r}, ','), 0) AS first"),
    "text_bucket": ("{v}", "css_text_bucket({r}, 'Bold') AS bold, css_text_bucket({r}, 'Bold Italic') AS regular"),
    "data_uri": ("css_data_uri({v})", "decode({r}, 'utf-8') AS text"),
    "href_policy": ("css_href_status({v})", "{r} AS status"),
})
_functions("sql_shapes", {
    "viewport": ("css_viewport({v})", "{r}.width AS width, {r}.height AS height"),
    "place": ("css_place({v})", "{r}.align AS align, {r}.justify AS justify"),
    "grid_tracks": ("css_grid_tracks({v})", "size({r}) AS n, aggregate({r}, 0D, (a, t) -> a + coalesce(t.fr, 0D)) AS fr, aggregate({r}, 0D, (a, t) -> a + coalesce(t.px, 0D)) AS px"),
    "path_tokens": ("css_path_tokens({v})", "size({r}) AS n, get({r}, 1) AS second, get({r}, 3) AS fourth"),
})


def lateral_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    install_tables(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("tessera_pages")
    return spark.sql("SELECT p.page_id, d.tag, count(*) AS n FROM tessera_pages p, LATERAL parse_dom(p.html, 'kind, tag, implied') d WHERE d.kind = 'element' AND NOT d.implied GROUP BY ALL")


def lateral_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    install_tables(spark)
    pages.card_pages(spark, sf_dir).createOrReplaceTempView("tessera_cards")
    return spark.sql(
        """SELECT page_id, r.rule_order, r.selector, d.prop, d.value, d.important FROM (SELECT page_id, regexp_extract(html, '<style>(.*?)</style>', 1) AS css FROM tessera_cards) s,
        LATERAL parse_css(s.css, 'rule_order, selector, decls') r, LATERAL inline(r.decls) d"""
    )


QUERIES |= {"lateral_dom": lateral_dom, "lateral_css": lateral_css}
ORACLES |= {"lateral_dom": pages.ORACLES["dom_tag_counts"], "lateral_css": pages.ORACLES["css_rules"]}
