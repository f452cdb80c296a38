"""Single values in, typed values out."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import css
from tessera.operators import svg
from tessera.sources.css import parse_rules, parse_selector


def read(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "want"), [("12px", 12.0), ("0", 0.0), ("-1.5", -1.5), ("2rem", 32.0), ("10vw", 144.0), (".5px", None), ("1em", None), ("calc(1px)", None), (None, None)])
def test_pixels(spark, value, want):
    assert read(spark, value, lambda v: css.pixels(v, 16.0, 1440.0, 900.0)) == want


@pytest.mark.parametrize(("value", "want"), [("#fff", (1, 1, 1, 1)), ("#00000080", (0, 0, 0, 128 / 255)), ("rgb(100%, 0, 0)", (1, 0, 0, 1)), ("rgba(300,-5,0,.25)", (1, 0, 0, 0.25)), ("transparent", (0, 0, 0, 0)), ("hotpink", None), ("rgb(1,2)", None), ("#12345", None), ("", None)])
def test_color(spark, value, want):
    got = read(spark, value, css.color)
    assert got is None if want is None else tuple(got) == pytest.approx(want)


def test_short_hex_that_cannot_be_read_has_no_number(spark):
    assert math.isnan(read(spark, "#g00", css.color)["r"])
    assert read(spark, "#gg0000", css.color) is None


@pytest.mark.parametrize(("value", "want"), [("1.5", ("PERCENT", 150.0)), ("24px", ("PIXELS", 24.0)), ("normal", ("AUTO", None)), ("0", None), ("-2px", None)])
def test_line_height(spark, value, want):
    got = read(spark, value, css.line_height)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("value", "want"), [("-0.025em", ("PERCENT", -2.5)), ("1rem", None), ("2px", ("PIXELS", 2.0))])
def test_letter_spacing(spark, value, want):
    got = read(spark, value, css.letter_spacing)
    assert (tuple(got) if got else None) == want


def test_gradient_has_two_stops_at_least(spark):
    got = read(spark, "linear-gradient(90deg, red, rgba(0, 0, 255, 0.5) 40%, blue)", css.gradient)
    assert (got["type"], got["angle"], [s["position"] for s in got["stops"]]) == ("GRADIENT_LINEAR", 90.0, [0.0, 0.4, 1.0])
    assert read(spark, "linear-gradient(red)", css.gradient) is None
    assert read(spark, "conic-gradient(red, blue)", css.gradient) is None


def test_border_and_shadow(spark):
    assert tuple(read(spark, "solid rgb(0, 0, 0) 2px", css.border)) == ("2px", "solid", "rgb(0, 0, 0)")
    assert [tuple(s) for s in read(spark, "0 1px 2px 3px red, inset 1px 1px", css.box_shadows)] == [(False, 0.0, 1.0, 2.0, 3.0, "red"), (True, 1.0, 1.0, 0.0, 0.0, "rgba(0,0,0,1)")]
    assert read(spark, "red 1px 1px", css.box_shadows) is None


@pytest.mark.parametrize(("value", "want"), [("#a .b p", (0, 1, 1, 1)), ("a:hover::before", (0, 0, 1, 2)), ("*", (0, 0, 0, 0)), ("ul > li[x=y] + li", (0, 0, 1, 3))])
def test_specificity(spark, value, want):
    assert tuple(read(spark, value, css.specificity)) == want


def test_declarations_keep_the_last(spark):
    assert read(spark, "Color: red; color: blue; x; :y; z:", css.declarations) == {"color": "blue"}
    assert read(spark, None, css.declarations) == {}


def test_rules():
    got = parse_rules("/* x */ a, b > c { COLOR: red !important; } @media print { p { margin: 0; } } .e {} @font-face { src: x } @import 'y';")
    assert got == [(["a", "b > c"], [("color", "red", True)]), (["p"], [("margin", "0", False)])]


def test_selectors():
    parts, combs, bad = parse_selector("nav#x > a.b.c:first-child")
    assert (parts, combs, bad) == ([("nav", "x", [], []), ("a", None, ["b", "c"], ["first-child"])], [">"], False)
    assert all(parse_selector(s)[2] for s in ("a + b", "a[href]", "p::before", "li:nth-child(2)", "a:hover", ""))
    assert parse_selector(":root")[0] == [("html", None, [], [])]


def test_plain_paths():
    assert svg.plain_path("M1 2h3V5z") == "M 1 2 l 3 0 L 4 5 z"
    assert svg.plain_path("M0 0 1 1 2 2") == "M 0 0 L 1 1 L 2 2"
    half = svg.plain_path("M0 0A1 1 0 0 1 2 0").split()
    assert half.count("C") == 2
    assert [float(x) for x in half[-2:]] == pytest.approx([2, 0])
    assert [float(x) for x in half[8:10]] == pytest.approx([1, -1])


def test_values_of_a_small_file_are_dealt_out(spark):
    """A file holds more rows than one task can read in time."""
    import os

    from tessera.plans import values

    if os.path.isdir("/root/testdata/sf0.001"):
        assert values.QUERIES["stroke"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
