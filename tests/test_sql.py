"""The functions and table functions that SQL users have."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import css, sql
from tessera.sources.tables import install_tables

VALUES = ["12px", " 2REM ", "50vw", "0", "-1.5", "auto", "", "   ", "1e999", "#fff", "#12345g", "rgba(1,2,3,.5)", "transparent", "Silver", "rgb(1 2)", "bold", "1.5", "120%", "normal", ".1em", "rotate(.25turn)", "16/9",
          "repeat(3, 1fr 20px) minmax(1px, 2fr)", "linear-gradient(to top, red, blue 20%)", "1px solid red", "0 1px 2px red, inset 0 0 1px #000", "blur(3px)", "start end", "a>b .c#d::before", "color:red;color:blue;x:'y;z'", "data:image/png;base64,aGk=", "800x600", "a-b_c D", "1 2 3", "'Fira Sans', serif", "x !important", "É 'quoted' \\ back", "a/../b.css?v=1", "../x.css", None]


def test_every_function_says_what_its_column_says(spark):
    names = sql.install(spark)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, value string")
    given = {"STRING": F.col("value"), "DOUBLE": F.coalesce(css.pixels(F.col("value")), F.lit(20.0)), "BOOLEAN": F.col("i") % 2 == 0, sql.COLOR: css.color(F.col("value")), sql.STYLE: css.declarations(F.concat(F.lit("background:"), "value", F.lit(";border-top-width:1px;border-top-color:"), "value", F.lit(";font-size:"), "value", F.lit(";padding:1px")))}
    for name in names:
        f = sql.FUNCTIONS[name]
        kinds = [p[1] for p in f.parameters]
        args = [given[k] for k in kinds]
        frame = rows.select("i", *(a.alias(f"a{k}") for k, a in enumerate(args)))
        both = frame.select(f.body(*(F.col(f"a{k}") for k in range(len(args)))).alias("column"), F.expr(f"{name}({', '.join(f'a{k}' for k in range(len(args)))})").alias("function"))
        kinds = dict(both.dtypes)
        assert kinds["column"] == kinds["function"], name
        for r in both.collect():
            assert repr(r["column"]) == repr(r["function"]), name


def test_names_and_defaults(spark):
    sql.install(spark, ["css_parse_px", "css_font_style", "css_resolved_href", "css_parse_color"])
    one = lambda text: spark.sql(f"SELECT {text} AS x").first()["x"]
    assert one("css_parse_px('2rem')") == 32.0
    assert one("css_parse_px('50vw', viewport_width => 200)") == 100.0
    assert one("css_parse_px('50vw')") is None
    assert one("css_parse_px(value => NULL)") is None
    assert one("css_font_style('700', italic => true)") == "Bold Italic"
    assert one("css_parse_color('#808080').r") == 128 / 255
    assert one("css_resolved_href('file:/a/b/page.html?x/y', './c/../d.css?v=2')") == "file:/a/b/d.css"
    assert one("css_resolved_href('page.html', 'd.css#f')") == "d.css"
    assert one("css_resolved_href('a/b.html', '../d.css')") is None
    plan = spark.sql("SELECT css_parse_px(cast(id AS STRING)) AS x FROM range(3)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_pages_in_lateral_joins(spark):
    install_tables(spark)
    spark.createDataFrame([(1, "<p class=a>hi<b>x</b></p>"), (2, None), (3, "")], "id int, html string").createOrReplaceTempView("some_pages")
    found = spark.sql("SELECT id, d.* FROM some_pages p, LATERAL parse_dom(p.html, 'tag, attrs') d WHERE d.tag IN ('p', 'b', 'html')")
    assert found.columns == ["id", "tag", "attrs"]
    assert sorted((r.id, r.tag, r.attrs.get("class")) for r in found.collect()) == [(1, "b", None), (1, "html", None), (1, "p", "a"), (2, "html", None), (3, "html", None)]
    every = spark.sql("SELECT d.* FROM some_pages p, LATERAL parse_dom(p.html) d")
    assert every.count() == 13
    assert every.where("error is not null").count() == 0
    with pytest.raises(Exception, match="no such column: nope"):
        spark.sql("SELECT * FROM some_pages p, LATERAL parse_dom(p.html, 'nope') d")
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT * FROM some_pages p, LATERAL parse_dom(p.html, p.html) d")


def test_sheets_in_lateral_joins(spark):
    install_tables(spark)
    found = spark.sql("SELECT id, r.* FROM VALUES (1, 'a b > c{color:red;margin:0} d, e::x{x:y}'), (2, NULL), (3, '') s(id, css), LATERAL parse_css(s.css, 'selector, supported, decls') r")
    assert sorted((r.id, r.selector, r.supported, len(r.decls)) for r in found.collect()) == [(1, "a b > c", True, 2), (1, "d", True, 1), (1, "e::x", False, 1)]
    assert [r.selector for r in spark.sql("SELECT selector FROM parse_css('a{b:c} d{}', 'selector')").collect()] == ["a"]
