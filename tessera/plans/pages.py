"""Queries over pages: the corpus as it is, and documents built from table rows so that SQL can say what must come out.

The stages of one corpus are computed once for all the queries of a session over the same files; `forget` drops them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import css
from tessera.operators import cascade, classify, components, document, nodes, page, scene, schemas, tokens
from tessera.plans.engine import Document, Options, convert
from tessera.plans.values import table
from tessera.sources import css as css_source
from tessera.sources import html as html_source
from tessera.sources.store import ship as _ship
from tessera.sources.store import by_page

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_documents: dict[tuple, Document] = {}


def _add(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


def ship(df: DataFrame) -> DataFrame:
    _ship(df.sparkSession)
    return df


def forget() -> None:
    _documents.clear()


def _document(spark: SparkSession, sf_dir: str, name: str, source: str, make: Callable[[], Document]) -> Document:
    """The document of this name over a table, made anew when the table's files change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{source}.parquet")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in system.listStatus(path))
    key = (name, str(state), spark.sparkContext.applicationId)
    if key not in _documents:
        _documents[key] = make()
    return _documents[key]


def corpus(spark: SparkSession, sf_dir: str) -> Document:
    """The pages table."""
    return _document(spark, sf_dir, "pages", "pages", lambda: convert(table(spark, sf_dir, "pages"), Options(layout=False)))


CARDS_CSS = (
    ":root{--ink:#333333} .grid{display:flex;gap:10px} .card0{background:#ff0000} .card1{background:#00ff00;padding:4px} .card2{background:#808080;border:1px solid #112233} "
    ".grid p{color:var(--ink)} .grid > .card1 p{color:#0000ff !important;font-size:14px} p{margin:0} .card2 p{font-weight:bold;font-size:24px}"
)


def card_pages(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """A page for each brand and thousand of part keys, so that pages don't grow with the table: a card for each part, in one of three looks by its size. whole: a page for each brand."""
    part = table(spark, sf_dir, "part")
    card = F.concat(F.lit('<div class="card'), (F.col("p_size") % 3), F.lit('"><p>'), F.col("p_name"), F.lit("</p></div>"))
    page_id = F.regexp_replace("p_brand", r"\D", "").cast("long")
    page_id = page_id if whole else page_id * 1_000_000_000 + F.floor(F.col("p_partkey") / 1000)
    cards = part.select(page_id.alias("page_id"), F.struct("p_partkey", card.alias("c")).alias("x")).groupBy("page_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    body = F.concat(F.lit(f"<!DOCTYPE html><html><head><style>{CARDS_CSS}</style></head><body><div class=\"grid\">"), F.array_join(F.transform("x", lambda x: x["c"]), ""), F.lit("</div></body></html>"))
    return cards.select("page_id", F.concat(F.lit("part/"), "page_id").alias("url"), body.alias("html"))


def cards(spark: SparkSession, sf_dir: str) -> Document:
    return _document(spark, sf_dir, "cards", "part", lambda: convert(by_page(card_pages(spark, sf_dir), "cards"), Options(layout=False)))


BRAND = "(regexp_replace(p_brand, '\\D', '', 'g')::BIGINT * 1000000000 + p_partkey // 1000)"
#: What a page's markup is without comments and scripts, for counting its tags.
BARE = "regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script>.*?</script>', '<script>', 'gs')"
LOOKS = f"(SELECT {BRAND} AS page_id, p_size % 3 AS look, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY ALL)"


@_add("SELECT page_id, length(html)::INT AS n_chars, url FROM pages")
def scan_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("n_chars"), "url")


@_add(f"SELECT page_id, t AS tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all({BARE}, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS t FROM pages) GROUP BY ALL")
def dom_tag_counts(spark, sf_dir):
    return corpus(spark, sf_dir).dom.where("kind = 'element' and not implied").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@_add("SELECT page_id, regexp_extract(html, '<style>(.*?)</style>', 1, 's') AS css FROM pages WHERE html LIKE '%<style>%'")
def collect_styles(spark, sf_dir):
    return css_source.stylesheets(corpus(spark, sf_dir).dom)


CARD_RULES = [
    (":root", "--ink", "#333333"), (".grid", "display", "flex"), (".grid", "gap", "10px"), (".card0", "background", "#ff0000"), (".card1", "background", "#00ff00"), (".card1", "padding", "4px"), (".card2", "background", "#808080"), (".card2", "border", "1px solid #112233"),
    (".grid p", "color", "var(--ink)"), (".grid > .card1 p", "color", "#0000ff"), (".grid > .card1 p", "font-size", "14px"), ("p", "margin", "0"), (".card2 p", "font-weight", "bold"), (".card2 p", "font-size", "24px"),
]
ORDER = list(dict.fromkeys(r[0] for r in CARD_RULES))
RULE_ROWS = ", ".join(f"({ORDER.index(sel)}, '{sel}', '{prop}', '{value}', {str(value == '#0000ff').lower()})" for sel, prop, value in CARD_RULES)


@_add(f"SELECT page_id, r.* FROM (SELECT DISTINCT {BRAND} AS page_id FROM part), (VALUES {RULE_ROWS}) r(rule_order, selector, prop, value, important)")
def css_rules(spark, sf_dir):
    return cards(spark, sf_dir).rules.select("page_id", "rule_order", "selector", F.explode("decls").alias("d")).select("page_id", "rule_order", "selector", F.col("d.prop").alias("prop"), F.col("d.value").alias("value"), F.col("d.important").alias("important"))


@_add(f"SELECT page_id, s.* FROM (SELECT DISTINCT {BRAND} AS page_id FROM part), (VALUES (':root', 1, '', true), ('.grid > .card1 p', 3, '>| ', true), ('.grid p', 2, ' ', true), ('p', 1, '', true)) s(selector, n_parts, combs, supported)")
def selector_parse(spark, sf_dir):
    return cards(spark, sf_dir).rules.where(F.col("selector").isin(":root", ".grid > .card1 p", ".grid p", "p")).select("page_id", "selector", F.size("parts").alias("n_parts"), F.array_join("combs", "|").alias("combs"), "supported")


def spoilt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part: every fifth has no html, every seventh is nested too deep."""
    html = F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 7 == 0, F.repeat(F.lit("<div>"), 600)).otherwise(F.concat(F.lit("<p>"), "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))


@_add("SELECT p_partkey AS page_id, p_size % 5 <> 0 AS ok, CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 7 = 0 THEN 603 ELSE 5 END::INT AS n_nodes, CASE WHEN p_size % 5 = 0 THEN 'no html' WHEN p_size % 7 = 0 THEN 'nested deeper than 512' END AS error FROM part")
def parse_outcomes(spark, sf_dir):
    return html_source.parse_outcomes(spoilt_pages(spark, sf_dir)).select("page_id", "ok", "n_nodes", "error")


def faulty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part: every fifth has no html, of the others every third asks for more tracks than there may be."""
    html = F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 3 == 0, '<div style="display:grid;grid-template-columns:repeat(99999999999999999999, 1fr)"><i>x</i></div>').otherwise(F.concat(F.lit("<p>"), "p_name"))
    url = F.concat(F.lit("pages/"), F.col("p_partkey"), F.lit("/"), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "-with-a-name-that-is-cut.html").otherwise(".html"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the conversion of these pages ended."""
    return _document(spark, sf_dir, "faulty", "part", lambda: by_page(convert(by_page(faulty_pages(spark, sf_dir), "faulty")).outcomes(), "outcomes"))


STAGE = "CASE WHEN p_size % 5 = 0 THEN 'read' WHEN p_size % 3 = 0 THEN 'layout' END"
FAULT = "CASE WHEN p_size % 5 = 0 THEN 'no html' WHEN p_size % 3 = 0 THEN 'ValueError: more than 10000 tracks' END"
FAULTY = "(p_size % 5 = 0 OR p_size % 3 = 0)"


@_add(f"SELECT p_partkey AS page_id, NOT {FAULTY} AS ok, {STAGE} AS stage, {FAULT} AS message, CASE WHEN NOT {FAULTY} THEN 1 END::BIGINT AS nodes FROM part")
def harness_outcomes(spark, sf_dir):
    """Every page is converted or told of, with the stage at which it failed; none keeps the others."""
    return faulty(spark, sf_dir).select("page_id", "ok", "stage", "message", "nodes")


@_add(
    f"""WITH named AS (SELECT *, p_partkey || '/' || p_name || CASE WHEN p_size % 2 = 0 THEN '-with-a-name-that-is-cut.html' ELSE '.html' END AS file FROM part)
    SELECT p_partkey AS page_id, CASE WHEN {FAULTY} THEN '  \u2717 ' ELSE '  \u2713 ' END || CASE WHEN length(file) > 40 THEN '\u2026' || right(file, 39) ELSE rpad(file, 40, ' ') END
    || CASE WHEN {FAULTY} THEN '  ERROR: ' || {FAULT} ELSE '  1 nodes       0c \u00d7 0i         1p \u00d7 1t \u00d7 0e      ' END AS line FROM named"""
)
def harness_table(spark, sf_dir):
    """A line for each page: its name, cut from the left, and what was made of it, or why nothing was."""
    return html_source.outcome_lines(faulty(spark, sf_dir), "pages/")


@_add(f"SELECT count(*) AS n, count(*) FILTER (NOT {FAULTY}) AS n_ok, count(*) FILTER ({FAULTY}) AS n_failed, max({FAULTY}::INT)::INT AS exit_code, printf('summary: %d converted, %d failed, %d total', count(*) FILTER (NOT {FAULTY}), count(*) FILTER ({FAULTY}), count(*)) AS line FROM part")
def harness_summary(spark, sf_dir):
    return html_source.outcome_totals(faulty(spark, sf_dir))


LINKS = [("../css/a.css", "refused"), ("./css/a.css", None), ("css/x/../a.css?v=3#top", None), ("/css/a.css", "refused"), ("https://x/css/a.css", "unresolved"), ("css/none.css", "unresolved")]


@_add(
    f"""SELECT p_partkey AS page_id, CASE WHEN p_size % 6 IN (1, 2) THEN CASE WHEN p_partkey % 2 = 0 THEN '#000001' ELSE '#000002' END END AS color,
    CASE p_size % 6 {' '.join(f"WHEN {i} THEN 'stylesheet {status}: {href}'" for i, (href, status) in enumerate(LINKS) if status)} END AS warning FROM part"""
)
def linked_styles(spark, sf_dir):
    """Two sites with sheets of one name each: a link is read from its page's own folder, or refused, or not found."""
    href = F.element_at(F.array(*(F.lit(h) for h, _ in LINKS)), (F.col("p_size") % 6 + 1).cast("int"))
    html = F.concat(F.lit('<head><link rel="preload stylesheet" href="'), href, F.lit('"></head><p>x</p>'))
    url = F.concat(F.lit("site"), (F.col("p_partkey") % 2).cast("string"), F.lit("/pages/"), F.col("p_partkey"), F.lit(".html"))
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))
    sheets = spark.createDataFrame([(f"site{k}/pages/css/a.css", f"p{{color:#00000{k + 1}}}") for k in (0, 1)] + [("css/a.css", "p{color:red}"), ("site0/css/a.css", "p{color:red}")], "path string, css string")
    doc = convert(by_page(pages, "sites"), Options(layout=False, stylesheets=sheets))
    styles = doc.dom.where("tag = 'p'").select("page_id", "node_id").join(doc.styles, ["page_id", "node_id"])
    return styles.join(doc.warnings.select("page_id", "warning"), "page_id", "left").select("page_id", F.col("style")["color"].alias("color"), "warning")


@_add("SELECT page_id, len(regexp_extract_all(html, '<!-- ad'))::BIGINT AS n_comments FROM pages WHERE html LIKE '%<!-- ad%'")
def comments(spark, sf_dir):
    return corpus(spark, sf_dir).dom.where("kind = 'comment'").groupBy("page_id").agg(F.count("*").alias("n_comments"))


@_add("SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title FROM pages WHERE html LIKE '%<title>%' AND regexp_extract(html, '<title>(.*?)</title>', 1) NOT LIKE '%&%'")
def inner_text(spark, sf_dir):
    d, whole = corpus(spark, sf_dir).dom, table(spark, sf_dir, "pages").where(F.col("html").contains("<title>") & ~F.regexp_extract("html", "<title>(.*?)</title>", 1).contains("&")).select("page_id")
    return classify.inner_text(d).join(d.where("tag = 'title'").select("page_id", "node_id"), ["page_id", "node_id"]).join(whole, "page_id", "left_semi").select("page_id", F.col("text").alias("title"))


@_add(f"SELECT page_id, unnest(['element', 'text']) AS kind, unnest([2 * sum(n) + 3, sum(n)])::BIGINT AS n FROM {LOOKS} GROUP BY page_id")
def ignored_tags(spark, sf_dir):
    """What is drawn: head and style with all that they hold are not."""
    return classify.drawn(cards(spark, sf_dir).dom).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@_add(f"SELECT page_id, unnest(['FRAME', 'TEXT']) AS ir_type, unnest([6, 2 + len(regexp_extract_all({BARE}, '<(li|h1|p)>'))])::BIGINT AS n FROM pages")
def ir_type_counts(spark, sf_dir):
    """Boxes: body, nav, ul, div, article, footer; texts: what stands in the last two of these alone, and each li, h1 and p."""
    return corpus(spark, sf_dir).kinds.groupBy("page_id", "ir_type").agg(F.count("*").alias("n"))


@_add(f"SELECT page_id, 1::BIGINT AS firsts, 1::BIGINT AS lasts, sum(n)::BIGINT AS onlies, (sum(n) * (sum(n) + 1) / 2)::BIGINT AS places, sum(n)::INT AS cards FROM {LOOKS} GROUP BY page_id")
def pseudo_classes(spark, sf_dir):
    """Of a page's cards the first and the last, the texts that are alone, and the cards' places among their kind."""
    card, alone = F.col("tag") == "div", (F.col("tag") == "p") & (F.col("el_cnt") == 1) & (F.col("ty_cnt") == 1)
    d = cards(spark, sf_dir).dom.where("depth >= 3")
    return d.groupBy("page_id").agg(F.count_if(card & (F.col("el_idx") == 1)).alias("firsts"), F.count_if(card & (F.col("el_idx") == F.col("el_cnt"))).alias("lasts"), F.count_if(alone).alias("onlies"), F.sum(F.when(card, F.col("ty_idx"))).alias("places"), F.max(F.when(card, F.col("ty_cnt"))).alias("cards"))


@_add("SELECT p_partkey AS page_id, unnest(['p', 'i']) AS tag, unnest(['m1', 'm2']) AS mid FROM part")
def text_leaves(spark, sf_dir):
    d = rich(spark, sf_dir).dom
    return scene.text_leaves(d).join(d.select("page_id", "node_id", "tag"), ["page_id", "node_id"]).select("page_id", "tag", "mid")


@_add("SELECT p_partkey AS page_id, unnest(['body', 'p', 'b', 'i', 'div']) AS tag, unnest([false, true, true, true, false]) AS text_only, unnest([1, 1, 1, 1, 2])::BIGINT AS n FROM part")
def text_leaf(spark, sf_dir):
    d = classify.drawn(rich(spark, sf_dir).dom)
    both = classify.text_only(d).join(d.select("page_id", "node_id", "tag"), ["page_id", "node_id"])
    return both.where(F.col("tag").isin("body", "p", "b", "i", "div")).groupBy("page_id", "tag", F.when(F.col("tag") == "div", False).otherwise(F.col("text_only")).alias("text_only")).agg(F.count("*").alias("n"))


@_add("SELECT p_partkey AS page_id, unnest(['FRAME', 'IMAGE', 'TEXT', 'VECTOR']) AS ir_type, unnest([3, 2, 3, 2])::BIGINT AS n FROM part")
def ir_types(spark, sf_dir):
    """Kinds of design nodes before drawings are taken apart: a body, a box and what it holds; bare text, a paragraph and an i; images; drawings."""
    return rich(spark, sf_dir).kinds.groupBy("page_id", "ir_type").agg(F.count("*").alias("n"))


@_add(
    f"""WITH pages AS (SELECT page_id, sum(n)::BIGINT AS n, list(look) AS looks, map(list(look), list(n)) AS by_look FROM {LOOKS} GROUP BY page_id)
    SELECT * FROM (SELECT page_id, unnest([':root', '.grid', '.card0', '.card1', '.card2', '.grid p', '.grid > .card1 p', 'p', '.card2 p']) AS selector, unnest([1, 1, 1, 1, 1, 1, 2, 0, 1])::INT AS classes, unnest([0, 0, 0, 0, 0, 1, 1, 1, 1])::INT AS types,
    unnest([1, 1, by_look[0], by_look[1], by_look[2], n, by_look[1], n, by_look[2]])::BIGINT AS matched FROM pages) WHERE matched IS NOT NULL"""
)
def css_match(spark, sf_dir):
    d = cards(spark, sf_dir)
    hit = d.matches.join(d.rules.select("page_id", "rule_order", "selector"), ["page_id", "rule_order"])
    return hit.groupBy("page_id", "selector", F.col("specificity.cls").alias("classes"), F.col("specificity.type").alias("types")).agg(F.count("*").alias("matched"))


@_add(f"SELECT page_id, sum(n)::BIGINT AS below, coalesce(sum(n) FILTER (look = 1), 0)::BIGINT AS child FROM {LOOKS} GROUP BY page_id")
def css_descendant(spark, sf_dir):
    d = cards(spark, sf_dir)
    hit = cascade.matches(d.dom, d.rules.where("size(parts) > 1")).join(d.rules.select("page_id", "rule_order", "selector"), ["page_id", "rule_order"])  # the relational form
    return hit.groupBy("page_id").agg(F.count_if(F.col("selector") == ".grid p").alias("below"), F.count_if(F.col("selector").contains(">")).alias("child"))


@_add(f"SELECT page_id, '.grid > .card1 p' AS selector, n AS matched FROM {LOOKS} WHERE look = 1")
def css_child(spark, sf_dir):
    d = cards(spark, sf_dir)
    return d.matches.join(d.rules.where("array_contains(combs, '>')").select("page_id", "rule_order", "selector"), ["page_id", "rule_order"]).groupBy("page_id", "selector").agg(F.count("*").alias("matched"))


@_add("SELECT l_orderkey AS page_id, l_suppkey % 3 AS prop, max_by(l_partkey, {'a': l_returnflag = 'R', 'b': l_linenumber % 2, 'c': l_linenumber * 10000000 + l_partkey}) AS value FROM lineitem GROUP BY ALL")
def css_winner(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.lit(0).alias("node_id"), (F.col("l_suppkey") % 3).alias("prop"), F.col("l_partkey").alias("value"), (F.col("l_returnflag") == "R").alias("important"), F.struct((F.col("l_linenumber") % 2).alias("inline")).alias("specificity"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("rule_order"), F.lit(0).alias("decl_idx"))
    return cascade.winners(rows).select("page_id", "prop", "value")


@_add("SELECT l_orderkey AS page_id, l_linenumber AS node_id, last_value(CASE WHEN l_quantity > 25 THEN l_partkey::VARCHAR END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS color, CASE WHEN l_quantity > 25 THEN l_suppkey::VARCHAR END AS width FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)")
def css_inherit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("node_id")).agg(*(F.max(c).alias(c) for c in ("l_quantity", "l_partkey", "l_suppkey")))
    chain = lines.withColumn("path", F.collect_list("node_id").over(Window.partitionBy("page_id").orderBy("node_id"))).withColumn("kind", F.lit("element"))
    declared = lines.where("l_quantity > 25")
    won = declared.select("page_id", "node_id", F.lit("color").alias("prop"), F.col("l_partkey").cast("string").alias("value")).unionByName(declared.select("page_id", "node_id", F.lit("width").alias("prop"), F.col("l_suppkey").cast("string").alias("value")))
    return cascade.computed(ship(chain), won).select("page_id", "node_id", F.col("style")["color"].alias("color"), F.col("style")["width"].alias("width"))


@_add(f"SELECT page_id, CASE look WHEN 1 THEN '#0000ff' ELSE '#333333' END AS color, CASE look WHEN 0 THEN NULL WHEN 1 THEN '14px' ELSE '24px' END AS size, sum(n)::BIGINT AS n FROM {LOOKS} GROUP BY ALL")
def css_vars(spark, sf_dir):
    d = cards(spark, sf_dir)
    p = d.dom.where("tag = 'p'").select("page_id", "node_id").join(d.styles, ["page_id", "node_id"])
    return p.groupBy("page_id", F.col("style")["color"].alias("color"), F.col("style")["font-size"].alias("size")).agg(F.count("*").alias("n"))


@_add(f"SELECT page_id, n FROM {LOOKS} WHERE look = 2")
def shorthands(spark, sf_dir):
    s = F.col("style")
    return cards(spark, sf_dir).styles.where((s["border-left-width"] == "1px") & (s["border-top-style"] == "solid") & (s["border-right-color"] == "#112233") & s["border"].isNull()).groupBy("page_id").agg(F.count("*").alias("n"))


@_add(f"SELECT page_id, 'card' || look AS component_id, 'Card' || look AS name, n AS occurrences FROM {LOOKS} WHERE n >= 3")
def component_groups(spark, sf_dir):
    return cards(spark, sf_dir).detected["components"].select("page_id", "component_id", "name", "occurrences")


@_add("SELECT page_id, sum(n)::BIGINT AS n, count(DISTINCT look) AS kinds FROM (SELECT regexp_replace(p_brand, '\\D', '', 'g')::BIGINT AS page_id, p_size % 3 AS look, count(*) AS n FROM part GROUP BY ALL) WHERE n >= 3 GROUP BY page_id")
def instances(spark, sf_dir):
    """On whole pages: a brand's cards are all on one, however many there are."""
    whole = _document(spark, sf_dir, "whole-cards", "part", lambda: convert(by_page(card_pages(spark, sf_dir, whole=True), "whole-cards"), Options(layout=False)))
    return whole.detected["instances"].groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("component_id").alias("kinds"))


FIRSTS = f"(SELECT l.*, p_name AS first_name, row_number() OVER (PARTITION BY l.page_id ORDER BY n DESC, look) AS place FROM {LOOKS} l JOIN part ON p_partkey = first_key WHERE n >= 3)"
PLACED = f"(SELECT {BRAND} AS page_id, p_size % 3 AS look, p_partkey, p_name FROM part)"
#: Instances in document order: cards of the looks that are components.
SHOWN = f"(SELECT p.*, f.first_name, 'instance-' || row_number() OVER (PARTITION BY p.page_id ORDER BY p_partkey) AS instance_id FROM {PLACED} p JOIN {FIRSTS} f USING (page_id, look))"


@_add(f"SELECT page_id, instance_id, 'card' || look AS component_id, 'card' || look || '.text-0' AS master_id, p_name AS characters FROM {SHOWN} WHERE p_name <> first_name")
def overrides(spark, sf_dir):
    return cards(spark, sf_dir).detected["overrides"].select("page_id", "instance_id", "component_id", "master_id", "characters")


@_add(f"SELECT page_id, instance_id, 'card' || look AS component_id, 'Card' || look AS name FROM {SHOWN}")
def instance_ids(spark, sf_dir):
    return cards(spark, sf_dir).detected["instances"].select("page_id", "instance_id", "component_id", "name")


@_add(f"SELECT page_id, place::INT AS rank, 'card' || look AS component_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, look) AS place, count(*) OVER (PARTITION BY page_id, n) AS ties FROM {LOOKS} WHERE n >= 3) WHERE ties = 1")
def component_ids(spark, sf_dir):
    """Components in the order of how often they occur; those that occur equally often (ordered by their shape's text) are left to the tests."""
    found = cards(spark, sf_dir).detected["components"]
    ties = F.count("*").over(Window.partitionBy("page_id", "occurrences"))
    return found.withColumn("ties", ties).where("ties = 1").select("page_id", "rank", "component_id")


@_add("SELECT p_partkey AS page_id, unnest(['Box', 'Component2', 'Box']) AS name, unnest(['box', 'component2', 'box-2']) AS component_id FROM part")
def component_names(spark, sf_dir):
    """A class that two components share, and a kind of element that says nothing."""
    three = lambda text: F.repeat(F.lit(text), 3)
    html = F.concat(F.lit("<body>"), F.repeat(F.lit('<div class="box"><hr></div>'), 5), F.repeat(F.lit("<section><hr><hr></section>"), 4), three('<div class="box"><hr><hr><hr></div>'), F.lit("</body>"))
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    return convert(by_page(pages, "names"), Options(layout=False)).detected["components"].select("page_id", "name", "component_id")


@_add(f"SELECT page_id, 'card' || look AS component_id, unnest(['card' || look, 'card' || look || '.text-0']) AS master_id FROM {LOOKS} WHERE n >= 3")
def master_ids(spark, sf_dir):
    d = cards(spark, sf_dir)
    return components.masters(nodes.ir_parents(d.ir), d.detected["components"]).select("page_id", "component_id", "master_id")


@_add(f"SELECT look AS key, count(*) AS hashes, sum(n)::BIGINT AS frames FROM (SELECT look, sum(n) AS n FROM {LOOKS} GROUP BY look) GROUP BY look")
def subtree_hash(spark, sf_dir):
    """Cards of one look have one hash on all pages, whatever their texts say."""
    d = cards(spark, sf_dir)
    return d.frames.where("name <> 'Grid' and tag <> 'body'").groupBy(F.substring("name", 5, 1).cast("bigint").alias("key")).agg(F.count_distinct("hash").alias("hashes"), F.count("*").alias("frames"))


USED = f"(SELECT page_id, look, CASE WHEN n >= 3 THEN 1 ELSE n END AS n FROM {LOOKS})"


@_add(f"SELECT page_id, hex, sum(background)::BIGINT AS background, sum(text)::BIGINT AS text, sum(stroke)::BIGINT AS stroke FROM (SELECT page_id, unnest([{{'hex': ['ff0000', '00ff00', '808080'][look + 1], 'background': n, 'text': 0, 'stroke': 0}}, {{'hex': ['333333', '0000ff', '333333'][look + 1], 'background': 0, 'text': n, 'stroke': 0}}, {{'hex': CASE WHEN look = 2 THEN '112233' END, 'background': 0, 'text': 0, 'stroke': n}}], recursive := true) FROM {USED}) WHERE hex IS NOT NULL GROUP BY ALL")
def paint_usage(spark, sf_dir):
    return cards(spark, sf_dir).tokens["paints"].select("page_id", "hex", "background", "text", "stroke")


@_add(f"SELECT page_id, ['ff0000', '00ff00', '808080', '333333', '0000ff', '112233'][k] AS hex, ['brand', 'brand', 'surface', 'ink', 'brand', 'border'][k] AS bucket FROM (SELECT page_id, list_distinct(flatten(list([[1, 4], [2, 5], [3, 4, 6]][look + 1]))) AS ks FROM {LOOKS} GROUP BY page_id) t, unnest(ks) u(k)")
def paint_buckets(spark, sf_dir):
    return cards(spark, sf_dir).tokens["paints"].select("page_id", "hex", "bucket")


@_add(
    f"""WITH used AS (SELECT page_id, hex, sum(n)::BIGINT AS total FROM (SELECT page_id, n, unnest([['ff0000', '333333'], ['00ff00', '0000ff'], ['808080', '333333', '112233']][look + 1]) AS hex FROM {USED}) GROUP BY ALL),
    kinds AS (SELECT *, CASE hex WHEN '808080' THEN 'surface' WHEN '333333' THEN 'ink' WHEN '112233' THEN 'border' ELSE 'brand' END AS bucket FROM used),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, bucket ORDER BY total DESC, hex) AS k FROM kinds)
    SELECT page_id, hex, total, bucket || '/' || CASE bucket WHEN 'border' THEN 'default' WHEN 'brand' THEN ['primary', 'accent', 'secondary'][k] ELSE 'primary' END AS style_id FROM ranked"""
)
def paint_names(spark, sf_dir):
    return cards(spark, sf_dir).tokens["paints"].select("page_id", "hex", "total", "style_id")


@_add(f"SELECT page_id, sum(n)::BIGINT AS n, count(*) AS styles FROM {USED} GROUP BY page_id")
def text_usage(spark, sf_dir):
    return cards(spark, sf_dir).tokens["texts"].groupBy("page_id").agg(F.sum("n").alias("n"), F.count("*").alias("styles"))


@_add(f"SELECT page_id, ['body/lg', 'body/md', 'heading/lg'][look + 1] AS style_id FROM {LOOKS}")
def text_names(spark, sf_dir):
    return cards(spark, sf_dir).tokens["texts"].select("page_id", "style_id")


@_add(f"SELECT page_id, look::INT AS look, 1::BIGINT AS n, ['body/lg', 'body/md', 'heading/lg'][look + 1] AS text_style_id, ['333333', '0000ff', '333333'][look + 1] AS text_fill, ['ff0000', '00ff00', '808080'][look + 1] AS card_fill, CASE WHEN look = 2 THEN 'border/default' END AS stroke_style_id FROM {LOOKS} WHERE n >= 3")
def apply_styles(spark, sf_dir):
    """The style ids stamped on each component's master and on its text; what a fill's id stands for."""
    d = cards(spark, sf_dir)
    tree = d.tokens["tree"].where("component_id is not null").join(d.tokens["paints"].select("page_id", F.col("style_id").alias("fill_style_id"), "hex"), ["page_id", "fill_style_id"], "left")
    on = lambda kind, c: F.max(F.when(F.col("ir_type") == kind, F.col(c)))
    return tree.groupBy("page_id", F.substring("component_id", 5, 1).cast("int").alias("look")).agg(F.count_if(F.col("ir_type") == "TEXT").alias("n"), on("TEXT", "text_style_id").alias("text_style_id"), on("TEXT", "hex").alias("text_fill"), on("FRAME", "hex").alias("card_fill"), on("FRAME", "stroke_style_id").alias("stroke_style_id"))


@_add("SELECT l_orderkey AS page_id, l_linenumber AS node_id, 'fill' AS role, 'p' || l_partkey % 4 AS style_id FROM lineitem WHERE l_partkey % 4 = 0 UNION ALL SELECT l_orderkey, l_linenumber, 'text', 't9' FROM lineitem WHERE l_suppkey % 2 = 0")
def apply_paint_styles(spark, sf_dir):
    """References to styles that don't exist, by node and role."""
    line = table(spark, sf_dir, "lineitem")
    tree = line.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("node_id"), F.concat(F.lit("p"), F.col("l_partkey") % 4).alias("fill_style_id"), F.lit(None).cast("string").alias("stroke_style_id"), F.when(F.col("l_suppkey") % 2 == 0, "t9").alias("text_style_id"), F.lit(None).cast("string").alias("effect_style_id"))
    styles = line.select(F.col("l_orderkey").alias("page_id")).distinct().select("page_id", F.explode(F.array(*map(F.lit, ("p1", "p2", "p3")))).alias("style_id"))
    return scene.dangling_styles(tree, styles)


@_add(f"SELECT page_id, 'Inter' AS family, CASE WHEN bool_or(look = 2) THEN 'Bold, Regular' ELSE 'Regular' END AS styles FROM {LOOKS} GROUP BY page_id")
def font_shopping(spark, sf_dir):
    return tokens.font_families(cards(spark, sf_dir).fonts)


@_add(f"SELECT page_id, (2 * sum(n) + 1)::BIGINT AS nodes, count(*) FILTER (n >= 3) AS components, coalesce(sum(n) FILTER (n >= 3), 0)::BIGINT AS instances, 0::BIGINT AS effect_styles FROM {LOOKS} GROUP BY page_id")
def doc_stats(spark, sf_dir):
    return cards(spark, sf_dir).stats.select("page_id", "nodes", "components", "instances", "effect_styles")


STYLED = f"(SELECT page_id, 2 * sum(n) + 1 AS nodes, count(*) FILTER (n >= 3) AS comps, coalesce(sum(n) FILTER (n >= 3), 0) AS insts, len(list_distinct(flatten(list([['ff0000', '333333'], ['00ff00', '0000ff'], ['808080', '333333', '112233']][look + 1])))) AS paints, count(*) AS texts FROM {LOOKS} GROUP BY page_id)"


@_add(f"SELECT page_id, concat_ws(', ', nodes || ' nodes', CASE WHEN comps > 0 THEN comps || ' components \u00d7 ' || insts || ' instances' END, paints || ' paint \u00d7 ' || texts || ' text \u00d7 0 effect styles') AS line, 'warnings:      0' || chr(10) || 'ir nodes:      ' || nodes || chr(10) || 'components:    ' || comps || chr(10) || 'instances:     ' || insts || chr(10) || 'paint styles:  ' || paints || chr(10) || 'text styles:   ' || texts || chr(10) || 'effect styles: 0' AS verbose FROM {STYLED}")
def summary_line(spark, sf_dir):
    return cards(spark, sf_dir).summary()


@_add(f"SELECT page_id, 1::INT AS version, 'Page' AS root_name, sum(n)::INT AS cards, count(*) FILTER (n >= 3)::INT AS components, coalesce(sum(n) FILTER (n >= 3), 0)::BIGINT AS instances, (SELECT paints::INT FROM {STYLED} s WHERE s.page_id = l.page_id) AS paints, count(*)::INT AS texts, 0::BIGINT AS faults FROM {LOOKS} l GROUP BY page_id")
def ir_export(spark, sf_dir):
    """Whole documents: what is nested where, and that a check finds no fault in them."""
    made = cards(spark, sf_dir).export()
    at = lambda path: F.get_json_object("json", path)
    long = lambda path: F.coalesce(F.json_array_length(at(path)), F.lit(0))
    bad = document.issues(made).groupBy("page_id").agg(F.count("*").alias("faults"))
    inner = at("$.root.children[0].children")
    shown = made.select("page_id", at("$.version").cast("int").alias("version"), at("$.root.name").alias("root_name"), F.json_array_length(inner).alias("cards"), long("$.components").alias("components"), F.regexp_count(inner, F.lit('"type":"INSTANCE"')).cast("long").alias("instances"), long("$.styles.paints").alias("paints"), long("$.styles.texts").alias("texts"))
    return shown.join(bad, "page_id", "left").na.fill(0, ["faults"])


@_add(f"SELECT page_id, unnest(list_concat(['root', 'div-' || 2 * count(*) + 1], flatten(list(['text-' || (2 * k - 1), 'div-' || 2 * k])))) AS ir_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) AS k FROM {PLACED}) GROUP BY page_id")
def ir_ids(spark, sf_dir):
    return nodes.ir_ids(cards(spark, sf_dir).ir).select("page_id", "ir_id")


FAULTS = "[CASE WHEN p_size % 2 = 0 THEN 'version' END, CASE WHEN p_size % 3 = 0 THEN 'root.id' END, CASE WHEN p_size > 25 THEN 'root.opacity' END, CASE WHEN p_size <= 10 THEN 'root.children.0.textStyle.fontSize' END, CASE WHEN p_size % 5 = 0 THEN 'root.children.1.type' END, 'fonts.0.family', CASE WHEN p_size % 7 = 0 THEN 'images' END]"


@_add(f"SELECT page_id, k::INT AS nth, found[k] AS path FROM (SELECT p_partkey AS page_id, list_filter({FAULTS}, lambda x: x IS NOT NULL) AS found FROM part), unnest(range(1, 6)) r(k) WHERE k <= len(found)")
def validate_ir(spark, sf_dir):
    """The first five faults of documents that have up to seven, some of them nested."""
    size = F.col("p_size")
    text = F.concat(F.lit('{"type":"TEXT","id":"t","characters":"x","textStyle":{"fontFamily":"Inter","fontSize":'), (size - 10).cast("string"), F.lit("}}"))
    other = F.concat(F.lit('{"type":"'), F.when(size % 5 == 0, "CIRCLE").otherwise("FRAME"), F.lit('","id":"f"}'))
    root = F.concat(F.lit('{"type":"FRAME","id":"'), F.when(size % 3 == 0, "").otherwise("root"), F.lit('","opacity":'), (size / 25).cast("string"), F.lit(',"children":['), text, F.lit(","), other, F.lit("]}"))
    doc = F.concat(F.lit('{"images":'), F.when(size % 7 == 0, "{}").otherwise("[]"), F.lit(',"version":'), F.when(size % 2 == 0, "2").otherwise("1"), F.lit(',"name":"x","root":'), root, F.lit(',"fonts":[{"family":""}]}'))
    return document.issues(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), doc.alias("json"))).select("page_id", "nth", "path")


@_add("SELECT l_orderkey AS page_id, l_linenumber AS instance FROM lineitem WHERE l_partkey % 3 = 0")
def dangling_refs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("instance"), F.concat(F.lit("c"), F.col("l_partkey") % 3).alias("component_id"))
    known = lines.select("page_id").distinct().select("page_id", F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("component_id"))
    return scene.dangling(lines, known).select("page_id", "instance")


@_add("SELECT l_orderkey AS page_id, l_linenumber AS ir_id, CASE WHEN l_linenumber = 1 THEN 'by id' WHEN l_linenumber = 2 THEN 'by name' ELSE 'own' END AS characters FROM lineitem")
def apply_overrides(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.lit("i").alias("instance_id"), F.col("l_linenumber").cast("string").alias("ir_id"), F.concat(F.lit("n"), "l_linenumber").alias("name"), F.lit("own").alias("characters"))
    keys = lines.select("page_id", "instance_id").distinct().select("page_id", "instance_id", F.explode(F.create_map(F.lit("1"), F.lit("by id"), F.lit("n2"), F.lit("by name"))).alias("key", "characters"))
    return scene.applied_overrides(lines, keys).select("page_id", F.col("ir_id").cast("int").alias("ir_id"), "characters")


@_add(
    """SELECT p_partkey AS page_id, 's0' AS sid, floor(least(10.5, -p_size))::DOUBLE AS x, 10.0::DOUBLE AS y, ceil(greatest(110.5, CASE WHEN p_size % 2 = 1 THEN 60 + p_size ELSE 0 END) - least(10.5, -p_size))::DOUBLE AS width,
    ceil(CASE WHEN p_size % 2 = 1 THEN 80.5 ELSE 60.5 END - 10.25)::DOUBLE AS height, (floor(least(10.5, -p_size)) - 10.5)::DOUBLE AS offset_x, (10.0 - 20.5)::DOUBLE AS offset_y FROM part
    UNION ALL SELECT p_partkey, 's1', 50.0, 50.0, ceil(10.0 + p_size), ceil(80.5 - 50.25), -0.5, -0.25 FROM part WHERE p_size % 2 = 1"""
)
def union_rect(spark, sf_dir):
    """What the pictures of two marked elements, one in the other, have to show: all below them that has an area, wherever it lies."""
    part = table(spark, sf_dir, "part")
    html = F.lit('<body><div data-c2f="snapshot"><p></p><div data-c2f="snapshot"><i></i></div></div><b></b></body>')
    dom = by_page(html_source.dom_nodes(part.select(F.col("p_partkey").alias("page_id"), html.alias("html"))).where("kind = 'element'").select("page_id", "node_id", "last_id", "kind", "tag", "attrs"), "marked")
    size, odd = F.col("p_size").cast("double"), F.col("p_size") % 2
    rect = lambda tag, nth, x, y, w, h: F.struct(F.lit(tag).alias("tag"), F.lit(nth).alias("nth"), *(c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "width"), (h, "height"))))
    n = F.lit
    seen = F.array(rect("div", 1, n(10.5), n(20.5), n(100), n(40)), rect("p", 1, -size, n(10.25), n(20), n(5)), rect("div", 2, n(50.5), n(50.25), n(0), n(0)), rect("i", 1, n(60), n(70.5), size, odd * 10), rect("b", 1, n(-999), n(-999), n(5000), n(5000)))
    seen = part.select(F.col("p_partkey").alias("page_id"), F.inline(seen))
    nth = F.row_number().over(Window.partitionBy("page_id", "tag").orderBy("node_id"))
    rects = dom.select("page_id", "node_id", "tag", nth.alias("nth")).join(seen.hint("merge"), ["page_id", "tag", "nth"]).drop("tag", "nth")
    return scene.subtree_rects(dom, by_page(rects, "rects")).drop("node_id")


@_add("SELECT p_partkey AS page_id, unnest([false, true]) AS strict, unnest([p_size % 3 = 0, true]) AS matched FROM part")
def css_strict(spark, sf_dir):
    """a > b q below two b's, of which only the outer one may stand in an a: taking the nearest misses it, CSS does not."""
    inner = F.when(F.col("p_size") % 3 == 0, "<b><q>x</q></b>").otherwise("<b><u><b><q>x</q></b></u></b>")
    html = F.concat(F.lit("<style>a > b q{color:#000007}</style><body><a>"), inner, F.lit("</a></body>"))
    pages = by_page(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html")), "strict")
    out = None
    for strict in (False, True):
        doc = convert(pages, Options(layout=False, strict=strict))
        one = doc.dom.where("tag = 'q'").select("page_id", "node_id").join(doc.styles, ["page_id", "node_id"]).select("page_id", F.lit(strict).alias("strict"), F.coalesce(F.col("style")["color"] == "#000007", F.lit(False)).alias("matched"))
        out = one if out is None else out.unionByName(one)
    return out


@_add(
    f"""WITH looks AS (SELECT page_id, list(look) AS ls, count(*) AS n_looks, sum(n) AS n_cards, coalesce(sum(n) FILTER (n >= 3), 0) AS n_instances, count(*) FILTER (n >= 3) AS n_components, bool_or(look = 2) AS bold FROM {LOOKS} GROUP BY page_id),
    sizes AS (SELECT page_id, [CASE WHEN bold THEN 2 ELSE 1 END, len(list_distinct(flatten(list_transform(ls, lambda x: [[1, 4], [2, 5], [3, 4, 6]][x + 1])))), n_looks, 2 * n_components, 2 + n_instances + 2 * (n_cards - n_instances)] AS s FROM looks),
    steps AS (SELECT page_id, unnest(range(1, 6)) AS k, s FROM sizes)
    SELECT page_id, ['font', 'paint', 'text', 'component', 'root'][k] AS kind, (coalesce(list_sum(s[1:k - 1]), 0) + 1)::INT AS first, list_sum(s[1:k])::INT AS last FROM steps WHERE s[k] > 0"""
)
def build_order(spark, sf_dir):
    """The steps in which a host builds each page: fonts, styles, components, and the page's own nodes last."""
    return cards(spark, sf_dir).build_order().groupBy("page_id", "kind").agg(F.min("step").alias("first"), F.max("step").alias("last"))


@_add(f"SELECT page_id, 1::INT AS version, 'FRAME' AS root, sum(n)::INT AS cards, count(*) FILTER (n >= 3)::INT AS components, coalesce(sum(n) FILTER (n >= 3), 0)::INT AS instances, 1 + max((look = 2)::INT)::INT AS fonts, min(look) = 0 AS red FROM {LOOKS} GROUP BY page_id")
def typed_documents(spark, sf_dir):
    """Documents read back as Spark structs."""
    d = schemas.typed_documents(cards(spark, sf_dir).export(), 3).select("page_id", "document.*")
    grid = F.get("root.children", 0)["children"]
    paints = F.flatten(F.transform("styles.paints", lambda p: F.transform(p["paints"], lambda x: css.color_hex(x["color"]))))
    return d.select("page_id", "version", F.col("root.type").alias("root"), F.size(grid).alias("cards"), F.size("components").alias("components"), F.size(F.filter(grid, lambda x: x["type"] == "INSTANCE")).alias("instances"), F.size("fonts").alias("fonts"), F.array_contains(paints, "ff0000").alias("red"))


@_add(f"SELECT page_id, 'Inter' AS family, 'Bold' AS style FROM {LOOKS} WHERE look = 2")
def font_preload(spark, sf_dir):
    """Fonts that have to be there before texts are set and aren't: only Inter Regular is installed."""
    d = cards(spark, sf_dir)
    wanted = scene.font_preload(d.fonts, d.tokens["tree"], d.tokens["texts"])
    return scene.missing_fonts(wanted, spark.createDataFrame([("Inter", "Regular")], "family string, style string")).select("page_id", "family", "style")


@_add(f"SELECT page_id, ['Inter/Regular', 'Inter/Bold'][k] AS font, [-1, min(3 * nth + 4) FILTER (look = 2)][k]::INT AS first_at FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) AS nth FROM {PLACED}), unnest([1, 2]) u(k) GROUP BY page_id, k HAVING k = 1 OR bool_or(look = 2)")
def fonts(spark, sf_dir):
    """Each font once, with the node that asks for it first; html, head, style, its text, body and grid come before the cards."""
    return cards(spark, sf_dir).fonts.select("page_id", F.concat_ws("/", "family", "style").alias("font"), "first_at")


@_add("SELECT p_partkey AS page_id, unnest(['FRAME', 'IMAGE', 'SVG', 'TEXT', 'VECTOR']) AS drawn_as, unnest([3, 2, 1, 3, 3])::BIGINT AS n, unnest([0, 2, 0, 0, 0])::BIGINT AS grey, unnest([0, 0, 0, 3, 0])::BIGINT AS run_spans FROM part")
def scene_nodes(spark, sf_dir):
    """What a host builds: a drawing of several shapes is imported whole, images without bytes are grey, runs stay within their text."""
    built = scene.scene(rich(spark, sf_dir).tokens["tree"])
    return built.groupBy("page_id", "drawn_as").agg(F.count("*").alias("n"), F.count("stand_in").alias("grey"), F.sum(F.coalesce(F.size("runs"), F.lit(0))).cast("long").alias("run_spans"))


@_add("SELECT DISTINCT l_orderkey AS page_id, concat_ws('-', l_linenumber, l_partkey) AS component_id, 'root must be a FRAME, got TEXT' AS message FROM lineitem WHERE l_partkey % 3 = 0")
def component_roots(spark, sf_dir):
    """Components whose root isn't a frame."""
    line = table(spark, sf_dir, "lineitem")
    tree = line.select(F.col("l_orderkey").alias("page_id"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("component_id"), F.explode(F.array(F.struct(F.lit(1).alias("node_id"), F.when(F.col("l_partkey") % 3 == 0, "TEXT").otherwise("FRAME").alias("ir_type")), F.struct(F.lit(2).alias("node_id"), F.lit("TEXT").alias("ir_type")))).alias("x"))
    return scene.component_faults(tree.select("page_id", "component_id", "x.*"))


@_add("SELECT p_partkey AS page_id, 'row' AS what, 10.0::DOUBLE AS x, p_size::DOUBLE AS width FROM part UNION ALL SELECT p_partkey, 'last', (10 + p_size + 5)::DOUBLE, 30.0 FROM part")
def layout_boxes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    html = F.concat(F.lit('<body><div style="display:flex;gap:5px;padding-left:10px"><div style="height:4px;width:'), "p_size", F.lit('px"></div><div style="width:30px;height:2px"></div></div></body>'))
    nodes_ = page.page_nodes(ship(part.select(F.col("p_partkey").alias("page_id"), html.alias("html"))))
    # html, head, body, the row, and its two boxes
    return nodes_.where("depth = 3 and box is not null").select("page_id", F.when(F.col("child_idx") == 0, "row").otherwise("last").alias("what"), "box.x", "box.width")


@_add(
    """SELECT p_partkey AS page_id, unnest(['share', 'ratio', 'pinned', 'moved', 'middle', 'right', 'w0', 'w2', 'img', 'capped', 'filled', 'inner']) AS what,
    floor(unnest([0, 0, 400 - p_size - 5, 7, 200 - p_size / 2.0, 400 - p_size, 0, 0, 0, (400 - 200 - p_size) / 2.0, 10, 10 + p_size]) + 0.5)::DOUBLE AS x,
    unnest([200, 2 * p_size, p_size, 400, p_size, p_size, 180, 180, p_size, 200 + p_size, p_size, 400 - 20 - p_size])::DOUBLE AS width FROM part"""
)
def layout_rules(spark, sf_dir):
    """Shares, ratios, absolute and relative places, alignment, wrapping, replaced elements, block centring and growth in one page of 400 pixels."""
    s = F.col("p_size").cast("string")
    box = lambda name, *style: F.concat(F.lit(f'<div id="{name}" style="height:5px;'), *(x if not isinstance(x, str) else F.lit(x) for x in style), F.lit('"></div>'))
    html = F.concat(
        F.lit('<body><div style="width:400px">'), box("share", "width:50%"), F.concat(F.lit('<div id="ratio" style="aspect-ratio:2;height:'), s, F.lit('px"></div>')),
        F.lit('<div style="position:relative;height:9px">'), box("pinned", "position:absolute;right:5px;width:", s, "px"), F.lit("</div>"), box("moved", "position:relative;left:7px"),
        F.lit('<div style="display:flex;justify-content:center">'), box("middle", "width:", s, "px"), F.lit('</div><div style="display:flex;justify-content:flex-end">'), box("right", "width:", s, "px"), F.lit("</div>"),
        F.lit('<div style="display:flex;flex-wrap:wrap">'), box("w0", "width:180px"), box("w1", "width:180px"), box("w2", "width:180px"), F.lit("</div>"),
        F.lit('<div style="display:flex"><img id="img" src="x" height="5" width="'), s, F.lit('"></div>'), box("capped", "margin:0 auto;max-width:", (F.col("p_size") + 200).cast("string"), "px"),
        F.lit('<div style="display:flex;padding:0 10px">'), box("filled", "width:", s, "px"), box("inner", "flex-grow:1"), F.lit("</div></div></body>"),
    )
    nodes_ = page.page_nodes(ship(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))), 400.0)
    return nodes_.where("attrs['id'] is not null and attrs['id'] <> 'w1'").select("page_id", F.col("attrs")["id"].alias("what"), F.col("box.x").alias("x"), F.col("box.width").alias("width"))


@_add("SELECT p_partkey AS page_id, CASE WHEN p_size % 2 = 0 THEN (p_size + 300) / 2.0 ELSE least(p_size + 300 - 20, 310.0) END - 14 AS width FROM part")
def content_width(spark, sf_dir):
    """The width that a box leaves its content: its own or its parent's less margins, at most max-width, less padding and borders."""
    own = F.when(F.col("p_size") % 2 == 0, "width:50%").otherwise("margin:0 10px;max-width:310px")
    html = F.concat(F.lit('<body><div style="width:'), (F.col("p_size") + 300).cast("string"), F.lit('px"><div style="padding:0 5px;border:2px solid red;'), own, F.lit('"><div id="in" style="height:1px"></div></div></div></body>'))
    nodes_ = page.page_nodes(ship(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))), 800.0)
    return nodes_.where("attrs['id'] = 'in'").select("page_id", F.col("box.width").alias("width"))


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part: bare text, a text in two weights, images, a drawing, and a shadow."""
    size = F.col("p_size").cast("string")
    html = F.concat(
        F.lit("<body>  bare  "), F.col("p_name"), F.lit(' <p>one <b style="font-weight:bold">two</b>\n three</p><img src="i'), size, F.lit('.png" alt="Pic"><img><svg fill="red" stroke="currentColor" style="color:#0000ff"><circle r="'), size,
        F.lit('"/><rect width="2" height="2" fill="none"/></svg><svg></svg><div class="box" style="box-shadow:0 1px '), (F.col("p_size") % 3 * 10 + 2).cast("string"), F.lit('px red"><div><i>x</i></div></div></body>'),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("part/"), "p_partkey").alias("url"), html.alias("html"))


def rich(spark: SparkSession, sf_dir: str) -> Document:
    return _document(spark, sf_dir, "rich", "part", lambda: convert(by_page(rich_pages(spark, sf_dir), "rich"), Options(layout=False, font_fallback="Arial")))


@_add("SELECT p_partkey AS page_id, unnest(['i' || p_size || '.png', '']) AS image_ref, unnest(['Pic', 'img']) AS name FROM part")
def images(spark, sf_dir):
    return rich(spark, sf_dir).ir.where("ir_type = 'IMAGE'").select("page_id", "image_ref", "name")


@_add("SELECT p_partkey AS page_id, unnest(['Path 1', 'Path 2', 'svg']) AS name, unnest(['ff0000', NULL, NULL]) AS fill, unnest(['0000ff', '0000ff', NULL]) AS stroke FROM part")
def svg_shapes(spark, sf_dir):
    v = rich(spark, sf_dir).ir.where("ir_type = 'VECTOR'")
    return v.select("page_id", "name", cascade.css.color_hex(F.get("fills", 0)["color"]).alias("fill"), cascade.css.color_hex(F.get("strokes", 0)["color"]).alias("stroke"))


@_add("SELECT p_partkey AS page_id, 'one two three' AS characters, unnest([0, 4, 7])::INT AS start, unnest([4, 7, 13])::INT AS stop, unnest(['Regular', 'Bold', 'Regular']) AS style FROM part")
def text_runs(spark, sf_dir):
    rows = rich(spark, sf_dir).texts.where("runs is not null").select("page_id", "characters", F.explode("runs").alias("r"))
    return rows.select("page_id", "characters", F.col("r.start").alias("start"), F.col("r.end").alias("stop"), F.col("r.text_style.font_style").alias("style"))


@_add("SELECT p_partkey AS page_id, trim('bare  ' || p_name) AS characters, left(trim('bare  ' || p_name), 32) AS name FROM part")
def bare_text(spark, sf_dir):
    return rich(spark, sf_dir).texts.where("tag is null").select("page_id", "characters", "name")


@_add("SELECT p_partkey AS page_id, 'shadow/' || ['sm', 'md', 'lg'][p_size % 3 + 1] AS style_id, 1::BIGINT AS n FROM part")
def effect_names(spark, sf_dir):
    return rich(spark, sf_dir).tokens["effects"].select("page_id", "style_id", "n")


@_add("SELECT p_partkey AS page_id, 'shadow' AS family, (p_size % 3 * 10 + 2)::DOUBLE AS radius, 1::BIGINT AS n FROM part")
def effect_usage(spark, sf_dir):
    used = tokens.effect_usage(rich(spark, sf_dir).detected["tree"])
    return used.select("page_id", F.split(tokens.effect_bucket(F.col("effects")), "/")[0].alias("family"), F.array_max(F.transform("effects", lambda e: e["radius"])).alias("radius"), "n")


@_add("SELECT p_partkey AS page_id, 2::BIGINT AS warnings, 'image without a source' AS first_warning FROM part")
def report(spark, sf_dir):
    return rich(spark, sf_dir).report().select("page_id", "warnings", F.get("messages", 0).alias("first_warning"))


@_add("SELECT DISTINCT p_partkey AS page_id, unnest(['Arial', 'Arial', 'Inter']) AS family, unnest(['Regular', 'Bold', 'Regular']) AS style FROM part")
def font_fallback(spark, sf_dir):
    return rich(spark, sf_dir).fonts.select("page_id", "family", "style")


@_add("SELECT p_partkey AS page_id, 'box' AS what, 0::BIGINT AS nested FROM part")
def outer_only(spark, sf_dir):
    """Of frames that repeat on a page, those within others that repeat are no components of their own: three boxes hold three each."""
    part = table(spark, sf_dir, "part")
    html = F.concat(F.lit("<body>"), F.repeat(F.lit('<div class="box"><div class="in"><hr></div></div>'), 3), F.lit("</body>"))
    doc = convert(by_page(part.select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html")), "nested"), Options(layout=False))
    return doc.detected["components"].groupBy("page_id").agg(F.min("component_id").alias("what"), F.count_if(F.col("component_id") != "box").alias("nested"))


@_add("SELECT p_partkey AS page_id, CASE WHEN p_size % 2 = 0 THEN '#000002' ELSE '#000001' END AS color FROM part")
def css_order(spark, sf_dir):
    """Sheets in document order: of equal selectors the later one wins, even if it stands in a sheet that is linked."""
    part = table(spark, sf_dir, "part")
    html = F.concat(F.lit("<head><style>p{color:#000001}</style>"), F.when(F.col("p_size") % 2 == 0, '<link rel="stylesheet" href="late.css">').otherwise('<link rel="stylesheet" href="../late.css">'), F.lit("</head><p>x</p>"))
    sheets = spark.createDataFrame([("late.css", "p{color:#000002}"), ("../late.css", "p{color:#000003}")], "path string, css string")
    doc = convert(by_page(part.select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html")), "sheets"), Options(layout=False, stylesheets=sheets))
    return doc.dom.where("tag = 'p'").select("page_id", "node_id").join(doc.styles, ["page_id", "node_id"]).select("page_id", F.col("style")["color"].alias("color"))


@_add("SELECT p_partkey AS page_id, (p_size + 1)::DOUBLE AS width, 7.0::DOUBLE AS height FROM part")
def measured_text(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    html = F.lit('<body><div style="display:flex;align-items:flex-start"><p data-c2f-mid="m1">some text</p></div></body>')
    seen = part.select(F.col("p_partkey").alias("page_id"), F.lit("m1").alias("mid"), (F.col("p_size") + 0.5).alias("width"), F.lit(6.2).alias("height"))
    nodes_ = page.page_nodes(ship(part.select(F.col("p_partkey").alias("page_id"), html.alias("html"))), measured=seen)
    return nodes_.where("tag = 'p'").select("page_id", "box.width", "box.height")


@_add("SELECT p_partkey AS page_id, floor((p_size + 100 - 8) / 4.0)::DOUBLE AS width, 1::INT AS nth FROM part UNION ALL SELECT p_partkey, floor((p_size + 100 - 8) / 4.0 * 3)::DOUBLE, 2::INT FROM part")
def grid_widths(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    html = F.concat(F.lit('<body><div style="display:grid;grid-template-columns:1fr 3fr;gap:8px;width:'), (F.col("p_size") + 100).cast("string"), F.lit('px"><i style="display:flex;height:1px"></i><i style="display:flex;height:1px"></i></div></body>'))
    nodes_ = page.page_nodes(ship(part.select(F.col("p_partkey").alias("page_id"), html.alias("html"))))
    return nodes_.where("tag = 'i'").select("page_id", "box.width", F.col("el_idx").alias("nth"))


@_add("SELECT p_partkey AS page_id, 'pic' || p_size AS image_ref, (3 + p_size)::DOUBLE AS width FROM part")
def snapshots(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    html = F.lit('<body><div data-c2f="snapshot" data-c2f-sid="s1"><p>x</p></div></body>')
    shots = part.select(F.col("p_partkey").alias("page_id"), F.lit("s1").alias("sid"), F.concat(F.lit("pic"), "p_size").alias("data_uri"), (F.col("p_size") + 3).alias("width"), F.lit(4).alias("height"), F.lit(0.0).alias("offset_x"), F.lit(0.0).alias("offset_y"))
    doc = convert(by_page(part.select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html")), "shot-pages"), Options(layout=False, snapshots=by_page(shots, "shots")))
    return doc.ir.where("ir_type = 'IMAGE'").select("page_id", "image_ref", F.col("geometry.width").alias("width"))


@_add("SELECT row_number() OVER (ORDER BY r_name, n_name) - 1 AS page_id, r_name || '/' || n_name || '.html' AS file, '<p>' || n_name AS html FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_dir(spark, sf_dir):
    """A folder for each region with an HTML file for each of its nations, and another file, read in the order of their paths."""
    from tessera.sources.store import shared_dir

    folder = f"{shared_dir(spark)}/tessera/scan-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect()  # two small fixed tables
    for r in rows:
        html_source.write_text(spark, f"{folder}/{r['r_name']}/{r['n_name']}.html", f"<p>{r['n_name']}")
    html_source.write_text(spark, f"{folder}/notes.txt", "no page")
    return html_source.read_html(spark, folder).select("page_id", F.regexp_extract("url", "([^/]+/[^/]+)$", 1).alias("file"), "html")


@_add("SELECT p_partkey AS page_id, unnest(['a', 'b', 'c', 'd']) AS id, unnest(['1px', '1px', NULL, NULL]) AS width, unnest(['red', 'red', 'red', 'blue']) AS color, unnest([NULL, NULL, 'initial', NULL]) AS height FROM part")
def css_keywords(spark, sf_dir):
    """inherit and unset take what the parent has, or nothing if it has none; initial stays as it is; over an element without declarations nothing but inherited properties passes."""
    html = F.lit('<body><div id="a" style="width:1px;color:red"><div id="b" style="width:inherit;color:unset"><p><i id="c" style="width:inherit;height:initial"></i></p></div></div><div id="d" style="color:blue;height:unset"></div></body>')
    nodes_ = page.page_nodes(ship(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))), layout=False)
    return nodes_.where("attrs['id'] is not null").select("page_id", F.col("attrs")["id"].alias("id"), *(F.col("style")[c].alias(c) for c in ("width", "color", "height")))


@_add("SELECT p_partkey AS page_id, 1.0::DOUBLE AS weight, '<svg fill=\"red\" stroke=\"#0000ff\" style=\"color:#0000ff\"><circle r=\"' || p_size || '\"></circle><rect width=\"2\" height=\"2\" fill=\"none\"></rect></svg>' AS markup FROM part")
def svg_markup(spark, sf_dir):
    """A drawing's markup with its own colour for currentColor; strokes without a width are 1 wide."""
    d = rich(spark, sf_dir).ir
    weight = d.where("ir_type = 'VECTOR' and size(strokes) > 0").groupBy("page_id").agg(F.max(F.get("strokes", 0)["weight"]).alias("weight"))
    return d.where("tag = 'svg' and svg_source is not null").select("page_id", F.col("svg_source").alias("markup")).join(weight, "page_id")


@_add("SELECT p_partkey AS page_id, unnest(['Site', 'Row', 'Cell', 'bare', 'Img']) AS name, unnest([false, true, false, NULL, NULL]) AS clips, unnest([NULL, NULL, 'AUTO', NULL, 'ABSOLUTE']) AS positioning FROM part")
def frame_flags(spark, sf_dir):
    """The root goes by the document's name; what overflows is clipped; elements in a flex container have a place in it, bare text hasn't."""
    html = F.lit('<body><div class="row" style="display:flex;overflow:hidden">bare<div class="cell"><hr></div><img class="img" src="a" style="position:absolute"></div></body>')
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    ir = convert(by_page(pages, "flags"), Options(name="Site", layout=False)).ir.where("name <> 'hr'")
    return ir.select("page_id", "name", F.col("clips_content").alias("clips"), F.col("child_layout.positioning").alias("positioning"))


@_add(f"SELECT n AS occurrences, pages FROM (SELECT look, sum(n)::BIGINT AS n, count(*) AS pages FROM {LOOKS} GROUP BY look) WHERE n >= 3")
def corpus_components(spark, sf_dir):
    """Subtrees that repeat over all pages: the three looks."""
    d = cards(spark, sf_dir)
    return components.corpus_components(d.ir.where("name <> 'Grid' and coalesce(tag, '') <> 'body'")).select("occurrences", "pages")


@_add(f"SELECT page_id, count(*) AS n_elements FROM (SELECT page_id, unnest(regexp_extract_all({BARE}, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) FROM pages) GROUP BY page_id")
def stream_pages(spark, sf_dir):
    from tessera.streaming.ingest import stream_nodes

    return stream_nodes(spark, f"{sf_dir}/pages.parquet")
