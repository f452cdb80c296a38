"""What kind of design node an element is, and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import css
from tessera.functions.text import collapsed, title_case, trimmed

# Tags that hold text, that are never drawn, that name a layer.
TEXT_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "span", "a", "label", "li", "strong", "em", "b", "i", "small", "button", "caption", "figcaption", "blockquote", "pre", "code"]
IGNORED = ["script", "style", "meta", "link", "title", "head", "noscript"]
CONTAINERS = ["flex", "inline-flex", "grid", "inline-grid"]
SEMANTIC = ["header", "nav", "main", "article", "section", "aside", "footer", "figure", "figcaption", "form", "dialog"]


def text_tag(tag: str | None) -> bool:
    return tag in TEXT_TAGS


def only_text(row: dict, kids: dict[int, list[dict]]) -> bool:
    """Whether all that a node holds is text, line breaks, and text tags of which the same is true."""
    work = [row]
    while work:
        for c in kids.get(work.pop()["node_id"], []):
            if c["kind"] == "element" and text_tag(c["tag"]):
                work.append(c)
            elif c["kind"] != "text" and c["tag"] != "br":
                return False
    return True


def drawn(nodes: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Nodes outside ignored subtrees: a node goes with each ancestor of an ignored tag, itself included. rows: those of nodes that are asked for."""
    rows = nodes if rows is None else rows
    gone = nodes.where(F.col("tag").isin(IGNORED)).select("page_id", F.col("node_id").alias("a"), F.col("last_id").alias("z"))
    up = rows.select("page_id", "node_id", F.explode("path").alias("a")).join(gone.select("page_id", "a").hint("merge"), ["page_id", "a"], "left_semi").select("page_id", "node_id").distinct()
    return rows.join(up.hint("merge"), ["page_id", "node_id"], "left_anti")


def text_only(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, text_only: for every element, whether all its descendants are text, br or text tags. What a br holds doesn't count."""
    hidden = nodes.where("tag = 'br'").select("page_id", F.col("node_id").alias("a"))
    rows = nodes.select("page_id", "node_id", "kind", "tag", F.explode("path").alias("a"))
    inside_br = rows.where("a <> node_id").join(hidden.hint("merge"), ["page_id", "a"], "left_semi").select("page_id", "node_id").distinct()
    plain = (F.col("kind") == "text") | F.coalesce((F.col("tag") == "br") | F.col("tag").isin(TEXT_TAGS), F.lit(False))
    below = rows.join(inside_br.hint("merge"), ["page_id", "node_id"], "left_anti").where("a <> node_id").groupBy("page_id", F.col("a").alias("node_id")).agg(F.min(plain).alias("text_only"))
    return nodes.where("kind = 'element'").select("page_id", "node_id").join(below.hint("merge"), ["page_id", "node_id"], "left").select("page_id", "node_id", F.coalesce("text_only", F.lit(True)).alias("text_only"))


def inner_text(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, text: all text within an element, br as a blank, blanks collapsed and trimmed."""
    pieces = nodes.where("kind = 'text' or tag = 'br'").select("page_id", "node_id", F.when(F.col("tag") == "br", "\n").otherwise(F.col("text")).alias("t"), F.explode("path").alias("a"))
    texts = pieces.where("a <> node_id").groupBy("page_id", F.col("a").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "t"))), lambda p: p["t"]), "").alias("t"))
    return nodes.where("kind = 'element'").select("page_id", "node_id").join(texts.hint("merge"), ["page_id", "node_id"], "left").select("page_id", "node_id", collapsed(F.coalesce("t", F.lit(""))).alias("text"))


def bare_text(nodes: DataFrame) -> Column:
    """Of text nodes that stand in a frame: trimmed, blanks kept."""
    return trimmed(F.col("text"))


def layer_name(fallback: Column | None = None) -> Column:
    """First class, else id, else the fallback, else a tag with a meaning, else the tag."""
    first = F.get(F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda c: c != ""), 0)
    given = F.lit(None).cast("string") if fallback is None else F.when(fallback != "", fallback)
    ident = F.when(F.col("attrs")["id"] != "", F.col("attrs")["id"])
    return F.coalesce(title_case(first), title_case(ident), given, F.when(F.col("tag").isin(SEMANTIC), title_case(F.col("tag"))), F.col("tag"))
