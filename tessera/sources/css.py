"""Stylesheets as rows of rules, selectors and declarations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
IMPORTANT = re.compile(r"\s*!\s*important\s*$", re.I)
IDENT = re.compile(r"[a-zA-Z0-9_-]*")
# The pseudo-classes that depend on the document alone, and at-rules that hold rules.
PSEUDOS = {"first-child", "last-child", "first-of-type", "last-of-type", "only-child", "only-of-type", "empty"}


def _until(css: str, at: int, stops: str) -> int:
    """Where the first of these characters stands outside quotes and parentheses."""
    depth, quote = 0, ""
    while at < len(css):
        c = css[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif not depth and c in stops:
            return at
        at += 1
    return at


def parse_declarations(body: str) -> list[tuple[str, str, bool]]:
    out, at = [], 0
    while at < len(body):
        end = _until(body, at, ";")
        name, colon, value = body[at:end].partition(":")
        name, value = name.strip(), value.strip()
        if colon and name:
            short = IMPORTANT.sub("", value)
            if short or name.startswith("--"):
                out.append((name.lower(), short.strip(), short != value))
        at = end + 1
    return out


def parse_rules(css: str) -> list[tuple[list[str], list[tuple[str, str, bool]]]]:
    """(selectors, declarations) in order. Rules within at-rules count as if they stood alone; rules without either are left out."""
    css, out = COMMENT.sub(" ", css), []

    def block(at: int, end: int) -> None:
        while at < end:
            stop = min(end, _until(css, at, "{;}"))
            head = css[at:stop].strip()
            if stop >= end or css[stop] != "{":
                at = stop + 1
                continue
            depth, close = 1, stop + 1
            while close < end and depth:
                close = _until(css, close, "{}")
                if close < end:
                    depth += 1 if css[close] == "{" else -1
                    close += 1
            inner = close - 1 if not depth else close
            if head.startswith("@"):
                if "{" in css[stop + 1 : inner]:
                    block(stop + 1, inner)
            else:
                selectors, a = [], 0
                while a <= len(head):
                    b = _until(head, a, ",")
                    if head[a:b].strip():
                        selectors.append(head[a:b].strip())
                    a = b + 1
                body = parse_declarations(css[stop + 1 : inner])
                if selectors and body:
                    out.append((selectors, body))
            at = close
        return

    block(0, len(css))
    return out


def parse_selector(selector: str) -> tuple[list[tuple], list[str], bool]:
    """(tag, id, classes, pseudos) of each compound, the combinators between them, and whether any part isn't supported."""
    parts, combs, bad, at, joined = [], [], False, 0, " "
    s = selector.strip()
    while at < len(s):
        tag, ident, classes, pseudos, seen = None, None, [], [], False
        while at < len(s) and s[at] not in " >+~":
            c, seen = s[at], True
            if c in "#.":
                m = IDENT.match(s, at + 1)
                if c == "#":
                    ident = m[0]
                else:
                    classes.append(m[0])
                at = m.end()
            elif c == ":":
                element = s[at + 1 : at + 2] == ":"
                m = IDENT.match(s, at + 1 + element)
                name, at = m[0].lower(), m.end()
                if at < len(s) and s[at] == "(":
                    depth, at, element = 1, at + 1, True
                    while at < len(s) and depth:
                        depth += {"(": 1, ")": -1}.get(s[at], 0)
                        at += 1
                if element:
                    bad = True
                elif name == "root":
                    tag = tag or "html"
                elif name in PSEUDOS:
                    pseudos.append(name)
                else:
                    bad = True
            elif c == "[":
                bad = True
                at = (s.find("]", at) + 1) or len(s)
            elif c == "*":
                tag, at = "*", at + 1
            elif re.match("[a-zA-Z_-]", c):
                m = IDENT.match(s, at)
                tag, at = m[0].lower(), m.end()
            else:
                bad, at = True, at + 1
        bad = bad or not seen
        if parts:
            combs.append(joined)
        parts.append((tag, ident, classes, pseudos))
        while at < len(s) and s[at].isspace():
            at += 1
        joined = " "
        if at < len(s) and s[at] in ">+~":
            bad = bad or s[at] != ">"
            joined = ">" if s[at] == ">" else " "
            at += 1
            while at < len(s) and s[at].isspace():
                at += 1
    return parts, combs, bad or not parts


PART = pa.struct([("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("pseudos", pa.list_(pa.string()))])
DECL = pa.struct([("decl_idx", pa.int32()), ("prop", pa.string()), ("value", pa.string()), ("important", pa.bool_())])
RULE_SCHEMA = "page_id long, rule_order int, sel_idx int, selector string, parts array<struct<tag:string,id:string,classes:array<string>,pseudos:array<string>>>, combs array<string>, supported boolean, decls array<struct<decl_idx:int,prop:string,value:string,important:boolean>>"


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(PART), pa.list_(pa.string()), pa.bool_(), pa.list_(DECL))
    names = [f.strip().split(" ")[0] for f in ("page_id", "rule_order", "sel_idx", "selector", "parts", "combs", "supported", "decls")]
    for batch in batches:
        rows = []
        for page, css in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for order, (selectors, body) in enumerate(parse_rules(css or "")):
                decls = [dict(zip(("decl_idx", "prop", "value", "important"), (i, *d), strict=True)) for i, d in enumerate(body)]
                for i, selector in enumerate(selectors):
                    parts, combs, bad = parse_selector(selector)
                    rows.append((page, order, i, selector, [dict(zip(("tag", "id", "classes", "pseudos"), p, strict=True)) for p in parts], combs, not bad, decls))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def css_rules(sheets: DataFrame, key: str = "page_id", column: str = "css") -> DataFrame:
    """A row for each rule and selector of each sheet."""
    return sheets.select(F.col(key).cast("long").alias("page_id"), F.col(column).alias("css")).mapInArrow(_rules, RULE_SCHEMA)


def href_status(href: Column) -> Column:
    """ok, refused (absolute, or leading out of the base folder) or unresolved (another host)."""
    depths = F.transform(F.filter(F.split(F.regexp_replace(href, "[?#].*$", ""), "/"), lambda p: ~p.isin("", ".")), lambda p: F.when(p == "..", -1).otherwise(1))
    lowest = F.aggregate(depths, F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")), lambda s, d: F.struct((s["now"] + d).alias("now"), F.least(s["low"], s["now"] + d).alias("low")))["low"]
    return F.when(href.rlike("(?i)^([a-z][a-z0-9+.-]*:)?//") | href.rlike("(?i)^[a-z][a-z0-9+.-]+:"), "unresolved").when(href.startswith("/") | (lowest < 0), "refused").otherwise("ok")


def _normal(parts: Column) -> Column:
    """Path segments without `.` and with `..` taken back; null if they lead above their start."""

    def step(state: Column, part: Column) -> Column:
        up = F.when(F.size(state) > 0, F.slice(state, F.lit(1), F.size(state) - 1))
        return F.when(part.isin("", "."), state).when(part == "..", up).otherwise(F.concat(state, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def resolved_href(url: Column, href: Column) -> Column:
    """The path that a page's link names: below the page's own folder, without query or fragment; null unless its status is ok."""
    below = F.array_join(_normal(F.split(F.regexp_replace(href, "[?#].*$", ""), "/")), "/")
    return F.when(href_status(href) == "ok", F.concat(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[^?#]*/)?", 0), below))


def linked_sheets(nodes: DataFrame, pages: DataFrame, sheets: DataFrame) -> DataFrame:
    """page_id, node_id, href, status, css: each stylesheet link with the sheet (path, css) that it names from its page's folder.

    pages: page_id, url. A link to a sheet that isn't there is unresolved, like one to another host.
    """
    links = link_nodes(nodes).join(pages.select("page_id", "url"), "page_id")
    links = links.withColumn("path", resolved_href(F.col("url"), F.col("href")))
    found = links.join(sheets.select("path", F.coalesce("css", F.lit("")).alias("css")).dropDuplicates(["path"]), "path", "left")
    status = F.when((F.col("status") == "ok") & F.col("css").isNull(), "unresolved").otherwise(F.col("status"))
    return found.select("page_id", "node_id", "href", status.alias("status"), "css")


def stylesheets(nodes: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """page_id, css: the text of a page's sheets in document order; linked: what its links name, as linked_sheets gives it."""
    styles = nodes.where("kind = 'element' and tag = 'style'").select("page_id", F.col("node_id").alias("at"))
    text = nodes.where("kind = 'text'").select("page_id", F.col("parent_id").alias("at"), "node_id", "text")
    inline = text.join(styles, ["page_id", "at"]).groupBy("page_id", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda t: t["text"]), "").alias("css"))
    sheets = inline.where(F.trim("css") != "")
    if linked is not None:
        sheets = sheets.unionByName(linked.where("css is not null").select("page_id", F.col("node_id").alias("at"), "css"))
    return sheets.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "css"))), lambda s: s["css"]), "\n").alias("css"))


def read_css(spark, path: str) -> DataFrame:
    """path, css of the *.css files below a folder, searched in depth; none if it isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "path string, css string")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][sS]").load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("css"))


def link_nodes(nodes: DataFrame) -> DataFrame:
    """Stylesheet links with their status."""
    rel = F.array_contains(F.split(F.lower(F.coalesce(F.col("attrs")["rel"], F.lit(""))), r"\s+"), "stylesheet")
    return nodes.where((F.col("tag") == "link") & rel & F.col("attrs")["href"].isNotNull()).select("page_id", "node_id", F.col("attrs")["href"].alias("href"), href_status(F.col("attrs")["href"]).alias("status"))
