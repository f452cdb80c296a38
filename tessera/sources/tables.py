"""Pages and style sheets as table functions, for LATERAL joins in SQL.

    SELECT p.page_id, d.tag FROM pages p, LATERAL parse_dom(p.html, 'kind, tag') d
    SELECT s.page_id, r.selector FROM sheets s, LATERAL parse_css(s.css) r

The second argument, a constant, names the columns that are wanted; others are not built, and don't travel. Without it all
come. A null or empty page has the nodes of an empty one (html, head, body); a null or empty sheet has no rules; a column
that isn't there is an error of the query. An `error` column, if asked for, tells what went wrong with a page or sheet:
that row has nothing else; if it isn't asked for, the page or sheet has no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.sources.css import parse_rules, parse_selector
from tessera.sources.html import NODE_FIELDS, parse, rows_of
from tessera.sources.store import ship

INT, TEXT, FLAG = IntegerType(), StringType(), BooleanType()
#: As html.NODE_SCHEMA and css.RULE_SCHEMA have them; schemas in words need a session, which a table function has not.
_KINDS = {"path": ArrayType(INT), "kind": TEXT, "tag": TEXT, "attrs": MapType(TEXT, TEXT), "text": TEXT, "is_empty": FLAG, "implied": FLAG}
_PART = StructType().add("tag", TEXT).add("id", TEXT).add("classes", ArrayType(TEXT)).add("pseudos", ArrayType(TEXT))
_DECL = StructType().add("decl_idx", INT).add("prop", TEXT).add("value", TEXT).add("important", FLAG)
NODES, RULES = StructType(), StructType()
for _name in (*(n for n, _ in NODE_FIELDS), "error"):
    NODES.add(_name, TEXT if _name == "error" else _KINDS.get(_name, INT))
for _name, _kind in (("rule_order", INT), ("sel_idx", INT), ("selector", TEXT), ("parts", ArrayType(_PART)), ("combs", ArrayType(TEXT)), ("supported", FLAG), ("decls", ArrayType(_DECL)), ("error", TEXT)):
    RULES.add(_name, _kind)


def _wanted(every: StructType, columns: AnalyzeArgument | None) -> StructType:
    if columns is None:
        return every
    if not columns.isConstantExpression or not isinstance(columns.value, str):
        raise ValueError("columns have to be named by a constant text")
    names = [c.strip().lower() for c in columns.value.split(",") if c.strip()]
    known = {f.name: f for f in every.fields}
    if unknown := [c for c in names if c not in known]:
        raise ValueError(f"no such column: {', '.join(unknown)}; there are {', '.join(known)}")
    return StructType([known[c] for c in names])


class _Asked:
    """What both functions share: rows are cut to the places of the columns asked for."""

    every: StructType

    def __init__(self, asked: AnalyzeResult):
        names = self.every.names
        self.places = [names.index(c) for c in asked.schema.names]

    def told(self, e: Exception):
        at = self.every.names.index("error")
        if at in self.places:
            yield tuple(f"{type(e).__name__}: {e}" if p == at else None for p in self.places)


class ParseDom(_Asked):
    every = NODES

    @staticmethod
    def analyze(html: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        return AnalyzeResult(_wanted(NODES, columns))

    def eval(self, html: str, columns: str | None = None):
        try:
            rows = rows_of(parse(html or ""))
        except Exception as e:  # one page's fault is told, not thrown
            yield from self.told(e)
            return
        at = NODES.names.index("attrs")
        for row in rows:
            yield tuple(None if p >= len(row) else dict(row[p]) if p == at else row[p] for p in self.places)


class ParseCss(_Asked):
    every = RULES

    @staticmethod
    def analyze(css: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        return AnalyzeResult(_wanted(RULES, columns))

    def eval(self, css: str, columns: str | None = None):
        try:
            rules = parse_rules(css or "")
        except Exception as e:
            yield from self.told(e)
            return
        names = [RULES.names[p] for p in self.places]
        wants_parts = any(c in ("parts", "combs", "supported") for c in names)
        for order, (selectors, body) in enumerate(rules):
            decls = [(i, *d) for i, d in enumerate(body)] if "decls" in names else None
            for i, selector in enumerate(selectors):
                parts, combs, bad = parse_selector(selector) if wants_parts else ([], [], False)
                row = {"rule_order": order, "sel_idx": i, "selector": selector, "parts": parts, "combs": combs, "supported": not bad, "decls": decls}
                yield tuple(row.get(c) for c in names)


def install_tables(spark: SparkSession) -> list[str]:
    """Registers parse_dom and parse_css for this session, and names them."""
    ship(spark)
    for name, handler in (("parse_dom", ParseDom), ("parse_css", ParseCss)):
        spark.udtf.register(name, udtf(handler, useArrow=True))
    return ["parse_dom", "parse_css"]
