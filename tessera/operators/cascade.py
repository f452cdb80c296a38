"""The CSS cascade as joins and aggregations over rows of nodes and rules.

Everything is keyed by page_id first. Matching rules to elements is an equi-join on (page_id, what the rightmost compound
asks for: id, class, tag or anything), then a check of the rest; winners are an arg-max; inheritance goes down from
parent to child where a page's rows meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import css

# The properties that pass from parent to child.
INHERITED = ["color", "font-family", "font-size", "font-style", "font-variant", "font-weight", "font", "letter-spacing", "line-height", "text-align", "text-decoration", "text-indent", "text-transform", "visibility", "word-spacing", "white-space", "direction", "cursor"]
_INHERITED = frozenset(INHERITED)
FACTS = "struct<tag:string,id:string,classes:array<string>,pseudos:array<string>>"


def facts() -> Column:
    """What selectors ask of an element."""
    classes = F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda c: c != "")
    held = {"first-child": F.col("el_idx") == 1, "last-child": (F.col("el_idx") > 0) & (F.col("el_idx") == F.col("el_cnt")), "first-of-type": F.col("ty_idx") == 1, "last-of-type": (F.col("ty_idx") > 0) & (F.col("ty_idx") == F.col("ty_cnt")), "only-child": F.col("el_cnt") == 1, "only-of-type": F.col("ty_cnt") == 1, "empty": F.col("is_empty")}
    pseudos = F.filter(F.array(*(F.when(c, n) for n, c in held.items())), lambda p: p.isNotNull())
    return F.struct(F.col("tag"), F.col("attrs")["id"].alias("id"), classes.alias("classes"), pseudos.alias("pseudos"))


def fits(part: Column, element: Column) -> Column:
    """Whether an element is what a compound asks for."""
    tag = part["tag"].isNull() | (part["tag"] == "*") | (part["tag"] == element["tag"])
    ident = (F.coalesce(part["id"], F.lit("")) == "") | F.coalesce(part["id"] == element["id"], F.lit(False))
    return tag & ident & (F.size(F.array_except(part["classes"], element["classes"])) == 0) & (F.size(F.array_except(part["pseudos"], element["pseudos"])) == 0)


def chain_fits(parts: Column, combs: Column, chain: Column) -> Column:
    """Whether the compounds left of the last fit ancestors (root first): a parent, or the nearest one that fits, without second tries."""

    def step(state: Column, at: Column) -> Column:
        part, cursor = F.get(parts, at), state["cursor"]
        child = F.get(combs, at) == ">"
        parent = F.coalesce((cursor >= 0) & fits(part, F.get(chain, cursor)), F.lit(False))
        found = F.array_max(F.transform(F.slice(chain, F.lit(1), F.greatest(F.lit(0), cursor + 1)), lambda e, i: F.when(fits(part, e), i)))
        ok = state["ok"] & F.when(child, parent).otherwise(found.isNotNull())
        return F.struct(ok.alias("ok"), F.when(child, cursor - 1).otherwise(F.coalesce(found, F.lit(0)) - 1).cast("int").alias("cursor"))

    steps = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 2, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(F.lit(True).alias("ok"), (F.size(chain) - 1).cast("int").alias("cursor")), step)["ok"]


def chain_fits_strictly(parts: Column, combs: Column, chain: Column) -> Column:
    """The same as CSS has it: along the ancestors go the compounds that end at the last one (here) and at any so far (above), so that no second try is needed."""
    before = F.slice(parts, F.lit(1), F.size(parts) - 1)
    nothing = F.transform(before, lambda _: F.lit(False))

    def step(state: Column, element: Column) -> Column:
        ready = lambda j: (j == 0) | F.coalesce(F.when(F.get(combs, j - 1) == ">", F.get(state["here"], j - 1)).otherwise(F.get(state["above"], j - 1)), F.lit(False))
        now = F.transform(before, lambda part, j: ready(j) & fits(part, element))
        return F.struct(now.alias("here"), F.zip_with(state["above"], now, lambda a, b: a | b).alias("above"))

    last = F.size(before) - 1
    end = F.aggregate(chain, F.struct(nothing.alias("here"), nothing.alias("above")), step, lambda s: F.when(F.get(combs, last) == ">", F.get(s["here"], last)).otherwise(F.get(s["above"], last)))
    return F.when(last >= 0, F.coalesce(end, F.lit(False))).otherwise(True)


def ancestors(elements: DataFrame) -> DataFrame:
    """page_id, node_id, chain: the facts of an element's ancestors, root first."""
    up = elements.select("page_id", "node_id", F.explode("path").alias("up"))
    own = elements.select("page_id", F.col("node_id").alias("up"), facts().alias("f"))
    chains = up.join(own, ["page_id", "up"]).where("up <> node_id").groupBy("page_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("up", "f"))).alias("c"))
    return chains.select("page_id", "node_id", F.transform("c", lambda x: x["f"]).alias("chain"))


def matches(nodes: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """page_id, node_id, rule_order, specificity (the best of the rule's selectors that match), decls. strict: no nearest ancestor hides another."""
    chained = chain_fits_strictly if strict else chain_fits
    elements = nodes.where("kind = 'element'")
    last = F.element_at("parts", -1)
    asked = F.when(F.coalesce(last["id"], F.lit("")) != "", F.concat(F.lit("#"), last["id"])).when(F.size(last["classes"]) > 0, F.concat(F.lit("."), F.get(last["classes"], 0))).when(last["tag"].isNotNull() & (last["tag"] != "*"), last["tag"]).otherwise("*")
    wanted = rules.where("supported").select("page_id", "rule_order", "parts", "combs", "decls", css.specificity(F.col("selector")).alias("specificity"), asked.alias("key"))
    own = elements.select("page_id", "node_id", facts().alias("f"))
    keys = F.array_distinct(F.concat(F.array(F.lit("*"), F.col("f.tag")), F.when(F.col("f.id").isNotNull(), F.array(F.concat(F.lit("#"), F.col("f.id")))).otherwise(F.array().cast("array<string>")), F.transform("f.classes", lambda c: F.concat(F.lit("."), c))))
    met = own.select("page_id", "node_id", "f", F.explode(keys).alias("key")).join(wanted, ["page_id", "key"]).where(fits(last, F.col("f")))
    single = met.where(F.size("parts") == 1)
    deep = met.where(F.size("parts") > 1).join(ancestors(elements), ["page_id", "node_id"], "left").where(chained(F.col("parts"), F.col("combs"), F.coalesce("chain", F.array().cast(f"array<{FACTS}>"))))
    both = single.select("page_id", "node_id", "rule_order", "specificity", "decls").unionByName(deep.select("page_id", "node_id", "rule_order", "specificity", "decls"))
    return both.groupBy("page_id", "node_id", "rule_order").agg(F.max("specificity").alias("specificity"), F.first("decls").alias("decls"))


def candidates(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Every declaration that applies to a node: the author's, and the node's own style attribute."""
    author = matches(nodes, rules).select("page_id", "node_id", "specificity", "rule_order", F.explode("decls").alias("d"))
    author = author.select("page_id", "node_id", F.col("d.prop").alias("prop"), F.col("d.value").alias("value"), F.col("d.important").alias("important"), "specificity", "rule_order", F.col("d.decl_idx").alias("decl_idx"))
    inline = nodes.where("kind = 'element'").where(F.col("attrs")["style"].isNotNull()).select("page_id", "node_id", F.explode(css.declarations(F.col("attrs")["style"])).alias("prop", "raw"))
    first = F.struct(*(F.lit(x).cast("int").alias(n) for n, x in (("inline", 1), ("id", 0), ("cls", 0), ("type", 0))))
    split = css.without_important(F.col("raw"))
    inline = inline.select("page_id", "node_id", "prop", split["value"].alias("value"), split["important"].alias("important"), first.alias("specificity"), F.lit(2147483647).alias("rule_order"), F.lit(0).alias("decl_idx"))
    return author.unionByName(inline)


def winners(found: DataFrame) -> DataFrame:
    """page_id, node_id, prop, value: importance, then specificity, then order decide; within a rule the first."""
    rank = F.struct("important", "specificity", "rule_order", -F.col("decl_idx"))
    return found.groupBy("page_id", "node_id", "prop").agg(F.max_by("value", rank).alias("value"))


NAME = re.compile(r"\s*(--[a-zA-Z0-9_-]+)\s*")
MOST_TURNS = 16


def reference(text: str, at: int) -> tuple[str, str | None, int] | None:
    """Of the reference whose "var(" ends at this place: its name, its fallback if it has one, and where it ends."""
    name = NAME.match(text, at)
    close = text.find(")", name.end()) if name else -1
    if close < 0 or text[name.end()] not in ",)":
        return None
    return name[1], text[name.end() + 1 : close].strip() if text[name.end()] == "," else None, close + 1


def resolve(value: str, env: dict[str, str]) -> str:
    """References replaced from env, or by their fallbacks, else by nothing.

    A stack of texts that are still to be read, each with the number of replacements it came by; one that came by more
    than MOST_TURNS, as in a cycle, is left as it stands.
    """
    out, unread = [], [(value, 0)]
    while unread:
        text, turns = unread.pop()
        at = text.find("var(") if turns <= MOST_TURNS else -1
        if at < 0:
            out.append(text)
            continue
        out.append(text[:at])
        found = reference(text, at + 4)
        if found is None:
            out.append("var(")
            unread.append((text[at + 4 :], turns))
            continue
        name, fallback, end = found
        unread.append((text[end:], turns))
        unread.append((env.get(name, fallback or ""), turns + 1))
    return "".join(out)


def passed(style: dict[str, str]) -> dict[str, str]:
    return {k: v for k, v in style.items() if k in _INHERITED or k.startswith("--")}


def child_style(parent: dict[str, str], own: dict[str, str]) -> dict[str, str]:
    """A node's properties from its parent's and its own winners."""
    now = passed(parent)
    for name, value in own.items():
        if value.strip().lower() not in ("inherit", "unset"):
            now[name] = value
        elif name in parent:
            now[name] = parent[name]
    return {k: resolve(v, now) if "var(" in v else v for k, v in now.items()}


def _computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each element's style from its parent's. Rows of a page follow one another: its declarations (without a path), then its elements, none before its parent."""
    at: object = None
    own: dict[int, dict[str, str]] = {}
    styles: dict[int, dict[str, str]] = {}
    for batch in batches:
        keep, out = [], []
        for i, (page, node, path, prop, value) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "node_id", "path", "prop", "value")), strict=True)):
            if page != at:
                at, own, styles = page, {}, {}
            if path is None:
                if value is not None and page is not None:
                    own.setdefault(node, {})[prop] = value
                continue
            above: dict[str, str] = {}
            if len(path) > 1 and path[-2] in styles:
                above = styles[path[-2]]
            else:  # ancestors that are no rows themselves
                for up in path[:-1]:
                    above = styles[up] = styles[up] if up in styles else child_style(above, own.get(up, {}))
            styles[node] = child_style(above, own.get(node, {}))
            keep.append(i)
            out.append(list(styles[node].items()))
        if keep:
            ids = [batch.column(c).take(pa.array(keep)) for c in ("page_id", "node_id")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(out, pa.map_(pa.string(), pa.string()))], ["page_id", "node_id", "style"])


def _added(style: Column, entries: dict[str, Column], gone: list[str]) -> Column:
    """style with what isn't there yet, and without the shorthands."""
    fresh = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, entries)), F.array(*entries.values())), lambda k, v: v.isNotNull() & ~F.map_contains_key(style, k))
    return F.map_filter(F.map_concat(style, fresh), lambda k, _: ~k.isin(gone))


def expanded(style: Column) -> Column:
    """Shorthands as longhands, sides before the whole border; longhands that are there stay."""
    names, every = {}, css.border(style["border"])
    for side in css.SIDES:
        own = css.border(style[f"border-{side}"])
        for part in ("width", "style", "color"):
            names[f"border-{side}-{part}"] = F.coalesce(own[part], every[part])
    names["__parsed-box-shadow"] = F.to_json(css.box_shadows(style["box-shadow"]))
    names["__parsed-filter-blur"] = css.blur(style["filter"]).cast("string")
    names["__parsed-backdrop-filter-blur"] = css.blur(style["backdrop-filter"]).cast("string")
    for kind, (a, b) in {"items": ("align-items", "justify-items"), "content": ("align-content", "justify-content"), "self": ("align-self", "justify-self")}.items():
        both = css.place(style[f"place-{kind}"])
        names |= {a: both["align"], b: both["justify"]}
    gone = [*(f"border-{s}" for s in css.SIDES), "border", "box-shadow", "filter", "backdrop-filter", "place-items", "place-content", "place-self"]
    # most styles have no shorthand, and stay as they are
    return F.when(F.arrays_overlap(F.map_keys(style), F.array(*map(F.lit, gone))), _added(style, names, gone)).otherwise(style)


def computed(nodes: DataFrame, won: DataFrame) -> DataFrame:
    """page_id, node_id, style: every element's resolved properties as a map.

    One shuffle brings a page's declarations and elements together; styles then go down from parent to child.
    """
    elements = nodes.where("kind = 'element'").select("page_id", "node_id", "path", F.lit(None).cast("string").alias("prop"), F.lit(None).cast("string").alias("value"))
    declared = won.select("page_id", "node_id", F.lit(None).cast(elements.schema["path"].dataType).alias("path"), "prop", "value")
    rows = elements.unionByName(declared).repartition("page_id").sortWithinPartitions("page_id", F.coalesce(F.size("path"), F.lit(-1)))
    kept = StructType([*(f for f in rows.schema.fields if f.name in ("page_id", "node_id")), *StructType.fromDDL("style map<string,string>").fields])
    return rows.mapInArrow(_computed, kept).select("page_id", "node_id", expanded(F.col("style")).alias("style"))
