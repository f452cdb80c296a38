"""Pages to design documents, stage by stage.

What a page decides alone (parse, cascade, kinds, geometry, design nodes) is one stage without a shuffle; only detection
and what follows it are keyed by page_id. What several stages use (a page's nodes, design nodes, the tree after detection)
is written to the shared folder once, in columns, so that a later stage reads just those it needs and nothing is computed
twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import components, document, nodes, page, scene, svg, tokens
from tessera.sources import css as css_source
from tessera.sources import html as html_source
from tessera.sources.store import by_page, ship


@dataclass
class Options:
    name: str = "Page"
    component_threshold: int = 3
    viewport_width: float = 1440.0
    viewport_height: float = 900.0
    font_fallback: str | None = None
    layout: bool = True
    #: selectors meet ancestors as CSS has it; else a compound takes the nearest ancestor that fits, without second tries.
    strict: bool = False
    #: (path, css): what the pages' stylesheet links name; a link's path is that from its page's folder, the url up to its last slash.
    stylesheets: DataFrame | None = None
    #: (page_id, mid, width, height): texts that a browser has measured.
    measurements: DataFrame | None = None
    #: (page_id, sid, data_uri, width, height, offset_x, offset_y): pictures that a browser has taken.
    snapshots: DataFrame | None = None


class Parts(Mapping):
    """Tables by name, each computed when it is asked for."""

    def __init__(self, make: dict[str, Callable[[], DataFrame]]):
        self._make, self._made = make, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._make)

    def __len__(self) -> int:
        return len(self._make)


@dataclass
class Document:
    """Every stage's result, each computed when it is asked for."""

    pages: DataFrame
    options: Options = field(default_factory=Options)

    @cached_property
    def linked(self) -> DataFrame | None:
        """The pages' stylesheet links and the sheets that they name."""
        sheets = self.options.stylesheets
        return None if sheets is None else by_page(css_source.linked_sheets(html_source.dom_nodes(self.pages), self.pages, sheets), "linked")

    @cached_property
    def _decided(self) -> DataFrame:
        """All that a page decides alone, in one stage, good pages and bad ones: see operators.page."""
        o, pages, column = self.options, self.pages, None
        if self.linked is not None:
            named = self.linked.where("css is not null").groupBy("page_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("href", "css")))).alias("__linked"))
            pages, column = pages.join(named.hint("merge"), "page_id", "left"), "__linked"
        return by_page(page.page_nodes(pages, o.viewport_width, o.viewport_height, o.layout, column, o.snapshots, o.measurements, o.strict), "page-nodes")

    @property
    def nodes(self) -> DataFrame:
        return self._decided.where("error is null").drop("stage", "error")

    def _hash(self, threshold: int | None) -> DataFrame:
        o = self.options
        if o.snapshots is not None:  # what is drawn changes once more
            return by_page(components.hashed(self.placed, None, threshold), "hashes")
        looks = self.looks if o.font_fallback is None else nodes.substitute_font(self.looks, o.font_fallback)
        return by_page(components.hashed(looks, self.nodes.where("drawn_as <> node_id"), threshold), "hashes")

    @cached_property
    def _hashed(self) -> DataFrame:
        """Hashes with the shapes of what repeats."""
        return self._hash(None)

    @cached_property
    def _ranked(self) -> DataFrame:
        """Hashes, and of the components' occurrences rank and name; no shapes, which take far more room."""
        return self._hash(self.options.component_threshold)

    @property
    def _hashes(self) -> DataFrame:
        return self._hashed if "_hashed" in self.__dict__ else self._ranked

    @property
    def frames(self) -> DataFrame:
        """page_id, node_id, hash, name, tag of every frame. Of design nodes that are drawn alike one is made for that."""
        found = self._hashes.where("error is null").select("page_id", "node_id", "hash", *(c for c in self._hashes.columns if c == "drawn_as"))
        if "drawn_as" not in found.columns:
            return found.join(self.ir.select("page_id", "node_id", "name", "tag").hint("merge"), ["page_id", "node_id"])
        return found.join(self.looks.select("page_id", F.col("node_id").alias("drawn_as"), "name", "tag").hint("merge"), ["page_id", "drawn_as"]).drop("drawn_as")

    @cached_property
    def _nested(self) -> DataFrame:
        return by_page(document.nested(self._parts(), self.options.name), "documents")

    @cached_property
    def failures(self) -> DataFrame:
        """page_id, stage, message: pages that could not be converted, each with the first stage that failed. No page ends the job."""
        early = self._decided.where("error is not null").select("page_id", "stage", F.col("error").alias("message"))
        late = [df.where("error is not null").select("page_id", F.lit(stage).alias("stage"), F.col("error").alias("message")) for df, stage in ((self._hashes, "components"), (self._nested, "export"))]
        return early.unionByName(late[0]).unionByName(late[1])

    @cached_property
    def _lost(self) -> DataFrame | None:
        """Pages that fail behind the page's own stage, if there are any."""
        lost = self._hashes.where("error is not null").select("page_id").distinct()
        return None if lost.isEmpty() else lost

    def _whole(self, df: DataFrame) -> DataFrame:
        """df without pages that failed later than its rows tell."""
        return df if self._lost is None else df.join(self._lost.hint("merge"), "page_id", "left_anti")

    @cached_property
    def dom(self) -> DataFrame:
        if "_decided" in self.__dict__:
            return self.nodes.select("page_id", *(n for n, _ in html_source.NODE_FIELDS))
        return by_page(html_source.dom_nodes(self.pages), "dom")

    @cached_property
    def rules(self) -> DataFrame:
        return by_page(css_source.css_rules(css_source.stylesheets(self.dom, self.linked)), "rules")

    @property
    def matches(self) -> DataFrame:
        return self.nodes.select("page_id", "node_id", F.inline("matched"))

    @property
    def winners(self) -> DataFrame:
        return self.nodes.select("page_id", "node_id", F.explode("won").alias("prop", "value"))

    @property
    def styles(self) -> DataFrame:
        return self.nodes.where("kind = 'element'").select("page_id", "node_id", "style")

    @property
    def kinds(self) -> DataFrame:
        return self.nodes.where("ir_type is not null").select("page_id", "node_id", "ir_type")

    @property
    def boxes(self) -> DataFrame | None:
        return self.nodes.where("box is not null").select("page_id", "node_id", "box.*") if self.options.layout else None

    def _designed(self, rows: DataFrame) -> DataFrame:
        """Design nodes of these rows, drawings not taken apart."""
        o = self.options
        return self._titled(nodes.ir_nodes(rows, o.viewport_width, o.viewport_height, o.layout))

    def _titled(self, ir: DataFrame) -> DataFrame:
        o = self.options
        # a body without class or id goes by the document's name
        title = "Page" if o.name.endswith((".html", ".json")) else o.name
        return ir.withColumn("name", F.when((F.col("tag") == "body") & (F.col("name") == "body"), title).otherwise(F.col("name")))

    @property
    def texts(self) -> DataFrame:
        """The TEXTs among the design nodes: if the others aren't there yet, they are not made, nor are drawings read."""
        if "ir" in self.__dict__:
            return self.ir.where("ir_type = 'TEXT'")
        texts, family = self._designed(self.nodes.where("ir_type = 'TEXT'")), self.options.font_fallback
        return texts if family is None else nodes.substitute_font(texts, family)

    @cached_property
    def looks(self) -> DataFrame:
        """Of the design nodes of a page that are drawn alike the first; drawings taken apart."""
        plain = self._designed(self.nodes.where("drawn_as = node_id"))
        inside = self.nodes.where("ir_type is null or ir_type = 'VECTOR'")  # no design node stands in a drawing
        # each is used more than once: both are read again, not made again
        shapes, sources = by_page(svg.shapes(self.nodes), "shapes"), by_page(svg.sources(inside), "markup")
        return by_page(svg.vectors(plain, shapes, sources), "looks")

    @cached_property
    def ir(self) -> DataFrame:
        o = self.options
        drawn = self.looks.unionByName(self._titled(nodes.alike(self.nodes, self.looks, o.viewport_width, o.viewport_height, o.layout)))
        shown = drawn if o.snapshots is None else self._pictured(drawn)
        return by_page(shown if o.font_fallback is None else nodes.substitute_font(shown, o.font_fallback), "nodes")

    def _pictured(self, ir: DataFrame) -> DataFrame:
        sid = self.dom.where(F.col("attrs")["data-c2f"] == "snapshot").select("page_id", "node_id", F.col("attrs")["data-c2f-sid"].alias("sid"))
        shots = sid.join(self.options.snapshots.withColumnsRenamed({"width": "w", "height": "h"}).hint("merge"), ["page_id", "sid"]).drop("sid")
        g = F.col("geometry")
        moved = F.struct((F.coalesce(g["x"], F.lit(0.0)) + F.col("offset_x")).alias("x"), (F.coalesce(g["y"], F.lit(0.0)) + F.col("offset_y")).alias("y"), F.col("w").cast("double").alias("width"), F.col("h").cast("double").alias("height"))
        both = ir.join(shots.hint("merge"), ["page_id", "node_id"], "left")
        return both.withColumn("geometry", F.when(F.col("data_uri").isNotNull(), moved).otherwise(g)).withColumn("image_ref", F.coalesce("data_uri", "image_ref")).select(ir.columns)

    @cached_property
    def placed(self) -> DataFrame:
        return self.ir if "ir_steps" in self.ir.columns else by_page(components.ir_parents(self.ir), "placed")

    @cached_property
    def _groups(self) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        """Components, and what makes their instances of them."""
        if "_hashed" in self.__dict__:
            found, instances = components.plan(self._whole(self.placed), self.options.component_threshold, self._hashed.where("error is null"))
            return found, lambda _: instances
        outer = self._ranked.where("rank is not null").select("page_id", "node_id", "hash", "rank", "name")
        return components.planned(outer), lambda found: components.instances_of(outer, found)

    @cached_property
    def detected(self) -> Parts:
        return Parts({
            "components": lambda: by_page(self._groups[0], "components"),
            "instances": lambda: by_page(self._groups[1](self.detected["components"]), "instances"),
            "overrides": lambda: components.overrides(self._whole(self.placed), self.detected["components"], self.detected["instances"]),
            "tree": lambda: by_page(components.rewritten(self._whole(self.placed), self.detected["components"], self.detected["instances"]), "tree"),
        })

    @cached_property
    def tokens(self) -> Parts:
        return Parts({
            "paints": lambda: by_page(tokens.paint_names(tokens.paint_usage(tokens.paint_uses(self.detected["tree"]))), "paints"),
            "texts": lambda: by_page(tokens.text_names(tokens.text_usage(self.detected["tree"])), "texts"),
            "effects": lambda: by_page(tokens.effect_names(tokens.effect_usage(self.detected["tree"])), "effects"),
            "tree": lambda: tokens.stamped(self.detected["tree"], self.tokens["paints"], self.tokens["texts"], self.tokens["effects"]),
        })

    @cached_property
    def fonts(self) -> DataFrame:
        return nodes.fonts(self.ir)

    @cached_property
    def warnings(self) -> DataFrame:
        return nodes.warnings(self.dom, self.linked)

    @cached_property
    def stats(self) -> DataFrame:
        """A row for each page: how many of everything."""
        count = lambda df, name: df.groupBy("page_id").agg(F.count("*").alias(name))
        out = count(self._whole(self.ir).where("tag is null or tag <> 'body'"), "nodes")
        for df, name in ((self.detected["components"], "components"), (self.detected["instances"], "instances"), (self.tokens["paints"], "paint_styles"), (self.tokens["texts"], "text_styles"), (self.tokens["effects"], "effect_styles"), (self.warnings, "warnings")):
            out = out.join(count(df, name).hint("merge"), "page_id", "left")
        return out.na.fill(0)

    def outcomes(self) -> DataFrame:
        """page_id, source, ok, stage, message, and what was made of it: a row for each page, whether it could be converted or not."""
        told = self.failures.groupBy("page_id").agg(F.min_by(F.struct("stage", "message"), "stage").alias("f"))
        out = self.pages.select("page_id", F.col("url").alias("source")).join(told.hint("merge"), "page_id", "left").join(self.stats.hint("merge"), "page_id", "left")
        counts = [F.when(F.col("f").isNull(), F.coalesce(c, F.lit(0))).alias(c) for c in ("nodes", "components", "instances", "paint_styles", "text_styles", "effect_styles", "warnings")]
        return out.select("page_id", "source", F.col("f").isNull().alias("ok"), "f.stage", "f.message", *counts)

    def report(self) -> DataFrame:
        listed = self.warnings.groupBy("page_id").agg(F.array_sort(F.collect_list("warning")).alias("messages"))
        return self.pages.select("page_id", F.col("url").alias("source")).join(self.stats.hint("merge"), "page_id", "left").join(listed.hint("merge"), "page_id", "left").withColumn("generated_at", F.current_timestamp())

    def summary(self) -> DataFrame:
        """page_id, line, verbose: what a conversion has made, in a line and in a list."""
        n = lambda c: F.col(c).cast("string")
        parts = [
            F.concat(n("nodes"), F.lit(" nodes")),
            F.when(F.col("components") > 0, F.concat(n("components"), F.lit(" components \u00d7 "), n("instances"), F.lit(" instances"))),
            F.when(F.col("paint_styles") + F.col("text_styles") + F.col("effect_styles") > 0, F.concat(n("paint_styles"), F.lit(" paint \u00d7 "), n("text_styles"), F.lit(" text \u00d7 "), n("effect_styles"), F.lit(" effect styles"))),
        ]
        labels = [("warnings", "warnings"), ("ir nodes", "nodes"), ("components", "components"), ("instances", "instances"), ("paint styles", "paint_styles"), ("text styles", "text_styles"), ("effect styles", "effect_styles")]
        listed = F.concat_ws("\n", *(F.concat(F.rpad(F.lit(f"{label}:"), 15, " "), n(c)) for label, c in labels))
        return self.stats.select("page_id", F.concat_ws(", ", *parts).alias("line"), listed.alias("verbose"))

    @cached_property
    def numbered(self) -> DataFrame:
        """The tree after detection, as it is written: id and overrides of each node, and the component it stands in."""
        tree, found = self.tokens["tree"], self.detected
        placed = self.placed
        ids = nodes.ir_ids(self.ir).select("page_id", "node_id", "ir_id")
        inside = components.masters(placed, found["components"]).select("page_id", "component_id", "node_id", "master_id")
        texts = found["overrides"].groupBy("page_id", "instance_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("master_id", F.struct("characters"))))).alias("overrides"))
        rows = tree.join(ids.hint("merge"), ["page_id", "node_id"], "left").join(texts.hint("merge"), ["page_id", "instance_id"], "left")
        rows = rows.join(inside.hint("merge"), ["page_id", "component_id", "node_id"], "left")
        return rows.withColumn("id", F.coalesce("instance_id", "master_id", "ir_id"))

    def build_order(self) -> DataFrame:
        """page_id, step, kind, key, node_id: see scene.build_order."""
        return scene.build_order(self.fonts, self.detected["components"], self.tokens)

    def export(self) -> DataFrame:
        """page_id, json: a page's document as one text, nodes nested, with its styles, components and fonts."""
        return self._nested.where("error is null").drop("error")

    def _parts(self) -> DataFrame:
        titles = self.detected["components"].select("page_id", "component_id", F.col("name").alias("title"))
        own = self.numbered.join(titles.hint("merge"), ["page_id", "component_id"], "left")
        columns = ["page_id", "part", "key", "title", "parent", "node_id", "json"]
        made = own.select("page_id", F.when(F.col("component_id").isNull(), "root").otherwise("component").alias("part"), F.coalesce("component_id", F.lit("")).alias("key"), "title", F.col("parent_ir").alias("parent"), "node_id", document.node_json().alias("json"))
        entry = lambda df, part, key, value: df.select("page_id", F.lit(part).alias("part"), key.alias("key"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("parent"), F.lit(0).alias("node_id"), F.to_json(value).alias("json"))
        title = lambda: (F.col("style_id").alias("id"), F.col("style_id").alias("name"))
        # registries come in the order of a language, not of code units
        by_name = F.lpad(F.row_number().over(Window.partitionBy("page_id").orderBy(F.collate("style_id", "UNICODE"), "style_id")).cast("string"), 12, "0")
        t = {k: df.withColumn("place", by_name) for k, df in self.tokens.items() if k != "tree"}
        style_id = F.col("place")
        solid = F.struct(F.lit("SOLID").alias("type"), F.col("color"), F.lit(1.0).alias("opacity"), F.lit(True).alias("visible"))
        for one in (
            entry(t["paints"], "paints", style_id, F.struct(*title(), F.array(solid).alias("paints"))),
            entry(t["texts"], "texts", style_id, F.struct(*title(), document._text_style(F.col("text_style")).alias("style"))),
            entry(t["effects"], "effects", style_id, F.struct(*title(), document._effects(F.col("effects")).alias("effects"))),
            entry(self.fonts, "fonts", F.lpad((F.col("first_at") + 1).cast("string"), 12, "0"), F.struct("family", "style")),
        ):
            made = made.unionByName(one.select(*columns))
        return self._whole(made)


def convert(pages: DataFrame, options: Options | None = None) -> Document:
    """pages (page_id, url, html) to their design documents."""
    ship(pages.sparkSession)
    return Document(pages, options or Options())
