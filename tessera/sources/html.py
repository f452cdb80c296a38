"""HTML pages as rows of nodes.

A page is read by one pass of a tokenizer and a tree builder that follows the HTML standard where real pages need it:
implied html, head and body; void and raw-text elements; end tags that may be left out (p, li, dt, dd, option, table
parts); formatting elements that stay open across blocks and are opened again in the next; character references.

Every page is parsed where it is read: no shuffle. No page is left out: as in browsers, an element that would be nested
deeper than MOST_DEPTH becomes a sibling of what is there, and parse_outcomes says so.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import dealt, numbered

# Element names by their role in parsing.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
HEAD_ONLY = set("base basefont bgsound link meta title style script noscript template".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SPECIAL = CLOSES_P | set("applet area base body br button caption col colgroup dd dt embed frame frameset head html iframe img input li link marquee meta object option param script select source style tbody td template textarea tfoot th thead title tr track wbr".split())
SCOPE = {"html", "table", "td", "th", "caption", "button", "applet", "marquee", "object", "template", "svg", "foreignobject"}
#: How deep elements are nested: a fixed value of browsers.
MOST_DEPTH = 512
IMPLIED_END = {"dd", "dt", "li", "option", "optgroup", "p", "rb", "rp", "rt", "rtc"}

TOKEN = re.compile(r"<!--(.*?)(?:--!?>|\Z)|<!(?:[^>]*)>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = " \t\n\r\f"


class Node:
    __slots__ = ("attrs", "children", "flattened", "implied", "kind", "parent", "tag", "text")

    def __init__(self, kind: str, tag: str | None = None, attrs: dict | None = None, text: str | None = None, implied: bool = False):
        self.kind, self.tag, self.attrs, self.text, self.implied = kind, tag, attrs or {}, text, implied
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.flattened = False  # of a root: whether elements were nested too deep to keep their places

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child


class TreeBuilder:
    def __init__(self):
        self.root = Node("element", "html", implied=True)
        self.head = self.root.append(Node("element", "head", implied=True))
        self.body = self.root.append(Node("element", "body", implied=True))
        self.open = [self.root, self.head]
        self.formatting: list[Node | None] = []
        self.in_head = True
        self.flattened = False
        self.opened: set[str] = set()  # tags that were ever pushed: what was never open needs no search

    def push(self, node: Node) -> None:
        """Opens an element that was just put into the current one; at the greatest depth the current one closes before it."""
        if len(self.open) >= MOST_DEPTH:
            self.flattened = True
            self.open.pop().children.pop()
            self.current.append(node)
        self.open.append(node)
        self.opened.add(node.tag)

    @property
    def current(self) -> Node:
        return self.open[-1]

    def to_body(self) -> None:
        if self.in_head:
            self.in_head = False
            self.open = [self.root, self.body]

    def in_scope(self, tag: str, barriers: set[str] = SCOPE) -> bool:
        for node in reversed(self.open):
            if node.tag == tag:
                return True
            if node.tag in barriers:
                return False
        return False

    def pop_until(self, tag: str) -> None:
        while len(self.open) > 2 and self.open.pop().tag != tag:
            pass

    def close_p(self) -> None:
        if "p" in self.opened and self.in_scope("p"):
            self.pop_until("p")

    def reopen_formatting(self) -> None:
        """Formatting elements that a closed block left open start again here."""
        at = len(self.formatting)
        while at and self.formatting[at - 1] is not None and self.formatting[at - 1] not in self.open:
            at -= 1
        for i in range(at, len(self.formatting)):
            old = self.formatting[i]
            self.formatting[i] = self.current.append(Node("element", old.tag, dict(old.attrs), implied=True))
            self.push(self.formatting[i])

    def text(self, value: str) -> None:
        if self.in_head:
            if not value.strip(SPACE):
                return
            self.to_body()
            value = value.lstrip(SPACE)
        if not value:
            return
        if value.strip(SPACE):
            self.reopen_formatting()
        last = self.current.children[-1] if self.current.children else None
        if last is not None and last.kind == "text":
            last.text += value
        else:
            self.current.append(Node("text", text=value))

    def comment(self, value: str) -> None:
        self.current.append(Node("comment", text=value))

    def raw(self, tag: str, attrs: dict, value: str) -> None:
        if not (self.in_head and tag in HEAD_ONLY):
            self.to_body()
        element = self.current.append(Node("element", tag, attrs))
        if value:
            element.append(Node("text", text=html.unescape(value) if tag in ("title", "textarea") else value))

    def start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in ("html", "head", "body"):
            node = {"html": self.root, "head": self.head, "body": self.body}[tag]
            node.implied = False
            for k, v in attrs.items():
                node.attrs.setdefault(k, v)
            if tag == "body":
                self.to_body()
            return
        if self.in_head and tag in HEAD_ONLY:
            node = self.current.append(Node("element", tag, attrs))
            if tag not in VOID:
                self.push(node)
            return
        self.to_body()
        if "svg" in self.opened and any(n.tag == "svg" for n in self.open[2:]) and tag not in ("div", "p", "span", "table", "ul"):
            node = self.current.append(Node("element", tag, attrs))
            if not closed:
                self.push(node)
            return
        if tag in CLOSES_P:
            self.close_p()
        if tag in HEADINGS and self.current.tag in HEADINGS:
            self.open.pop()
        if tag in ("li", "dd", "dt"):
            stop = {"li"} if tag == "li" else {"dd", "dt"}
            for node in reversed(self.open):
                if node.tag in stop:
                    self.pop_until(node.tag)
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
        elif tag in ("option", "optgroup"):
            if self.current.tag == "option":
                self.open.pop()
        elif tag in ("tr", "td", "th", "tbody", "thead", "tfoot"):
            self.table_part(tag)
        elif tag == "a" and any(n is not None and n.tag == "a" for n in self.formatting):
            self.end("a")
        if tag not in SPECIAL or tag in ("br", "img", "button", "input", "select", "embed", "area", "wbr"):
            self.reopen_formatting()
        node = self.current.append(Node("element", tag, attrs))
        if tag in VOID or (closed and tag == "svg"):
            return
        self.push(node)
        if tag in FORMATTING:
            self.formatting.append(node)
        elif tag in ("td", "th", "caption", "button", "object"):
            self.formatting.append(None)

    def table_part(self, tag: str) -> None:
        if not self.in_scope("table", {"html"}):
            return
        groups = {"tbody", "thead", "tfoot"}
        ends = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}.get(tag, {"td", "th", "tr"} | groups)
        while self.current.tag not in ("table", "html") and (self.current.tag in ends or self.current.tag not in groups | {"tr"}):
            self.open.pop()
        if tag == "tr" and self.current.tag == "table":
            self.open.append(self.current.append(Node("element", "tbody", implied=True)))
        if tag in ("td", "th"):
            if self.current.tag == "table":
                self.open.append(self.current.append(Node("element", "tbody", implied=True)))
            if self.current.tag in groups:
                self.open.append(self.current.append(Node("element", "tr", implied=True)))

    def end(self, tag: str) -> None:
        if tag == "head":
            self.to_body()
            return
        if tag in ("html", "body") or tag in VOID and tag != "br":
            return
        if tag in ("br", "p") and not (tag == "p" and self.in_scope("p")):
            self.start(tag, {}, False)
            if tag == "p":
                self.pop_until("p")
            return
        if tag in FORMATTING:
            self.end_formatting(tag)
            return
        for node in reversed(self.open[1:]):
            if node.tag == tag or (tag in HEADINGS and node.tag in HEADINGS):
                self.pop_until(node.tag)
                if tag in ("td", "th", "caption", "button", "object"):
                    while self.formatting and self.formatting.pop() is not None:
                        pass
                return
            if node.tag in SPECIAL and tag not in SPECIAL or node.tag in ("table", "td", "th") and tag not in SCOPE | {"tr", "tbody", "thead", "tfoot"}:
                return

    def end_formatting(self, tag: str) -> None:
        node = next((n for n in reversed(self.formatting) if n is not None and n.tag == tag), None)
        if node is None:
            return
        self.formatting.remove(node)
        if node not in self.open:
            return
        at = self.open.index(node)
        block = next((n for n in self.open[at + 1 :] if n.tag in SPECIAL), None)
        if block is None:
            del self.open[at:]
            return
        # the block that was opened inside moves out, and holds a copy of the element around what it has so far
        node.children.remove(block)
        parent = node.parent
        block.parent = parent
        parent.children.insert(parent.children.index(node) + 1, block)
        copy = Node("element", node.tag, dict(node.attrs), implied=True)
        for child in block.children:
            copy.append(child)
        block.children = []
        block.append(copy)
        del self.open[at]


def parse(page: str) -> Node:
    """The html element of a page."""
    b, at = TreeBuilder(), 0
    for_end: dict[str, re.Pattern] = {}
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            b.text(html.unescape(page[at:]))
            break
        if m.start() > at:
            b.text(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[3]:
            tag = m[3].lower()
            attrs: dict[str, str] = {}
            for a in ATTRIBUTE.finditer(m[4]):
                value = next((x for x in a.groups()[1:] if x is not None), "")
                attrs.setdefault(a[1].lower(), html.unescape(value))
            if tag in RAW:
                if tag not in for_end:
                    for_end[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I)
                close = for_end[tag].search(page, at)
                b.raw(tag, attrs, page[at : close.start()])
                at = close.end()
            else:
                b.start(tag, attrs, m[4].rstrip().endswith("/"))
        elif m[2]:
            b.end(m[2].lower())
        elif m[1] is not None:
            b.comment(m[1])
    b.root.flattened = b.flattened
    return b.root


NODE_FIELDS = [
    ("node_id", pa.int32()), ("parent_id", pa.int32()), ("path", pa.list_(pa.int32())), ("depth", pa.int32()), ("child_idx", pa.int32()), ("kind", pa.string()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("el_idx", pa.int32()), ("el_cnt", pa.int32()), ("ty_idx", pa.int32()), ("ty_cnt", pa.int32()), ("is_empty", pa.bool_()), ("last_id", pa.int32()), ("implied", pa.bool_()),
]
NODE_SCHEMA = "page_id long, node_id int, parent_id int, path array<int>, depth int, child_idx int, kind string, tag string, attrs map<string,string>, text string, el_idx int, el_cnt int, ty_idx int, ty_cnt int, is_empty boolean, last_id int, implied boolean"


def rows_of(root: Node) -> list[list]:
    """A row for each node in document order; ordinals count from one among element siblings, zero for the root."""
    rows: list[list] = []
    work: list[tuple] = [(root, None, [], 0, (0, 0, 0, 0))]  # what is still to come, the next on top
    while work:
        node, parent, path, child, ordinals = work.pop()
        me = len(rows)
        own = [*path, me]
        elements = [c for c in node.children if c.kind == "element"]
        empty = node.kind == "element" and not elements and not any(c.kind == "text" and c.text.strip() for c in node.children)
        rows.append([me, parent, own, len(path), child, node.kind, node.tag, list(node.attrs.items()), node.text, *ordinals, empty, me, node.implied])
        totals = Counter(c.tag for c in elements)
        seen: Counter = Counter()
        nth, below = 0, []
        for i, c in enumerate(node.children):
            if c.kind == "element":
                nth += 1
                seen[c.tag] += 1
                below.append((c, me, own, i, (nth, len(elements), seen[c.tag], totals[c.tag])))
            else:
                below.append((c, me, own, i, (0, 0, 0, 0)))
        work += reversed(below)
    for row in reversed(rows):  # a node's last descendant is that of its last child
        if row[1] is not None:
            rows[row[1]][-2] = max(rows[row[1]][-2], row[-2])
    return rows


def count_of(root: Node) -> int:
    """How many rows rows_of makes, without making them: their paths are as long as a page is deep."""
    n, work = 0, [root]
    while work:
        n += 1
        work += work.pop().children
    return n


def node_columns(ids: list[int], rows: list[list]) -> list[pa.Array]:
    """Arrow columns page_id and NODE_FIELDS."""
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(NODE_FIELDS)
    return [pa.array(ids, pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(cols, NODE_FIELDS, strict=True))]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            ids, rows = [], []
            for key, page in zip(batch.column(0).slice(at, 64).to_pylist(), batch.column(1).slice(at, 64).to_pylist(), strict=True):
                try:
                    own = rows_of(parse(page or ""))
                except Exception:  # such a page has no rows; parse_outcomes says why
                    own = []
                ids += [key] * len(own)
                rows += own
            yield pa.RecordBatch.from_arrays(node_columns(ids, rows), ["page_id", *(n for n, _ in NODE_FIELDS)])


def dom_nodes(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """A row for each node of each page."""
    return dealt(pages.select(F.col(key).cast("long").alias("page_id"), F.col(column).alias("html"))).mapInArrow(_read, NODE_SCHEMA)


def parse_outcomes(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """page_id, ok, n_nodes, error: how the parse of each page ended; no page fails the job.

    A missing page isn't ok; one whose elements were nested too deep is, with a remark.
    """

    def outcome(page: str | None) -> tuple[bool, int, str | None]:
        if page is None:
            return False, 0, "no html"
        try:
            root = parse(page)
            return True, count_of(root), f"nested deeper than {MOST_DEPTH}" if root.flattened else None
        except Exception as e:
            return False, 0, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, n, error = zip(*map(outcome, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ok, pa.bool_()), pa.array(n, pa.int32()), pa.array(error, pa.string())], ["page_id", "ok", "n_nodes", "error"])

    return dealt(pages.select(F.col(key).cast("long").alias("page_id"), F.col(column).alias("html"))).mapInArrow(run, "page_id long, ok boolean, n_nodes int, error string")


def shortened(name: Column, width: int) -> Column:
    """name filled up to a width, or cut from the left so that it fits."""
    return F.when(F.length(name) > width, F.concat(F.lit("\u2026"), F.right(name, F.lit(width - 1)))).otherwise(F.rpad(name, width, " "))


def outcome_lines(outcomes: DataFrame, base: str = "") -> DataFrame:
    """page_id, line: how each page's conversion went. outcomes: source (without base, if it starts so), ok, message and counts."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    source = F.coalesce("source", F.lit(""))
    name = shortened(F.when(source.startswith(base), F.substring(source, len(base) + 1, 1 << 30)).otherwise(source), 40)
    made = F.rpad(F.concat(n("nodes"), F.lit(" nodes")), 12, " ")
    parts = F.rpad(F.concat(n("components"), F.lit("c \u00d7 "), n("instances"), F.lit("i")), 14, " ")
    styles = F.rpad(F.concat(n("paint_styles"), F.lit("p \u00d7 "), n("text_styles"), F.lit("t \u00d7 "), n("effect_styles"), F.lit("e")), 16, " ")
    warned = F.when(F.coalesce(F.col("warnings"), F.lit(0)) == 0, "").otherwise(F.concat(n("warnings"), F.when(F.col("warnings") == 1, " warning").otherwise(" warnings")))
    good = F.concat(F.lit("  \u2713 "), F.concat_ws("  ", name, made, parts, styles, warned))
    return outcomes.select("page_id", F.when(F.col("ok"), good).otherwise(F.concat(F.lit("  \u2717 "), name, F.lit("  ERROR: "), F.col("message"))).alias("line"))


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """n, n_ok, n_failed, exit_code, line: one row for all pages."""
    ok, failed = F.count_if("ok"), F.count_if(~F.col("ok"))
    line = F.format_string("summary: %d converted, %d failed, %d total", ok, failed, F.count("*"))
    return outcomes.agg(F.count("*").alias("n"), ok.alias("n_ok"), failed.alias("n_failed"), F.when(failed > 0, 1).otherwise(0).alias("exit_code"), line.alias("line"))


def write_text(spark, path: str, text: str) -> None:
    """A small file in any store that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


#: Files whose numbers are sent to every task; of more, numbers and contents are joined by a shuffle.
MOST_NUMBERS = 200_000


def read_html(spark, path: str) -> DataFrame:
    """page_id, url, html of an HTML file or a folder of them, searched in depth; an empty or missing folder has no pages.

    page_id counts from 0 in the order of the paths. Only that the folder is missing counts as empty; other faults are raised.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "page_id long, url string, html string")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[hH][tT][mM][lL]").load(path)
    # numbers by the order of the paths alone; contents stay where they are read, unless there are very many files
    numbers = numbered(raw.select("path"), "path", "page_id")
    if numbers.count() <= MOST_NUMBERS:
        numbers = F.broadcast(numbers)
    return raw.join(numbers, "path").select("page_id", F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))
