"""CSS values as typed columns. What cannot be read is null, and null is not zero."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import half_up, let, number, split_top, trimmed

COLOR = "struct<r:double,g:double,b:double,a:double>"
UNIT_VALUE = "struct<unit:string,value:double>"

# Colour names, generic font names, border styles, sides, weights' names.
NAMED_COLORS = {"black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255), "gray": (128, 128, 128), "grey": (128, 128, 128), "silver": (192, 192, 192)}
GENERIC_FONTS = ["serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui", "ui-serif", "ui-sans-serif", "ui-monospace", "ui-rounded", "math", "emoji", "fangsong", "-apple-system", "blinkmacsystemfont", "inherit", "initial", "unset", "revert", "revert-layer"]
BORDER_STYLES = ["none", "hidden", "solid", "dashed", "dotted", "double", "groove", "ridge", "inset", "outset"]
SIDES = ["top", "right", "bottom", "left"]
WEIGHTS = [(100, "Thin"), (200, "Extra Light"), (300, "Light"), (400, "Regular"), (500, "Medium"), (600, "Semi Bold"), (700, "Bold"), (800, "Extra Bold")]


def lowered(c: Column) -> Column:
    return F.lower(trimmed(c))


def declarations(style: Column) -> Column:
    """An inline style as a map; of a property set twice the later value counts."""
    pairs = F.transform(
        F.filter(F.split(style, ";"), lambda d: F.instr(d, ":") > 0),
        lambda d: F.struct(lowered(F.substring_index(d, ":", 1)).alias("key"), trimmed(F.substring(d, F.instr(d, ":") + 1, F.length(d))).alias("value")),
    )
    good = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    last = let(good, lambda g: F.filter(g, lambda p, i: F.size(F.filter(F.slice(g, i + 2, F.size(g)), lambda q: q["key"] == p["key"])) == 0))
    return F.map_from_entries(F.coalesce(last, F.array().cast("array<struct<key:string,value:string>>")))


def without_important(value: Column) -> Column:
    return F.struct(F.regexp_replace(value, r"(?is)\s*!important\s*$", "").alias("value"), value.rlike(r"(?i)!important\s*$").alias("important"))


def pixels(value: Column, root_font_size: Column | float = 16.0, viewport_width: Column | float | None = None, viewport_height: Column | float | None = None) -> Column:
    pattern = r"(?i)^(-?\d+(?:\.\d+)?)(px|rem|vw|vh)?$"
    column = lambda x: F.lit(None).cast("double") if x is None else x if isinstance(x, Column) else F.lit(float(x))

    def read(t: Column) -> Column:
        n, unit = F.regexp_extract(t, pattern, 1).try_cast("double"), F.lower(F.regexp_extract(t, pattern, 2))
        scale = F.when(unit == "rem", column(root_font_size)).when(unit == "vw", column(viewport_width) / 100).when(unit == "vh", column(viewport_height) / 100).otherwise(1.0)
        return F.when(t.rlike(pattern), n * scale)

    return let(trimmed(value), read)


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _hex(c: Column, nan_ok: bool = True) -> Column:
    digits = F.regexp_extract(c, "^[0-9a-f]+", 0)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("double")).otherwise(F.lit(float("nan")))


def color(value: Column) -> Column:
    make = lambda r, g, b, a: F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a")).cast(COLOR)

    def of_hex(digits: Column) -> Column:
        n = F.length(digits)
        pairs = F.when(n.isin(3, 4), F.transform(F.filter(F.split(digits, "(?!^)"), lambda d: d != ""), lambda d: F.repeat(d, 2))).when(n.isin(6, 8), F.regexp_extract_all(digits, F.lit("(?s).."), F.lit(0)))
        # the short form keeps what can't be read as not-a-number, the long form is refused
        build = lambda x: F.when(n.isin(3, 4) | ~F.exists(F.slice(x, 1, 3), F.isnan), make(F.get(x, 0), F.get(x, 1), F.get(x, 2), F.coalesce(F.get(x, 3), F.lit(1.0))))
        return let(F.transform(pairs, lambda p: _hex(p) / 255), build)

    def of_rgb(v: Column) -> Column:
        parts = F.filter(F.split(F.regexp_extract(v, r"^rgba?\(\s*([^)]+)\s*\)$", 1), r"[\s,/]+"), lambda p: p != "")
        share = lambda p, i: F.when(p.endswith("%"), number(F.regexp_replace(p, "%$", "")) / 100).otherwise(number(p) / F.when(i < 3, 255).otherwise(1))
        read = F.transform(F.transform(parts, share), lambda x: F.when(x.isNotNull(), _clamped(x)))
        return let(read, lambda x: F.when((F.size(x) >= 3) & ~F.exists(F.slice(x, 1, 4), lambda c: c.isNull()), make(F.get(x, 0), F.get(x, 1), F.get(x, 2), F.coalesce(F.get(x, 3), F.lit(1.0)))))

    def read(v: Column) -> Column:
        named = F.create_map(*[x for name, rgb in NAMED_COLORS.items() for x in (F.lit(name), make(*(F.lit(c / 255) for c in rgb), F.lit(1.0)))])
        return F.when(v == "transparent", make(*[F.lit(0.0)] * 4)).when(v.startswith("#"), of_hex(F.substring(v, 2, 1 << 20))).when(v.rlike(r"^rgba?\("), of_rgb(v)).otherwise(named[v])

    return let(lowered(value), read)


def color_key(c: Column) -> Column:
    """What makes two colours the same: channels to four places."""
    return F.when(c.isNotNull(), F.concat_ws("|", *(F.format_string("%.4f", half_up(c[x], 4)) for x in "rgba")))


def color_hex(c: Column) -> Column:
    byte = lambda x: F.lpad(F.lower(F.hex(half_up(c[x] * 255).cast("long"))), 2, "0")
    return F.when(c.isNotNull(), F.concat(*(byte(x) for x in "rgb")))


def alpha_hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(half_up(c["a"] * 255).cast("long"))), 2, "0")


def font_style(weight: Column, italic: Column) -> Column:
    def of(w: Column) -> Column:
        out = F.when(w.isin("", "normal"), "Regular").when(w == "bold", "Bold").when(number(w).isNull(), "Regular")
        for most, name in WEIGHTS:
            out = out.when(number(w) <= most, name)
        return out.otherwise("Black")

    return let(let(lowered(F.coalesce(weight, F.lit(""))), of), lambda base: F.when(~italic, base).when(base == "Regular", "Italic").otherwise(F.concat(base, F.lit(" Italic"))))


def font_family(value: Column) -> Column:
    cleaned = F.transform(F.split(value, ","), lambda f: F.regexp_replace(trimmed(f), "^[\"']|[\"']$", ""))
    return F.get(F.filter(cleaned, lambda f: (f != "") & ~F.lower(f).isin(GENERIC_FONTS)), 0)


def _unit(unit: str, value: Column) -> Column:
    return F.struct(F.lit(unit).alias("unit"), value.alias("value"))


def _without(v: Column, n: int) -> Column:
    return number(F.substring(v, F.lit(1), F.length(v) - n))


def _positive(unit: str, n: Column) -> Column:
    return let(n, lambda x: F.when(x > 0, _unit(unit, x)))


def line_height(value: Column) -> Column:
    auto = _unit("AUTO", F.lit(None).cast("double"))
    read = lambda v: F.when(v == "", None).when(v == "normal", auto).when(v.endswith("%"), _positive("PERCENT", _without(v, 1))).when(v.endswith("px"), _positive("PIXELS", _without(v, 2))).otherwise(_positive("PERCENT", number(v) * 100))
    return let(lowered(value), read).cast(UNIT_VALUE)


def letter_spacing(value: Column) -> Column:
    given = lambda unit, n: let(n, lambda x: F.when(x.isNotNull(), _unit(unit, x)))
    read = lambda v: F.when(v == "", None).when(v == "normal", _unit("PIXELS", F.lit(0.0))).when(v.endswith("%"), given("PERCENT", _without(v, 1))).when(v.endswith("em"), given("PERCENT", _without(v, 2) * 100)).otherwise(given("PIXELS", pixels(v)))
    return let(lowered(value), read).cast(UNIT_VALUE)


def _degrees(n: Column, unit: Column) -> Column:
    return F.when(unit.isin("", "deg"), n).when(unit == "turn", n * 360).when(unit == "rad", n * 180 / math.pi).when(unit == "grad", n * 0.9)


def rotation(transform: Column) -> Column:
    pattern = r"(?i)\brotate\(\s*([-\d.]+)(deg|turn|rad|grad)?\s*\)"
    return F.when(transform.rlike(pattern), _degrees(number(F.regexp_extract(transform, pattern, 1)), F.lower(F.regexp_extract(transform, pattern, 2))))


def aspect_ratio(value: Column) -> Column:
    def read(v: Column) -> Column:
        over = F.instr(v, "/")
        ratio = F.when(over == 0, number(v)).otherwise(let(number(F.substring(v, over + 1, F.length(v))), lambda b: F.when(b != 0, number(F.substring(v, F.lit(1), over - 1)) / b)))
        return F.when(~v.isin("", "auto"), let(ratio, lambda r: F.when(r > 0, r)))

    return let(lowered(value), read)


def _keyword(value: Column, names: dict[str, str]) -> Column:
    v, out = lowered(value), F.when(F.lit(False), F.lit(None).cast("string"))
    for word, name in names.items():
        out = out.when(v == word, name)
    return out


def text_align(value: Column) -> Column:
    return _keyword(value, {"left": "LEFT", "start": "LEFT", "center": "CENTER", "right": "RIGHT", "end": "RIGHT", "justify": "JUSTIFIED"})


def text_decoration(value: Column) -> Column:
    v = lowered(value)
    return F.when(v.contains("underline"), "UNDERLINE").when(v.contains("line-through"), "STRIKETHROUGH").when(v == "none", "NONE")


def text_transform(value: Column) -> Column:
    return _keyword(value, {"uppercase": "UPPER", "lowercase": "LOWER", "capitalize": "TITLE", "none": "ORIGINAL"})


TRACK = "struct<fr:double,px:double>"


def _track(token: Column) -> Column:
    fr, px = r"(?i)^(-?\d+(?:\.\d+)?)fr$", r"(?i)^(-?\d+(?:\.\d+)?)(px)?$"
    none = F.lit(None).cast("double")
    pair = lambda a, b: F.struct(a.alias("fr"), b.alias("px"))
    return F.when(token.rlike(fr), pair(F.regexp_extract(token, fr, 1).try_cast("double"), none)).when(token.rlike(px) & (token != "0"), pair(none, F.regexp_extract(token, px, 1).try_cast("double"))).otherwise(pair(F.lit(1.0), none))


#: A repeat() that holds no other, with what stands before and behind it.
REPEAT = r"(?is)^(|.*?[^a-z0-9_-])repeat\(\s*(\d+)\s*,((?:(?!repeat\()[^()]|\((?:(?!repeat\()[^()]|\([^()]*\))*\))+)\)(|[\s)].*)$"


#: As many times a repeat() is written out; a template that asks for more can't be read.
MOST_REPEATS = 10_000


def grid_tracks(value: Column) -> Column:
    """Tracks of a template: N fr or N px, everything else counts as 1fr. repeat() is written out from the inside, however deep."""
    t = F.when(~trimmed(value).isin("", "none"), trimmed(value))
    part = lambda s, i: F.regexp_extract(s, REPEAT, i)

    def write_out(s: Column, _: Column) -> Column:
        inner = let(trimmed(part(s, 3)), lambda x: F.when(x.isin("", "none"), "1fr").otherwise(x))
        times = let(part(s, 2).try_cast("int"), lambda n: F.when(n <= MOST_REPEATS, n))
        return F.when(s.rlike(REPEAT), F.concat(part(s, 1), F.repeat(F.concat(inner, F.lit(" ")), times), part(s, 4))).otherwise(s)

    turns = F.sequence(F.lit(0), F.coalesce(F.regexp_count(t, F.lit(r"(?i)repeat\(")), F.lit(0)))
    tracks = F.transform(split_top(F.aggregate(turns, t, write_out), " "), _track)
    return F.when(F.size(tracks) > 0, tracks)


def opacity(value: Column) -> Column:
    n = number(value)
    return F.when(n.isNull(), 1.0).otherwise(_clamped(n))


def corner_radius(value: Column, width: Column, height: Column, **context) -> Column:
    t = trimmed(value)
    share = number(F.regexp_replace(t, "%$", ""))
    return F.when(t.rlike(r"^-?\d+(?:\.\d+)?%$"), F.least(width, height) * share / 100).otherwise(pixels(t, **context))


LINEAR, RADIAL = r"(?is)^linear-gradient\s*\(\s*([\s\S]+)\s*\)\s*$", r"(?is)^radial-gradient\s*\(\s*([\s\S]+)\s*\)\s*$"
STOP = "struct<color:struct<r:double,g:double,b:double,a:double>,position:double>"


def gradient_angle(token: Column) -> Column:
    """Degrees of a gradient's first argument, null if it is none."""
    pattern = r"^(-?\d+(?:\.\d+)?)(deg|turn|rad|grad)?$"

    def named(sides: Column) -> Column:
        has = lambda *s: F.size(F.array_intersect(sides, F.array(*map(F.lit, s)))) == len(s)
        out = F.when(F.lit(False), F.lit(None).cast("double"))
        for angle, at in ((45, ("top", "right")), (135, ("bottom", "right")), (225, ("bottom", "left")), (315, ("top", "left")), (0, ("top",)), (90, ("right",)), (180, ("bottom",)), (270, ("left",))):
            out = out.when(has(*at), float(angle))
        return out

    return let(lowered(token), lambda t: F.when(t.rlike(pattern), _degrees(F.regexp_extract(t, pattern, 1).try_cast("double"), F.regexp_extract(t, pattern, 2))).when(t.startswith("to "), let(F.split(F.substring(t, 4, 1 << 20), r"\s+"), named)))


def gradient_stop(part: Column) -> Column:
    make = lambda c, p: F.struct(c.alias("color"), p.alias("position")).cast(STOP)

    def read(tokens: Column) -> Column:
        last = F.lower(F.element_at(tokens, -1))
        n = number(F.regexp_replace(last, "(%|px)$", ""))
        position = F.when(F.size(tokens) > 1, F.when(last.endswith("%"), let(n, lambda x: F.when(x.isNotNull(), _clamped(x / 100)))).when(last.endswith("px"), let(n, lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), x)))))
        # a colour with a position behind it, else all of it a colour
        with_position = let(position, lambda p: F.when(p.isNotNull(), let(color(F.array_join(F.slice(tokens, 1, F.greatest(F.lit(0), F.size(tokens) - 1)), " ")), lambda c: F.when(c.isNotNull(), make(c, p)))))
        whole = let(color(F.array_join(tokens, " ")), lambda c: F.when(c.isNotNull(), make(c, F.lit(None).cast("double"))))
        return F.when(F.size(tokens) > 0, F.coalesce(with_position, whole))

    return let(split_top(trimmed(part), " "), read)


def gradient_stops(parts: Column) -> Column:
    """Stops that can be read, with positions filled in by rank; null if fewer than two."""

    def fill(read: Column) -> Column:
        n = F.size(read)
        spread = lambda i: F.when(i == 0, 0.0).when(i == n - 1, 1.0).otherwise(i / (n - 1))
        return F.when(n >= 2, F.transform(read, lambda s, i: F.struct(s["color"].alias("color"), _clamped(F.coalesce(s["position"], spread(i))).alias("position"))))

    return let(F.filter(F.transform(parts, gradient_stop), lambda s: s.isNotNull()), fill)


def linear_matrix(angle: Column) -> Column:
    dx, dy = F.sin(F.radians(angle)), -F.cos(F.radians(angle))
    return F.array(F.array(dx, -dy, 0.5 - dx / 2), F.array(dy, dx, 0.5 - dy / 2))


def gradient(value: Column) -> Column:
    """type, angle (linear), matrix, stops of a value that is one gradient; null else."""
    make = lambda kind, a, m, s: F.struct(F.lit(kind).alias("type"), a.alias("angle"), m.alias("matrix"), s.alias("stops"))
    fixed = F.array(F.array(*map(F.lit, (0.5, 0.0, 0.5))), F.array(*map(F.lit, (0.0, 0.5, 0.5))))
    rest = lambda parts: F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts)))

    def linear(parts: Column) -> Column:
        def of(angle: Column) -> Column:
            turned = F.coalesce(angle, F.lit(180.0))
            return let(gradient_stops(F.when(angle.isNotNull(), rest(parts)).otherwise(parts)), lambda s: F.when(s.isNotNull(), make("GRADIENT_LINEAR", turned, linear_matrix(turned), s)))

        return F.when(F.size(parts) >= 2, let(gradient_angle(F.get(parts, 0)), of))

    def radial(parts: Column) -> Column:
        stops = gradient_stops(F.when(gradient_stop(F.get(parts, 0)).isNotNull(), parts).otherwise(rest(parts)))
        return F.when(F.size(parts) >= 2, let(stops, lambda s: F.when(s.isNotNull(), make("GRADIENT_RADIAL", F.lit(None).cast("double"), fixed, s))))

    inner = lambda v, p: split_top(F.regexp_extract(v, p, 1), ",")
    return let(trimmed(value), lambda v: F.when(v.rlike(LINEAR), let(inner(v, LINEAR), linear)).when(v.rlike(RADIAL), let(inner(v, RADIAL), radial)))


WIDTH = r"(?i)^(thin|medium|thick|0|-?\d+(?:\.\d+)?(px|em|rem|%)?)$"


def border(value: Column) -> Column:
    """width, style, color of a border shorthand in any order; only what is there."""

    def of(tokens: Column) -> Column:
        at = F.struct(F.array_position(F.transform(tokens, lambda t: t.rlike(WIDTH)), True).cast("int").alias("w"), F.array_position(F.transform(tokens, lambda t: F.lower(t).isin(BORDER_STYLES)), True).cast("int").alias("s"))

        def deal(p: Column) -> Column:
            rest = F.filter(tokens, lambda t, i: (i + 1 != p["w"]) & (i + 1 != p["s"]))
            return F.struct(F.when(p["w"] > 0, F.get(tokens, p["w"] - 1)).alias("width"), F.when(p["s"] > 0, F.lower(F.get(tokens, p["s"] - 1))).alias("style"), let(F.array_join(rest, " "), lambda c: F.when(c != "", c)).alias("color"))

        return let(at, deal)

    return let(split_top(trimmed(value), " "), of)


SHADOW = "struct<inset:boolean,x:double,y:double,blur:double,spread:double,color:string>"


def length(token: Column) -> Column:
    pattern = r"(?i)^\s*(-?\d+(?:\.\d+)?)(px)?\s*$"
    return F.when(token.rlike(pattern), F.regexp_extract(token, pattern, 1).try_cast("double"))


def box_shadows(value: Column) -> Column:
    """The shadows of a list that have two lengths at least, in order."""

    def one(part: Column) -> Column:
        return let(split_top(trimmed(part), " "), lambda tokens: let(F.filter(tokens, lambda t: F.lower(t) != "inset"), lambda rest: measured(rest, F.size(rest) < F.size(tokens))))

    def measured(rest: Column, inset: Column) -> Column:
        lengths = F.transform(rest, length)
        # lengths are read up to the first token that is none; the rest is the colour
        lead = F.coalesce(F.array_position(F.transform(lengths, lambda x: x.isNull()), True).cast("int"), F.lit(0))
        return let(F.struct(lengths.alias("x"), F.when(lead == 0, F.size(rest)).otherwise(lead - 1).alias("n")), lambda m: made(rest, inset, m))

    def made(rest: Column, inset: Column, m: Column) -> Column:
        nth = lambda i: F.coalesce(F.when(m["n"] > i, F.get(m["x"], i)), F.lit(0.0))
        tail = trimmed(F.array_join(F.slice(rest, m["n"] + 1, F.greatest(F.lit(0), F.size(rest) - m["n"])), " "))
        return F.when(m["n"] >= 2, F.struct(inset.alias("inset"), nth(0).alias("x"), nth(1).alias("y"), nth(2).alias("blur"), nth(3).alias("spread"), let(tail, lambda t: F.when(t == "", "rgba(0,0,0,1)").otherwise(t)).alias("color")))

    return let(F.filter(F.transform(split_top(trimmed(value), ","), one), lambda s: s.isNotNull()), lambda found: F.when(F.size(found) > 0, found))


def blur(value: Column) -> Column:
    pattern = r"(?i)\bblur\(\s*([^)]+)\s*\)"
    return F.when(value.rlike(pattern), length(F.regexp_extract(value, pattern, 1)))


def place(value: Column) -> Column:
    """align, justify of a place-* shorthand."""
    return let(split_top(trimmed(value), " "), lambda p: F.when(F.size(p) > 0, F.struct(F.get(p, 0).alias("align"), F.coalesce(F.get(p, 1), F.get(p, 0)).alias("justify"))))


def specificity(selector: Column) -> Column:
    """inline, id, cls, type; compares as a whole."""
    s = F.regexp_replace(selector, r"\s*[>+~]\s*", " ")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    attributes = count(s, r"\[[^\]]*\]?")
    s = F.regexp_replace(s, r"\[[^\]]*\]?", " ")
    elements = count(s, r"::[a-zA-Z0-9_-]*")
    s = F.regexp_replace(s, r"::[a-zA-Z0-9_-]*", " ")
    ids, classes = count(s, r"#[a-zA-Z0-9_-]*"), count(s, r"[.:][a-zA-Z0-9_-]*")
    s = F.regexp_replace(s, r"[#.:][a-zA-Z0-9_-]*", " ")
    return F.struct(F.lit(0).alias("inline"), ids.cast("int").alias("id"), (attributes + classes).cast("int").alias("cls"), (elements + count(s, r"[a-zA-Z_-][a-zA-Z0-9_-]*")).cast("int").alias("type"))


def viewport(value: Column) -> Column:
    pattern = r"(?i)^(\d+)x(\d+)$"
    return F.when(trimmed(value).rlike(pattern), F.struct(*(F.regexp_extract(trimmed(value), pattern, i).try_cast("int").alias(n) for i, n in ((1, "width"), (2, "height")))))


def data_uri(value: Column) -> Column:
    """The bytes of a base64 data URI; characters outside the alphabet don't matter."""
    pattern = r"(?is)^data:[^,]*;base64,([\s\S]*)$"
    return F.when(value.rlike(pattern), F.try_to_binary(F.regexp_replace(F.regexp_extract(value, pattern, 1), "[^A-Za-z0-9+/=]", ""), F.lit("base64")))


def single_line(height: Column, font_size: Column) -> Column:
    return (height > 0) & (height <= 1.7 * font_size)


def edges(value: Column, context: dict | None = None) -> Column:
    """top, right, bottom, left of one to four lengths; what can't be read is left out before they are dealt."""
    read = F.filter(F.transform(split_top(trimmed(value), " "), lambda t: pixels(t, **(context or {}))), lambda x: x.isNotNull())
    pick = lambda n, *at: F.coalesce(*(F.get(n, i) for i in at))
    return let(read, lambda n: F.when(F.size(n) > 0, F.struct(pick(n, 0).alias("top"), pick(n, 1, 0).alias("right"), pick(n, 2, 0).alias("bottom"), pick(n, 3, 1, 0).alias("left"))))


def has_key(style: Column, *names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | style[n].isNotNull()
    return out


def first_value(style: Column, *names: str) -> Column:
    return F.coalesce(*(style[n] for n in names))


def box_styling(style: Column) -> Column:
    drawn = has_key(style, "background", "background-color", "border-radius", "border", *(f"border-{s}" for s in SIDES), "border-width", *(f"border-{s}-width" for s in SIDES))
    padded = F.lit(False)
    for n in ("padding", *(f"padding-{s}" for s in SIDES)):
        padded = padded | F.coalesce((style[n] != "") & ~trimmed(style[n]).isin("0", "0px"), F.lit(False))
    return drawn | padded


def stroke(style: Column, **context) -> Column:
    """color, weight of the first side that is drawn."""
    # a side without a width or a colour is not drawn, and not read
    read = lambda s: F.struct(pixels(style[f"border-{s}-width"], **context).alias("w"), lowered(style[f"border-{s}-style"]).alias("k"), color(style[f"border-{s}-color"]).alias("c"))
    sides = F.array(*(F.when(style[f"border-{s}-width"].isNotNull() & style[f"border-{s}-color"].isNotNull(), read(s)) for s in SIDES))
    drawn = F.filter(sides, lambda s: (s["w"] > 0) & ~F.coalesce(s["k"].isin("none", "hidden"), F.lit(False)) & s["c"].isNotNull())
    return let(F.get(drawn, 0), lambda s: F.when(s.isNotNull(), F.struct(s["c"].alias("color"), s["w"].alias("weight"))))


EFFECT = "struct<type:string,color:struct<r:double,g:double,b:double,a:double>,x:double,y:double,radius:double,spread:double>"


def effects(style: Column) -> Column:
    """Shadows in order, then blurs. The shorthands are read as they are, or as expanded by the cascade."""
    none = F.lit(None)
    shadows = F.from_json(style["__parsed-box-shadow"], f"array<{SHADOW}>")
    shadows = F.coalesce(shadows, box_shadows(style["box-shadow"]), F.array().cast(f"array<{SHADOW}>"))
    drawn = F.filter(F.transform(shadows, lambda s: F.struct(F.when(s["inset"], "INNER_SHADOW").otherwise("DROP_SHADOW").alias("type"), color(s["color"]).alias("color"), s["x"].alias("x"), s["y"].alias("y"), s["blur"].alias("radius"), s["spread"].alias("spread"))), lambda e: e["color"].isNotNull())
    out = drawn.cast(f"array<{EFFECT}>")
    for kind, stashed, raw in (("LAYER_BLUR", "__parsed-filter-blur", "filter"), ("BACKGROUND_BLUR", "__parsed-backdrop-filter-blur", "backdrop-filter")):
        r = F.coalesce(number(style[stashed]), blur(style[raw]))
        one = F.struct(F.lit(kind).alias("type"), none.cast(COLOR).alias("color"), none.cast("double").alias("x"), none.cast("double").alias("y"), r.alias("radius"), none.cast("double").alias("spread"))
        out = F.concat(out, F.when(r > 0, F.array(one)).otherwise(F.array()).cast(f"array<{EFFECT}>"))
    return out


TEXT_STYLE = "struct<font_family:string,font_style:string,font_size:double,line_height:struct<unit:string,value:double>,letter_spacing:struct<unit:string,value:double>,align:string,decoration:string,transform:string>"


def text_style(style: Column, **context) -> Column:
    italic = F.lower(F.coalesce(style["font-style"], F.lit(""))).contains("italic")
    size = pixels(style["font-size"], **context)
    return F.struct(
        F.coalesce(font_family(style["font-family"]), F.lit("Inter")).alias("font_family"),
        font_style(style["font-weight"], italic).alias("font_style"),
        F.coalesce(size, F.lit(16.0)).alias("font_size"),
        F.coalesce(line_height(style["line-height"]), _unit("AUTO", F.lit(None).cast("double")).cast(UNIT_VALUE)).alias("line_height"),
        F.coalesce(letter_spacing(style["letter-spacing"]), _unit("PIXELS", F.lit(0.0)).cast(UNIT_VALUE)).alias("letter_spacing"),
        F.coalesce(text_align(style["text-align"]), F.lit("LEFT")).alias("align"),
        F.coalesce(text_decoration(style["text-decoration"]), F.lit("NONE")).alias("decoration"),
        F.coalesce(text_transform(style["text-transform"]), F.lit("ORIGINAL")).alias("transform"),
    ).cast(TEXT_STYLE)


def text_fill(style: Column) -> Column:
    black = F.struct(*(F.lit(x).alias(n) for n, x in zip("rgba", (0.0, 0.0, 0.0, 1.0), strict=True)))
    return F.coalesce(color(style["color"]), black)


def background(style: Column) -> Column:
    """The colour of a background that isn't a gradient."""
    return F.when(gradient(style["background"]).isNull(), color(first_value(style, "background-color", "background")))
