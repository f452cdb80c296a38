"""Repeated subtrees as components: hashing, grouping, planning, instances and overrides.

A subtree's hash is built from below: of a node's own print and its children's hashes, one pass over a page's nodes in
reverse document order. What repeats, and what of it stands in nothing else that repeats, is told in the same pass: only
that goes on. Shapes are spelled out to order what is equally frequent. The rest is equi-joins within a page.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.faults import by_pages
from tessera.operators.nodes import ir_parents

# Names that say nothing of a component.
GENERIC = r"(?i)^(div|section|article|header|footer|main|nav|aside|span|html|body)(-\d+)?$"


def own_print() -> Column:
    """What a node itself adds to its subtree's identity: no geometry, and no content of texts."""
    frame = F.to_json(F.struct(F.lit("F").alias("t"), "name", "layout", "fills", "strokes", "effects", "corner_radius", "svg_source"))
    text = F.to_json(F.struct(F.lit("T").alias("t"), "text_style", "fills"))
    image = F.to_json(F.struct(F.lit("I").alias("t"), F.when(F.col("image_ref").startswith("data:"), F.col("image_ref")).alias("r"), "fills", "corner_radius"))
    vector = F.to_json(F.struct(F.lit("V").alias("t"), "vector_path", "fills", "strokes", "svg_source"))
    return F.when(F.col("ir_type") == "FRAME", frame).when(F.col("ir_type") == "TEXT", text).when(F.col("ir_type") == "IMAGE", image).otherwise(vector)


HASHES = pa.schema([("page_id", pa.int64()), ("node_id", pa.int32()), ("hash", pa.string()), ("shape", pa.string())])


def subtree_hashes(placed: DataFrame) -> DataFrame:
    """page_id, node_id, hash of every frame's subtree, shape (where a hash that repeats on its page occurs first). placed: design nodes with parent_ir."""
    return hashed(placed).where("error is null").drop("error")


def hashed(placed: DataFrame, alike: DataFrame | None = None, threshold: int | None = None) -> DataFrame:
    """The same with the column error: of a page that fails there is one row.

    alike: further design nodes (page_id, node_id, parent_ir, ir_type) that are drawn as one of those in placed (drawn_as);
    if given, rows have drawn_as too. threshold: if given, rows have no shape but what found_by_page() says of them.
    """
    more = alike is not None

    def fold(page: dict[str, list]) -> tuple[list, ...]:
        ids, parents, types, known, drawn_as = (page[c] for c in ("node_id", "parent_ir", "ir_type", "p", "drawn_as"))
        at = {n: i for i, n in enumerate(ids)}
        prints = [p if p is not None else known[at[as_]] for p, as_ in zip(known, drawn_as, strict=True)]
        below: list[list[int]] = [[] for _ in ids]
        hashes = [b""] * len(ids)
        for i in range(len(ids) - 1, -1, -1):
            h = hashlib.sha256(prints[i].encode())
            for c in reversed(below[i]):
                h.update(hashes[c])
            hashes[i] = h.digest()
            if (up := at.get(parents[i])) is not None:
                below[up].append(i)
        frames = [i for i, t in enumerate(types) if t == "FRAME"]

        def shape(i: int) -> str:
            rows, work = [], [(i, 0)]
            while work:
                n, depth = work.pop()
                rows.append({"d": depth, "p": prints[n]})
                work += [(c, depth + 1) for c in below[n]]
            return json.dumps(rows, separators=(",", ":"), ensure_ascii=False)

        counts = Counter(hashes[i] for i in frames)
        if threshold is None:
            firsts = {hashes[i]: i for i in reversed(frames)}
            told = [[shape(i) if counts[hashes[i]] > 1 and firsts[hashes[i]] == i else None for i in frames]]
        else:
            ranks = found_by_page([at.get(p) for p in parents], hashes, frames, counts, shape, threshold)
            names = page["name"]
            told = [[ranks.get(i) for i in frames], [names[at[drawn_as[i]]] if i in ranks else None for i in frames]]
        return [ids[i] for i in frames], [hashes[i].hex() for i in frames], *told, *([[drawn_as[i] for i in frames]] if more else [])

    named = [] if threshold is None else ["name"]
    rows = placed.select("page_id", "node_id", "parent_ir", "ir_type", own_print().alias("p"), F.col("node_id").alias("drawn_as"), *named)
    schema, ddl = HASHES, "page_id long, node_id int, hash string, shape string"
    if threshold is not None:
        schema, ddl = pa.schema([*list(HASHES)[:3], ("rank", pa.int32()), ("name", pa.string())]), "page_id long, node_id int, hash string, rank int, name string"
    if more:
        schema, ddl = schema.append(pa.field("drawn_as", pa.int32())), f"{ddl}, drawn_as int"
        none = F.lit(None).cast("string")
        rows = rows.unionByName(alike.select("page_id", "node_id", "parent_ir", "ir_type", none.alias("p"), "drawn_as", *(none.alias(c) for c in named)))
    return by_pages(rows, fold, schema, ddl)


def found_by_page(up: list[int | None], hashes: list[bytes], frames: list[int], counts: Counter, shape: Callable[[int], str], threshold: int) -> dict[int, int]:
    """Of a page's frames that are occurrences of a component the component's rank: what plan() finds by joins.

    up: of each design node its parent, which comes before it. Shapes are spelled out only to order what is equally frequent.
    """
    if threshold <= 0:
        return {}
    repeated = {i for i in frames if counts[hashes[i]] >= threshold}
    inside = [False] * len(up)  # within another candidate: not an occurrence of its own
    for i, p in enumerate(up):
        inside[i] = p is not None and (inside[p] or p in repeated)
    groups: dict[bytes, list[int]] = {}
    for i in frames:
        if i in repeated and not inside[i]:
            groups.setdefault(hashes[i], []).append(i)
    groups = {h: found for h, found in groups.items() if len(found) >= threshold}
    equal = Counter(counts[h] for h in groups)
    order = sorted(groups, key=lambda h: (-counts[h], shape(groups[h][0]) if equal[counts[h]] > 1 else ""))
    return {i: rank for rank, h in enumerate(order, 1) for i in groups[h]}


def plan(placed: DataFrame, threshold: int = 3, hashes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """components (page_id, hash, rank, component_id, name, master, occurrences) and instances (page_id, node_id, hash, instance_id, ...)."""
    hashes = subtree_hashes(placed) if hashes is None else hashes
    counts = hashes.groupBy("page_id", "hash").agg(F.count("*").alias("all_occurrences"), F.max("shape").alias("shape")).where(F.col("all_occurrences") >= threshold if threshold > 0 else F.lit(False))
    candidates = hashes.select("page_id", "node_id", "hash").join(counts.hint("merge"), ["page_id", "hash"]).join(placed.select("page_id", "node_id", "ir_path", "name").hint("merge"), ["page_id", "node_id"])
    # within another candidate: not an occurrence of its own
    above = candidates.select("page_id", F.col("node_id").alias("a"))
    nested = candidates.select("page_id", "node_id", F.explode("ir_path").alias("a")).where("a <> node_id").join(above.hint("merge"), ["page_id", "a"], "left_semi").select("page_id", "node_id").distinct()
    outer = candidates.join(nested.hint("merge"), ["page_id", "node_id"], "left_anti")
    groups = outer.groupBy("page_id", "hash", "all_occurrences", "shape").agg(F.count("*").alias("occurrences"), F.min("node_id").alias("master"), F.min_by("name", "node_id").alias("raw_name")).where(F.col("occurrences") >= threshold)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("all_occurrences"), "shape"))
    found = named(groups.withColumn("rank", rank))
    return found, instances_of(outer, found)


def planned(outer: DataFrame) -> DataFrame:
    """The components that plan() finds, of their occurrences (page_id, node_id, hash, rank, name) as hashed() tells them."""
    return named(outer.groupBy("page_id", "hash", "rank").agg(F.count("*").alias("occurrences"), F.min("node_id").alias("master"), F.min_by("name", "node_id").alias("raw_name")))


def named(groups: DataFrame) -> DataFrame:
    """groups (page_id, hash, rank, raw_name, master, occurrences) with names and ids of their own."""
    cleaned = F.regexp_replace(F.regexp_replace(F.trim("raw_name"), r"^\.", ""), r"-\d+$", "")
    name = F.when((F.coalesce(cleaned, F.lit("")) == "") | cleaned.rlike(GENERIC), F.concat(F.lit("Component"), "rank")).otherwise(F.concat(F.upper(F.substring(cleaned, 1, 1)), F.substring(cleaned, 2, 1 << 20)))
    return unique_ids(groups.withColumn("name", name)).select("page_id", "hash", "rank", "component_id", "name", "master", "occurrences")


def instances_of(outer: DataFrame, groups: DataFrame) -> DataFrame:
    """page_id, node_id, hash, component_id, master, name, instance_id of each occurrence of a component."""
    ids = F.row_number().over(Window.partitionBy("page_id").orderBy("node_id"))
    instances = outer.join(groups.select("page_id", "hash", "component_id", "master", F.col("name").alias("component_name")).hint("merge"), ["page_id", "hash"])
    return instances.select("page_id", "node_id", "hash", "component_id", "master", F.when(F.col("name") != "", F.col("name")).otherwise(F.col("component_name")).alias("name"), F.concat(F.lit("instance-"), ids).alias("instance_id"))


def unique_ids(groups: DataFrame) -> DataFrame:
    """A slug for each component; the second of a kind ends in -2, unless that is taken. Folded over a page's few components in order."""
    base = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-|-$", "")
    base = F.when(base == "", "component").otherwise(base)
    listed = groups.withColumn("slug", base).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "slug", "hash"))).alias("all"))

    def step(state: Column, one: Column) -> Column:
        taken = F.transform(state, lambda s: s["id"])
        numbered = F.transform(F.sequence(F.lit(2), F.size(state) + 2), lambda i: F.concat_ws("-", one["slug"], i))
        own = F.when(~F.array_contains(taken, one["slug"]), one["slug"]).otherwise(F.get(F.filter(numbered, lambda n: ~F.array_contains(taken, n)), 0))
        return F.concat(state, F.array(F.struct(one["hash"].alias("hash"), own.alias("id"))))

    ids = listed.select("page_id", F.explode(F.aggregate("all", F.array().cast("array<struct<hash:string,id:string>>"), step)).alias("x")).select("page_id", F.col("x.hash").alias("hash"), F.col("x.id").alias("component_id"))
    return groups.join(ids.hint("merge"), ["page_id", "hash"])


def relative_paths(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """page_id, top, node_id, rel: each node below a root (page_id, top) by its place: ordinals from the root down, and the kinds on the way."""
    rows = placed.select("page_id", "node_id", "ir_steps", F.posexplode("ir_path").alias("level", "top")).where("node_id <> top").join(roots.hint("merge"), ["page_id", "top"])
    return rows.select("page_id", "top", "node_id", F.array_join(F.slice("ir_steps", F.col("level") + 2, F.size("ir_steps")), ".").alias("rel"))


def masters(placed: DataFrame, components: DataFrame) -> DataFrame:
    """page_id, component_id, node_id, master_id: the nodes of each component's first occurrence under ids of their own."""
    tops = components.select("page_id", F.col("master").alias("top"), "component_id")
    inner = relative_paths(placed, tops.select("page_id", "top")).join(tops.hint("merge"), ["page_id", "top"]).select("page_id", "component_id", "node_id", F.concat_ws(".", "component_id", "rel").alias("master_id"))
    return inner.unionByName(tops.select("page_id", "component_id", F.col("top").alias("node_id"), F.col("component_id").alias("master_id")))


def overrides(placed: DataFrame, components: DataFrame, instances: DataFrame) -> DataFrame:
    """page_id, instance_id, component_id, master_id, characters: texts that differ from the master's at the same place."""
    tops = instances.select("page_id", F.col("node_id").alias("top"), "instance_id", "component_id")
    texts = placed.where("ir_type = 'TEXT'").select("page_id", "node_id", "characters")
    here = relative_paths(placed, tops.select("page_id", "top")).join(texts.hint("merge"), ["page_id", "node_id"]).join(tops.hint("merge"), ["page_id", "top"])
    there = masters(placed, components).join(texts.withColumnRenamed("characters", "master_characters").hint("merge"), ["page_id", "node_id"]).select("page_id", "component_id", "master_id", "master_characters")
    own = here.select("page_id", "instance_id", "component_id", F.concat_ws(".", "component_id", "rel").alias("master_id"), "characters")
    return own.join(there.hint("merge"), ["page_id", "component_id", "master_id"]).where("characters <> master_characters").drop("master_characters")


def rewritten(placed: DataFrame, components: DataFrame, instances: DataFrame) -> DataFrame:
    """The tree after detection: occurrences are INSTANCE nodes, what they hold is gone, and each component's master follows once (component_id set)."""
    tops = instances.select("page_id", F.col("node_id").alias("a"))
    gone = placed.select("page_id", "node_id", F.explode("ir_path").alias("a")).join(tops.hint("merge"), ["page_id", "a"], "left_semi").where("a <> node_id").select("page_id", "node_id").distinct()
    kept = placed.join(gone.hint("merge"), ["page_id", "node_id"], "left_anti").join(instances.select("page_id", "node_id", F.col("component_id").alias("instance_of"), "instance_id").hint("merge"), ["page_id", "node_id"], "left")
    empty = lambda c, k: F.when(F.col("instance_of").isNotNull(), F.array().cast(k)).otherwise(F.col(c)).alias(c)
    types = dict(placed.dtypes)
    tree = kept.select(*(F.when(F.col("instance_of").isNotNull(), "INSTANCE").otherwise(F.col("ir_type")).alias("ir_type") if c == "ir_type" else empty(c, types[c]) if c in ("fills", "strokes", "effects") else F.col(c) for c in placed.columns), F.lit(None).cast("string").alias("component_id"), "instance_of", "instance_id")
    own = placed.join(masters(placed, components).select("page_id", "node_id", "component_id").hint("merge"), ["page_id", "node_id"])
    return tree.unionByName(own.select(*placed.columns, "component_id", F.lit(None).cast("string").alias("instance_of"), F.lit(None).cast("string").alias("instance_id")))


def corpus_components(ir: DataFrame, threshold: int = 3) -> DataFrame:
    """An extension: subtrees that repeat across pages. hash, occurrences, pages."""
    hashes = subtree_hashes(ir_parents(ir))
    return hashes.groupBy("hash").agg(F.count("*").alias("occurrences"), F.count_distinct("page_id").alias("pages")).where(F.col("occurrences") >= threshold)
