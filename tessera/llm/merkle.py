"""A Merkle manifest of a table: a leaf for each document, a tree for each group of them, a tree over the groups' roots.

A parent is the hash of its children's hex digests, one after the other; that text, its preimage, is what the manifest
stores. A leaf's proof is the list of its ancestors' preimages and of the slot of 64 characters that it, or the ancestor
below, has in each. Cutting the slots out leaves the siblings; putting another digest into the first slot, its hash into
the next and so on folds the tree anew for a changed leaf.

Leaves are put in order by ranges: a range's rows are numbered where they lie, and a small table has how many rows of a
group come before each range. Runs of fan^levels leaves are then one row each, in which `levels` levels of the tree are
made at once; the runs' tops are the leaves of the next tier. So a tree of n leaves takes log(n) / log(fan^levels) small
shuffles of digests, no group, however large, meets in one task, and a text is read once.

Defined cases: a null in any column is hashed as `-`, an empty text as `0:`, a very long one whole; a null group comes
first, as does a null doc_id within its group; rows that tie by group and doc_id are in the order of their digests, and
rows that repeat are leaves each; extra columns, whatever their names, are not hashed; an empty table has no leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_width, written

#: Characters of a digest.
SLOT = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """`-` if null, else the bytes of its text, a colon and the text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**changed: Column) -> Column:
    """A document's leaf; of the fields named, by these values."""
    return digest(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)))


def siblings(path: Column) -> Column:
    """A path's preimages without the slots of the leaf and of its ancestors, joined from below."""
    return F.array_join(F.transform(path, lambda p: F.overlay(p["preimage"], F.lit(""), p["slot"] * SLOT + 1, F.lit(SLOT))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a path leads to from this leaf."""
    return F.aggregate(path, leaf, lambda below, p: digest(F.overlay(p["preimage"], below, p["slot"] * SLOT + 1, F.lit(SLOT))))


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with pos, from 0 in each group by these columns (nulls first), and n, the group's rows."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), name)
    counted = dealt.groupBy(F.col(group).alias("of"), F.col("part").alias("at")).agg(F.min("row").alias("first"), F.count("*").alias("here"))
    whole = Window.partitionBy("of")  # a row for each range that holds rows of the group
    counted = counted.select("of", "at", (F.sum("here").over(whole.orderBy("at")) - F.col("here") - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("n"))
    found = dealt.join(counted, F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    return found.select(*rows.columns, (F.col("row") + F.col("shift")).alias("pos"), "n")


def tree(nodes: DataFrame, fan: int, levels: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with path in place of n; g, top: each group's root). nodes: g, pos, n, hash and whatever else they carry.

    path: array of (preimage, slot), from the node's parent up to the group's root.
    """
    width = fan**levels
    carried = [c for c in nodes.columns if c not in ("g", "pos", "n")]
    own = F.sort_array(F.collect_list(F.struct("pos", *carried))).alias("own")
    at = (F.col("n") > width) | (F.size("hashes") > 1)  # a group's last node is its root
    runs = nodes.groupBy("g", "n", F.floor(F.col("pos") / width).alias("run")).agg(own).withColumn("hashes", F.transform("own", lambda x: x["hash"]))
    for k in range(levels):
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("hashes") - 1) / fan)), lambda i: F.array_join(F.slice(F.col("hashes"), i * fan + 1, F.lit(fan)), ""))
        runs = runs.withColumn(f"level{k}", F.when(at, pairs).otherwise(F.array().cast("array<string>")))
        runs = runs.withColumn("hashes", F.when(at, F.transform(f"level{k}", digest)).otherwise(F.col("hashes")))
    runs = written(runs.select("g", "n", "run", "own", *(f"level{k}" for k in range(levels)), F.col("hashes")[0].alias("top")), name)

    def path(pos: Column) -> Column:
        place, steps = F.pmod(pos, F.lit(width)), []
        for k in range(levels):
            place_here = F.floor(place / fan**k)
            steps.append(F.struct(F.get(F.col(f"level{k}"), F.floor(place_here / fan).cast("int")).alias("preimage"), F.pmod(place_here, F.lit(fan)).cast("int").alias("slot")))
        return F.filter(F.array(*steps), lambda s: s["preimage"].isNotNull())

    below = F.transform("own", lambda x: F.struct(x["pos"].alias("pos"), *(x[c].alias(c) for c in carried), path(x["pos"]).alias("path")))
    most = runs.agg(F.max("n")).first()[0]
    if most is None or most <= width:
        tops, rows = runs.select("g", "top"), runs.select("g", F.explode(below).alias("x")).select("g", "x.*")
    else:
        upper, tops = tree(runs.select("g", F.col("run").alias("pos"), F.ceil(F.col("n") / width).alias("n"), F.col("top").alias("hash")), fan, levels, f"{name}-up")
        upper = upper.select(F.col("g").alias("of"), F.col("pos").alias("at"), F.col("path").alias("above"))
        rows = runs.join(upper, (F.col("g") == F.col("of")) & (F.col("run") == F.col("at"))).select("g", "above", F.explode(below).alias("x"))
        rows = rows.select("g", *(f"x.{c}" for c in ("pos", *carried)), F.concat("x.path", "above").alias("path"))
    return rows, tops


def manifest(docs: DataFrame, claims: dict[str, Column] | None = None, group: str = "lang", fan: int = 2, levels: int = 8) -> DataFrame:
    """doc_id, leaf, subroot, root, path, and the claims' columns: a row for each document.

    claims: further columns, made of a document's own, that go with it (as the leaf that somebody claims for it). fan:
    children of a parent, at most; levels: of the tree that are made in one step.
    """
    named = {f"claim{i}": c for i, c in enumerate((claims or {}).values())}
    leaves = docs.select(F.col("doc_id"), F.col(group).alias("part_of"), leaf_of().alias("hash"), *(c.alias(n) for n, c in named.items()))
    leaves = placed(written(leaves, "merkle-leaves"), "part_of", ["doc_id", "hash"], "merkle-order")
    groups = placed(leaves.where("pos = 0").select("part_of", F.lit(0).alias("all")), "all", ["part_of"], "merkle-groups")
    groups = written(groups.select(F.col("part_of").alias("group"), F.col("pos").alias("g"), F.col("n").alias("groups")), "merkle-numbers")
    nodes = leaves.join(groups, F.col("part_of").eqNullSafe(F.col("group"))).select("g", "pos", "n", "hash", "doc_id", *named)
    rows, tops = tree(nodes, fan, levels, "merkle-runs")
    tops = tops.join(groups.select(F.col("g").alias("of"), "groups"), F.col("g") == F.col("of"))
    tops, whole = tree(tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.col("groups").alias("n"), F.col("top").alias("hash")), fan, levels, "merkle-top")
    root = whole.first()  # one digest; none if there are no documents
    tops = written(tops.select(F.col("pos").alias("of"), F.col("hash").alias("subroot"), F.lit(root and root["top"]).cast("string").alias("root"), F.col("path").alias("above")), "merkle-roots")
    rows = rows.join(tops, F.col("g") == F.col("of"))
    return rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.concat("path", "above").alias("path"), *(F.col(n).alias(c) for n, c in zip(named, claims or {}, strict=True)))


def verify(docs: DataFrame, claimed: Column, group: str = "lang", fan: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: does the claimed leaf of each document lead to the root?"""
    found = manifest(docs, {"claimed": claimed}, group, fan).withColumn("folded_root", folded(F.col("claimed"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
