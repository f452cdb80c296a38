"""Mixing sources to target weights, with DataFrame functions alone.

Weights are token shares raised to an exponent and normalised; a smaller exponent flattens them. The exponent, in [0, 1],
is found by bisection: the largest that meets an entropy (as a share of that of equal weights), or the smallest that keeps
to a limit on how often a source is repeated. What a step asks of the sources is an aggregation over them, so that their
number doesn't matter. The token budget deals out
target = weight x budget. A source's documents lie in blocks of a random permutation (a hash of the document); it is taken
whole as often as its target allows and then once more in part, block by block in the permuted order up to the document
at which the target is reached. Only block totals are summed in order; the one block in which a source's cut falls is
summed by document. So no task holds a source, however hot.

Defined cases: a null source is a source; a null or empty text has no tokens and is taken as often as its source is taken
whole (at least once if budget is None); a very long text counts whole, and is left out of a part that it would exceed;
repeated rows, and rows whose hashes tie, are taken together; sources without tokens get no weight; an empty table gives
an empty one; extra columns pass through, and if one has the name of an added column, the added one gets "_" behind it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, small_or_joined, written

#: Blocks of a source's permutation, as bits of the hash: a fixed number, so that a block's share of a source is known.
BLOCK_BITS = 10
ROUNDS = 60


def free_name(df: DataFrame, name: str) -> str:
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def tokens_in(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def _entropies(live: DataFrame, top: float, alphas: list[float]) -> list[float]:
    """Of the weights at each exponent, by one aggregation over the sources."""
    x = F.col("tokens") / top
    sums = [f for a in alphas for f in (F.sum(F.pow(x, F.lit(a))), F.sum(F.pow(x, F.lit(a)) * F.ln(x)))]
    row = tuple(live.agg(*(f.alias(f"s{i}") for i, f in enumerate(sums))).first())
    return [math.log(z) - a * y / z for a, z, y in zip(alphas, row[::2], row[1::2], strict=True)]


def exponent(live: DataFrame, max_repeats: float | None, entropy_share: float | None) -> float:
    """The largest exponent in [0, 1] that meets the entropy; for a limit on repeats the smallest, as a greater one repeats less.

    live: source, tokens, tokens > 0. How often a source is repeated beside the one with the most tokens is
    (tokens / most) to the power exponent - 1, greatest for the one with the fewest: two numbers decide it. Entropies of
    several exponents are taken in one pass over the sources: six halvings each.
    """
    least, top, n = live.agg(F.min("tokens"), F.max("tokens"), F.count("*")).first()
    meets = lambda alpha: (least / top) ** (alpha - 1) <= max_repeats
    low, high = 0.0, 1.0
    if max_repeats is not None:
        for _ in range(ROUNDS):
            mid = (low + high) / 2
            low, high = (low, mid) if meets(mid) else (mid, high)
        at_least = high
    if entropy_share is None:
        return at_least if max_repeats is not None else 1.0
    wanted, low, high = entropy_share * math.log(n) - 1e-12, 0.0, 1.0
    for _ in range(ROUNDS // 6):
        grid = [low + (high - low) * i / 64 for i in range(1, 64)]
        at, step = 0, 32
        known = _entropies(live, float(top), grid)
        while step:  # the entropy falls as the exponent rises
            if known[at + step - 1] >= wanted:
                at += step
            step //= 2
        low, high = (grid[at - 1] if at else low), (grid[at] if at < 63 else high)
    return low if max_repeats is None else max(low, at_least)


def mixing_plan(counts: DataFrame, max_repeats: float | None, entropy_share: float | None, budget: int | None) -> DataFrame:
    """source, tokens, alpha, weight, target: a row for each source. counts: source, tokens.

    budget None: as many tokens as show the source that is repeated least just once, so that no document is lost. With a
    limit on repeats and an entropy, the limit decides where they contradict each other.
    """
    out = "source string, tokens long, alpha double, weight double, target double"
    live = counts.where("tokens > 0")
    if live.isEmpty():
        return counts.sparkSession.createDataFrame([], out)
    alpha = exponent(live, max_repeats, entropy_share)
    top = float(live.agg(F.max("tokens")).first()[0])
    raised = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / top, F.lit(alpha))).otherwise(0.0)
    total = live.agg(F.sum(raised)).first()[0]
    weight = raised / total
    return counts.select("source", "tokens", F.lit(alpha).alias("alpha"), weight.alias("weight"), (weight * (total * top if budget is None else float(budget))).alias("target"))


def mix(docs: DataFrame, max_repeats: float | None = 2.0, entropy_share: float | None = None, budget: int | None = None, seed: int = 3, most_sources: int = 50_000) -> DataFrame:
    """docs with the columns mix_epoch (0, 1, ...), mix_block and mix_order added: a row for each time that a document is taken.

    Sorted by mix_epoch and mix_order, an epoch's blocks and their documents come in random order.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    order = F.xxhash64(F.lit(seed), doc_id, F.col("text")).alias("o")
    block = F.shiftrightunsigned("o", 64 - BLOCK_BITS).cast("int").alias("block")
    keyed = docs.select("source", tokens_in(F.col("text")).alias("n"), order).select("source", "n", "o", block)
    keyed = written(keyed, "mix-keys")
    blocks = written(keyed.groupBy("source", "block").agg(F.sum("n").alias("n")), "mix-blocks")
    plan = mixing_plan(blocks.groupBy("source").agg(F.sum("n").alias("tokens")), max_repeats, entropy_share, budget)
    # whole passes over a source, and what remains for one more in part
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens") + 1e-9)).otherwise(0).cast("long")
    plan = written(plan.withColumn("passes", passes).withColumn("rest", F.when(F.col("tokens") > 0, F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("tokens"))).otherwise(0.0)), "mix-plan")
    sources = plan.count()
    small = small_or_joined(plan.select(F.col("source").alias("s"), "passes", "rest"), sources, most_sources)
    before = F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    cut = blocks.withColumn("before", F.coalesce(before, F.lit(0))).join(small, F.col("source").eqNullSafe(F.col("s")))
    cut = cut.where("before < rest and before + n >= rest").select("s", "block", (F.col("rest") - F.col("before")).alias("left"))
    cut_blocks = small_or_joined(written(cut, "mix-cuts").withColumnRenamed("block", "cut_block"), sources, most_sources)
    inside = keyed.join(cut_blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("cut_block")))
    inside = inside.groupBy("s", "cut_block", "left", "o").agg(F.sum("n").alias("n"))
    run = F.sum("n").over(Window.partitionBy("s").orderBy("o").rowsBetween(Window.unboundedPreceding, -1))
    # the first document whose tokens would pass the target is left out, with all that follow
    limits = inside.withColumn("before", F.coalesce(run, F.lit(0))).where("before + n <= left + 1e-6").groupBy("s", "cut_block").agg(F.max("o").alias("last"))
    limits = written(limits, "mix-limits")
    full = written(plan.select(F.col("source").alias("s"), "passes", "rest").join(cut_blocks.withColumnRenamed("s", "cs"), F.col("s").eqNullSafe(F.col("cs")), "left").drop("cs").join(limits.select(F.col("s").alias("ls"), "last"), F.col("s").eqNullSafe(F.col("ls")), "left").drop("ls", "left"), "mix-final")
    final = small_or_joined(full, sources, most_sources)
    # the documents' own columns travel as one, so that no name can clash
    rows = docs.select(F.struct(*docs.columns).alias("d"), "source", order).withColumn("b", F.shiftrightunsigned("o", 64 - BLOCK_BITS).cast("int"))
    rows = rows.join(final.select(F.struct("s", "passes", "rest", "cut_block", "last").alias("m")), F.col("source").eqNullSafe(F.col("m.s")), "left")
    once_more = F.coalesce((F.col("m.rest") > 0) & ((F.col("b") < F.col("m.cut_block")) | ((F.col("b") == F.col("m.cut_block")) & (F.col("o") <= F.col("m.last")))), F.lit(False))
    passes = F.coalesce(F.col("m.passes"), F.lit(0)) + once_more.cast("long")
    if budget is None:
        passes = F.greatest(passes, F.lit(1))
    rows = rows.withColumn("n", passes).where("n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    permuted = F.struct(F.xxhash64("source", "epoch", "b", F.lit(seed)).alias("block"), F.xxhash64("o", "epoch").alias("document"))
    return rows.select("d.*", F.col("epoch").alias(free_name(docs, "mix_epoch")), F.col("b").alias(free_name(docs, "mix_block")), permuted.alias(free_name(docs, "mix_order")))
