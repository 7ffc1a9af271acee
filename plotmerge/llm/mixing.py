"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source whose target is above its
size is taken whole as often as that goes; what is left of the target is a budget for a
subset of its documents. That subset is found on the counts: every length gives its
seeded share first, and the rest, at most ``DP_WORDS`` plus one document, is met by a
bounded-knapsack dynamic program over the lengths that are left. The documents behind
the chosen counts are the first of their length in a seeded order, so reruns agree.

The rows of a source are never gathered: tasks see its distinct lengths, and the seeded
order is an exact rank over range-sorted rows, whatever share of the rows a source has.

Defined results: null text has size 0; the null source is a source of its own, ordered
last; a document of size 0 takes 0; repeated rows are separate documents; a table without
words has targets of 0. Columns other than the three named are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotmerge.llm.common import free_name, rank_in_class, stored, whole_text

#: Weights of the sources in their order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Share of all sizes that the mix has.
SHARE = 1.5
#: How often a source, and a document, may be taken at most.
MOST = 2
#: The dynamic program meets the last so many words of a budget.
DP_WORDS = 1 << 16
SEED = 20


def word_count(column: str = "text") -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.regexp_count(whole_text(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water-filled shares.

    The excess of sources that stop at ``MOST`` times their size is shared again until none
    is above: all others then get the same multiple of their weight. Sources in order of
    size by weight stop one after the other, so the multiple is found along one running
    sum over the sources (one row each, not documents).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    # Budget and weight left when all sources that stop earlier have stopped.
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.lit(SHARE) * F.sum("source_size").over(everything)
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("level", left / weight_left)
    # The first source whose stop lies above its level sets the level of all that follow.
    open_ = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)
    filled = F.coalesce(level["level"] * F.col("weight"), F.col("cap"))
    return w.select("source", "source_size", F.least("cap", filled).alias("target"))


def _subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum is as near the budget as can be.

    Bounded knapsack on a bit set of reachable sums: counts are split into powers of two,
    and ``first`` keeps the item that reached a sum first, which is enough to walk back.
    Sums up to one document above the budget are reachable too, and count if nearer.
    """
    take = np.zeros(len(lengths), np.int64)
    fits = (lengths > 0) & (lengths <= 2 * budget) & (counts > 0)
    if budget <= 0 or not fits.any():
        return take
    top = budget + min(budget, int(lengths[fits].min()))
    reach, mask, items = 1, (1 << (top + 1)) - 1, []
    first = np.full(top + 1, -1, np.int64)
    for k in np.flatnonzero(fits):
        left, many = min(int(counts[k]), top // int(lengths[k])), 1
        while left:
            many = min(many, left)
            new = (reach << (many * int(lengths[k]))) & mask & ~reach
            if new:
                raw = np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8)
                first[np.flatnonzero(np.unpackbits(raw, bitorder="little")[: top + 1])] = len(items)
                reach |= new
            items.append((k, many))
            left, many = left - many, many * 2
        if reach >> budget & 1:
            break
    sums = np.append(np.flatnonzero(first >= 0), 0)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        k, many = items[first[at]]
        take[k] += many
        at -= many * int(lengths[k])
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: float, seed: int) -> np.ndarray:
    """Documents of each length to take: seeded shares first, then the dynamic program."""
    total, goal = int((lengths * counts).sum()), round(budget)
    if goal <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    rng = np.random.default_rng(seed)
    draw, order = rng.random(len(lengths)), rng.permutation(len(lengths))
    take = np.minimum(counts, np.floor(counts * (goal / total) + draw)).astype(np.int64)
    # Shares that together go over the budget are cut in seeded order.
    cost = take[order] * lengths[order]
    room = np.clip(goal - (np.cumsum(cost) - cost), 0, None)
    take[order] = np.minimum(take[order], room // np.maximum(lengths[order], 1))
    left = goal - int((take * lengths).sum())
    # Whole documents in seeded order until the dynamic program's window is left.
    for k in order:
        if left <= DP_WORDS:
            break
        if lengths[k]:
            more = min(int(counts[k] - take[k]), (left - DP_WORDS // 2) // int(lengths[k]))
            take[k] += more
            left -= more * int(lengths[k])
    return take + _subset_sum(lengths, counts - take, left)


def _fit(table: pa.Table) -> pa.Table:
    """Counts to take for one source, from one row for each of its distinct lengths."""
    table = table.sort_by("size")
    lengths, counts = table["size"].to_numpy(), table["n"].to_numpy()
    whole, budget = table["whole"][0].as_py(), table["budget"][0].as_py()
    take = fit_budget(lengths, counts, budget, table["seed"][0].as_py() & 0x7FFFFFFF)
    return pa.table(
        {"source": table["source"], "size": table["size"], "whole": pa.array([whole] * len(lengths), pa.int64()),
         "take": pa.array(take, pa.int64())}
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix takes a row."""
    # Stored first: range-sorting samples its input, and texts are to be read once.
    sized = stored(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size"),
        F.xxhash64(F.col(id_col), F.lit(seed)).alias("_h"),
    ), "mix-sizes")
    ranked = rank_in_class(sized, ["source", "size"], "mix-ranked").drop("_h")
    counts = stored(ranked.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = stored(targets(sizes), "mix-targets")
    size_f = F.greatest(F.col("source_size"), F.lit(1))
    whole = F.least(F.floor(F.col("target") / size_f), F.lit(MOST)).cast("long")
    per_source = goal.select(
        F.col("source").alias("_s"), whole.alias("whole"),
        (F.col("target") - whole * F.col("source_size")).alias("budget"),
        F.xxhash64("source", F.lit(seed)).alias("seed"),
    )
    fitted = counts.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").groupBy(
        "source"
    ).applyInArrow(_fit, "source string, size bigint, whole bigint, take bigint")
    fitted = stored(fitted, "mix-fitted").select(
        F.col("source").alias("_fs"), F.col("size").alias("_fz"), "whole", "take"
    )
    goal = goal.select(F.col("source").alias("_gs"), "source_size", "target")
    out = ranked.join(fitted, F.col("source").eqNullSafe(F.col("_fs")) & (F.col("size") == F.col("_fz")))
    out = out.join(goal, F.col("source").eqNullSafe(F.col("_gs")))
    copies = F.col("whole") + (F.col("_rank") < F.col("take")).cast("long")
    return out.select(
        "id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).alias("copies"),
    )


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         seed: int = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns.

    Rows that repeat an id, a source and a size are taken alike, as often as the least of them.
    """
    plan = mix(docs, id_col, text_col, source_col, seed).groupBy("id", "source", "size").agg(
        F.min("copies").alias("copies")
    ).where("copies > 0")
    names = {c: free_name(docs, f"_mix_{c}") for c in ("id", "source", "size", "copies", "n")}
    plan = stored(plan.select(*[F.col(c).alias(names[c]) for c in plan.columns]), "mix-plan")
    same = (
        F.col(id_col).eqNullSafe(F.col(names["id"]))
        & F.col(source_col).cast("string").eqNullSafe(F.col(names["source"]))
        & (word_count(text_col) == F.col(names["size"]))
    )
    # The plan has as many rows as documents: both sides are dealt by key at every size.
    taken = docs.join(plan.hint("merge"), same).withColumn(
        names["n"], F.explode(F.array_repeat(F.lit(0), F.col(names["copies"]).cast("int")))
    )
    return taken.select(*docs.columns)
