"""Highly conserved sequences: runs of positions whose index k-mers overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.operators.ranks import with_place
from kmerloom.sources.shared import stored


def index_picks(found: DataFrame, stats: DataFrame, threshold: float | None = None, by: str = "counts") -> DataFrame:
    """(position, kmer, low_support): the smallest index sequence of each position that has one.

    ``threshold`` in percent: ``by="counts"`` asks for count * 100 >= support * threshold, ``by="incidence"`` for incidence >= the threshold
    clamped to 0..100; without one all positions with an index take part.
    """
    own = found.where("motif_short = 'I'").join(stats.select("position", "support", "low_support"), "position")
    if threshold is not None:
        fits = F.col("incidence") >= max(0.0, min(100.0, threshold)) if by == "incidence" else F.col("count") * 100 >= F.col("support") * F.lit(threshold)
        own = own.where(fits)
    return own.groupBy("position").agg(F.min("sequence").alias("kmer"), F.first("low_support").alias("low_support"))


def regions(picks: DataFrame, low: tuple[str, ...] = ("NS", "LS"), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, region_id, start_position, end_position, sequence, positions, low_support_positions), from 1 in order.

    A region goes on while positions follow one another and k-1 characters overlap (always, where k is 1). Whether it does is seen from the
    pick of the next position, by a join; the n-th place where a region starts belongs to the n-th where one ends, and both are numbered
    by ``with_place``. So no window runs over the alignment. Only a region's own positions are gathered, which are its result.
    """
    picks = stored(picks, "picks")
    of = [F.col(f"`{c}`") for c in keys]
    k = F.length("kmer")
    tails = picks.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in keys], (F.col("position") + 1).alias("next"), F.col("kmer").alias("prev"))
    joins = (F.col("position") == F.col("next")) & (F.substring(F.col("kmer"), F.lit(1), k - 1) == F.expr("substring(prev, 2)"))
    same = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"__{c}")) for c in keys], joins)
    starts = picks.join(tails, same, "left_anti").select(*of, F.lit(0).alias("kind"), "position")
    ends = tails.join(picks, same, "left_anti").select(*[F.col(f"__{c}").alias(c) for c in keys], F.lit(1).alias("kind"), (F.col("next") - 1).alias("position"))
    placed = with_place(starts.unionByName(ends), [*keys, "kind"], [F.col("position")])
    edge = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("position")))
    bounds = placed.groupBy(*of, F.col("place").cast("int").alias("region_id")).agg(edge(0).alias("start_position"), edge(1).alias("end_position"))
    each = bounds.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in keys], "region_id", F.explode(F.sequence("start_position", "end_position")).alias("__position"))
    inside = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"__{c}")) for c in keys], F.col("position") == F.col("__position"))
    grouped = picks.join(each, inside).groupBy(*of, "region_id").agg(F.array_sort(F.collect_list(F.struct("position", "kmer", "low_support"))).alias("x"))
    tail = F.transform(F.slice("x", 2, F.greatest(F.size("x"), F.lit(1))), lambda v: F.right(v["kmer"], F.lit(1)))
    return grouped.select(
        *of,
        "region_id",
        F.element_at("x", 1)["position"].alias("start_position"),
        F.element_at("x", -1)["position"].alias("end_position"),
        F.concat(F.element_at("x", 1)["kmer"], F.array_join(tail, "")).alias("sequence"),
        F.transform("x", lambda v: v["position"]).alias("positions"),
        F.transform(F.filter("x", lambda v: F.coalesce(v["low_support"].isin(*low), F.lit(False))), lambda v: v["position"]).alias("low_support_positions"),
    )


def low_support_summary(found: DataFrame) -> DataFrame:
    """Regions with positions of low support, and how many."""
    return found.select("region_id", F.size("low_support_positions").alias("low_support_count"), F.size("positions").alias("position_count")).where("low_support_count > 0")


def consensus(found: DataFrame, spine: DataFrame, k: int) -> DataFrame:
    """One row: the middle character of each position's first index k-mer (smallest sequence), X where there is none."""
    first = found.where("motif_short = 'I'").groupBy("position").agg(F.min("sequence").alias("kmer"))
    char = F.coalesce(F.substring("kmer", k // 2 + 1, 1), F.lit("X"))
    chars = spine.join(first, "position", "left").select("position", char.alias("c"))
    return chars.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "c"))), lambda x: x["c"]), "").alias("consensus"))


def alignment_length(stats: DataFrame, k: int) -> DataFrame:
    return stats.agg((F.max("position") + k - 1).alias("alignment_length"))


