"""Filters over results, roll-ups for charts, sorting, pages, downsampling."""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.operators.ranks import with_place
from kmerloom.ship import ship

MOTIF_ORDER = ("I", "Ma", "Mi", "U")
LONGEST_QUERY = 200
TOP = 10


@dataclass(frozen=True)
class Filters:
    """What positions must satisfy. A range with NaN is ignored, an inverted one holds nothing; no motifs, or all, is no motif filter."""

    positions: tuple[float, float] | None = None
    entropy: tuple[float, float] | None = None
    motifs: tuple[str, ...] = MOTIF_ORDER
    sequence: str = ""
    include_low_support: bool = True

    @property
    def motif_active(self) -> bool:
        return bool(self.motifs) and not set(MOTIF_ORDER) <= set(self.motifs)

    @property
    def query(self) -> str:
        return self.sequence.strip()[:LONGEST_QUERY].upper()

    @property
    def is_default(self) -> bool:
        return self.active == 0

    @property
    def active(self) -> int:
        return sum([self.positions is not None, self.entropy is not None, self.motif_active, bool(self.query), not self.include_low_support])


def _in_range(value: Column, limits: tuple[float, float] | None) -> Column:
    if limits is None or any(math.isnan(x) for x in limits):
        return F.lit(True)
    return value.between(*limits) if limits[0] <= limits[1] else F.lit(False)


def filter_positions(stats: DataFrame, found: DataFrame, f: Filters) -> DataFrame:
    """Positions that pass; where motifs or a sequence are asked for, one variant must have both. A semi-join on the flat variants."""
    fine = _in_range(F.col("position"), f.positions)
    if f.entropy is not None and not any(map(math.isnan, f.entropy)):
        fine = fine & (F.abs("entropy") < float("inf")) & ~F.isnan("entropy") & _in_range(F.col("entropy"), f.entropy)
    if not f.include_low_support:
        fine = fine & ~F.coalesce(F.col("low_support").isin("NS", "LS"), F.lit(False))
    out = stats.where(fine)
    if not f.motif_active and not f.query:
        return out
    match = F.lit(True)
    if f.motif_active:
        match = match & F.col("motif_short").isin(*f.motifs)
    if f.query:
        match = match & F.upper("sequence").contains(f.query)
    return out.join(found.where(match).select("position"), "position", "left_semi")


def filter_nested(positions: DataFrame, f: Filters) -> DataFrame:
    """The same on the nested form, without a join."""
    flat = filter_positions(positions, positions, Filters(f.positions, f.entropy, MOTIF_ORDER, "", f.include_low_support))
    if not f.motif_active and not f.query:
        return flat

    def match(v: Column) -> Column:
        ok = v["motif_short"].isin(*f.motifs) if f.motif_active else F.lit(True)
        return ok & F.upper(v["sequence"]).contains(f.query) if f.query else ok

    return flat.where(F.coalesce(F.exists("diversity_motifs", match), F.lit(False)))


def lookup(stats: DataFrame, position: int) -> DataFrame:
    return stats.where(F.col("position") == position)


def metadata_fields(found: DataFrame) -> DataFrame:
    """Field names of the first variant that has metadata."""
    first = found.where("metadata IS NOT NULL AND size(metadata) > 0").agg(F.min_by("metadata", F.struct("position", "sequence")).alias("m"))
    return first.select(F.explode(F.map_keys("m")).alias("field"))


def distribution(values: DataFrame, top: int = TOP) -> DataFrame:
    """(position, field, name, count): the ``top`` values by count of each position and field (ties by name), the rest as Others.

    ``values(position, sequence, field, value, count)``. Ranks run over a field's values at a position.
    """
    sums = values.groupBy("position", "field", "value").agg(F.sum("count").alias("count"))
    rank = F.row_number().over(Window.partitionBy("position", "field").orderBy(F.desc("count"), "value"))
    name = F.when(F.col("r") > top, "Others").when(F.col("value") == "", "(empty)").otherwise(F.col("value"))
    ranked = sums.withColumn("r", rank).select("position", "field", name.alias("name"), (F.col("r") > top).alias("others"), "count")
    return ranked.groupBy("position", "field", "name", "others").agg(F.sum("count").alias("count")).where("count > 0").drop("others")


def motif_rollup(found: DataFrame, stats: DataFrame) -> DataFrame:
    """(position, index, major, minor, unique, total_variants, variant_richness): incidence of each class, to 0.1."""
    of = lambda m, name: F.round(F.sum(F.when(F.col("motif_short") == m, F.col("incidence")).otherwise(0.0)), 1).alias(name)
    sums = found.groupBy("position").agg(of("I", "index"), of("Ma", "major"), of("Mi", "minor"), of("U", "unique"))
    rates = stats.select("position", F.round("total_variants_incidence", 1).alias("total_variants"), F.round("distinct_variants_incidence", 1).alias("variant_richness"))
    return rates.join(sums, "position", "left").fillna(0.0)


def sorted_variants(found: DataFrame, by: str = "motif") -> DataFrame:
    """By motif (index, major, minor, unique, then falling count), count or incidence."""
    rank = F.create_map(*[F.lit(x) for i, m in enumerate(MOTIF_ORDER) for x in (m, i)])[F.col("motif_short")]
    order = {"motif": [rank, F.desc("count")], "count": [F.desc("count")], "incidence": [F.desc("incidence")]}[by]
    return found.orderBy(*order, "sequence")


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ordered rows."""
    return rows.offset((number - 1) * size).limit(size)


def pages(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.ceil(F.count(F.lit(1)) / size).alias("pages"))


def ranges(stats: DataFrame) -> DataFrame:
    """One row: least and largest finite entropy (0 and 1 if there is none) and position (1 and 1)."""
    e = F.when((F.abs("entropy") < float("inf")) & ~F.isnan("entropy"), F.col("entropy"))
    default = lambda x, y, name: F.coalesce(x, F.lit(y)).alias(name)
    return stats.agg(default(F.min(e), 0.0, "min_entropy"), default(F.max(e), 1.0, "max_entropy"), default(F.min("position"), 1, "min_position"), default(F.max("position"), 1, "max_position"))


def series(stats: DataFrame) -> DataFrame:
    """(index from 0, row 0, entropy) in the order of positions, which are not gathered for it."""
    placed = with_place(stats.select("position", "entropy"), [], [F.col("position")])
    return placed.select((F.col("place") - 1).cast("int").alias("index"), F.lit(0).alias("row"), "entropy")


def _hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of the corners of the convex hull of distinct points sorted by (x, y)."""

    def chain(order) -> list[int]:
        kept: list[int] = []
        for i in order:
            while len(kept) > 1:
                a, b = kept[-2:]
                if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) > 0:
                    break
                kept.pop()
            kept.append(i)
        return kept

    return sorted({*chain(range(len(x))), *chain(range(len(x) - 1, -1, -1))})


def _corners(points: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ``points(by, x, y)`` without those inside the hull of their neighbours in a batch. Corners of a bucket's hull always stay."""
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})

    def cut(batches):
        for b in batches:
            groups = b.column("__g").to_numpy(zero_copy_only=False)
            x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
            ends = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)] if len(groups) else [0]
            kept = [lo + i for lo, hi in itertools.pairwise(ends) for i in _hull(x[lo:hi].tolist(), y[lo:hi].tolist())]
            yield b.take(pa.array(kept, pa.int64()))

    ship(points.sparkSession)
    own = points.withColumn("__g", group).sortWithinPartitions("__g", "x", "y")
    return own.mapInArrow(cut, own.schema).drop("__g")


def downsample(points: DataFrame, threshold: int, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Largest-triangle downsampling of ``points(keys, x, y)`` with buckets of equal x-range, for each series.

    First and last points stay; each bucket gives the point with the largest triangle between the point picked before it and the mean of
    the next bucket that has points (else the last point), first of equals. Series of at most ``threshold`` points, of one x, or with a
    threshold under 3 stay whole. Points without x or y go; x and y are taken as doubles; null keys are a series.

    The largest triangle over any base stands on a corner of the bucket's convex hull, so points inside the hull go before a bucket is
    gathered: first where they lie, spread by value, then with their bucket. A fold over the buckets, at most ``threshold``, picks.
    """
    points = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    if threshold < 3:
        return points
    ends = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y")).alias("first"), F.max(F.struct("x", "y")).alias("last"))
    own = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], "n", "first", "last")
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    all_of = points.join(own, same).drop(*[f"__{k}" for k in keys])
    plain = (F.col("n") <= threshold) | (F.col("first.x") == F.col("last.x"))
    whole = all_of.where(plain).select(*keys, "x", "y")
    width = (F.col("last.x") - F.col("first.x")) / (threshold - 2)
    bucket = F.least(F.floor((F.col("x") - F.col("first.x")) / width), F.lit(threshold - 3))
    # repeated points are counted; of the two ends one each is no inner point
    is_end = (F.struct("x", "y") == F.col("first")) | (F.struct("x", "y") == F.col("last"))
    inner = all_of.where(~plain).withColumn("bucket", bucket).withColumn("end", is_end)
    inner = inner.groupBy(*keys, "bucket", "x", "y", "end").agg(F.count(F.lit(1)).alias("w")).withColumn("w", F.col("w") - F.col("end").cast("int")).where("w > 0")
    by = [*keys, "bucket"]
    corners = _corners(_corners(inner.select(*by, "x", "y"), by).repartition(*by), by)
    mean = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(f"a{c}")
    means = inner.groupBy(*by).agg(mean("x"), mean("y"))
    after = Window.partitionBy(*keys).orderBy("bucket")
    ahead = means.select(*[F.col(c).alias(f"__{c}") for c in by], F.lead("ax").over(after).alias("nx"), F.lead("ay").over(after).alias("ny"))
    grouped = corners.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    joined = grouped.join(ahead, same & (F.col("bucket") == F.col("__bucket"))).drop(*[f"__{c}" for c in by])
    listed = joined.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "p", "nx", "ny"))).alias("buckets"))
    listed = own.join(listed, same).drop(*[f"__{k}" for k in keys])

    def pick(state: Column, b: Column) -> Column:
        cx, cy = F.coalesce(b["nx"], F.col("last.x")), F.coalesce(b["ny"], F.col("last.y"))
        a = F.element_at(state, -1)
        area = lambda p: F.abs((a["x"] - cx) * (p["y"] - a["y"]) - (a["x"] - p["x"]) * (cy - a["y"])) * 0.5
        best = F.array_max(F.transform(b["p"], lambda p: F.struct(area(p).alias("area"), (-p["x"]).alias("nx"), (-p["y"]).alias("ny"))))
        return F.array_append(state, F.struct((-best["nx"]).alias("x"), (-best["ny"]).alias("y")))

    start = F.array(F.struct(F.col("first.x").alias("x"), F.col("first.y").alias("y")))
    picked = listed.select(*keys, F.array_append(F.aggregate("buckets", start, pick), F.struct(F.col("last.x").alias("x"), F.col("last.y").alias("y"))).alias("p"))
    return whole.unionByName(picked.select(*keys, F.explode("p").alias("q")).select(*keys, "q.x", "q.y"))
