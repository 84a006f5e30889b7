"""Interval annotations: clean-up, categories, coordinate mapping, overlaps, annotations by position."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kmerloom.operators.ranks import with_place
from kmerloom.sources.shared import stored, together

# Category of each feature type that is kept.
CATEGORIES = {
    "DOMAIN": "DOMAIN",
    "REGION": "REGION",
    "BINDING": "BINDING",
    "NP_BIND": "BINDING",
    "ACT_SITE": "ACT_SITE",
    "SIGNAL": "SIGNAL",
    "TRANSMEM": "TRANSMEM",
    "CARBOHYD": "CARBOHYD",
    "DISULFID": "DISULFID",
    "TOPO_DOM": "TOPO_DOM",
    "MOTIF": "MOTIF",
}
#: Columns that the smallest bins of the overlap join cover, and rows of a bin from which it is dealt to several tasks.
BIN, HOT = 64, 1 << 17
#: Levels of a tree of sums, from its top, whose nodes are sent to all tasks: some 2^SENT nodes.
SENT = 12


def category(feature_type: Column) -> Column:
    """The category of a type, null for others."""
    return F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])[feature_type]


def is_point(begin: Column, end: Column) -> Column:
    return begin == end


def clean(features: DataFrame) -> DataFrame:
    """features(feature_type, begin, end, ...) with types in upper case, of those that are kept; without a usable begin, or with an end before
    it, rows go; a missing or unreadable end is the begin."""
    own = features.withColumn("feature_type", F.upper("feature_type")).where(F.col("feature_type").isin(*CATEGORIES))
    own = own.withColumn("begin", F.col("begin").cast("string").try_cast("int")).withColumn("end", F.coalesce(F.col("end").cast("string").try_cast("int"), F.col("begin")))
    return own.where("begin > 0 AND begin <= `end`").withColumn("category_key", category(F.col("feature_type")))


def search(features: DataFrame, text: str) -> DataFrame:
    """Features that hold the text in description, type or category, in any case."""
    q = text.strip().lower()
    return features.where(F.lower("description").contains(q) | F.lower("feature_type").contains(q) | F.lower("category").contains(q)) if q else features


def listed_by_category(features: DataFrame) -> DataFrame:
    """(category_key, feature_id, place): the members of each category in the order of their begin, then id; a category may lie in many partitions."""
    return with_place(features.select("category_key", "feature_id", "begin"), ["category_key"], [F.col("begin"), F.col("feature_id")]).select("category_key", "feature_id", "place")


def by_category(features: DataFrame) -> DataFrame:
    return features.groupBy("category_key").agg(F.count(F.lit(1)).alias("features"))


def mapping_runs(to_structure: DataFrame, msa: DataFrame) -> DataFrame:
    """(first, last, low, high): maximal runs of residues whose first and last alignment positions both rise by one from residue to residue;
    ``low`` and ``high`` are those of the run's first residue.

    A run is a gap-free stretch of one diagonal: residues minus their place among those of the diagonal are equal in it. What follows grows with
    runs, not with residues.
    """
    extent = msa.groupBy("structure_residue").agg(F.min("msa_position").alias("lo"), F.max("msa_position").alias("hi"))
    each = to_structure.join(extent, "structure_residue").groupBy(F.col("residue").cast("long").alias("residue")).agg(F.min("lo").cast("long").alias("lo"), F.max("hi").cast("long").alias("hi"))
    placed = with_place(each.select("residue", (F.col("lo") - F.col("residue")).alias("a"), (F.col("hi") - F.col("residue")).alias("b")), ["a", "b"], [F.col("residue")])
    runs = placed.groupBy("a", "b", (F.col("residue") - F.col("place")).alias("island")).agg(F.min("residue").alias("first"), F.max("residue").alias("last"))
    return runs.select("first", "last", (F.col("a") + F.col("first")).alias("low"), (F.col("b") + F.col("first")).alias("high"))


def map_features(features: DataFrame, to_structure: DataFrame, msa: DataFrame) -> DataFrame:
    """features(feature_id, feature_type, begin, end) with msa_begin and msa_end, the extent over all their residues; null if none maps.

    ``to_structure(residue, structure_residue)`` and ``msa(msa_position, structure_residue)``; types without a category go. A feature's extent comes
    from the runs that begin or end in it, and from those that it cuts at its begin or its end; it has no row for each residue or run.
    """
    own = features.withColumn("category_key", category(F.col("feature_type"))).where("category_key IS NOT NULL")
    wanted = own.select("feature_id", F.col("begin").cast("long").alias("lo"), F.col("end").cast("long").alias("hi")).where("lo <= hi")
    ranges = stored(wanted.select("lo", "hi").distinct(), "ranges")
    runs = stored(mapping_runs(to_structure, msa), "runs")
    low, high = {"msa_begin": F.min}, {"msa_end": F.max}
    none, top = F.lit(None).cast("long"), F.col("high") + F.col("last") - F.col("first")
    edges = runs.select(F.col("first").alias("at"), F.col("low").alias("msa_begin"), none.alias("msa_end")).unionByName(runs.select(F.col("last").alias("at"), none.alias("msa_begin"), top.alias("msa_end")))
    found = [sums_within(ranges, edges, low | high)]
    # what is cut is on the run's diagonal: its value less its place holds along the run
    left = runs.select((F.col("first") + 1).alias("lo"), F.col("last").alias("hi"), (F.col("low") - F.col("first")).alias("msa_begin"))
    right = runs.select(F.col("first").alias("lo"), (F.col("last") - 1).alias("hi"), (F.col("high") - F.col("first")).alias("msa_end"))
    for side, cut, how in (("lo", left, low), ("hi", right, high)):
        (name,) = how
        at = sums_over(ranges.select(F.col(side).alias("at")).distinct(), cut, how).withColumnRenamed("at", side)
        found.append(ranges.join(at, side).select("lo", "hi", *[F.col(c) + F.col(side) if c == name else none.alias(c) for c in ("msa_begin", "msa_end")]).toDF("lo", "hi", "msa_begin", "msa_end"))
    extents = _merged(reduce(DataFrame.unionByName, found), ["lo", "hi"], low | high)
    mapped = wanted.join(extents, ["lo", "hi"]).groupBy("feature_id").agg(*[how(c).cast("int").alias(c) for c, how in (low | high).items()])
    return own.join(mapped, "feature_id", "left")


def direct_mapping(positions: DataFrame, residues: DataFrame, offset: int = 0) -> DataFrame:
    """(msa_position, residue): position + offset where that residue exists and fits 32 bits."""
    wanted = positions.select(F.col("position").alias("msa_position"), (F.col("position").cast("long") + offset).alias("residue")).where(F.col("residue").between(-(1 << 31), (1 << 31) - 1))
    return wanted.join(residues.select(F.col("residue").cast("long").alias("residue")).distinct(), "residue").select("msa_position", F.col("residue").cast("int").alias("residue"))


def coverage(positions: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: mapped, positions, coverage in percent."""
    both = positions.select("position").distinct().join(mapping.select(F.col("msa_position").alias("position"), F.lit(1).alias("m")).distinct(), "position", "left")
    n = F.count(F.lit(1))
    return both.agg(F.count("m").alias("mapped"), n.alias("positions"), F.coalesce(F.count("m") / n * 100, F.lit(0.0)).alias("coverage"))


def _merged(rows: DataFrame, keys: list[str], how: dict[str, Callable]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[f(c).alias(c) for c, f in how.items()])


def _nodes(ranges: DataFrame) -> DataFrame:
    """Rows of ``ranges(lo, hi, ...)``, ends included, for each of the nodes (level, bin) that they are made up of: bin * 2^level and the 2^level - 1
    places after it. A range has two nodes a level at most; those with lo above hi have none."""
    each = ranges.where("lo <= hi").select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.log2((F.col("hi") - F.col("lo") + 1).cast("double"))).cast("int"))).alias("level"))
    # what is left of a range at a level, once smaller nodes have made its ends even
    first, after = F.expr("shiftright(lo + shiftleft(1L, level) - 1, level)"), F.expr("shiftright(hi + 1, level)")
    each = each.withColumn("first", first).withColumn("after", after).where("first < after")
    odd = lambda x: F.col(x).bitwiseAND(1) == 1
    return each.withColumn("bin", F.explode(F.array(F.when(odd("first"), F.col("first")), F.when(odd("after"), F.col("after") - 1)))).where("bin IS NOT NULL").drop("lo", "hi", "first", "after")


def _above(points: DataFrame, top: int) -> DataFrame:
    """Rows of ``points(at, ...)`` for each of the nodes, up to level ``top``, that hold them."""
    return points.select("*", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")).withColumn("bin", F.expr("shiftright(at, level)"))


def _clipped(ranges: DataFrame, points: DataFrame) -> tuple[DataFrame, int]:
    """ranges(lo, hi, ...) cut to the extent of the points(at), and the highest level of a node of any."""
    low, high = points.agg(F.min("at"), F.max("at")).first()
    if low is None:
        return ranges.limit(0), 0
    return ranges.withColumn("lo", F.greatest("lo", F.lit(low))).withColumn("hi", F.least("hi", F.lit(high))), (high - low + 1).bit_length()


def _met(asked: DataFrame, sums: DataFrame, top: int) -> DataFrame:
    """asked(level, bin, ...) with the one row of sums(level, bin, ...) for its node. The highest levels have few nodes, each asked for by many: those are sent."""
    few = F.col("level") > top - SENT
    return asked.where(few).join(F.broadcast(sums.where(few)), ["level", "bin"]).unionByName(asked.where(~few).join(sums.where(~few), ["level", "bin"]))


def sums_within(ranges: DataFrame, points: DataFrame, how: dict[str, Callable]) -> DataFrame:
    """(lo, hi, ...): for each of ``ranges(lo, hi)``, all different, that holds any of ``points(at, ...)``, the columns of ``how`` over all that it holds, summed up
    by F.sum, F.min or F.max.

    Points are summed up by node of a binary tree over their places, and a range is made up of some two nodes a level: rows grow with the sides and
    the logarithm of the extent, not with pairs.
    """
    cut, top = _clipped(ranges.select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "lo", "hi"), points)
    sums = _merged(_above(_merged(points, ["at"], how), top), ["level", "bin"], how)
    return _merged(_met(_nodes(cut), sums, top).select(F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), *how), ["lo", "hi"], how)


def sums_over(points: DataFrame, ranges: DataFrame, how: dict[str, Callable]) -> DataFrame:
    """(at, ...): for each of ``points(at)``, all different, that lies in any of ``ranges(lo, hi, ...)``, the columns of ``how`` over all that hold it; the other way
    round of ``sums_within``, with the same tree."""
    cut, top = _clipped(_merged(ranges, ["lo", "hi"], how), points)
    sums = _merged(_nodes(cut), ["level", "bin"], how)
    return _merged(_met(_above(points, top), sums, top).select("at", *how), ["at"], how)


def emitted(side: DataFrame, levels: list[int]) -> DataFrame:
    """Rows of ``side(lo, hi, level, ...)`` in the bins that they meet at each of the levels from their own on: two a level, about."""
    wanted = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("level"))
    each = side.select("*", F.explode(wanted).alias("at"))
    return each.select("*", F.explode(F.expr("sequence(shiftright(lo, at), shiftright(hi, at))")).alias("bin"))


def meeting(a: DataFrame, b: DataFrame, smallest: int = BIN, hot: int = HOT) -> DataFrame:
    """Pairs (a, b), structs of the two sides' columns, of intervals (lo, hi) that share a place; ends included.

    Bins are hierarchical: an interval's own level is that of the smallest bins, ``smallest`` columns and up by twos, of which it meets two at most. A pair
    is looked for at the larger of its two levels, so a side emits rows for those levels from its own on at which the other has intervals: a
    logarithmic number, however long an interval is. A pair is kept in the first bin that both reach, so none comes twice. A bin
    with more than ``hot`` emitted rows is dealt to several tasks; the intervals of the other side's own level go to each of them.
    """
    bits = max(0, (smallest - 1).bit_length())
    size = F.col("hi") - F.col("lo") + 1
    level = F.greatest(F.lit(bits), F.ceil(F.log2(size.cast("double"))).cast("int"))

    def side(df: DataFrame, name: str) -> tuple[DataFrame, int, list[int]]:
        """The intervals as a table, with their number and levels, which are observed while it is written."""
        own = df.where("lo <= hi").select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
        seen = Observation()
        sums = F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1L, level)")).alias("levels")
        held = stored(own.withColumn("level", level).withColumn("id", F.monotonically_increasing_id()).observe(seen, *sums), f"intervals-{name}")
        # an input found empty while it is planned leaves nothing to observe
        found = seen.get or held.agg(*sums).first().asDict()
        levels = found["levels"] or 0
        return held, found["n"], [x for x in range(64) if levels >> x & 1]

    (left, n_left, at_left), (right, n_right, at_right) = together(a.sparkSession, lambda: side(a, "a"), lambda: side(b, "b"))
    about = {"a": (n_left, at_left), "b": (n_right, at_right)}

    def joined(wide: DataFrame, narrow: DataFrame, wide_name: str, narrow_name: str, strict: bool) -> DataFrame:
        """Pairs of wide intervals, in their own level, with narrower ones (or as wide, unless strict)."""
        at = about[wide_name][1] or [bits]
        few = emitted(narrow, at)
        own = wide.select(F.col(wide_name), F.col("lo").alias("wlo"), F.col("hi").alias("whi"), F.col("level").alias("at"), F.explode(F.expr("sequence(shiftright(lo, level), shiftright(hi, level))")).alias("bin"))
        few = few.where(F.col("level") < F.col("at")) if strict else few
        near = "wlo <= hi AND lo <= whi AND bin = shiftright(greatest(wlo, lo), at)"
        if about[narrow_name][0] <= hot:
            # an interval is in a bin once: none can hold more
            return own.join(few, ["at", "bin"]).where(near).select("a", "b")
        crowded = few.groupBy("at", "bin").count().where(F.col("count") > hot).select("at", "bin", F.ceil(F.col("count") / hot).cast("int").alias("salts"))
        crowded = stored(crowded, "crowded")
        own = own.join(crowded, ["at", "bin"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        few = few.join(crowded, ["at", "bin"], "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        return own.join(few, ["at", "bin", "salt"]).where(near).select("a", "b")

    return joined(left, right, "a", "b", False).unionByName(joined(right, left, "b", "a", True))


def overlaps(regions: DataFrame, features: DataFrame, k: int = 1, width: int = BIN) -> DataFrame:
    """Pairs of regions (region_id, start_position, end_position) and mapped features (feature_id, msa_begin, msa_end) that share a column.

    A region covers the k - 1 columns after its last window. ``width`` is that of the smallest bins of ``meeting``.
    """
    a = regions.select("region_id", "start_position", "end_position", F.col("start_position").alias("lo"), (F.col("end_position") + max(0, k - 1)).alias("hi"))
    b = features.where("msa_begin IS NOT NULL AND msa_end IS NOT NULL").select("feature_id", "msa_begin", "msa_end", F.col("msa_begin").alias("lo"), F.col("msa_end").alias("hi"))
    return meeting(a, b, width).select("a.region_id", "a.start_position", "a.end_position", "b.feature_id", "b.msa_begin", "b.msa_end")


def overlap_sums(regions: DataFrame, features: DataFrame, k: int = 1) -> DataFrame:
    """(feature_id, regions, first_region, last_region): for each feature_id with overlaps, how many pairs ``overlaps`` gives, and the least and the
    greatest region_id of them. Pairs may be as many as regions times features; none of them is built.

    A region shares a column with a feature if it begins in it, or begins before it and goes on to its begin.
    """
    how = {"regions": F.sum, "first_region": F.min, "last_region": F.max}
    own = regions.select(F.col("start_position").cast("long").alias("lo"), (F.col("end_position").cast("long") + max(0, k - 1)).alias("hi"), "region_id").where("lo <= hi")
    own = stored(own.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("regions"), F.min("region_id").alias("first_region"), F.max("region_id").alias("last_region")), "regions")
    wanted = features.select("feature_id", F.col("msa_begin").cast("long").alias("lo"), F.col("msa_end").cast("long").alias("hi")).where("lo <= hi")
    ranges = stored(wanted.select("lo", "hi").distinct(), "ranges")
    begin = sums_within(ranges, own.withColumnRenamed("lo", "at").drop("hi"), how)
    go_on = sums_over(ranges.select(F.col("lo").alias("at")).distinct(), own.withColumn("lo", F.col("lo") + 1), how)
    both = begin.unionByName(ranges.join(go_on.withColumnRenamed("at", "lo"), "lo").select(begin.columns))
    return _merged(wanted.join(_merged(both, ["lo", "hi"], how), ["lo", "hi"]), ["feature_id"], how)


def annotated(positions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations (position_number, label, note, ...) with the values of their position; those without one go."""
    return annotations.join(positions, F.col("position_number") == F.col("position")).drop("position_number")
