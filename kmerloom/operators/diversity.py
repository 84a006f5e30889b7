"""Positions and variants from k-mer counts: support, entropy, motif classes, diversity, summary.

All statistics of a position are functions of its count spectrum: how many types occur how often. A position with N reads has at
most sqrt(2N) distinct counts, so the spectrum is a small array whatever the number of variants, and no window function runs over
variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.operators.ranks import with_place

# Support labels and motif classes.
NO_SUPPORT, LOW_SUPPORT, AT_THRESHOLD = "NS", "LS", "ELS"
MOTIFS = {"I": "Index", "Ma": "Major", "Mi": "Minor", "U": "Unique"}


def total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + of(x))


def spectrum(counts: DataFrame) -> DataFrame:
    """(position, spectrum): array of (count, types), rising; a null k-mer, for windows that are not valid, is no type."""
    types = counts.groupBy("position", "count").agg(F.count("kmer").alias("types"))
    return types.groupBy("position").agg(F.array_sort(F.collect_list(F.when(F.col("types") > 0, F.struct("count", "types")))).alias("spectrum"))


def label(support: Column, threshold: int) -> Column:
    return F.when(support == 0, NO_SUPPORT).when(support < threshold, LOW_SUPPORT).when(support == threshold, AT_THRESHOLD)


def raw_entropy(items: Column, support: Column) -> Column:
    """Shannon entropy in bits; 0 for an empty spectrum, never a negative zero."""
    bits = total(items, lambda x: x["types"] * (x["count"] / support) * F.log2(x["count"] / support))
    return F.when((support > 0) & (bits < 0), -bits).otherwise(F.lit(0.0))


def position_stats(counts: DataFrame, threshold: int, spine: DataFrame | None = None) -> DataFrame:
    """(position, spectrum, support, distinct_kmers, low_support, raw_entropy, top, second and the diversity rates).

    ``top`` is the index count (null if all variants are unique), ``second`` the major count. Positions without a valid window, which
    counts with ``gaps`` hold and a ``spine`` adds to other counts, have support 0 and an empty spectrum.
    """
    own = spectrum(counts)
    if spine is not None:
        own = spine.join(own, "position", "left")
    items = F.coalesce("spectrum", F.array().cast("array<struct<count:bigint,types:bigint>>"))
    own = own.select("position", items.alias("spectrum"))
    whole = lambda of: F.aggregate("spectrum", F.lit(0).cast("long"), lambda s, x: s + of(x))
    own = own.withColumn("support", whole(lambda x: x["count"] * x["types"])).withColumn("distinct_kmers", whole(lambda x: x["types"]))
    many = F.filter("spectrum", lambda x: x["count"] > 1)
    own = own.withColumn("top", F.when(F.size(many) > 0, F.element_at(many, -1)["count"])).withColumn("second", F.when(F.size(many) > 1, F.element_at(many, -2)["count"]))
    index_types = whole(lambda x: F.when(x["count"] == F.col("top"), x["types"]).otherwise(F.lit(0).cast("long")))
    own = own.withColumn("__i", index_types)
    other_types = F.col("distinct_kmers") - F.col("__i")
    other_reads = F.col("support") - F.col("__i") * F.coalesce("top", F.lit(0))
    return own.select(
        "position",
        label(F.col("support"), threshold).alias("low_support"),
        "support",
        "distinct_kmers",
        raw_entropy(F.col("spectrum"), F.col("support")).alias("raw_entropy"),
        other_types.alias("distinct_variants_count"),
        F.when(other_reads > 0, other_types / other_reads * 100).otherwise(0.0).alias("distinct_variants_incidence"),
        F.when(F.col("support") > 0, other_reads / F.col("support") * 100).otherwise(0.0).alias("total_variants_incidence"),
        "top",
        "second",
        "spectrum",
    )


def motif(count: Column, top: Column, second: Column) -> Column:
    """Index: largest count; Unique: count 1; Major: the next largest count; Minor: the rest. Ties share a class."""
    return F.when(count == 1, "U").when(count == top, "I").when(count == second, "Ma").otherwise("Mi")


def variants(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """(position, sequence, count, incidence, motif_short, motif_long)."""
    own = counts.where("kmer IS NOT NULL").join(stats.select("position", "support", "top", "second"), "position")
    short = motif(F.col("count"), F.col("top"), F.col("second"))
    names = F.create_map(*[F.lit(x) for kv in MOTIFS.items() for x in kv])
    out = own.select("position", F.col("kmer").alias("sequence"), "count", (F.col("count") / F.col("support") * 100).alias("incidence"), short.alias("motif_short"))
    return out.withColumn("motif_long", names[F.col("motif_short")])


def nested(stats: DataFrame, found: DataFrame) -> DataFrame:
    """Positions with their variants as an array, by falling count, then sequence; null where there are none.

    One position's variants become one row: for the sinks that want the nested form. The flat tables have no such bound.
    """
    fields = [c for c in ("sequence", "count", "incidence", "motif_short", "motif_long", "metadata") if c in found.columns]

    def order(a: Column, b: Column) -> Column:
        """By falling count, then sequence; maps inside the structs have no order of their own."""
        first = (a["count"] > b["count"]) | ((a["count"] == b["count"]) & (a["sequence"] < b["sequence"]))
        return F.when(first, -1).when((a["count"] == b["count"]) & (a["sequence"] == b["sequence"]), 0).otherwise(1)

    arrays = found.groupBy("position").agg(F.array_sort(F.collect_list(F.struct(*fields)), order).alias("diversity_motifs"))
    return stats.join(arrays, "position", "left")


def summary(stats: DataFrame, sequences: int, threshold: int, k: int, name: str = "") -> DataFrame:
    """One row about the run. Averages and the highest entropy leave out NS and LS positions and entropies that are not finite; of
    equal entropies the last position is the highest."""
    fine = (~F.coalesce(F.col("low_support"), F.lit("")).isin(NO_SUPPORT, LOW_SUPPORT)) & (F.abs("entropy") < float("inf"))
    best = F.max(F.when(fine, F.struct("entropy", "position")))
    out = stats.agg(F.count_if(F.col("low_support").isNotNull()).alias("low"), best.alias("best"), F.avg(F.when(fine, F.col("entropy"))).alias("mean"))
    return out.select(
        F.lit(sequences).cast("long").alias("sequence_count"),
        F.lit(threshold).cast("long").alias("support_threshold"),
        F.col("low").alias("low_support_count"),
        F.lit(name).alias("query_name"),
        F.lit(k).alias("kmer_length"),
        F.struct(F.coalesce("best.position", F.lit(0)).alias("position"), F.coalesce("best.entropy", F.lit(0.0)).alias("entropy")).alias("highest_entropy"),
        F.coalesce("mean", F.lit(0.0)).alias("average_entropy"),
    )


def highest_entropy(rows: DataFrame, order: str = "position", value: str = "entropy") -> DataFrame:
    """(position, entropy) of the largest value, the last of equals; 0 and 0.0 of an empty table."""
    best = rows.agg(F.max(F.struct(F.col(value).alias("e"), F.col(order).alias("p"))).alias("b"))
    return best.select(F.coalesce("b.p", F.lit(0)).alias("position"), F.coalesce("b.e", F.lit(0.0)).alias("entropy"))


def minors(found: DataFrame, position: int, descending: bool = False) -> DataFrame:
    """Minor variants of a position by count."""
    order = F.desc("count") if descending else F.asc("count")
    return found.where((F.col("position") == position) & (F.col("motif_short") == "Mi")).orderBy(order, "sequence")


def metadata_counts(rows: DataFrame, fields: list[str], k: int, a) -> DataFrame:
    """(position, sequence, field, value, count): how often each value of each field occurs among a variant's sequences.

    Fields are unpivoted before k-mers are counted, and counted map-side: what is shuffled follows the values of each field, not the
    combinations of all.
    """
    from kmerloom.functions.kmers import windows

    own = windows(rows, k, a, tuple(fields))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    each = own.select("position", F.col("kmer").alias("sequence"), pairs).where("x.value IS NOT NULL")
    return each.groupBy("position", "sequence", "x.field", "x.value").agg(F.count(F.lit(1)).alias("count"))


def with_metadata(found: DataFrame, values: DataFrame) -> DataFrame:
    """Variants with ``metadata``: field to value to count, keys sorted; an empty map where no value was seen."""
    inner = values.groupBy("position", "sequence", "field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "count")))).alias("m"))
    outer = inner.groupBy("position", "sequence").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.map_entries("m").alias("e"))))).alias("e"))
    maps = outer.select("position", "sequence", F.transform_values("e", lambda _, e: F.map_from_entries(e)).alias("metadata"))
    empty = F.create_map().cast("map<string,map<string,bigint>>")
    return found.join(maps, ["position", "sequence"], "left").withColumn("metadata", F.coalesce("metadata", empty))


def rolling_rank(found: DataFrame) -> DataFrame:
    """Variants with their place in the position's order: by falling count, then sequence. A position's variants may lie in many partitions."""
    return with_place(found, ["position"], [F.desc("count"), F.col("sequence")])
