"""Metadata tables: a row for each sequence, a nullable string column for each field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_columns(rows: DataFrame, fields: list[str], source: str = "metadata") -> DataFrame:
    """Map column to one column a field."""
    return rows.select("seq_id", *[F.col(source)[f].alias(f) for f in fields])


def to_map(table: DataFrame, fields: list[str]) -> DataFrame:
    """Columns to a map of the fields that have a value; null where none has."""
    whole = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))]), lambda _, v: v.isNotNull())
    return table.select("seq_id", F.when(F.size(whole) > 0, whole).alias("metadata"))


def value_counts(table: DataFrame, field: str) -> DataFrame:
    return table.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def matching(table: DataFrame, field: str, value: str) -> DataFrame:
    """seq_id of the rows with the value; an unknown field matches none."""
    return any_value(table, field, [value])


def any_value(table: DataFrame, field: str, values: list[str]) -> DataFrame:
    return table.where(F.col(field).isin(values) if field in table.columns and values else F.lit(False)).select("seq_id")


def distinct_values(table: DataFrame, field: str) -> DataFrame:
    return table.where(F.col(field).isNotNull()).select(F.col(field).alias("value")).distinct()


def mask(table: DataFrame, field: str, value: str) -> DataFrame:
    """seq_id and whether the row has the value; null is false."""
    return table.select("seq_id", F.coalesce(F.col(field) == value, F.lit(False)).alias("matches"))


def _equal(table: DataFrame, field: str, value: str) -> Column:
    return F.coalesce(F.col(field) == value, F.lit(False)) if field in table.columns else F.lit(False)


def query_and(table: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """seq_id of rows that match all pairs; none for an unknown field or an empty query."""
    return table.where(reduce(lambda a, b: a & b, [_equal(table, *w) for w in wanted]) if wanted else F.lit(False)).select("seq_id")


def query_or(table: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """seq_id of rows that match a pair; unknown fields match none."""
    return table.where(reduce(lambda a, b: a | b, [_equal(table, *w) for w in wanted]) if wanted else F.lit(False)).select("seq_id")


def gather(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``table`` for ``wanted(place, seq_id)``, in that table's places; nulls for ids that are not there."""
    return wanted.join(table, "seq_id", "left")


def table_stats(table: DataFrame, fields: list[str]) -> DataFrame:
    """One row: sequences, fields, values, present, distinct (summed over fields)."""
    n = F.count(F.lit(1))
    present = reduce(lambda a, b: a + b, [F.count(f) for f in fields])
    each = [F.count_distinct(f) for f in fields]
    return table.agg(n.alias("sequences"), F.lit(len(fields)).alias("fields"), (n * len(fields)).alias("total_values"), present.alias("non_null_values"), reduce(lambda a, b: a + b, each).alias("distinct_values"))


def bulk_update(table: DataFrame, field: str, updates: DataFrame) -> DataFrame:
    """``updates(seq_id, value, place)``: the last place of a seq_id wins; ids that are not in the table change nothing."""
    last = updates.groupBy("seq_id").agg(F.max_by(F.struct("value"), "place").alias("__new"))
    joined = table.join(last, "seq_id", "left")
    return joined.withColumn(field, F.when(F.col("__new").isNotNull(), F.col("__new.value")).otherwise(F.col(field))).select(*table.columns)


def aggregate_for(table: DataFrame, ids: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, count) over the rows of a set of seq_ids."""
    own = table.join(ids.select("seq_id").distinct(), "seq_id", "left_semi")
    each = own.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select("x.*")
    return each.where("value IS NOT NULL").groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set intersection of seq_ids."""
    return a.select("seq_id").intersect(b.select("seq_id"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set union of seq_ids."""
    return a.select("seq_id").union(b.select("seq_id")).distinct()


def row_sets(table: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, bucket, rows): the seq_ids of each value as bitmaps, one for every 32,768 ids. Stored once, sets are intersected and united by
    their bitmaps; what is shuffled then are 4 KiB for each bucket and value, not ids."""
    each = table.select("seq_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).where("x.value IS NOT NULL AND seq_id IS NOT NULL")
    bucket = F.bitmap_bucket_number("seq_id").alias("bucket")
    return each.groupBy("x.field", "x.value", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("seq_id")).alias("rows"))


def _wanted(sets: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    return sets.where(reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("value") == v) for f, v in wanted], F.lit(False)))


def intersected(sets: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """(bucket, rows) of the ids that have all (field, value) pairs; none for an empty list."""
    wanted = list(dict.fromkeys(wanted))
    both = _wanted(sets, wanted).groupBy("bucket").agg(F.bitmap_and_agg("rows").alias("rows"), F.count(F.lit(1)).alias("n"))
    return both.where(F.col("n") == len(wanted)).select("bucket", "rows")


def united(sets: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """(bucket, rows) of the ids that have any of the pairs."""
    return _wanted(sets, wanted).groupBy("bucket").agg(F.bitmap_or_agg("rows").alias("rows"))


def cardinality(found: DataFrame) -> DataFrame:
    """One row: how many ids the bitmaps hold."""
    return found.agg(F.coalesce(F.sum(F.bitmap_count("rows")), F.lit(0)).alias("sequences"))
