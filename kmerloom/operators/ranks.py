"""Places in an order, and stored orders to page through, without a window over all rows of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.sources.shared import stored

#: Bits that Spark's rising ids leave to the number of a row within its partition.
_ROW_BITS = 33
#: Rows that a task sorts, about, where their number is known.
SORTED = 1 << 18


def in_order(rows: DataFrame, by: list[str | Column], n: int | None = None) -> DataFrame:
    """rows range-partitioned and sorted by ``by``. With ``n``, their number, a partition has about SORTED of them at any size; else there are as many
    partitions as the session shuffles to."""
    parts = [] if n is None else [max(1, -(-n // SORTED))]
    return rows.repartitionByRange(*parts, *by).sortWithinPartitions(*by)


def with_place(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "place", path: str | None = None, count: str | None = None, n: int | None = None) -> DataFrame:
    """rows with their place, from 1, in ``order`` among the rows of the same ``keys``; null keys are a key.

    A segmented scan: the rows are range-partitioned and sorted by keys and order, and written once. A segment is what one partition holds of
    a key; segments are counted, and only their counts, at most partitions plus keys, are summed in order. So a key with
    all rows is spread over all partitions. ``order`` should tell rows apart: equal ones get places in any order. With ``count`` a column of that name
    says how many rows the key has. ``path`` is where the sorted rows are kept, for ``page``; ``n`` is the number of rows, where it is known (``in_order``).
    """
    by = [*[F.col(f"`{k}`") for k in keys], *order]
    held = stored(in_order(rows, by, n).withColumn("__at", F.monotonically_increasing_id()), "sorted", path)
    part = F.shiftright("__at", _ROW_BITS)
    own = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    segments = held.groupBy(*own, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    line = Window.partitionBy(*names).orderBy("__part")
    before = F.coalesce(F.sum("__n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = segments.withColumn("__before", before)
    if count:
        starts = starts.withColumn("__all", F.sum("__n").over(Window.partitionBy(*names)))
    starts = stored(starts, "segments").drop("__n")
    same = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    joined = held.join(starts, reduce(Column.__and__, same, part == F.col("__part")))
    extra = [F.col("__all").alias(count)] if count else []
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias(name), *extra)


def store_order(rows: DataFrame, keys: list[str], order: list[str | Column], path: str) -> None:
    """Keep rows under ``path`` in their order, with ``place`` and ``of``, the number of rows of their key: files are ranges of (keys, place)."""
    placed = with_place(rows, keys, order, count="of")
    by = [*[F.col(f"`{k}`") for k in keys], F.col("place")]
    placed.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(path)


def page(stored: DataFrame, number: int, size: int, **keys) -> DataFrame:
    """Page ``number`` (from 1) of a stored order, for the key given: a range of places, which Parquet's statistics prune to the files and row
    groups that hold it. Nothing is sorted or skipped."""
    own = reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(v)) for k, v in keys.items()], F.lit(True))
    return stored.where(own & F.col("place").between((number - 1) * size + 1, number * size))
