"""Ranges of documents for the token files: their number, and ids that hold many rows."""

from collections import Counter

from pyspark.sql import functions as F

from kmerloom.llm import common, token_orc


def parts_of(spark, rows, n):
    own = token_orc._ranged(spark.createDataFrame(rows, "doc_id long, text string"), n)
    return [(r["p"], r["doc_id"], r["text"]) for r in own.withColumn("p", F.spark_partition_id()).collect()]


def test_a_hot_id_has_several_ranges(spark):
    """Half of the rows have one id, a quarter none: they are spread, nothing is lost, and ids still rise over the parts."""
    rows = [(7, f"t{i}") for i in range(4000)] + [(None, f"n{i}") for i in range(2000)] + [(i - 500, "x") for i in range(2000)]
    found = parts_of(spark, rows, 16)
    assert Counter((d, t) for _, d, t in found) == Counter(rows)
    assert max(Counter(p for p, _, _ in found).values()) <= 1000
    assert len({p for p, d, _ in found if d == 7}) >= 7 and len({p for p, d, _ in found if d is None}) >= 3
    low = -(1 << 63)
    spans = {}
    for p, d, _ in found:
        d = low if d is None else d
        spans[p] = (min(d, spans.get(p, (d, d))[0]), max(d, spans.get(p, (d, d))[1]))
    order = [spans[p] for p in sorted(spans)]
    assert all(a[1] <= b[0] for a, b in zip(order, order[1:]))


def test_extreme_ids_and_few_rows(spark):
    """The smallest and greatest ids, and more ranges than rows."""
    rows = [((1 << 63) - 1, "a"), (-(1 << 63), "b"), (None, None), (0, ""), ((1 << 63) - 1, "a")]
    for n in (1, 2, 7, 64):
        found = parts_of(spark, rows, n)
        assert Counter((d, t) for _, d, t in found) == Counter(rows)
        ids = [-(1 << 63) if d is None else d for _, d, _ in sorted(found, key=lambda r: (r[0], r[1] is not None, r[1] or 0))]
        assert ids == sorted(ids)


def test_number_of_ranges_follows_size(spark, monkeypatch):
    """Twice the data has twice the ranges."""
    at = common.fresh_path(spark, "sized")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    docs.write.parquet(at)
    monkeypatch.setattr(token_orc, "RANGE_BYTES", 50_000)
    one = token_orc._ranges(spark.read.parquet(at))
    docs.write.mode("append").parquet(at)
    two = token_orc._ranges(spark.read.parquet(at))
    assert one > 20 and abs(two - 2 * one) <= 2
    where = common.fresh_path(spark, "tokens")
    token_orc.write_tokens(spark.read.parquet(at), where)
    own = token_orc.starts(spark, where)
    assert own.count() == 40_000
    ordered = own.orderBy("start").collect()
    assert [r["doc_id"] for r in ordered] == sorted(r["doc_id"] for r in ordered)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:]))
    assert token_orc.read_tokens(spark, where).select("part").distinct().count() > 20
