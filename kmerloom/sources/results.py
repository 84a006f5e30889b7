"""Stored results: Parquet of summary, positions and variants; and JSON, JSON Lines and TSV by Spark's writers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators.diversity import nested

# Formats by extension, columns of the TSV form.
EXTENSIONS = {".parquet": "compact", ".tsv": "tsv", ".tab": "tsv", ".jsonl": "jsonl", ".ndjson": "jsonl"}
FORMATS = ("json", "jsonl", "tsv", "compact")
CODECS = {"none": "none", "lz4": "lz4", "zstd": "zstd"}
TSV_COLUMNS = (
    "position",
    "entropy",
    "support",
    "low_support",
    "distinct_variants_count",
    "distinct_variants_incidence",
    "total_variants_incidence",
    "index_sequence",
    "index_count",
    "index_incidence",
    "major_sequence",
    "major_count",
    "major_incidence",
    "minor_count",
    "minor_incidence",
    "unique_count",
    "unique_incidence",
)
POSITION = ("position", "low_support", "entropy", "support", "distinct_variants_count", "distinct_variants_incidence", "total_variants_incidence")


def output_format(path: str | None, explicit: str | None = None) -> str:
    """What was asked for, else by the extension, else json."""
    if explicit:
        if explicit not in FORMATS:
            raise ValueError(f"unknown format {explicit!r}")
        return explicit
    return EXTENSIONS.get(os.path.splitext(path or "")[1].lower(), "json")


def save(result, path: str, compression: str = "zstd") -> None:
    """The compact form: three Parquet tables under ``path``, lossless."""
    for name in ("summary", "positions", "variants"):
        table = getattr(result, name)
        table.drop(*[c for c in ("spectrum", "top", "second") if c in table.columns]).write.option("compression", CODECS[compression]).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str):
    from kmerloom.plans.analyze import Analysis

    return Analysis(*[spark.read.parquet(f"{path}/{n}") for n in ("summary", "positions", "variants")])


def check_finite(positions: DataFrame) -> None:
    """Stop if a float of the positions is not finite: JSON cannot hold it."""
    floats = [c for c, t in positions.dtypes if t == "double" and c != "intercept"]
    bad = F.lit(False)
    for c in floats:
        bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    if positions.where(bad).limit(1).count():
        raise ValueError("a value is not finite")


def documents(result) -> DataFrame:
    """Positions in the nested form, one row each."""
    return nested(result.positions.select(*POSITION), result.variants)


def envelope(result, pretty: bool = False) -> DataFrame:
    """One row, ``value``: the whole result as a JSON document, keys of maps sorted; with line breaks and indents if ``pretty``.

    It is one document by definition, as long as the alignment; for more use JSON Lines or the tables.
    """
    rows = documents(result).agg(F.array_sort(F.collect_list(F.struct(*POSITION, "diversity_motifs")), lambda a, b: a["position"] - b["position"]).alias("results"))
    whole = F.struct(*result.summary.columns, "results")
    return result.summary.crossJoin(F.broadcast(rows)).select(F.to_json(whole, {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("value"))


def tsv(result) -> DataFrame:
    """The 17 columns as strings: tied index and major variants comma-joined, minor and unique ones summed, "." for none."""
    by = lambda m: F.col("motif_short") == m
    two = lambda c: F.format_string("%.2f", c)
    listed = lambda m: F.array_sort(F.collect_list(F.when(by(m), F.struct((-F.col("count")).alias("n"), F.col("sequence").alias("s"), F.col("incidence").alias("i")))))
    summed = lambda m, c: F.sum(F.when(by(m), F.col(c)))
    sums = result.variants.groupBy("position").agg(listed("I").alias("I"), listed("Ma").alias("Ma"), *[summed(m, c).alias(f"{m}_{c}") for m in ("Mi", "U") for c in ("count", "incidence")])
    own = result.positions.select(*POSITION).join(sums, "position", "left")

    def joined(m: str, of) -> Column:
        return F.when(F.size(m) > 0, F.array_join(F.transform(m, of), ",")).otherwise(".")

    cells = [F.col("position").cast("string"), F.format_string("%.6f", "entropy"), F.col("support").cast("string"), F.coalesce("low_support", F.lit(".")), F.col("distinct_variants_count").cast("string"), two(F.col("distinct_variants_incidence")), two(F.col("total_variants_incidence"))]
    for m in ("I", "Ma"):
        cells += [joined(m, lambda x: x["s"]), joined(m, lambda x: (-x["n"]).cast("string")), joined(m, lambda x: two(x["i"]))]
    for m in ("Mi", "U"):
        cells += [F.coalesce(F.col(f"{m}_count").cast("string"), F.lit(".")), F.when(F.col(f"{m}_incidence").isNotNull(), two(F.col(f"{m}_incidence"))).otherwise(".")]
    return own.select(*[c.alias(n) for c, n in zip(cells, TSV_COLUMNS, strict=True)])


def write(result, path: str, explicit: str | None = None, header: bool = True, compression: str = "zstd", pretty: bool = False) -> None:
    """Write in the format asked for or that of the extension; text forms are ordered by position. ``pretty`` is for the JSON document."""
    form = output_format(path, explicit)
    if form == "compact":
        save(result, path, compression)
        return
    check_finite(result.positions)
    if form == "json":
        envelope(result, pretty).write.text(path)
    elif form == "jsonl":
        documents(result).orderBy("position").write.option("ignoreNullFields", "false").json(path)
    else:
        tsv(result).orderBy(F.col("position").cast("int")).write.option("sep", "\t").option("header", str(header).lower()).csv(path)


def hcs_json(found: DataFrame) -> DataFrame:
    """One row, ``value``: the conserved sequences of regions as a JSON array of strings, in order."""
    rows = found.agg(F.array_sort(F.collect_list(F.struct("region_id", "sequence"))).alias("x"))
    return rows.select(F.to_json(F.transform("x", lambda x: x["sequence"])).alias("value"))


def convert(spark: SparkSession, source: str, path: str, explicit: str | None = None, header: bool = True, pretty: bool = False) -> None:
    """Stored results to another form."""
    write(load(spark, source), path, explicit, header, pretty=pretty)
