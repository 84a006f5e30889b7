"""FASTA files and tables as aligned rows: (seq_id, header, sequence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_HEADER_BYTES, MOST_SEQUENCE_BYTES = 10 << 10, 100 << 20


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, at, place): pieces between line-start ">", with their file, where its split begins, and a number that rises in a split.
    Spark deals the same files to the same partitions whenever they are read in a session, so places of two readings agree."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("place"))


def strays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, place, key): what stands before the first ">" of a file, at most one row a file, told by its place; ``key`` is a hash of its text.

    Only a file's first piece can begin with ">", as the source takes that of all others. It is looked up by one aggregate next to the scan.
    """
    first = _pieces(spark, path).where("at = 0")
    body = F.regexp_replace("value", r"^[\x{FEFF}]?(?:;[^\n]*(?:\n|$)|\s+)*", "")
    head = first.groupBy("file").agg(F.min(F.struct("place", F.xxhash64("value").alias("key"), F.substring(body, 1, 1).alias("head"))).alias("x"))
    return head.where("x.head NOT IN ('>', '')").select("file", "x.place", "x.key")


def check_fasta(spark: SparkSession, path: str | list[str]) -> None:
    """Stop where files do not start as FASTA; the error names five of them."""
    found = [r["file"] for r in strays(spark, path).select("file").limit(5).collect()]
    if found:
        raise ValueError(f"no record starts these files: {', '.join(sorted(found))}")


def read_fasta(spark: SparkSession, path: str | list[str], line_breaks: str = "join", repartition: int | None = None, malformed: str = "skip") -> DataFrame:
    """Records of FASTA files, which the text source splits at line-start ">"; .gz, .bz2 and .zst by extension.

    Byte-order marks go, as do ";" comment lines and records without a header. Lines of a sequence are joined; ``line_breaks="keep"`` leaves
    their breaks in. gz and zst files are not splittable: ``repartition`` spreads what follows. seq_id rises within a split.
    What stands before the first ">" of a file is left out, or is an error with ``malformed="fail"``; either reads the files' starts once
    more, which ``malformed="trust"`` does not, for files known to be sound.
    """
    raw = _pieces(spark, path)
    if malformed == "fail":
        check_fasta(spark, path)
    elif malformed == "skip":
        bad = strays(spark, path).select(F.col("file").alias("__file"), F.col("place").alias("__place"), "key")
        raw = raw.join(bad, (F.col("at") == 0) & (F.col("file") == F.col("__file")) & (F.col("place") == F.col("__place")) & (F.xxhash64("value") == F.col("key")), "left_anti")
    if repartition:
        raw = raw.repartition(repartition)
    record = F.regexp_replace("value", r"^[\x{FEFF}]?(?:;[^\n]*\n)*>?", "")
    own = raw.select(F.col("place").alias("seq_id"), record.alias("r")).where("r <> ''")
    header = F.rtrim(F.substring_index("r", "\n", 1), F.lit("\r"))
    body = F.when(F.instr("r", "\n") > 0, F.expr("substring(r, instr(r, '\n') + 1)")).otherwise("")
    body = F.regexp_replace(body, r"(?m)^;[^\n]*\n?", "")
    sequence = F.regexp_replace(body, r"[\r\n]", "") if line_breaks == "join" else F.regexp_replace(body, r"[\r\n]+$", "")
    return own.select("seq_id", header.alias("header"), sequence.alias("sequence")).where(F.btrim("header", F.lit(" \t")) != "")


def skipped_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row: records without a header, and what stands before the first record of a file; ``read_fasta`` leaves both out."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^[\x{FEFF}]?(?:;[^\n]*\n)*>?", "").alias("r"))
    own = raw.agg(F.count_if((F.col("r") != "") & (F.btrim(F.substring_index("r", "\n", 1), F.lit(" \t\r")) == "")).alias("n"))
    both = own.unionByName(strays(spark, path).agg(F.count(F.lit(1)).alias("n")))
    return both.agg(F.sum("n").alias("skipped_records"))


def from_table(rows: DataFrame, header: str = "header", sequence: str = "sequence", seq_id: str | None = None) -> DataFrame:
    """Any table with a header and a sequence column; without an id column, rows get rising ids."""
    own = F.col(seq_id) if seq_id else F.monotonically_increasing_id()
    return rows.select(own.cast("long").alias("seq_id"), F.col(header).cast("string").alias("header"), F.col(sequence).cast("string").alias("sequence"))


def record_sizes(rows: DataFrame) -> DataFrame:
    """One row: records, and the bytes of the longest header and sequence (0 where there are none)."""
    longest = lambda c: F.coalesce(F.max(F.octet_length(c)), F.lit(0)).cast("long").alias(f"{c}_bytes")
    return rows.agg(F.count(F.lit(1)).alias("records"), longest("header"), longest("sequence"))


def check_records(rows: DataFrame, most_records: int | None = None) -> None:
    """Stop on oversized headers or sequences, and on more records than allowed, by one aggregate."""
    n, h, s = record_sizes(rows).first()
    if h > MOST_HEADER_BYTES or s > MOST_SEQUENCE_BYTES or most_records is not None and n > most_records:
        raise ValueError(f"{n} records, headers to {h} and sequences to {s} bytes: beyond the limits")
