"""Profiling and validation of input."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.functions.alphabet import PROTEIN, Alphabet, class_counts
from kmerloom.functions.kmers import windows
from kmerloom.operators.ranks import with_place
from kmerloom.sources import pieces
from kmerloom.sources.shared import stored

# Characters that decide between alphabets.
NUCLEOTIDES = "ACGTUNRYSWKMBDHV"
PROTEIN_ONLY = "EFIJLPQXZ"
SKIPPED = "-.*"


def character_stats(rows: DataFrame, k: int, a: Alphabet = PROTEIN) -> DataFrame:
    """One row over sequences of at least k characters: characters by class with percentages to 0.1, and invalidated k-mers."""
    own = rows.where(F.length("sequence") >= k)
    cls = class_counts(F.col("sequence"), a)
    sums = own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"{n}_chars") for n, c in cls.items()], F.coalesce(F.sum(F.length("sequence") - (k - 1)), F.lit(0)).alias("__windows"))
    fine = windows(own, k, a, keep=()).agg(F.count(F.lit(1)).alias("__fine"))
    share = lambda n: F.when(F.col("total_chars") > 0, F.round(F.col(f"{n}_chars") / F.col("total_chars") * 100, 1)).otherwise(0.0).alias(f"{n}_percent")
    names = [f"{n}_chars" for n in cls]
    return sums.crossJoin(F.broadcast(fine)).select(*names, (F.col("__windows") - F.col("__fine")).alias("invalidated_kmers"), *[share(n) for n in cls if n != "total"])


def detect_alphabet(rows: DataFrame, sample: int | None = 10) -> DataFrame:
    """One row: alphabet of the first ``sample`` sequences (None: all): protein from over 1 % of characters that only proteins have,
    else nucleotide from over 90 % of nucleotide characters, else protein; unknown without characters."""
    own = rows.select("seq_id", "sequence")
    own = own if sample is None else own.orderBy("seq_id").limit(sample)
    return own.agg(*_letters("sequence")).select(_alphabet().alias("alphabet"))


def _letters(text: str) -> list[Column]:
    """Sums over texts of what decides between alphabets: ``n`` characters, ``nt`` of nucleotides, ``aa`` that only proteins have."""
    s = F.regexp_replace(F.upper(text), r"[\-.*]", "")
    count = lambda chars: F.sum(F.length(s) - F.length(F.regexp_replace(s, f"[{chars}]", "")))
    return [F.coalesce(F.sum(F.length(s)), F.lit(0)).alias("n"), count(NUCLEOTIDES).alias("nt"), count(PROTEIN_ONLY).alias("aa")]


def _alphabet() -> Column:
    n = F.coalesce("n", F.lit(0))
    return F.when(n == 0, "unknown").when(F.col("aa") / n > 0.01, "protein").when(F.col("nt") / n > 0.9, "nucleotide").otherwise("protein")


def report(rows: DataFrame, offenders: int = 5, samples: int = 3) -> DataFrame:
    """One row: is_valid, sequence_count, sequence_length, sample_headers, alphabet, empty_sequences, length_mismatches and the first of
    them. Lists are the first rows by seq_id; everything else is aggregated."""
    first = rows.agg(F.min_by(F.length("sequence"), F.when(F.length("sequence") > 0, F.col("seq_id"))).alias("expected"))
    own = rows.crossJoin(F.broadcast(first))
    wrong = (F.length("sequence") > 0) & (F.length("sequence") != F.col("expected"))
    sums = own.agg(F.count(F.lit(1)).alias("sequence_count"), F.max("expected").alias("sequence_length"), F.count_if(F.length("sequence") == 0).alias("empty_sequences"), F.count_if(wrong).alias("length_mismatches"))
    listed = lambda df, n, name: df.orderBy("seq_id").limit(n).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq_id", "header"))), lambda x: x["header"]).alias(name))
    out = sums.crossJoin(listed(rows, samples, "sample_headers")).crossJoin(listed(own.where(wrong), offenders, "first_mismatches")).crossJoin(detect_alphabet(rows))
    valid = (F.col("sequence_count") > 0) & (F.col("empty_sequences") == 0) & (F.col("length_mismatches") == 0)
    return out.select(F.coalesce(valid, F.lit(False)).alias("is_valid"), "sequence_count", "sequence_length", "sample_headers", "alphabet", "empty_sequences", "length_mismatches", "first_mismatches")


_ERROR = "struct<error_type string, message string, line_number bigint>"
_REPORT = f"file string, is_valid boolean, sequence_count bigint, sequence_length bigint, sample_headers array<string>, alphabet string, errors array<{_ERROR}>, file_size_bytes bigint, file_modified_at timestamp"


def report_files(spark: SparkSession, path: str | list[str], offenders: int = 5, samples: int = 3, texts: int = 10, parts: bool = False) -> DataFrame:
    """A row for each FASTA file: file, is_valid, sequence_count, sequence_length, sample_headers, alphabet, errors(error_type, message, line_number),
    file_size_bytes, file_modified_at.

    Sequences are the records with characters, ``sequence_length`` is that of a file's first, ``alphabet`` that of its first ``texts``. A path without
    files is ``file_not_found``; a file with null bytes is ``binary_file`` (at the first line of a piece that holds one), one without header lines, or
    without anything, ``no_headers``, one whose records are all empty ``no_sequences``: these have that one error, and neither
    sequences nor headers. Else come, by line, ``text_before_header``, the first ``offenders`` of ``empty_sequence`` (at the header's line; a file's last record too) and of
    ``length_mismatch``; how many more there are of either stands last. Files are read once, line by line, and long ones by many tasks; records and
    errors get places in order, of which the first are kept. With ``parts`` the files of a folder are the parts of one (``pieces.read_pieces``).
    """
    paths = [path] if isinstance(path, str) else list(path)
    lost = [p for p in paths if not _exists(spark, p)]
    missing = spark.createDataFrame([(p, False, 0, None, [], "unknown", [("file_not_found", f"No such file: {p}", None)], 0, None) for p in lost], _REPORT)
    paths = [p for p in paths if p not in lost]
    if not paths:
        return missing
    meta = F.col("_metadata")
    listed = spark.read.format("binaryFile").load(paths)
    # the source's own listing, which it holds on the driver, has empty files too; a scan leaves them out
    # the listing writes an empty authority out, the metadata column does not
    names = [re.sub(r"^([A-Za-z][\w+.-]*):///", r"\1:/", f) for f in listed.inputFiles()]
    every = spark.createDataFrame([(f,) for f in names], "file string")
    files = listed.select(meta["file_path"].alias("file"), meta["file_size"].alias("file_size_bytes"), meta["file_modification_time"].alias("file_modified_at"))
    files = every.join(files, "file", "left").withColumn("file_size_bytes", F.coalesce("file_size_bytes", F.lit(0).cast("long")))
    if parts:
        files = files.groupBy(pieces.folder("file").alias("file")).agg(F.sum("file_size_bytes").alias("file_size_bytes"), F.max("file_modified_at").alias("file_modified_at"))
    own = pieces.read_pieces(spark, paths, parts)
    order = [F.col("record.at"), F.col("record.number")]
    each = stored(own.records().select(F.col("record.file").alias("file"), "record", "header", "line", "length", (F.col("length") > 0).alias("full")), "records")
    # places among a file's full records and among its empty ones; headers have places of their own
    placed = stored(with_place(each, ["file", "full"], order, n=each.count()), "placed")
    # the first of all are among the first of either
    early = placed.where(F.col("place") <= samples)
    heads = early.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy(*order))).where(F.col("r") <= samples)
    sampled = heads.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "header"))), lambda x: x["header"]).alias("sample_headers"))
    first = placed.where("full AND place = 1").select("file", F.col("length").alias("sequence_length"))
    counts = placed.groupBy("file").agg(F.count_if("full").alias("sequence_count"), F.count(F.lit(1)).alias("records"))
    some = placed.where(F.col("full") & (F.col("place") <= texts)).select("record")
    letters = own.pieces.join(F.broadcast(some) if texts * len(names) <= 100_000 else some, "record").groupBy("file").agg(*_letters("text"))
    # one row a file is sent: the records of a file stay in many tasks
    wrong = placed.where("full").join(F.broadcast(first), "file").where("length <> sequence_length").select("file", "line", F.col("place").alias("number"), "length", "sequence_length")
    wrong = stored(with_place(wrong, ["file"], [F.col("line")], n=wrong.count()), "wrong")
    said = F.format_string("Sequence %d has length %d, expected %d: sequences of an alignment have one length", "number", "length", "sequence_length")
    nothing = F.format_string("Empty sequence for the header at line %d", "line")
    kinds = [
        _first_of(wrong.select("file", "line", "place", said.alias("message")), "length_mismatch", "length mismatches", offenders),
        _first_of(placed.where("NOT full").select("file", "line", "place", nothing.alias("message")), "empty_sequence", "empty sequences", offenders),
        own.pieces.where("record IS NULL AND length > 0").groupBy("file").agg(F.min("line").alias("line")).select("file", F.lit("text_before_header").alias("error_type"), F.lit("Text before the first header").alias("message"), "line"),
    ]
    rank = F.when(F.col("line").isNull(), 1).otherwise(0)
    told = reduce(DataFrame.unionByName, kinds).groupBy("file").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "line", "error_type", "message"))).alias("e"))
    binary = own.pieces.where("binary").groupBy("file").agg(F.min("line").alias("binary_line"))
    out = files
    for part in (counts, first, sampled, letters, told, binary):
        out = out.join(part, "file", "left")
    one = lambda kind, message, line=None: F.array(F.struct(F.lit(kind).alias("error_type"), F.lit(message).alias("message"), (F.lit(None) if line is None else F.col(line)).cast("long").alias("line_number")))
    errors = F.transform("e", lambda x: F.struct(x["error_type"].alias("error_type"), x["message"].alias("message"), x["line"].alias("line_number")))
    fatal = F.when(F.col("binary_line").isNotNull(), one("binary_file", "The file holds null bytes; FASTA files are plain text", "binary_line"))
    fatal = fatal.when(F.col("records").isNull(), one("no_headers", "No header lines, which start with '>'")).when(F.col("sequence_count") == 0, one("no_sequences", "No sequences"))
    fine = fatal.isNull()
    out = out.select(
        "file",
        (fine & F.col("e").isNull()).alias("is_valid"),
        F.when(fine, F.col("sequence_count")).otherwise(0).alias("sequence_count"),
        F.when(fine, F.col("sequence_length")).alias("sequence_length"),
        F.when(fine, F.col("sample_headers")).otherwise(F.array().cast("array<string>")).alias("sample_headers"),
        F.when(fine, _alphabet()).otherwise("unknown").alias("alphabet"),
        F.coalesce(fatal, errors, F.array().cast(f"array<{_ERROR}>")).alias("errors"),
        "file_size_bytes",
        "file_modified_at",
    )
    return out.unionByName(missing) if lost else out


def _first_of(found: DataFrame, kind: str, name: str, n: int) -> DataFrame:
    """(file, error_type, message, line) of the first n rows(file, line, place, message) of each file, and one without a line that says how many more there are."""
    first = found.where(F.col("place") <= n)
    more = found.groupBy("file").agg((F.count(F.lit(1)) - n).alias("more")).where("more > 0")
    rest = more.select("file", F.lit(kind).alias("error_type"), F.format_string(f"... and %d more {name}", "more").alias("message"), F.lit(None).cast("long").alias("line"))
    return first.select("file", F.lit(kind).alias("error_type"), "message", "line").unionByName(rest)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0
