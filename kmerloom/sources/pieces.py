"""FASTA files read line by line: sequences longer than a task's string, and errors with line numbers.

The text source cuts files where it likes, so a split may begin inside a sequence. Every task cuts its lines into pieces of records, with
places counted from the split's start; a table of splits, whose sums run along each file, then says which record a split
began in, and how many characters and lines came before it. Pieces are sent to the chunks of their record that they meet, so that one
chromosome is windowed by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.functions.alphabet import PROTEIN, Alphabet
from kmerloom.functions.kmers import windows
from kmerloom.operators.ranks import with_place
from kmerloom.ship import ship
from kmerloom.sources.shared import stored

#: Characters of a chunk at which windows start.
CHUNK = 1 << 20
_PIECE = "file string, at long, number int, header string, line long, lines long, start long, length long, binary boolean, cut boolean, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of records: what a batch holds of each. ``number`` counts the headers of the split so far, 0 for what goes on from before it."""
    split, number, start, line = None, 0, 0, 0
    for b in batches:
        file, at = b.column(1), b.column(2).to_numpy()
        other = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | (at[1:] != at[:-1]) if b.num_rows else np.empty(0, bool)
        edges = [0, *(np.flatnonzero(other) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            if (file[lo].as_py(), int(at[lo])) != split:
                split, number, start, line = (file[lo].as_py(), int(at[lo])), 0, 0, 0
            raw = b.column(0).slice(lo, hi - lo)
            if line == 0 and at[lo] == 0 and raw[0].as_py().startswith("﻿"):
                raw = pa.concat_arrays([pa.array([raw[0].as_py()[1:]], raw.type), raw.slice(1)])
            rows = pc.utf8_trim_whitespace(raw)
            is_header = pc.starts_with(rows, ">")
            # a sequence is the text between two headers: its lines lie side by side in the buffer once other lines are empty
            body = pc.if_else(pc.or_(is_header, pc.starts_with(rows, ";")), "", rows).cast(pa.large_string())
            heads = np.flatnonzero(is_header.to_numpy(zero_copy_only=False))
            cuts = np.concatenate([[0], heads, [len(rows)]])
            offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1][cuts]
            text = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), body.buffers()[2]).cast(pa.string())
            length = pc.utf8_length(text).to_numpy().astype(np.int64)
            n = len(length)
            starts = np.zeros(n, np.int64)
            starts[0] = start
            names = pa.concat_arrays([pa.nulls(1, pa.string()), pc.utf8_slice_codeunits(rows.take(pa.array(heads)), 1).cast(pa.string())])
            nul = np.add.reduceat(np.append(pc.match_substring(raw, "\0").to_numpy(zero_copy_only=False), False), np.minimum(cuts[:-1], len(rows))) > 0
            columns = [
                pa.array([split[0]] * n),
                pa.array(np.full(n, split[1])),
                pa.array((number + np.arange(n)).astype(np.int32)),
                names,
                pa.array(line + cuts[:-1] + 1),
                pa.array(np.diff(cuts)),
                pa.array(starts),
                pa.array(length),
                pa.array(nul),
                # records between others of a batch are whole: what is next to its ends may go on
                pa.array((np.arange(n) == 0) | (np.arange(n) == n - 1)),
                text,
            ]
            out = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PIECE.split(", ")])
            # an empty first piece says nothing
            yield out.slice(0 if cuts[1] > 0 else 1)
            number, start, line = number + n - 1, int(starts[-1] + length[-1]), line + len(rows)


@dataclass(frozen=True)
class Pieces:
    """``pieces(file, record, header, line, start, length, binary, cut, text)``: header only where the record begins, ``line`` the number in the file of the
    piece's first line, ``start`` its place in the record from 0, ``cut`` false where the piece is known to be a whole record. A null record is text before the
    first header of a file."""

    pieces: DataFrame

    def records(self) -> DataFrame:
        """(record, header, line, length), a row each; the texts are not read, and only records that may be cut are gathered."""
        own = self.pieces.where("record IS NOT NULL")
        gathered = own.where("cut").groupBy("record").agg(F.max("header").alias("header"), F.min("line").alias("line"), F.sum("length").alias("length"))
        return own.where("NOT cut").select("record", "header", "line", "length").unionByName(gathered)


def folder(file: str) -> Column:
    return F.regexp_replace(file, "/[^/]*$", "")


def read_pieces(spark: SparkSession, path: str | list[str], parts: bool = False) -> Pieces:
    """The records of FASTA files in pieces, written. Blank and ";" lines, blanks around lines and byte-order marks go. A record is told by its
    file, its split's start, and its number there, in the order of the file.

    With ``parts`` the files of a folder, in the order of their names, are one file that many tasks wrote: it has the folder's name, records and line
    numbers go on from part to part, and splits are told by their number. Parts end with a line break, as Spark's own do.
    """
    ship(spark)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    held = stored(lines.mapInArrow(_cut, _PIECE), "pieces")
    # a split's last record is cut, so whole ones need no group of their own
    each = held.groupBy("file", "at", F.when(F.col("cut"), F.col("number")).alias("number")).agg(F.max("number").alias("headers"), F.sum("length").alias("n"), F.sum("lines").alias("lines"))
    splits = each.groupBy("file", "at").agg(F.max("headers").alias("headers"), F.max_by("n", "number").alias("tail"), F.sum("lines").alias("lines"))
    # a row for each split: sums along a file run over its splits alone
    line = Window.partitionBy("of").orderBy("file", "at")
    splits = splits.withColumn("of", folder("file") if parts else F.col("file")).withColumn("split", F.row_number().over(line).cast("long") if parts else F.col("at"))
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    sums = splits.withColumn("chars", F.coalesce(F.sum("tail").over(past), F.lit(0))).withColumn("above", F.coalesce(F.sum("lines").over(past), F.lit(0)))
    owner = F.last(F.when(F.col("headers") > 0, F.struct(F.col("split").alias("at"), "headers", "chars")), True).over(past)
    sums = stored(sums.withColumn("owner", owner).select("file", "at", "of", "split", "above", "owner", (F.col("chars") - F.col("owner.chars")).alias("base")), "splits")
    goes_on = F.col("number") == 0
    record = F.when(goes_on, F.when(F.col("owner").isNotNull(), F.struct(F.col("of").alias("file"), F.col("owner.at").alias("at"), F.col("owner.headers").alias("number")))).otherwise(F.struct(F.col("of").alias("file"), F.col("split").alias("at"), "number"))
    start = F.col("start") + F.when(goes_on, F.coalesce("base", F.lit(0))).otherwise(0)
    # the driver, which plans the splits, has as many rows
    joined = held.join(F.broadcast(sums), ["file", "at"])
    return Pieces(joined.select(F.col("of").alias("file"), record.alias("record"), "header", (F.col("above") + F.col("line")).alias("line"), start.alias("start"), "length", "binary", "cut", "text"))


def chunks(own: Pieces, k: int, size: int = CHUNK) -> DataFrame:
    """(record, start, sequence): chunks of ``size`` + k - 1 characters, every ``size`` characters, so that each window lies whole in the one chunk
    where it starts. Pieces are sent to the chunks that they meet; a task gathers a chunk, never a sequence."""
    begin, end = F.col("start"), F.col("start") + F.col("length")
    first = F.greatest(F.floor((begin - (k - 1)) / size), F.lit(0).cast("long"))
    met = own.pieces.where("record IS NOT NULL AND length > 0").select("record", "start", "length", "text", F.explode(F.sequence(first, F.floor((end - 1) / size))).alias("chunk"))
    low = F.greatest(begin, F.col("chunk") * size)
    high = F.least(end, F.col("chunk") * size + size + k - 1)
    part = F.substring("text", (low - begin + 1).cast("int"), (high - low).cast("int"))
    parts = met.select("record", "chunk", F.struct(low.alias("at"), part.alias("part")).alias("x"))
    whole = parts.groupBy("record", "chunk").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select("record", (F.col("chunk") * size).alias("start"), F.array_join("x.part", "").alias("sequence"))


def chunks_of(rows: DataFrame, k: int, size: int = CHUNK) -> DataFrame:
    """The same for ``rows(seq_id, sequence)`` of a table: (seq_id, start, sequence)."""
    own = rows.where(F.length("sequence") > 0)
    each = own.select("seq_id", "sequence", F.explode(F.sequence(F.lit(0), F.floor((F.length("sequence") - 1) / size))).alias("chunk"))
    cut = F.substring("sequence", (F.col("chunk") * size + 1).cast("int"), F.lit(size + k - 1))
    return each.select("seq_id", (F.col("chunk") * size).alias("start"), cut.alias("sequence"))


def count_chunks(cut: DataFrame, k: int, a: Alphabet = PROTEIN) -> DataFrame:
    """(position, kmer, count) from chunks that overlap by k - 1: what ``count_kmers`` counts of the whole sequences."""
    each = windows(cut, k, a, ("start",)).select((F.col("start") + F.col("position")).alias("position"), "kmer")
    return each.groupBy("position", "kmer").agg(F.count(F.lit(1)).alias("count"))


def errors(own: Pieces) -> DataFrame:
    """(file, error_type, line_number, sequence_number, length, expected), a row for each error of the files.

    ``binary_file`` at lines of pieces that hold null bytes; ``no_headers`` for text before a file's first header; ``empty_sequence`` at the header's line;
    ``length_mismatch`` for sequences, numbered along a file without the empty ones, that differ from the file's first.
    """
    none = lambda t: F.lit(None).cast(t)
    row = lambda kind, number=None, length=None, expected=None: (F.lit(kind).alias("error_type"), F.col("line").alias("line_number"), (number if number is not None else none("long")).alias("sequence_number"), (length if length is not None else none("long")).alias("length"), (expected if expected is not None else none("long")).alias("expected"))
    records = stored(own.records().select(F.col("record.file").alias("file"), "record.at", "record.number", "line", "length"), "records")
    full = records.where("length > 0")
    full = with_place(full, ["file"], [F.col("at"), F.col("number")], n=full.count())
    full = stored(full, "numbered")
    expected = full.where("place = 1").select(F.col("file").alias("of"), F.col("length").alias("expected"))
    # a row for each file, which the driver lists: the records of a file stay in many tasks
    wrong = full.join(F.broadcast(expected), (F.col("file") == F.col("of")) & (F.col("length") != F.col("expected")))
    stray = own.pieces.where("record IS NULL AND length > 0").groupBy("file").agg(F.min("line").alias("line"))
    binary = own.pieces.where("binary").select("file", "line")
    out = records.where("length = 0").select("file", *row("empty_sequence"))
    out = out.unionByName(wrong.select("file", *row("length_mismatch", F.col("place"), F.col("length"), F.col("expected"))))
    return out.unionByName(binary.select("file", *row("binary_file"))).unionByName(stray.select("file", *row("no_headers")))


def first_errors(found: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` errors of each kind by file and line."""
    return found.withColumn("r", F.row_number().over(Window.partitionBy("error_type").orderBy("file", "line_number"))).where(F.col("r") <= n).drop("r")
