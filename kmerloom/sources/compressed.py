"""Compressed FASTA told by its content, whatever the file is called: a Spark data source that decompresses while it reads.

Each file is a partition, as none of these codecs can be cut; files are opened by pyarrow's file systems, so they may lie in any store that
those reach. At most a record and a block of bytes are held at once.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kmerloom.ship import ship

# How compressed files begin.
MAGIC = {b"\x1f\x8b": "gzip", b"BZ": "bzip2", b"\xfd7zX": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
#: Characters of sequence in a batch of rows, about.
BATCH = 4 << 20


def codec_of(begin: bytes) -> str | None:
    """The codec of a file from its first bytes, None for plain text."""
    return next((name for magic, name in MAGIC.items() if begin.startswith(magic)), None)


def opened(raw, codec: str | None):
    """A stream of the plain bytes of an open file."""
    if codec == "gzip":
        return gzip.GzipFile(fileobj=raw)
    if codec == "bzip2":
        return bz2.BZ2File(raw)
    if codec == "xz":
        return lzma.LZMAFile(raw)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return raw


def packed(text: bytes, codec: str | None) -> bytes:
    """Text in a codec."""
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(text)
    return {"gzip": gzip.compress, "bzip2": bz2.compress, "xz": lzma.compress}.get(codec or "none", bytes)(text)


def packer(path: str, codecs: list[str]):
    """For groups of rows(n, header, sequence): writes each as the FASTA file ``part-<n>`` below ``path``, in the n-th codec. A task that runs again
    writes the same file."""

    def pack(rows: pa.Table) -> pa.Table:
        n = rows.column("n")[0].as_py()
        text = "".join(f">{h}\n{s}\n" for h, s in zip(rows.column("header").to_pylist(), rows.column("sequence").to_pylist(), strict=True))
        fs, at = pafs.FileSystem.from_uri(path)
        fs.create_dir(at)
        with fs.open_output_stream(f"{at}/part-{n}", compression=None) as out:
            out.write(packed(text.encode(), codecs[n]))
        return pa.table({"n": pa.array([n], pa.int32()), "records": pa.array([rows.num_rows], pa.int64())})

    return pack


def records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(header, sequence) of FASTA lines; what stands before the first header and records without one go, as do blank and ";" lines."""
    header, body = None, []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if header:
                yield header, "".join(body)
            header, body = line[1:], []
        elif header and line and not line.startswith(";"):
            body.append(line)
    if header:
        yield header, "".join(body)


class _File(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        fs, at = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(at)
        if found.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        return [_File(f.path) for f in sorted(files, key=lambda f: f.path) if f.is_file and f.size and not f.base_name.startswith((".", "_"))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.value) as raw:
            codec = codec_of(raw.read(4))
            raw.seek(0)
            lines = io.TextIOWrapper(io.BufferedReader(opened(raw, codec), 1 << 20) if codec == "zstd" else opened(raw, codec), encoding="utf-8-sig", newline="\n")
            rows, size = [], 0
            for header, sequence in records(lines):
                rows.append((partition.value, codec or "none", header, sequence))
                size += len(sequence)
                if size > BATCH or len(rows) >= 10_000:
                    yield self._batch(rows)
                    rows, size = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["file", "codec", "header", "sequence"])


class FastaSource(DataSource):
    """spark.read.format("fasta_by_content").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "fasta_by_content"

    def schema(self) -> str:
        return "file string, codec string, header string, sequence string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_by_content(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, file, codec, header, sequence) of the FASTA files at ``path``, a file or a folder: gzip, bzip2, xz, zstd or plain, by what they begin with."""
    ship(spark)
    spark.dataSource.register(FastaSource)
    found = spark.read.format("fasta_by_content").load(path)
    return found.select(F.monotonically_increasing_id().alias("seq_id"), "file", "codec", "header", "sequence")
