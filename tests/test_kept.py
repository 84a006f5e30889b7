"""Counts kept in generations, row sets as bitmaps, and files told by their content."""

import bz2
import gzip
import lzma
import random

import pytest
import zstandard

from kmerloom.functions import kmers
from kmerloom.operators import metadata
from kmerloom.sources import compressed, fasta
from kmerloom.streaming import counts as streaming

SCHEMA = "seq_id long, header string, sequence string"


def put(spark, folder, i, seqs):
    spark.createDataFrame([(i, "h", s) for s in seqs], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_generations(spark, tmp_path):
    """Restarts, a batch that runs again, and leftovers change nothing; folders stay few."""
    r = random.Random(1)
    source, at, checkpoint = (str(tmp_path / n) for n in ("in", "kept", "checkpoint"))
    seqs = []

    def run(every=3):
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        streaming.keep_generations(rows, 3, at, checkpoint, every=every).awaitTermination()

    def check():
        want = {(x.position, x.kmer): x["count"] for x in kmers.count_kmers(spark.createDataFrame([(s,) for s in seqs], "sequence string"), 3).collect()}
        assert {(x.position, x.kmer): x["count"] for x in streaming.kept(spark, at).collect()} == want

    for part in range(2):
        for i in range(4):
            new = ["".join(r.choice("ACD") for _ in range(6)) for _ in range(20)]
            seqs += new
            put(spark, source, part * 4 + i, new)
        run()
        check()
    assert streaming._folders(spark, f"{at}/base", "upto") == [5] and streaming._folders(spark, f"{at}/deltas", "batch") == [6, 7]
    # a delta that was merged but not deleted is not counted twice, an unfinished generation not at all
    put(spark, f"{at}/deltas/batch=5", 0, ["AAAAAA"])
    spark.createDataFrame([(1, "AAA", 9)], "position int, kmer string, count long").write.parquet(f"{at}/base/upto=7")
    (tmp_path / "kept" / "base" / "upto=7" / "_SUCCESS").unlink()
    check()
    assert streaming.kept(spark, str(tmp_path / "nowhere")).count() == 0


def test_row_sets(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", None]), r.choice(["x", "y"])) for i in r.sample(range(200_000), 3000)] + [(None, "a", "x"), (0, "a", "x")]
    sets = metadata.row_sets(spark.createDataFrame(rows, "seq_id long, f string, g string"), ["f", "g"])
    size = lambda found: metadata.cardinality(found).first()[0]
    ids = lambda test: len({x[0] for x in rows if x[0] is not None and test(x)})
    assert size(metadata.intersected(sets, [("f", "a"), ("g", "x"), ("g", "x")])) == ids(lambda x: x[1] == "a" and x[2] == "x")
    assert size(metadata.united(sets, [("f", "a"), ("g", "x")])) == ids(lambda x: x[1] == "a" or x[2] == "x")
    assert size(metadata.intersected(sets, [("f", "a"), ("g", "no")])) == 0 and size(metadata.united(sets, [])) == 0 and size(metadata.intersected(sets, [])) == 0


def test_files_by_content(spark, tmp_path):
    text = "﻿stray\n>a one\r\nACD\r\n\r\nEF\r\n;note\n>\nXX\n>b\n" + "GH" * 5000 + "\n>c\n"
    want = {("a one", "ACDEF"), ("b", "GH" * 5000), ("c", "")}
    raw = text.encode()
    (tmp_path / "gz.txt").write_bytes(gzip.compress(raw[:40]) + gzip.compress(raw[40:]))
    (tmp_path / "noname").write_bytes(bz2.compress(raw))
    (tmp_path / "x.gz").write_bytes(lzma.compress(raw))
    (tmp_path / "z").write_bytes(zstandard.compress(raw[:40]) + zstandard.compress(raw[40:]))
    (tmp_path / "plain.xz").write_bytes(raw)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"no")
    found = compressed.read_by_content(spark, str(tmp_path))
    got = {}
    for x in found.collect():
        got.setdefault((x.file.rsplit("/", 1)[1], x.codec), set()).add((x.header, x.sequence))
    assert got == {k: want for k in (("gz.txt", "gzip"), ("noname", "bzip2"), ("x.gz", "xz"), ("z", "zstd"), ("plain.xz", "none"))}
    assert found.select("seq_id").distinct().count() == found.count() == 15
    assert compressed.read_by_content(spark, str(tmp_path / "x.gz")).count() == 3


def test_record_sizes_and_limits(spark, monkeypatch):
    none = spark.createDataFrame([], "seq_id long, header string, sequence string")
    assert tuple(fasta.record_sizes(none).first()) == (0, 0, 0)
    fasta.check_records(none, 0)
    rows = spark.createDataFrame([(1, "h\u00e9", None), (2, None, "ACD")], "seq_id long, header string, sequence string")
    assert tuple(fasta.record_sizes(rows).first()) == (2, 3, 3)
    with pytest.raises(ValueError, match="2 records"):
        fasta.check_records(rows, 1)
    monkeypatch.setattr(fasta, "MOST_SEQUENCE_BYTES", 2)
    with pytest.raises(ValueError, match="beyond the limits"):
        fasta.check_records(rows)
