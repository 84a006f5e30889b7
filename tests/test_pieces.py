"""Long sequences over many splits, FASTA errors, intervals of uneven length, mappings by runs."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import kmers
from kmerloom.operators import features, ranks, validate
from kmerloom.sources import fasta, pieces
from kmerloom.sources.shared import together


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def wrapped(r, records, width=50):
    """FASTA text with comments, blank lines and CRLF here and there."""
    out = []
    for name, seq in records:
        out.append(">" + name)
        for i in range(0, len(seq), width):
            out += [seq[i : i + width]] + ([";note"] if r.random() < 0.02 else [""] if r.random() < 0.02 else [])
    return "".join(x + r.choice(["\n", "\n", "\r\n"]) for x in out)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [7, 1000, 1 << 20])
def test_long_sequences(spark, tmp_path, small_splits, size):
    """Counts equal to the plain form, with sequences over many splits and splits with many sequences."""
    r = random.Random(size)
    long = ["".join(r.choice("ACDEFGHIKL-X") for _ in range(n)) for n in ((300, 40, 0, 3, 900) if size < 10 else (30000, 40, 0, 3, 9000, 17, 5000))]
    (tmp_path / "a.fasta").write_text("﻿" + wrapped(r, [(f"s{i}", s) for i, s in enumerate(long)]))
    (tmp_path / "b.fasta").write_text("stray\nlines\n" + wrapped(r, [("t", long[0][::-1]), ("u", "")]))
    (tmp_path / "c.fasta").write_text("")
    own = pieces.read_pieces(spark, str(tmp_path))
    got = Counter((re.sub(".*/", "", x.record.file), x.header, x.length) for x in own.records().collect())
    assert got == Counter([("a.fasta", f"s{i}", len(s)) for i, s in enumerate(long)] + [("b.fasta", "t", len(long[0])), ("b.fasta", "u", 0)])
    assert size < 10 or own.pieces.select("file", "record").distinct().count() < own.pieces.count()
    cut = pieces.chunks(own, 3, size)
    assert cut.where(F.length("sequence") > size + 2).count() == 0
    whole = kmers.count_kmers(spark.createDataFrame([(s,) for s in [*long, long[0][::-1]]], "sequence string"), 3)
    want = {(x.position, x.kmer): x["count"] for x in whole.collect()}
    assert {(x.position, x.kmer): x["count"] for x in pieces.count_chunks(cut, 3).collect()} == want
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([*long, long[0][::-1], None])], "seq_id long, sequence string")
    assert {(x.position, x.kmer): x["count"] for x in pieces.count_chunks(pieces.chunks_of(rows, 3, size), 3).collect()} == want


def test_one_sequence_over_many_tasks(spark, tmp_path):
    """Ten million characters in one record are read, cut and windowed by many tasks."""
    block = "ACDEFGHIKLMNPQRSTVWY" * 5
    (tmp_path / "x.fasta").write_text(">one\n" + (block + "\n") * 100_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
    try:
        own = pieces.read_pieces(spark, str(tmp_path))
        cut = pieces.chunks(own, 9, 1 << 18)
        assert own.records().collect()[0].length == 10_000_000
        assert own.pieces.select(F.col("start")).count() > 10
        sizes = [(x.start, x.n) for x in cut.select("start", F.length("sequence").alias("n")).orderBy("start").collect()]
        assert len(sizes) == 39 and all(n == (1 << 18) + 8 for _, n in sizes[:-1]) and sizes[-1][0] + sizes[-1][1] == 10_000_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_errors(spark, tmp_path, small_splits):
    r = random.Random(3)
    lines, want, number = ["lost text"], [], 0
    want.append(("no_headers", 1, None, None))
    for i in range(900):
        n = 0 if r.random() < 0.02 else 15 if r.random() < 0.02 and i else 20
        lines.append(f">r{i}")
        at = len(lines)
        if r.random() < 0.1:
            lines.append("; comment")
        if n:
            number += 1
            lines += ["A" * 12, "A" * (n - 12)]
            if n != 20:
                want.append(("length_mismatch", at, number, n))
        else:
            want.append(("empty_sequence", at, None, None))
    (tmp_path / "x.fasta").write_text("\n".join(lines))
    found = pieces.errors(pieces.read_pieces(spark, str(tmp_path)))
    assert Counter((x.error_type, x.line_number, x.sequence_number, x.length) for x in found.collect()) == Counter(want)
    first = pieces.first_errors(found).where("error_type = 'length_mismatch'")
    assert sorted(x.line_number for x in first.collect()) == sorted(x[1] for x in want if x[0] == "length_mismatch")[:5]
    (tmp_path / "y.fasta").write_bytes(b">a\nAC\0D\n")
    binary = pieces.errors(pieces.read_pieces(spark, str(tmp_path / "y.fasta"))).collect()
    assert [x.error_type for x in binary] == ["binary_file"]


@pytest.mark.parametrize("hot", [1 << 17, 30])
def test_meeting_is_brute_force(spark, hot):
    r = random.Random(hot)

    def some(n):
        out = []
        for i in range(n):
            lo = r.randrange(1, 5000)
            out.append((i, lo, lo + r.choice([0, 0, 3, 60, 63, 64, 65, 1000, 10**9]) if r.random() < 0.9 else lo - 1))
        return out

    a, b = some(150), some(200)
    frames = [spark.createDataFrame(x, "i int, lo long, hi long") for x in (a, b)]
    both = features.meeting(*frames, hot=hot)
    want = Counter((i, j) for i, lo, hi in a for j, x, y in b if lo <= hi and x <= y and lo <= y and x <= hi)
    assert Counter((x.a.i, x.b.i) for x in both.collect()) == want
    assert ("salt" in plan(both)) == (hot == 30)
    assert features.meeting(frames[0], frames[1].limit(0)).count() == 0 and features.meeting(frames[0].limit(0), frames[1]).count() == 0


def test_long_intervals_emit_few_rows(spark):
    one = spark.createDataFrame([(0, 10**9, 6), (5, 5, 6)], "lo long, hi long, level int").withColumn("level", F.when(F.col("hi") > 5, 30).otherwise(6))
    counts = features.emitted(one, list(range(6, 41))).groupBy("lo").count().collect()
    assert all(x["count"] < 100 for x in counts)


def test_mapping_follows_runs(spark):
    to = spark.createDataFrame([(i, i + 5) for i in range(1, 2001) if i % 100], "residue int, structure_residue int")
    msa = spark.createDataFrame([(i + 40, i) for i in range(1, 3000)], "msa_position int, structure_residue int")
    runs = features.mapping_runs(to, msa)
    assert runs.count() == 20
    own = spark.createDataFrame([(1, "DOMAIN", 1, 10**9), (2, "REGION", 100, 100), (3, "SITE", 1, 2), (4, "MOTIF", 150, 260)], "feature_id long, feature_type string, begin int, end int")
    got = {x.feature_id: (x.msa_begin, x.msa_end) for x in features.map_features(own, to, msa).collect()}
    assert got == {1: (46, 2044), 2: (None, None), 4: (195, 305)}


def test_compressed_names_are_plain(spark, tmp_path):
    """What read_fasta and the pieces say of the same file."""
    (tmp_path / "a.fasta").write_text(">a\nACD\nEF\n>b\nGH\n")
    rows = {(x.header, len(x.sequence)) for x in fasta.read_fasta(spark, str(tmp_path)).collect()}
    assert rows == {(x.header, x.length) for x in pieces.read_pieces(spark, str(tmp_path)).records().collect()}


def test_report_of_files(spark, tmp_path):
    """One row a file: what is wrong, where, and how much more of it there is."""
    texts = {
        "sound": "﻿>a\nACGT\n;note\n>b\nAC\nGT\n",
        "uneven": ">a\nMKVF\n" + "".join(f">r{i}\nMKV\n" for i in range(7)) + ">last\n",
        "stray": "MKV\n>a\nMKVF\n",
        "binary": ">a\nMK\0V\n",
        "plain": "no header\nat all\n",
        "hollow": ">a\n>b\n\n",
        "nothing": "",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    lost = str(tmp_path / "lost")
    own = {r["file"].rsplit("/", 1)[-1]: r for r in validate.report_files(spark, [str(tmp_path), lost]).collect()}
    kinds = {n: [(e["error_type"], e["line_number"]) for e in r["errors"]] for n, r in own.items()}
    assert kinds == {
        "sound": [],
        "uneven": [("length_mismatch", 3 + 2 * i) for i in range(5)] + [("empty_sequence", 17), ("length_mismatch", None)],
        "stray": [("text_before_header", 1)],
        "binary": [("binary_file", 1)],
        "plain": [("no_headers", None)],
        "hollow": [("no_sequences", None)],
        "nothing": [("no_headers", None)],
        "lost": [("file_not_found", None)],
    }
    assert [n for n, r in own.items() if r["is_valid"]] == ["sound"]
    assert own["uneven"]["errors"][-1]["message"] == "... and 2 more length mismatches"
    assert (own["uneven"]["sequence_count"], own["uneven"]["sequence_length"], own["uneven"]["sample_headers"]) == (8, 4, ["a", "r0", "r1"])
    assert (own["sound"]["alphabet"], own["uneven"]["alphabet"], own["plain"]["alphabet"]) == ("nucleotide", "protein", "unknown")
    assert own["sound"]["file_size_bytes"] == len(texts["sound"].encode()) and own["lost"]["file_modified_at"] is None
    assert [r["errors"][0]["error_type"] for r in validate.report_files(spark, lost).collect()] == ["file_not_found"]


def test_together(spark):
    """Results come in the order of the jobs, and an error of any is raised."""
    assert together(spark, lambda: spark.range(3).count(), lambda: spark.range(5).count()) == [3, 5]
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: 1, lambda: 1 // 0)


def test_meeting_of_nothing(spark):
    """A side without intervals, or with none that is sound, gives no pairs."""
    some = spark.createDataFrame([(1, 5), (7, 9)], "lo int, hi int")
    none = spark.createDataFrame([], "lo int, hi int")
    wrong = spark.createDataFrame([(9, 2)], "lo int, hi int")
    for a, b in ((some, none), (none, some), (none, none), (some, wrong)):
        assert features.meeting(a, b).count() == 0
    assert features.meeting(some, some).count() == 2


def test_tree_sums_are_brute_force(spark, monkeypatch):
    """Sums over what a range holds, and over what holds a point, below zero too, with joined and with sent levels."""
    r = random.Random(8)
    monkeypatch.setattr(features, "SENT", 3)
    ranges = {(lo, lo + r.choice([-1, 0, 1, 7, 8, 9, 500, 10**9])) for lo in (r.randrange(-900, 900) for _ in range(150))}
    points = [(r.randrange(-1000, 1000), i) for i in range(300)]
    how = {"n": F.sum, "low": F.min, "high": F.max}
    held = spark.createDataFrame(points, "at long, low long").selectExpr("at", "1L AS n", "low", "low AS high")
    got = {(x.lo, x.hi): (x.n, x.low, x.high) for x in features.sums_within(spark.createDataFrame(list(ranges), "lo long, hi long"), held, how).collect()}
    inside = {(lo, hi): [i for at, i in points if lo <= at <= hi] for lo, hi in ranges}
    assert got == {k: (len(v), min(v), max(v)) for k, v in inside.items() if v}
    spans = [(lo, hi, i) for i, (lo, hi) in enumerate(sorted(ranges)) for _ in range(2)]
    over = spark.createDataFrame(spans, "lo long, hi long, low long").selectExpr("lo", "hi", "1L AS n", "low", "low AS high")
    got = {x.at: (x.n, x.low, x.high) for x in features.sums_over(held.select("at").distinct(), over, how).collect()}
    around = {at: [i for lo, hi, i in spans if lo <= at <= hi] for at, _ in points}
    assert got == {k: (len(v), min(v), max(v)) for k, v in around.items() if v}
    assert features.sums_within(spark.createDataFrame(list(ranges), "lo long, hi long"), held.limit(0), how).count() == 0


def test_overlap_sums_build_no_pairs(spark, monkeypatch):
    """200 million pairs are counted without the join that gives them; features without overlaps have none, repeated ids one."""
    n = 20_000
    regions = spark.range(n).selectExpr("id AS region_id", "cast(id AS int) AS start_position", "cast(id AS int) AS end_position")
    long = spark.range(n // 2).selectExpr("id AS feature_id", "cast(-id AS int) AS msa_begin", "cast(id + 1000000 AS int) AS msa_end")
    more = spark.createDataFrame([(-1, 10, 12), (-1, 14, 14), (-2, 30_000, 30_001), (-3, 12, 10), (-4, 20_001, 20_001)], "feature_id long, msa_begin int, msa_end int")
    got = {x.feature_id: (x.regions, x.first_region, x.last_region) for x in features.overlap_sums(regions, long.unionByName(more), 3).collect()}
    assert got == {i: (n, 0, n - 1) for i in range(n // 2)} | {-1: (5 + 3, 8, 14), -4: (1, n - 1, n - 1)}


def test_mapping_meets_no_pairs(spark, monkeypatch):
    """Features over all of a mapping whose runs are single residues: as many pairs as features times residues."""
    monkeypatch.setattr(features, "meeting", None)
    n = 20_000
    to = spark.range(1, n + 1).selectExpr("cast(id AS int) AS residue", "cast(id + 5 AS int) AS structure_residue")
    msa = spark.range(1, n + 1).selectExpr("cast(3 * id AS int) AS msa_position", "cast(id + 5 AS int) AS structure_residue")
    own = spark.range(n // 2).selectExpr("id AS feature_id", "'DOMAIN' AS feature_type", "cast(id + 1 AS int) AS begin", "cast(id + 1000000 AS int) AS `end`")
    got = {x.feature_id: (x.msa_begin, x.msa_end) for x in features.map_features(own, to, msa).collect()}
    assert got == {i: (3 * i + 3, 3 * n) for i in range(n // 2)}


def test_parts_are_one_file(spark, tmp_path, small_splits):
    """Errors and reports of a file that many tasks wrote are those of the file in one piece, records over the ends of parts too."""
    r = random.Random(12)
    lines = ["lost text"] + [x for i in range(600) for x in (f">r{i}", *(["; note"] if i % 7 == 0 else []), *([] if i % 50 == 3 else ["MKVLQE", "F"] if i % 40 == 9 else ["MKVLQEFP", "IW"]))]
    whole, cut = tmp_path / "whole" / "f=0", tmp_path / "cut" / "f=0"
    for at in (whole, cut):
        at.mkdir(parents=True)
    (whole / "part-00000").write_text("\n".join(lines) + "\n")
    ends = [0, *sorted(r.sample(range(1, len(lines)), 12)), len(lines)]
    for i in reversed(range(13)):
        (cut / f"part-{i:05d}").write_text("".join(x + "\n" for x in lines[ends[i] : ends[i + 1]]))
    found = [sorted(map(repr, pieces.errors(pieces.read_pieces(spark, str(at.parent), parts=True)).drop("file").collect())) for at in (whole, cut)]
    assert found[0] == found[1] and len(found[0]) == 12 + 15 + 1
    one, many = (validate.report_files(spark, str(at.parent), parts=True).drop("file_modified_at").collect() for at in (whole, cut))
    assert [x.asDict() | {"file": ""} for x in one] == [x.asDict() | {"file": ""} for x in many]
    assert len(many) == 1 and many[0]["file"].endswith("/cut/f=0") and many[0]["sample_headers"] == ["r0", "r1", "r2"] and many[0]["file_size_bytes"] == (whole / "part-00000").stat().st_size


def test_files_stay_in_many_tasks(spark, tmp_path, monkeypatch):
    """The records of one file are neither joined nor sorted in one task, and whole ones are not gathered."""
    (tmp_path / "x.fasta").write_text("".join(f">r{i}\nACD{'EF' * (i % 2)}\n" for i in range(1000)))
    monkeypatch.setattr(ranks, "SORTED", 100)
    assert ranks.in_order(spark.range(1000), ["id"], 1000).rdd.getNumPartitions() == 10
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = pieces.read_pieces(spark, str(tmp_path))
        found = pieces.errors(own)
        assert "hashpartitioning(file" not in plan(found.where("error_type = 'length_mismatch'").select("line_number", "expected"))
        assert own.pieces.where("cut").count() == 1
        assert found.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
