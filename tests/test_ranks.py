"""Places, stored orders, regions across cuts, expected entropy against exact sums, and FASTA pieces told by place."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.operators import conserved, diversity, entropy, ranks
from kmerloom.sources import fasta


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_of_a_hot_key(spark):
    """A key with nearly all rows is spread over partitions; places are those of a sort."""
    r = random.Random(1)
    rows = [(None if i % 7 == 0 else "hot", r.randrange(10**9), i) for i in range(3000)] + [("b", 5, 3000), ("c", 1, 3001)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(5)
    own = ranks.with_place(df, ["k"], [F.desc("v"), F.col("i")], count="of")
    got = {x.i: (x.place, x.of) for x in own.collect()}
    for k in (None, "hot", "b", "c"):
        line = sorted((x for x in rows if x[0] == k), key=lambda x: (-x[1], x[2]))
        assert [got[x[2]] for x in line] == [(i + 1, len(line)) for i in range(len(line))]
    held = own.select(F.shiftright("place", 0)).count()
    assert held == len(rows) and own.columns == ["k", "v", "i", "place", "of"]
    assert ranks.with_place(df.limit(0), ["k"], [F.col("v")]).count() == 0
    assert sorted(x.place for x in ranks.with_place(df, [], [F.col("i")]).collect()) == list(range(1, len(rows) + 1))


def test_pages_read_ranges(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    ranks.store_order(df, ["k"], [F.desc("v")], f"{tmp_path}/order")
    stored = spark.read.parquet(f"{tmp_path}/order")
    page = ranks.page(stored, 3, 50, k=1)
    assert [x.v for x in page.orderBy("place").collect()] == [x for x in range(4999, -1, -1) if x % 3 == 1][100:150]
    said = plan(page)
    assert "GreaterThanOrEqual(place,101)" in said and "LessThanOrEqual(place,150)" in said and "Sort" not in said and "Exchange" not in said
    assert {x.of for x in stored.collect()} == {1666, 1667}


def plain_regions(picks):
    out = []
    for p, kmer in sorted(picks):
        if out and p == out[-1][1] + 1 and out[-1][3][1:] == kmer[:-1]:
            out[-1] = (out[-1][0], p, out[-1][2] + kmer[-1], kmer)
        else:
            out.append((p, p, kmer, kmer))
    return [(i + 1, a, b, s) for i, (a, b, s, _) in enumerate(out)]


@pytest.mark.parametrize("k", [1, 3])
def test_regions_across_cuts(spark, k):
    r = random.Random(k)
    text = "".join(r.choice("AC") for _ in range(900))
    picks = [(i + 1, text[i : i + k] if r.random() < 0.97 else "G" * k) for i in range(900 - k) if r.random() < 0.98]
    df = spark.createDataFrame([(g, p, s, "LS" if p % 5 == 0 else None) for g in ("x", None) for p, s in picks], "g string, position int, kmer string, low_support string")
    own = conserved.regions(df, keys=("g",))
    for g in ("x", None):
        got = sorted(tuple(x) for x in own.where(F.col("g").eqNullSafe(F.lit(g))).select("region_id", "start_position", "end_position", "sequence").collect())
        assert got == plain_regions(picks)
    assert own.where("exists(low_support_positions, p -> p % 5 <> 0)").count() == 0
    assert "SinglePartition" not in plan(own)
    assert conserved.regions(df.limit(0)).count() == 0


def exact(counts, types, m):
    n = sum(c * t for c, t in zip(counts, types))
    return sum(t * sum(Fraction(math.comb(c, j) * math.comb(n - c, m - j), math.comb(n, m)) * Fraction(-j / m * math.log2(j / m)) for j in range(1, min(c, m) + 1) if m - j <= n - c) for c, t in zip(counts, types))


def test_expected_entropy_is_exact():
    for counts, types in [([1, 2, 7], [5, 3, 1]), ([600, 900, 1500], [1, 2, 1]), ([1], [9]), ([3000], [1]), ([1, 2999], [1, 1])]:
        c, t = np.array(counts), np.array(types)
        n = int((c * t).sum())
        sizes = sorted({m for m in (2, 3, 7, 50, n // 3, n - 1) if 2 <= m < n})
        got = entropy.expected_entropy(c, t, np.array(sizes))
        assert got == pytest.approx([float(exact(counts, types, m)) for m in sizes], abs=1e-9)
        # pieces of a spectrum add up
        parts = sum(entropy.expected_entropy(c[i : i + 1], t[i : i + 1], np.array(sizes), n) for i in range(len(c)))
        assert parts == pytest.approx(got, abs=1e-12)


def test_steps_keep_their_bound(monkeypatch):
    """Every step that is taken errs by less than its bound, the bound is small, and the number of terms does not follow the depth."""
    wide = {}
    for n in (10**4, 10**6, 10**8):
        c = np.array([n // 50, n // 7, n // 2])
        t = np.array([int((n - int(c[1:].sum())) // c[0]), 1, 1])
        reads = int((c * t).sum())
        sizes = np.array([50, n // 10, n // 2])
        quick = entropy.expected_entropy(c, t, sizes)
        for m in sizes:
            mean = (c - 1) * ((m - 1) / (reads - 1))
            var = mean * (1 - (c - 1) / (reads - 1)) * ((reads - m) / (reads - 2))
            step = entropy.step_of(mean, np.sqrt(var))
            assert all(entropy.step_error(*x) < 1e-8 for x in zip(mean.tolist(), var.tolist(), step.tolist()))
            wide[n] = max(wide.get(n, 0), *(2 * entropy.TAIL * (np.sqrt(var) + 1) / step))
        with monkeypatch.context() as only:
            only.setattr(entropy, "WIDE", float("inf"))
            slow = entropy.expected_entropy(c, t, sizes) if n < 10**8 else quick
        assert quick == pytest.approx(slow, abs=1e-8)
    assert wide[10**8] < 1.2 * wide[10**6] < 150


def test_curve_once(spark):
    """The curve of a spectrum in many pieces is that of the whole, and is computed once."""
    counts = spark.createDataFrame([(p, f"k{p}-{i}", 1 + (i * 7 + p) % 190) for p in (1, 2) for i in range(400)] + [(3, "x", 5)], "position int, kmer string, count long")
    stats = diversity.position_stats(counts, 100)
    points = entropy.rarefaction(stats, 100)
    assert plan(points).count("ArrowEvalPython") == 1
    got = {(x.position, x.m): x.h for x in points.collect()}
    for r in stats.collect():
        c, t = (np.array([x[f] for x in r.spectrum]) for f in ("count", "types"))
        assert len(c) > entropy.CHUNK or r.position == 3
        sizes = np.array(sorted(m for p, m in got if p == r.position and m < r.support), np.int64)
        assert [got[r.position, m] for m in sizes.tolist()] == pytest.approx(entropy.expected_entropy(c, t, sizes).tolist(), abs=1e-12)
    assert entropy.with_entropy(stats, 100).columns == [*stats.columns, "intercept", "entropy"]


def test_stray_text_equal_to_a_record(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("h1\nACD\n>h1\nACD\n>h2\nACF\n")
    (tmp_path / "b.fasta").write_text(">h1\nACD\n")
    path = str(tmp_path)
    assert sorted((x.header, x.sequence) for x in fasta.read_fasta(spark, path).collect()) == [("h1", "ACD"), ("h1", "ACD"), ("h2", "ACF")]
    assert fasta.skipped_records(spark, path).first()[0] == 1
