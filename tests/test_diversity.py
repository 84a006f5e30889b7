import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import headers, kmers
from kmerloom.functions.alphabet import NUCLEOTIDE, PROTEIN, alphabet, class_counts, classify, custom, invalid_characters, unique_invalid_characters
from kmerloom.operators import conserved, diversity, entropy, explore, features, metadata, validate
from kmerloom.plans.analyze import analyze
from kmerloom.sources import fasta, results
from kmerloom.streaming import counts as streaming


def aligned(spark, sequences, heads=None):
    return spark.createDataFrame([(i, (heads or ["h"] * len(sequences))[i], s) for i, s in enumerate(sequences)], "seq_id long, header string, sequence string")


def counts_of(spark, counts):
    return spark.createDataFrame([(1, f"K{i}", c) for i, c in enumerate(counts)], "position int, kmer string, count long")


def motifs(spark, counts):
    c = counts_of(spark, counts)
    rows = diversity.variants(c, diversity.position_stats(c, 1)).collect()
    return [r.motif_short for r in sorted(rows, key=lambda r: r.sequence)]


def test_identical(spark):
    r = analyze(aligned(spark, ["ACDEFGHIKL"] * 3), 3, 100)
    p = r.positions.orderBy("position").collect()
    assert len(p) == 8 and all(x.entropy == 0 and x.low_support == "LS" for x in p)
    assert {(v.motif_short, v.incidence) for v in r.variants.collect()} == {("I", 100.0)}
    s = r.summary.first()
    assert s.highest_entropy.position == 0 and s.average_entropy == 0 and s.low_support_count == 8 and s.sequence_count == 3


def test_diverse_and_gap(spark):
    s = analyze(aligned(spark, ["ACDEFGHIKL", "MNPQRSTVWY", "ACDEFSTVWY"]), 3, 2).summary.first()
    assert s.average_entropy > 0
    p = analyze(aligned(spark, ["ACDEFGHIKL", "ACD-FGHIKL", "ACDEFGHIKL"]), 3, 2).positions.collect()
    assert {x.position: x.support for x in p}[2] == 2
    p = analyze(aligned(spark, ["ACD---", "ACD---"]), 3, 2).positions.orderBy("position").collect()
    assert [x.low_support for x in p] == ["ELS", "NS", "NS", "NS"] and p[1].total_variants_incidence == 0


@pytest.mark.parametrize(("n", "t", "want"), [(3, 5, "LS"), (4, 4, "ELS"), (10, 5, None)])
def test_labels(spark, n, t, want):
    assert {x.low_support for x in analyze(aligned(spark, ["ACDEF"] * n), 3, t, check=False).positions.collect()} == {want}


def test_motifs(spark):
    assert motifs(spark, [10, 10, 3]) == ["I", "I", "Ma"]
    assert motifs(spark, [1, 1, 1]) == ["U", "U", "U"]
    assert motifs(spark, [9, 5, 5, 3, 2, 1]) == ["I", "Ma", "Ma", "Mi", "Mi", "U"]
    s = diversity.position_stats(counts_of(spark, [9, 5, 1]), 1).first()
    assert (s.distinct_variants_count, round(s.distinct_variants_incidence, 6), s.total_variants_incidence) == (2, 33.333333, 40.0)


def test_bad_input(spark):
    with pytest.raises(ValueError):
        analyze(aligned(spark, ["ACDEFGHIKL", "ACDEF"]), 3)
    with pytest.raises(ValueError):
        analyze(aligned(spark, []), 3)
    with pytest.raises(ValueError):
        analyze(aligned(spark, ["AC"]), 3)
    for k in (0, 15):
        with pytest.raises(ValueError):
            kmers.check_k(k, PROTEIN)
    assert (kmers.check_k(None, PROTEIN), kmers.check_k(None, NUCLEOTIDE)) == (9, 27)


def test_codes(spark):
    df = spark.createDataFrame([("ACDEFGHIKLMNPQ",), ("YYYYYYYYYYYYYY",), ("AXC",)], "k string").withColumn("code", kmers.encode(F.col("k")))
    rows = df.withColumn("back", kmers.decode(F.col("code"), 14)).collect()
    assert [r.back for r in rows] == ["ACDEFGHIKLMNPQ", "YYYYYYYYYYYYYY", None] and rows[1].code == 20**14 - 1
    df = spark.createDataFrame([("U" * 27,)], "k string")
    assert df.select(kmers.encode(F.col("k"), NUCLEOTIDE)).first()[0] == 5**27 - 1


def test_alphabets(spark):
    assert alphabet("DNA") is NUCLEOTIDE and alphabet("aa") is PROTEIN
    with pytest.warns(UserWarning):
        assert alphabet("what") is PROTEIN
    with pytest.raises(ValueError):
        custom("")
    df = spark.createDataFrame([(0, "ACX-b1")], "seq_id long, sequence string")
    got = df.select(*[c.alias(n) for n, c in class_counts(F.col("sequence"), PROTEIN).items()]).first().asDict()
    assert got == {"total": 6, "valid": 2, "ambiguous": 1, "gap": 1, "invalid": 2}
    assert [tuple(r) for r in invalid_characters(df).orderBy("place").collect()] == [(0, 4, "b", "Invalid"), (0, 5, "1", "Invalid")]
    assert invalid_characters(df, strict=True).count() == 3 and unique_invalid_characters(df).count() == 2
    assert df.select(classify(F.lit("U"), NUCLEOTIDE), classify(F.lit("U"), PROTEIN)).first()[:] == ("Valid", "Ambiguous")
    lower = custom("ACGT", allow_lowercase=True)
    assert kmers.count_kmers(aligned(spark, ["acgt"]), 2, lower).count() == 3


def test_headers(spark):
    rows = aligned(spark, ["AC"] * 5, ["USA|2023|P1", " CAN |\t2024 |P2 ", "MEX||P​3", "x|y", "a|b|c|d"])
    got = headers.with_fields(rows, "country|year|patient").orderBy("seq_id").collect()
    assert [(r.country, r.year, r.patient) for r in got] == [("USA", "2023", "P1"), ("CAN", "2024", "P2"), ("MEX", "Unknown", "P3"), (None,) * 3, (None,) * 3]
    assert headers.with_fields(rows, "country|year|patient", fill="").where("seq_id = 2").first().country is None
    assert headers.diagnostics(rows, ["country", "year", "patient"]).first()[1:] == (2, 0.4)
    with pytest.raises(ValueError):
        headers.check_headers(rows, "country|year|patient")
    for bad in ("a||b", "a|a", ""):
        with pytest.raises(ValueError):
            headers.check_format(bad)
    assert headers.wanted(["a", "b", "c"], ["c", "zz", "a"]) == ["a", "c"]
    assert tuple(headers.detect_format(aligned(spark, ["A"] * 2, ["a;b;c|d", "e;f;g|h"])).first()) == (";", 3, "field1;field2;field3")
    assert tuple(headers.detect_format(aligned(spark, ["A"] * 2, ["a", "b"])).first()) == (None, 0, None)


def test_metadata_of_variants(spark):
    heads = ["USA|2023|Patient1", "CAN|2024|Patient2", "MEX|2023|Patient3"]
    r = analyze(aligned(spark, ["ACDEFGHIKLM"] * 3, heads), 3, 2, header_format="country|year|patient", metadata_fields=["year", "country"])
    m = r.variants.where("position = 1").first().metadata
    assert m == {"country": {"CAN": 1, "MEX": 1, "USA": 1}, "year": {"2023": 2, "2024": 1}}


def test_expected_entropy_is_the_mean_of_draws():
    counts, types = np.array([1, 3, 40]), np.array([5, 2, 1])
    sizes = np.array([2, 10, 30])
    want = entropy.expected_entropy(counts, types, sizes)
    draws = np.mean([entropy.sampled_entropy(counts, types, sizes, 1, s) for s in range(3000)], axis=0)
    assert np.abs(want - draws).max() < 0.03
    assert entropy.expected_entropy(np.array([7]), np.array([1]), np.array([3]))[0] == 0
    x = np.array([0, 1, 5, 63, 64, 170, 2_000_000])
    assert np.allclose(entropy.log_factorial(x), [math.lgamma(i + 1) for i in x.tolist()], rtol=1e-13, atol=1e-12)


@pytest.mark.parametrize(("counts", "want"), [([500, 300, 200], 1.48939), ([40, 35, 30, 25, 20], 2.29287), ([102, 98], 1.0), ([995, 1, 1, 1, 1, 1], None), ([1] * 120, None)])
def test_regimes(spark, counts, want):
    s = entropy.with_entropy(diversity.position_stats(counts_of(spark, counts), 100), 100).first()
    assert abs(s.entropy - (s.raw_entropy if want is None else want)) < 1e-4


def test_entropy_bounds(spark):
    rng = np.random.default_rng(3)
    rows = [(p, f"K{i}", int(c)) for p in range(20) for i, c in enumerate(rng.integers(1, 40, rng.integers(1, 51)))]
    c = spark.createDataFrame(rows, "position int, kmer string, count long")
    for s in entropy.with_entropy(diversity.position_stats(c, 10), 10).collect():
        assert 0 <= s.entropy <= math.log2(s.distinct_kmers) + 1e-9 and (s.distinct_kmers > 1 or s.entropy == 0)


def test_fit(spark):
    line = spark.createDataFrame([(1, float(x), 2.0 * x + 1) for x in (1, 2, 3, 4)], "g int, a double, b double")
    got = entropy.fit(line, ["g"], F.col("a"), "b").first()
    assert abs(got.slope - 2) < 1e-12 and abs(got.intercept - 1) < 1e-12
    assert entropy.fit(line.limit(1), ["g"], F.col("a"), "b").first().slope is None


def picks(spark, rows):
    return spark.createDataFrame(rows, "position int, kmer string, low_support string")


def test_regions(spark):
    p = picks(spark, [(1, "ACD", None), (2, "CDE", "LS"), (4, "EFG", "ELS"), (5, "FGH", None), (6, "XYZ", None)])
    got = conserved.regions(p).orderBy("region_id").collect()
    assert [(r.start_position, r.end_position, r.sequence) for r in got] == [(1, 2, "ACDE"), (4, 5, "EFGH"), (6, 6, "XYZ")]
    assert got[0].low_support_positions == [2] and got[1].low_support_positions == []
    assert [r.sequence for r in conserved.regions(picks(spark, [(1, "A", None), (2, "C", None), (4, "D", None)])).orderBy("region_id").collect()] == ["AC", "D"]
    assert conserved.low_support_summary(conserved.regions(p)).count() == 1
    assert results.hcs_json(conserved.regions(p)).first().value == '["ACDE","EFGH","XYZ"]'


def test_index_threshold(spark):
    r = analyze(aligned(spark, ["ACDEF"] * 6 + ["ACDGF"] * 4), 3, 2)
    assert conserved.index_picks(r.variants, r.positions, 60.0).count() == 3
    assert conserved.index_picks(r.variants, r.positions, 60.1).count() == 1 == conserved.index_picks(r.variants, r.positions, 61.0, "incidence").count()
    assert conserved.consensus(r.variants, kmers.spine(aligned(spark, ["ACDEF"]), 3), 3).first().consensus == "CDE"
    assert conserved.alignment_length(r.positions, 3).first()[0] == 5


def test_features(spark):
    raw = spark.createDataFrame([(1, "Domain", "c", "d", "3", "9"), (2, "helix", "c", "d", "1", "2"), (3, "NP_BIND", "c", "d", "5", None), (4, "MOTIF", "c", "d", "x", "2"), (5, "MOTIF", "c", "d", "9", "2")], "feature_id long, feature_type string, category string, description string, begin string, end string")
    own = features.clean(raw).orderBy("feature_id")
    assert [(r.feature_id, r.begin, r.end, r.category_key) for r in own.collect()] == [(1, 3, 9, "DOMAIN"), (3, 5, 5, "BINDING")]
    to = spark.createDataFrame([(i, i + 10) for i in range(1, 9)], "residue int, structure_residue int")
    msa = spark.createDataFrame([(1, 13), (2, 13), (3, 15), (200, 18)], "msa_position int, structure_residue int")
    mapped = features.map_features(own, to, msa)
    assert {r.feature_id: (r.msa_begin, r.msa_end) for r in mapped.collect()} == {1: (1, 200), 3: (3, 3)}
    reg = spark.createDataFrame([(1, 4, 5), (2, 190, 260), (3, 1, 1)], "region_id int, start_position int, end_position int")
    assert sorted((r.region_id, r.feature_id) for r in features.overlaps(reg, mapped, 1).collect()) == [(1, 1), (2, 1), (3, 1)]
    assert sorted((r.region_id, r.feature_id) for r in features.overlaps(reg, mapped, 3).collect()) == [(1, 1), (2, 1), (3, 1), (3, 3)]
    pos = spark.createDataFrame([(1,), (2,), (3,)], "position int")
    direct = features.direct_mapping(pos, spark.createDataFrame([(4,), (6,), (6,)], "residue int"), 3)
    assert sorted(map(tuple, direct.collect())) == [(1, 4), (3, 6)] and features.coverage(pos, direct).first().mapped == 2


def test_metadata_table(spark):
    t = spark.createDataFrame([(0, "2023-01-01", "USA", "Human"), (1, "2023-01-02", "Canada", "Human"), (2, "2023-01-01", "USA", "Mouse"), (3, None, None, None)], "seq_id long, date string, country string, species string")
    ids = lambda df: sorted(r.seq_id for r in df.collect())
    assert {r.value: r["count"] for r in metadata.value_counts(t, "country").collect()} == {"USA": 2, "Canada": 1}
    assert ids(metadata.matching(t, "country", "USA")) == [0, 2] and ids(metadata.matching(t, "nowhere", "x")) == []
    assert ids(metadata.query_and(t, [("country", "USA"), ("species", "Mouse")])) == [2] and ids(metadata.query_and(t, [])) == []
    assert ids(metadata.query_or(t, [("species", "Mouse"), ("nowhere", "x"), ("country", "Canada")])) == [1, 2]
    assert tuple(metadata.table_stats(t, ["date", "country", "species"]).first()) == (4, 3, 12, 9, 6)
    up = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (9, "c", 2), (2, None, 3)], "seq_id long, value string, place int")
    assert {r.seq_id: r.country for r in metadata.bulk_update(t, "country", up).collect()} == {0: "USA", 1: "b", 2: None, 3: None}
    wanted = spark.createDataFrame([(0, 2), (1, 77), (2, 2)], "place int, seq_id long")
    assert [r.country for r in metadata.gather(t, wanted).orderBy("place").collect()] == ["USA", None, "USA"]
    assert metadata.to_map(t, ["date", "country"]).where("seq_id = 3").first().metadata is None
    assert {r.matches for r in metadata.mask(t, "country", "USA").where("seq_id = 3").collect()} == {False}


def test_filters(spark):
    r = analyze(aligned(spark, ["ACDEF"] * 6 + ["ACDGF"] * 4 + ["A----"]), 3, 2)
    near = lambda **k: sorted(x.position for x in explore.filter_positions(r.positions, r.variants, explore.Filters(**k)).collect())
    assert near() == [1, 2, 3] and near(positions=(2, 9)) == [2, 3] and near(positions=(3, 1)) == [] and near(positions=(float("nan"), 1)) == [1, 2, 3]
    assert near(motifs=()) == [1, 2, 3] and near(motifs=("Ma",)) == [2, 3] and near(motifs=("I",), sequence=" cdg ") == [] and near(motifs=("Ma",), sequence="cdg") == [2]
    flat = results.documents(r)
    assert sorted(x.position for x in explore.filter_nested(flat, explore.Filters(motifs=("Ma",), sequence="cdg")).collect()) == [2]
    f = explore.Filters(positions=(1, 2), sequence="x", include_low_support=False)
    assert f.active == 3 and not f.is_default and explore.Filters().is_default
    values = diversity.metadata_counts(headers.with_fields(aligned(spark, ["ACD"] * 4, ["a", "a", "b", "c"]), ["x"]), ["x"], 3, PROTEIN)
    assert {x.name: x["count"] for x in explore.distribution(values, 1).collect()} == {"a": 2, "Others": 2}


def test_downsample(spark):
    pts = [(0, float(i), 100.0 if i == 37 else float(i % 7)) for i in range(100)]
    got = sorted((r.x, r.y) for r in explore.downsample(spark.createDataFrame(pts, "series int, x double, y double"), 12).collect())
    assert got[0] == (0.0, 0.0) and got[-1] == (99.0, 1.0) and (37.0, 100.0) in got and len(got) == 12
    few = spark.createDataFrame(pts[:5], "series int, x double, y double")
    assert explore.downsample(few, 12).count() == 5 and explore.downsample(few, 2).count() == 5
    same = spark.createDataFrame([(0, 1.0, float(i)) for i in range(9)], "series int, x double, y double")
    assert explore.downsample(same, 5).count() == 9


def _thinned(pts, threshold):
    """Largest triangles over all points, bucket by bucket, in plain Python."""
    pts = sorted(pts)
    (fx, _), (lx, ly) = pts[0], pts[-1]
    buckets = {}
    for x, y in pts[1:-1]:
        buckets.setdefault(min(int((x - fx) / ((lx - fx) / (threshold - 2))), threshold - 3), []).append((x, y))
    out, order = [pts[0]], sorted(buckets)
    for i, b in enumerate(order):
        after = buckets[order[i + 1]] if i + 1 < len(order) else [(lx, ly)]
        cx, cy = sum(p[0] for p in after) / len(after), sum(p[1] for p in after) / len(after)
        ax, ay = out[-1]
        out.append(min(buckets[b], key=lambda p: (-abs((ax - cx) * (p[1] - ay) - (ax - p[0]) * (cy - ay)), p)))
    return sorted([*out, pts[-1]])


def test_downsample_all_points(spark):
    """Many points in few buckets, repeated points (ends too), a null series and points without y."""
    rng = np.random.default_rng(3)
    pts = [(float(x), float(y)) for x, y in rng.integers(0, 1000, (4000, 2))]
    pts += [min(pts), max(pts), pts[7], pts[7]]
    rows = [(1, *p) for p in pts] + [(None, *p) for p in pts[:500]] + [(1, 5.0, None)]
    got = explore.downsample(spark.createDataFrame(rows, "series int, x double, y double").repartition(5), 9).collect()
    assert sorted((r.x, r.y) for r in got if r.series == 1) == _thinned(pts, 9)
    assert sorted((r.x, r.y) for r in got if r.series is None) == _thinned(pts[:500], 9)
    assert explore.downsample(spark.createDataFrame([], "series int, x double, y double"), 9).count() == 0


def test_draws_beyond_numpy():
    """Spectra of billions of reads and of millions of types are drawn entry by entry, and come close to the expectation."""
    counts, types = np.array([1, 900, 10**9]), np.array([3_000_000, 70_000, 2])
    sizes = np.array([1000, 2_000_000])
    got = entropy.sampled_entropy(counts, types, sizes, 1, 5)
    assert got == pytest.approx(entropy.expected_entropy(counts, types, sizes), rel=0.1)
    rng = np.random.default_rng(1)
    far = [entropy.hypergeometric(rng, 3 * 10**9, 10**9, 10**6) for _ in range(200)]
    assert np.mean(far) == pytest.approx(750_000, abs=150) and np.std(far) == pytest.approx(433, rel=0.25)


def test_one_scan(spark, tmp_path):
    """Positions, their correction and variants come from one pass over the rows, empty positions included."""
    aligned(spark, ["AC-EF"] * 3 + ["ACDEF"] * 3).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    counts = kmers.count_kmers(rows, 3, gaps=True)
    stats = entropy.with_entropy(diversity.position_stats(counts, 1), 1)
    assert stats._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 1
    assert [(r.position, r.support) for r in stats.orderBy("position").collect()] == [(1, 3), (2, 3), (3, 3)]
    only_gaps = kmers.count_kmers(aligned(spark, ["A---F"]), 3, gaps=True)
    assert [(r.position, r.low_support) for r in diversity.position_stats(only_gaps, 1).orderBy("position").collect()] == [(1, "NS"), (2, "NS"), (3, "NS")]
    assert diversity.variants(only_gaps, diversity.position_stats(only_gaps, 1)).count() == 0


def test_stored_and_plain_analysis_agree(spark):
    rows = aligned(spark, ["ACDEF", "ACDGF", "ACDEF", "AC-EF"])
    a, b = (analyze(rows, 3, 1, store=x) for x in (True, False))
    for name in ("summary", "positions", "variants"):
        assert sorted(map(str, getattr(a, name).collect())) == sorted(map(str, getattr(b, name).collect()))


def test_validation(spark):
    rows = aligned(spark, ["ACGT-", "ACGTA", "ACG"], ["a", "b", "c"])
    r = validate.report(rows).first()
    assert (r.is_valid, r.sequence_length, r.length_mismatches, r.first_mismatches, r.alphabet) == (False, 5, 1, ["c"], "nucleotide")
    s = validate.character_stats(rows, 4, NUCLEOTIDE).first()
    assert (s.total_chars, s.gap_chars, s.invalidated_kmers, s.gap_percent) == (10, 1, 1, 10.0)
    assert validate.detect_alphabet(aligned(spark, ["---"])).first()[0] == "unknown"


def test_fasta_and_sinks(spark, tmp_path):
    src = tmp_path / "a.fasta"
    src.write_bytes(b"\xef\xbb\xbf>s1|USA|2023\r\nACDEF\r\nGHI\r\n;note\r\n>s2 > odd|CAN|2024\r\nACDEFGHK\r\n>\r\nAAA\r\n")
    rows = fasta.read_fasta(spark, str(src)).orderBy("seq_id").collect()
    assert [(r.header, r.sequence) for r in rows] == [("s1|USA|2023", "ACDEFGHI"), ("s2 > odd|CAN|2024", "ACDEFGHK")]
    assert fasta.skipped_records(spark, str(src)).first()[0] == 1
    fasta.check_records(fasta.read_fasta(spark, str(src)), 2)
    with pytest.raises(ValueError):
        fasta.check_records(fasta.read_fasta(spark, str(src)), 1)
    r = analyze(fasta.from_table(fasta.read_fasta(spark, str(src))), 3, 1, "q", "id|country|year", metadata_fields=["country"])
    for form in ("json", "jsonl", "tsv", "compact"):
        results.write(r, str(tmp_path / form), form)
    doc = spark.read.json(str(tmp_path / "json")).first()
    assert doc.sequence_count == 2 and len(doc.results) == 6 and doc.results[0].diversity_motifs[0].metadata.country.CAN == 1
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 6
    t = spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "tsv")).where("position = 6").first()
    assert t.asDict() == {"position": "6", "entropy": "1.000000", "support": "2", "low_support": ".", "distinct_variants_count": "2", "distinct_variants_incidence": "100.00", "total_variants_incidence": "100.00", "index_sequence": ".", "index_count": ".", "index_incidence": ".", "major_sequence": ".", "major_count": ".", "major_incidence": ".", "minor_count": ".", "minor_incidence": ".", "unique_count": "2", "unique_incidence": "100.00"}
    back = results.load(spark, str(tmp_path / "compact"))
    assert sorted(map(str, back.variants.collect())) == sorted(map(str, r.variants.collect()))
    results.convert(spark, str(tmp_path / "compact"), str(tmp_path / "again.tsv"))
    assert results.output_format("x.NDJSON") == "jsonl" and results.output_format("x") == "json" and results.output_format("x.tab", "json") == "json"
    with pytest.raises(ValueError):
        results.check_finite(r.positions.withColumn("entropy", F.lit(float("nan"))))


def test_malformed_fasta(spark, tmp_path):
    (tmp_path / "bad.fasta").write_text("garbage line\nmore\n>s1\nACDEF\n>\nAAA\n>garbage line\nACDEF\n")
    (tmp_path / "good.fasta").write_text("\ufeff;note\n\n>s2\nACDEF\n")
    (tmp_path / "empty.fasta").write_text("")
    d = str(tmp_path / "*.fasta")
    assert sorted(r.header for r in fasta.read_fasta(spark, d).collect()) == ["garbage line", "s1", "s2"]
    assert fasta.skipped_records(spark, d).first()[0] == 2
    with pytest.raises(ValueError, match="bad.fasta"):
        fasta.read_fasta(spark, d, malformed="fail")
    fasta.check_fasta(spark, str(tmp_path / "good.fasta"))
    assert fasta.read_fasta(spark, str(tmp_path / "empty.fasta")).count() == 0


def test_stream(spark, tmp_path):
    for i, seqs in enumerate((["ACDEF", "ACDEF"], ["ACDGF"])):
        aligned(spark, seqs).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("seq_id long, header string, sequence string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.keep_counts(rows, 3, str(tmp_path / "deltas"), str(tmp_path / "cp")).awaitTermination()
    deltas = spark.read.parquet(str(tmp_path / "deltas"))
    want = {(r.position, r.kmer, r["count"]) for r in kmers.count_kmers(aligned(spark, ["ACDEF", "ACDEF", "ACDGF"]), 3).collect()}
    assert {(r.position, r.kmer, r["count"]) for r in streaming.current(deltas).collect()} == want
    assert streaming.positions_now(deltas, 2, 3).count() == 3
    q = streaming.stream_counts(rows, 3).writeStream.format("memory").queryName("kmers_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.position, r.kmer, r["count"]) for r in spark.table("kmers_now").collect()} == want


def test_plans(spark):
    """Windows are counted before the shuffle, and no Python runs in the k-mer path."""
    c = kmers.count_kmers(aligned(spark, ["ACDEF"]), 3)
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan and "Arrow" not in plan
    assert "Window" not in diversity.position_stats(c, 1)._jdf.queryExecution().executedPlan().toString()
