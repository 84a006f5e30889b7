"""Names, threads, repeated ids and lengths: what must not lose rows nor crash."""

import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kmerloom.llm import common, decontaminate, neighbours, quality

ODD = "doc_id long, text string, lang string, source string, n_chars int, `a.b` string, __score double, __bytes string, row int, number int"


def odd_docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, f"dot{i}", 0.5, "bytes", 5, 6) for i, t in enumerate(texts)], ODD)


def plain_texts(n):
    return [" ".join(f"w{(i * 7919 + j * 104729) % 5003}" for j in range(40)) for i in range(n)]


def test_scratch_of_other_threads(spark):
    """What another thread writes while a stage runs stays."""
    kept = {}
    inside, wrote = threading.Event(), threading.Event()

    def other():
        inside.wait(60)
        kept["df"] = common.written(spark.range(5), "other")
        wrote.set()

    t = threading.Thread(target=other)
    t.start()
    with common.scratch(spark):
        own = common.written(spark.range(3), "own")
        with common.scratch(spark):
            inner = common.written(spark.range(2), "inner")
        inside.set()
        assert wrote.wait(60) and own.count() == 3
    t.join()
    assert kept["df"].count() == 5
    for gone in (own, inner):
        with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
            spark.read.parquet(gone.inputFiles()[0]).count()


def test_odd_names(spark):
    docs = odd_docs(spark, [None, "", "a b c", *plain_texts(20)])
    model = quality.fit(docs, spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int"))
    assert quality.keep_good(docs, model, -1.0).collect() == docs.collect()
    assert set(quality.score(docs, model).columns) == set(docs.columns)
    bench = spark.createDataFrame([(1, plain_texts(2)[1]), (2, plain_texts(1)[0])], "item_id long, text string")
    for blocks in (200_000, 20):
        found = decontaminate.match(docs, bench, block_words=blocks, at_once=1)
        assert set(found.columns) == {*docs.columns, "__words", "__spans", "__items"} and found.where(F.size("__items") > 0).count() == 2
        assert {r.doc_id: r["__words"] for r in found.collect()} == {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
        clean = decontaminate.decontaminate(docs, bench, block_words=blocks)
        assert clean.columns == docs.columns and clean.orderBy("doc_id").collect() == docs.where("doc_id NOT IN (3, 4)").orderBy("doc_id").collect()
    only = decontaminate.decontaminate(docs.select("text"), bench)
    assert only.columns == ["text"] and only.count() == 21


def test_pipeline_passes_names_on(spark, tmp_path):
    docs = odd_docs(spark, [None, "", *plain_texts(30), plain_texts(1)[0], "password = hunter22secret " + plain_texts(40)[39]])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, plain_texts(9)[8])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        done = common.written(stage(spark, now, str(tmp_path)), name)
        if name != "tokens":
            assert done.columns == docs.columns
            assert done.where("`a.b` <> concat('dot', doc_id) OR __score <> 0.5 OR __bytes <> 'bytes'").count() == 0
        now = done
    # null and blank texts are one class; one document is a copy, one the benchmark's
    assert now.count() == docs.count() - 3


def test_pipeline_of_nothing(spark, tmp_path):
    for name, schema in (("documents", ODD), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_neighbours_of_rows(spark):
    """Rows that repeat a vec_id ask and are found each; a short vector with the smallest id sets no dimension."""
    schema = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(1, [1.0, 1.0]), (1, [-1.0, -1.0]), (2, [1.0, 0.0])], schema)
    got = Counter(tuple(r) for r in neighbours.search(few, few.where("vec_id = 1"), 5).collect())
    assert got == Counter([(1, 1, 2, 1.0), (1, 2, 1, -2.0), (1, 1, 2, -1.0), (1, 2, 1, -2.0)])
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 3))
    rows = [(0, [9.0])] + [(i + 1, x.tolist()) for i, x in enumerate(v)] + [(None, v[7].tolist())]
    df = spark.createDataFrame(rows, schema)
    own = neighbours.search(df, df.where("vec_id = 8"), 3).orderBy("rank").collect()
    scores = sorted([(-float(v[7] @ v[7]), 2**63)] + [(-float(v[7] @ x), i + 1) for i, x in enumerate(v) if i != 7])[:3]
    assert [(r.rank, r.vec_id if r.vec_id is not None else 2**63, round(r.score, 12)) for r in own] == [(i + 1, n, round(-s, 12)) for i, (s, n) in enumerate(scores)]


def test_neighbours_scan_where_no_probes_do(spark, monkeypatch):
    """With a target that probing cannot reach, all vectors are scanned: nothing is missed in silence."""
    monkeypatch.setattr(neighbours, "MOST_PROBES", 1)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 20 = 0"), 10, target=1.0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q, found in got.items():
        near = v @ v[q]
        near[q] = -np.inf
        assert found == set(np.argsort(-near)[:10].tolist())
    assert len(got) == 20 and neighbours.hashes_for(10**12) > 16
