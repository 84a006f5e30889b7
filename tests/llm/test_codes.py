"""Product codes against brute force, and what a round shuffles."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from contextlib import contextmanager

import numpy as np
import pytest

from kmerloom.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, row string, `a.b` int, entry int"


def plain(rows, entries, rounds=4):
    """{row number: (code, error)} and the digest of the codebooks, with Python integers."""
    fine = [(i, r) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = Counter(len(r[1]) for _, r in fine)
    if not fine:
        return {}, hashlib.sha256(b"").hexdigest()
    dims = max(sizes, key=lambda s: (sizes[s], s))
    w = dims // 4
    cut = {i: [[math.floor(1024 * float(np.float32(x))) for x in r[1]][p * w : (p + 1) * w] for p in range(4)] for i, r in fine if len(r[1]) == dims}
    first = sorted(cut, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, [float(np.float32(x)) for x in rows[i][1]]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            members = defaultdict(list)
            for i in cut:
                members[near(cut[i][p], books[p])[1]].append(cut[i][p])
            books[p] = [[sum(c) // len(c) for c in zip(*members[e])] if e in members else y for e, y in enumerate(books[p])]
    out = {i: (None, None) for i, _ in fine}
    for i in cut:
        found = [near(cut[i][p], books[p]) for p in range(4)]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found))
    return out, hashlib.sha256(",".join(str(c) for book in books for y in book for c in y).encode()).hexdigest()


def vectors(seed, n, dims=8):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(dims)], r.choice([0, 1, 2, None]), 1, "x", 2, 3) for i in r.sample(range(10 * n), n)]
    common = [0.25, -0.5] * (dims // 2)
    rows += [(10 * n + i, common, 1, 1, "x", 2, 3) for i in range(n // 2)]
    rows += [rows[0], (rows[0][0], [1.0] * dims, 0, 1, "x", 2, 3), (None, [0.125] * dims, 0, 1, "x", 2, 3), (3, None, 0, 1, "x", 2, 3), (4, [None] * dims, 0, 1, "x", 2, 3), (5, [float("nan")] * dims, 0, 1, "x", 2, 3), (6, [float("inf")] + [0.0] * (dims - 1), None, 1, "x", 2, 3), (-7, [1.0, 2.0], 2, 1, "x", 2, 3)]
    return rows


@pytest.mark.parametrize("n, entries, owner_rows", [(300, 16, 1 << 14), (300, 8, 20), (5, 256, 10)])
def test_codes(spark, monkeypatch, n, entries, owner_rows):
    plans, tables = [], codes._tables

    @contextmanager
    def spied(session):
        with tables(session) as save:

            def record(df, buckets):
                plans.append(df._jdf.queryExecution().executedPlan().toString())
                return save(df, buckets)

            yield record

    monkeypatch.setattr(codes, "_tables", spied)
    rows = vectors(n, n)
    found, books = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=entries, owner_rows=owner_rows)
    want, said = plain(rows, entries)
    key = lambda r, found: (r[0], r[2], None if r[1] is None else tuple(np.float32(x) for x in r[1]), *found)
    got = Counter(key((x.row.vec_id, x.row.embedding, x.row.label), (x.code, x.error)) for x in found.collect())
    assert got == Counter(key(rows[i], w) for i, w in want.items())
    assert codes.digest(books) == said
    assert found.select("row.*").columns == ["vec_id", "embedding", "label", "code", "row", "a.b", "entry"]
    # one exchange a round, that of the parts which move; residents come from their bucketed table
    assert len(plans) == 4 and all(p.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in p for p in plans[1:])
    assert spark.sql("SHOW TABLES").where("tableName LIKE 'kmerloom_owners%'").count() == 0


def test_owners_split(spark):
    """The commonest entry's members go to many owners, equal as they are."""
    same = spark.createDataFrame([(i, [0.5] * 8) for i in range(2000)], "vec_id long, embedding array<float>")
    found, _ = codes.compress(same, owner_rows=100)
    assert found.groupBy("code", "error").count().collect() == [("00000000", 0, 2000)]
    assert len(set(codes._salt(np.arange(2000), 0, np.zeros(2000, int), codes._salts_of(np.full((1, 1), 2000), 100)).tolist())) == 20


def test_query(spark, tmp_path):
    rows = [r[:3] for r in vectors(9, 400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, said = plain(rows, 256)
    sums = Counter()
    for i, (_, error) in want.items():
        sums[rows[i][2]] += error or 0
    got = Counter(tuple(x) for x in codes.op12_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == Counter((rows[i][0], c, e, sums[rows[i][2]], said) for i, (c, e) in want.items())


def test_odd(spark):
    schema = "vec_id long, embedding array<double>"
    assert codes.compress(spark.createDataFrame([], schema))[0].count() == 0
    assert codes.compress(spark.createDataFrame([(1, None)], schema))[0].count() == 0
    assert [x.code for x in codes.compress(spark.createDataFrame([(1, [])], schema))[0].collect()] == ["00000000"]
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0, 2.0])], schema))
    with pytest.raises(ValueError, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e300] * 4)], schema))
    # beyond what float products hold exactly
    big = [(i, [float((i * 7919 + j * 104729) % 30000) for j in range(8)]) for i in range(40)]
    found, books = codes.compress(spark.createDataFrame(big, schema), entries=8)
    want, said = plain([(i, v) for i, v in big], 8)
    assert codes.digest(books) == said and {x.row.vec_id: (x.code, x.error) for x in found.collect()} == want
