"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Vectors get one more coordinate that makes all norms equal, so that nearness by inner product is nearness by distance. Each of
``tables`` tables cuts Gaussian projections, more of them the more vectors there are, into cells of width ``width``; a query visits its own
cell and the perturbed cells in the order of estimated success (the sum of squared distances to the crossed walls).

How many cells a query visits is measured, not guessed: for ``SAMPLE`` queries the true neighbours are found by a scan, and the number of
probes is the least that finds ``TARGET`` of them, with fewer projections if ``MOST_PROBES`` do not, and a scan of all if one projection does
not either. Clustered vectors need few probes.

Cells are dealt to parts by their code. A part with many vectors is cut into pieces by vector id, one with many queries into slices by
query id, so that no group outgrows a task; a query goes once to every piece that may hold its cells, with the list of
those cells. There each cell is one matrix product of its queries and its vectors; the best of all parts are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import ship, sliced, table, written

TABLES, WIDTH = 8, 2.0
#: Calibration: queries asked, the share of their true neighbours to be found, and the most cells of a table that a query visits.
SAMPLE, TARGET, MOST_PROBES = 128, 0.95, 1024
#: Vectors and queries of a group, about, and the least number of parts.
PART_ROWS, PART_QUERIES, LEAST_PARTS = 16384, 4096, 64
SEED = 11
K = 20
#: The id of rows without one.
NO_ID = 2**63 - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes_for(n: int) -> int:
    """Projections of a table for n vectors: cells multiply as vectors do."""
    return max(3, round(0.7 * math.log2(max(n, 2))))


class Hashes:
    """The projections of all tables; scale is the common norm of the vectors."""

    def __init__(self, dims: int, scale: float, hashes: int, tables: int = TABLES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.scale, self.hashes, self.tables = scale, hashes, tables
        self.a = rng.normal(size=(dims + 1, tables * hashes)) / (width * scale)
        self.b = rng.random(tables * hashes)

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Places in units of the cell width: rows x tables x hashes."""
        norm2 = (x * x).sum(1)
        if query:
            full = np.concatenate([x * (self.scale / np.sqrt(norm2))[:, None], np.zeros((len(x), 1))], 1)
        else:
            full = np.concatenate([x, np.sqrt(np.maximum(self.scale**2 - norm2, 0))[:, None]], 1)
        return (full @ self.a + self.b).reshape(len(x), self.tables, self.hashes)

    @staticmethod
    def codes(cells: np.ndarray, table: np.ndarray | int) -> np.ndarray:
        """A long for each cell of a table (last axis: its integer coordinates)."""
        h = np.full(cells.shape[:-1], 0x243F6A8885A308D3, np.uint64) + np.asarray(table, np.uint64)
        for j in range(cells.shape[-1]):
            h = (h ^ cells[..., j].astype(np.int64).view(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def probes(self, place: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates of the ``most`` likeliest cells of one table for each row of places (rows x most x hashes), and their scores.

        Perturbations are extended coordinate by coordinate. Staying costs nothing, so the best of all begin with the best of the shorter
        ones, and no more than ``most`` of these need be kept.
        """
        base = np.floor(place)
        inside = place - base
        score, delta = np.zeros((len(place), 1)), np.zeros((len(place), 1, 0), np.int8)
        steps = np.array([0, -1, 1], np.int8)
        for j in range(self.hashes):
            wall = np.stack([np.zeros(len(place)), inside[:, j] ** 2, (1 - inside[:, j]) ** 2], 1)
            score = (score[:, :, None] + wall[:, None, :]).reshape(len(place), -1)
            n = score.shape[1]
            keep = np.argpartition(score, most - 1, 1)[:, :most] if n > most else np.broadcast_to(np.arange(n), score.shape)
            score = np.take_along_axis(score, keep, 1)
            before = np.take_along_axis(delta, (keep // 3)[:, :, None], 1)
            delta = np.concatenate([before, steps[keep % 3][:, :, None]], 2)
        order = np.argsort(score, 1, kind="stable")
        return base[:, None, :].astype(np.int64) + np.take_along_axis(delta, order[:, :, None], 1), np.take_along_axis(score, order, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.flatten().to_numpy(zero_copy_only=False)
    return lists.reshape(len(column), -1).astype(np.float64)


def _part(codes: np.ndarray, parts: int) -> np.ndarray:
    return ((codes.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)


def _index(h: Hashes, parts: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            codes = h.codes(np.floor(h.project(_matrix(b.column(2)), False)).astype(np.int64), np.arange(h.tables)).ravel()
            at = pa.array(np.repeat(np.arange(b.num_rows), h.tables))
            yield pa.RecordBatch.from_arrays([pa.array(_part(codes, parts)), pa.array(codes), *[c.take(at) for c in b.columns]], names=["part", "cell", "row", "vec_id", "v"])

    return index


def _probe(h: Hashes, most: int, parts: int):
    """For each query and part one row, with the cells of the part that the query visits."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            places = h.project(_matrix(b.column(1)), True)
            codes = np.concatenate([h.codes(h.probes(places[:, t], most)[0], t) for t in range(h.tables)], 1)
            part = _part(codes, parts)
            order = np.argsort(part, 1, kind="stable")
            codes, part = np.take_along_axis(codes, order, 1).ravel(), np.take_along_axis(part, order, 1).ravel()
            row = np.repeat(np.arange(b.num_rows), len(part) // b.num_rows)
            first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (row[1:] != row[:-1]))))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(part)).astype(np.int32)), pa.array(codes))
            own = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), b.column(0).take(own), b.column(1).take(own), lists], names=["part", "query", "v", "cells"])

    return probe


class _Best:
    """The k best of each query so far, by exact double-precision inner products, ties to the smaller id. Queries and vectors are told apart by
    the number of their row."""

    def __init__(self, q: np.ndarray, own: np.ndarray, v: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.own, self.v, self.rows, self.ids, self.k = q, own, v, rows, ids, k
        self.least = np.full(len(q), -np.inf)
        self.kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        # settled early, so that what follows is measured against the best so far
        self.room = max(1 << 16, 4 * k * len(q))

    def offer(self, queries: np.ndarray, rows: np.ndarray) -> None:
        """All rows to all queries; those that clearly miss a query's k best are let go at once."""
        for at in range(0, len(rows), max(1, (1 << 21) // len(queries))):
            some = rows[at : at + max(1, (1 << 21) // len(queries))]
            near = self.q[queries] @ self.v[some].T
            least = self.least[queries]
            with np.errstate(invalid="ignore"):
                i, j = np.nonzero(near >= np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)[:, None])
            self.new.append((queries[i], some[j]))
            self.waiting += len(i)
            if self.waiting > self.room:
                self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        i, j = (np.concatenate(x) for x in zip(*self.new, strict=True))
        score = np.concatenate([np.empty(0)] + [(self.v[j[at : at + 65536]] * self.q[i[at : at + 65536]]).sum(1) for at in range(0, len(i), 65536)])
        i, j, score = (np.concatenate(x) for x in zip(self.kept, (i, j, score), strict=True))
        good = self.rows[j] != self.own[i]
        i, j, score = i[good], j[good], score[good]
        order = np.lexsort((self.rows[j], self.ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        # several tables may have found the same vector
        one = np.ones(len(i), bool)
        one[1:] = (i[1:] != i[:-1]) | (self.rows[j[1:]] != self.rows[j[:-1]])
        i, j, score = i[one], j[one], score[one]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        first = rank < self.k
        last = rank == self.k - 1
        self.least[i[last]] = score[last]
        self.kept, self.new, self.waiting = (i[first], j[first], score[first]), [], 0


def _best(k: int):
    """The k nearest of a piece for each of its queries; a query without a list of cells is compared with all of it."""

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        none = np.empty(0, np.int64)
        kept = _Best(np.zeros((0, 1)), none, np.zeros((0, 1)), none, none, k)
        if queries.num_rows and rows.num_rows:
            q, v = _matrix(queries.column("v").combine_chunks()), _matrix(rows.column("v").combine_chunks())
            kept = _Best(q, queries.column("query").to_numpy(), v, rows.column("row").to_numpy(), rows.column("vec_id").to_numpy(), k)
            cell = rows.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            names, starts = np.unique(cell[order], return_index=True)
            starts = np.append(starts, len(cell))
            lists = queries.column("cells").combine_chunks()
            every = np.flatnonzero(lists.is_null().to_numpy(zero_copy_only=False))
            if len(every):
                kept.offer(every, np.arange(len(v)))
            flat = lists.flatten().to_numpy()
            who = np.repeat(np.arange(len(lists)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
            hit = names[at] == flat
            at, who = at[hit], who[hit]
            by = np.argsort(at, kind="stable")
            at, who = at[by], who[by]
            found, first = np.unique(at, return_index=True)
            ends = np.append(first, len(at))
            for c, a, b in zip(found.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                kept.offer(who[a:b], order[starts[c] : starts[c + 1]])
            kept.settle()
        i, j, score = kept.kept
        return pa.table({"query": kept.own[i], "row": kept.rows[j], "vec_id": kept.ids[j], "score": score})

    return best


def _ranked(parts: DataFrame, k: int) -> DataFrame:
    """Merge the best of all parts: (query, rank, vec_id, score), nearest first. A window's limit works before and after its shuffle."""
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    once = parts.groupBy("query", "row", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", "vec_id", "score")


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v) of the vectors that take part, written: not null nor zero, all components finite, of the commonest length (the longer of
    equally common ones), as others have no inner product with these. Every row has a number of its own; a null vec_id is ``NO_ID``."""
    v = F.col("embedding").cast("array<double>")
    good = vectors.where("embedding IS NOT NULL").select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v"))
    good = good.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0))
    size = good.groupBy(F.size("v").alias("size")).count().agg(F.max(F.struct("count", "size")).alias("x")).first()["x"]
    fits = good.where(F.size("v") == (size["size"] if size else 0))
    return written(fits.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")


def calibrate(rows: DataFrame, asked: DataFrame, n: int, dims: int, scale: float, k: int, tables: int, hashes: int, width: float, target: float, seed: int) -> tuple[Hashes, int | None]:
    """Projections and the number of probes that find ``target`` of the true k nearest of ``SAMPLE`` queries; None for the number if even one
    projection a table does not find them with ``MOST_PROBES``. What reaches the driver is these queries and their neighbours."""
    some = asked.orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(SAMPLE).collect()
    if not some or n < 2:
        return Hashes(dims, scale, hashes, tables, width, seed), 1
    own, q = np.array([r["query_id"] for r in some]), np.array([r["v"] for r in some])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = [()] * len(q)
        for b in sliced(batches, 4096):
            v, ids = _matrix(b.column(1)), b.column(0).to_numpy()
            near = q @ v.T
            near[own[:, None] == ids[None, :]] = -np.inf
            for i, at in enumerate(np.argpartition(-near, min(k, near.shape[1]) - 1, 1)[:, :k].tolist()):
                best[i] = tuple(sorted([*best[i], *((-near[i, x], int(ids[x]), v[x]) for x in at if near[i, x] > -np.inf)], key=lambda x: x[:2])[:k])
        flat = [(i, -x[0], x[1], x[2].tolist()) for i, found in enumerate(best) for x in found]
        if flat:
            i, score, ids, v = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64()), pa.array(v, pa.list_(pa.float64()))], names=["query_id", "vec_id", "score", "v"])

    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    near = rows.mapInArrow(exact, "query_id long, vec_id long, score double, v array<double>").withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).select("query_id", "v").collect()
    who, v = np.array([r["query_id"] for r in near]), np.array([r["v"] for r in near])
    while True:
        h = Hashes(dims, scale, hashes, tables, width, seed)
        asks, cells = h.project(q, True), np.floor(h.project(v, False))
        rank = np.full(len(who), MOST_PROBES)
        for t in range(tables):
            base = np.floor(asks[who, t])
            moved, inside = cells[:, t] - base, asks[who, t] - base
            score = np.where(moved == 0, 0, np.where(moved < 0, inside, 1 - inside) ** 2).sum(1)
            bound = h.probes(asks[:, t], MOST_PROBES)[1]
            place = np.array([np.searchsorted(bound[i], s - 1e-12) for i, s in zip(who, score, strict=True)])
            rank = np.minimum(rank, np.where(np.abs(moved).max(1) <= 1, place, MOST_PROBES))
        probes = int(np.quantile(rank, target, method="higher")) + 1
        if probes <= MOST_PROBES:
            return h, probes
        if hashes <= 1:
            return h, None
        hashes -= 1


def search(vectors: DataFrame, queries: DataFrame, k: int = K, tables: int = TABLES, hashes: int | None = None, width: float = WIDTH, probes: int | None = None, target: float = TARGET, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of ``vectors(vec_id, embedding)`` for each of ``queries(vec_id, embedding)``.

    ``hashes`` follows the number of vectors and ``probes`` is measured where they are not given; if no number of probes reaches the target,
    all vectors are scanned. Rows are told apart by a number of their own: a query never finds its own row, and rows that repeat a vec_id ask
    and are found each. A query for which the cells hold fewer than k others is compared with all vectors, in the same parts. A row of
    ``queries`` asks for all rows of ``vectors`` with its vec_id. Vectors that ``usable`` leaves out neither ask nor are found; a null vec_id comes
    last of ties; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(norm)).alias("scale"), F.max(F.size("v")).alias("dims")).first()
    n, dims, scale = about["n"], about["dims"] or 1, about["scale"] or 1.0
    wanted = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    asked = written(rows.join(wanted, "vec_id", "left_semi").select(F.col("row").alias("query"), "vec_id", "v"), "asked")
    if probes:
        h = Hashes(dims, scale, hashes or hashes_for(n), tables, width, seed)
    else:
        h, probes = calibrate(rows.select(F.col("row").alias("vec_id"), "v"), asked.select(F.col("query").alias("query_id"), "v"), n, dims, scale, k, tables, hashes or hashes_for(n), width, target, seed)
    parts = max(LEAST_PARTS, -(-n * tables // PART_ROWS))
    schema = "query long, row long, vec_id long, score double"

    def nearest(visits: DataFrame, held: DataFrame) -> DataFrame:
        # a row for each part: how many pieces and slices it is cut into
        cut = lambda n, most: F.ceil(n / most).cast("int")
        sizes = held.groupBy("part").agg(cut(F.count(F.lit(1)), PART_ROWS).alias("pieces")).join(visits.groupBy("part").agg(cut(F.count(F.lit(1)), PART_QUERIES).alias("slices")), "part")
        sizes = written(sizes, "part-sizes")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        right = held.join(sizes, "part").withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")).withColumn("slice", all_of("slices"))
        left = visits.join(sizes, "part").withColumn("slice", F.pmod(F.xxhash64("query"), F.col("slices")).cast("int")).withColumn("piece", all_of("pieces"))
        by = ["part", "piece", "slice"]
        return left.select(*by, "query", "v", "cells").groupBy(*by).cogroup(right.select(*by, "cell", "row", "vec_id", "v").groupBy(*by)).applyInArrow(_best(k), schema)

    best, few = None, asked.select("query", "v")
    if probes:
        indexed = rows.mapInArrow(_index(h, parts), "part int, cell long, row long, vec_id long, v array<double>")
        visits = written(asked.select("query", "v").mapInArrow(_probe(h, probes, parts), "part int, query long, v array<double>, cells array<long>"), "visits")
        best = written(_ranked(nearest(visits, indexed), k), "nearest")
        full = best.groupBy("query").count().where(F.col("count") >= min(k, n - 1))
        few = written(few.join(full, "query", "left_anti"), "few")
    if best is None or few.limit(1).count():
        dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.lit(0).cast("long").alias("cell"), "row", "vec_id", "v")
        spread = few.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "query", "v", F.lit(None).cast("array<long>").alias("cells"))
        scanned = _ranked(nearest(spread, dealt), k)
        best = scanned if best is None else best.join(few, "query", "left_anti").unionByName(scanned)
    named = best.join(asked.select("query", F.col("vec_id").alias("query_id")), "query")
    return named.select(F.nullif("query_id", F.lit(NO_ID)).alias("query_id"), "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op5_nearest_neighbours": op5_nearest_neighbours}
ORACLES: dict[str, str] = {}
