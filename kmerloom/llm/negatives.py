"""Hard negatives: rows of another label whose score lies in a window under that of an anchor's positive.

Candidates are ordered by (label, place on a Hilbert curve through the coordinates that vary most), cut into blocks and written as Parquet;
a zone map keeps, for each block, the least and greatest value of every dimension and the range of its labels. By interval arithmetic the
zone map bounds the score of an anchor with any row of a block from both sides. A block is read for an anchor only if a window of the
anchor meets these bounds:

1. each anchor reads the blocks that promise most, which gives it a score that its best rows reach at least;
2. it then reads the other blocks whose bounds meet what is left of its windows, and no more.

Positives are found the same way with one window without ends. Blocks lie in units of some ``UNIT_ROWS`` rows; an anchor goes once to each
unit of which it reads a block, with the list of those blocks, and units that many anchors read are taken in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import ship, sliced, table, written

SCALE, PERIOD, ANCHORS, POSITIVES, NEGATIVES = 256, 7, 100, 5, 5
#: Rows of a block and a unit, about; the least number of units; anchors of a slice; blocks of a tile of the zone map.
BLOCK_ROWS, UNIT_ROWS, LEAST_UNITS, SLICE_ROWS, TILE_BLOCKS = 512, 16384, 16, 2048, 4096
#: Blocks of each anchor that are read first.
SEEDS = 2
#: Coordinates of the curve and bits of each.
CURVE, BITS = 12, 5
#: The id of rows without one, which come last among ties.
NO_ID = 2**63 - 1
_LOW, _HIGH = -(2**62), 2**62


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of grid cells (rows x dimensions) on a Hilbert curve, after Skilling (2004): from the highest bit down, each axis either flips the
    lower bits of the first or swaps them with it; what remains is a Gray code whose bits interleave."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dims):
            set_ = (x[:, d] >> bit) & 1 == 1
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(set_, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip[:, None]
    place = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            place = (place << 1) | ((x[:, d] >> bit) & 1)
    return place


def _matrix(column, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), dims)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def usable(vectors: DataFrame, scale: int = SCALE, period: int | None = PERIOD, classes: int = 10) -> DataFrame:
    """(vec_id, label, v) of the rows with a label and a vector of finite components; v holds floor(scale * x). Where vec_id is divisible by
    ``period`` the label becomes (label + 1) % classes. Null vec_ids are ``NO_ID``."""
    x = F.col("embedding").cast("array<double>")
    own = vectors.where("label IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    own = own.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    moved = F.when(F.col("id") % period == 0, (F.col("label") + 1) % classes).otherwise(F.col("label")) if period else F.col("label")
    return own.select(F.coalesce("id", F.lit(NO_ID)).alias("vec_id"), moved.alias("label"), F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _spread(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and deviation of every dimension and the number of rows: a row for each task, merged on the driver's side of one aggregate."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for b in sliced(batches, 4096):
            x = _matrix(b.column(0), dims)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), _lists(np.concatenate([s, q])[None, :])], names=["n", "s"])

    each = rows.select("v").mapInArrow(sums, "n long, s array<double>").select("n", F.posexplode("s").alias("at", "x"))
    found = each.groupBy("at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("at").collect()
    n = found[0]["n"] if found else 0
    x = np.array([r["x"] for r in found]).reshape(2, -1) if found else np.zeros((2, dims))
    mean = x[0] / max(n, 1)
    return mean, np.sqrt(np.maximum(x[1] / max(n, 1) - mean**2, 0)), n


def blocks(rows: DataFrame, dims: int, block_rows: int = BLOCK_ROWS, unit_rows: int = UNIT_ROWS, units: int = LEAST_UNITS) -> DataFrame:
    """The written candidates (unit, block, row, vec_id, label, v) of ``rows(row, vec_id, label, v)``, in the order of (label, Hilbert place, row)."""
    mean, deviation, n = _spread(rows, dims)
    axes = np.sort(np.argsort(-deviation, kind="stable")[:CURVE])
    side = 1 << BITS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            x = _matrix(b.column(3), dims)[:, axes]
            cells = np.clip(np.floor(((x - mean[axes]) / np.maximum(deviation[axes], 1e-300) / 6 + 0.5) * side), 0, side - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert(cells))], names=[*b.schema.names, "place"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(((at + np.arange(b.num_rows)) // block_rows).astype(np.int32)), *b.columns[1:5]], names=["unit", "block", "row", "vec_id", "label", "v"])
            at += b.num_rows

    kept = "row long, vec_id long, label long, v array<double>"
    placed = rows.select("row", "vec_id", "label", "v").mapInArrow(place, f"{kept}, place long")
    order = ["label", "place", "row"]
    dealt = placed.repartitionByRange(max(units, -(-n // unit_rows)), *order).sortWithinPartitions(*order)
    return written(dealt.select(F.spark_partition_id().alias("unit"), "row", "vec_id", "label", "v").mapInArrow(number, f"unit int, block int, {kept}"), "blocks")


_ZONE = "unit int, block int, low_label long, high_label long, low array<double>, high array<double>"


def zones(held: DataFrame, dims: int) -> DataFrame:
    """The zone map of the blocks, one row each, written."""

    def fold(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for b in sliced(batches, 4096):
            u, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            labels = [b.column(2).to_numpy(), b.column(2 + at).to_numpy()]
            v = [_matrix(b.column(3 + at), dims), _matrix(b.column(3 + 2 * at), dims)]
            cut = np.flatnonzero((np.diff(u) != 0) | (np.diff(k) != 0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(u)], strict=True):
                new = [labels[0][lo:hi].min(), labels[1][lo:hi].max(), v[0][lo:hi].min(0), v[1][lo:hi].max(0)]
                old = found.get((u[lo], k[lo]))
                found[u[lo], k[lo]] = new if old is None else [min(old[0], new[0]), max(old[1], new[1]), np.minimum(old[2], new[2]), np.maximum(old[3], new[3])]
        if found:
            (u, k), (a, b, low, high) = zip(*found, strict=True), zip(*found.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int32()), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), _lists(np.array(low)), _lists(np.array(high))], names=["unit", "block", "low_label", "high_label", "low", "high"])

    # a block that is cut by the reader has a row for each piece, which a shuffle of zone rows brings together
    parts = held.select("unit", "block", "label", "v").mapInArrow(lambda batches: fold(batches, 0), _ZONE)
    return written(parts.repartition("unit").mapInArrow(lambda batches: fold(batches, 1), _ZONE), "zones")


def _bounds(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each vector with any point of each box, a little wider than exact."""
    up, down = np.maximum(v, 0), np.minimum(v, 0)
    slack = 1e-12 * (np.abs(v) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def _asked(asks: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, labels and windows (rows x windows, empty ones inverted) of a table of asks."""
    lists = [asks.column(c).combine_chunks() for c in ("low", "high")]
    sizes = lists[0].value_lengths().to_numpy()
    low, high = np.full((len(sizes), sizes.max(initial=0)), 1), np.full((len(sizes), sizes.max(initial=0)), 0)
    inside = np.arange(low.shape[1]) < sizes[:, None]
    low[inside], high[inside] = lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()
    return _matrix(asks.column("v"), dims), asks.column("label").to_numpy(), low, high


def _choose(dims: int, same: bool, seeds: int | None):
    """The blocks of a tile of the zone map that each ask has to read; with ``seeds``, the so many that promise most."""

    def choose(asks: pa.Table, tile: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(4)]
        if asks.num_rows and tile.num_rows:
            v, label, low, high = _asked(asks, dims)
            first, last = tile.column("low_label").to_numpy(), tile.column("high_label").to_numpy()
            unit, block, ask = tile.column("unit").to_numpy(), tile.column("block").to_numpy(), asks.column("ask").to_numpy()
            a, b = _matrix(tile.column("low"), dims), _matrix(tile.column("high"), dims)
            for at in range(0, len(v), 256):
                some = slice(at, at + 256)
                least, most = _bounds(v[some], a, b)
                fits = (first <= label[some, None]) & (label[some, None] <= last) if same else (first != label[some, None]) | (last != label[some, None])
                meets = np.zeros(fits.shape, bool)
                for w in range(low.shape[1]):
                    lo, hi = low[some, w, None], high[some, w, None]
                    meets |= (lo <= hi) & (most >= lo) & (least <= hi)
                meets &= fits
                if seeds is not None and len(unit) > seeds:
                    promise = np.where(meets, most, -np.inf)
                    best = np.argpartition(-promise, seeds - 1, 1)[:, :seeds]
                    chosen = np.zeros(fits.shape, bool)
                    np.put_along_axis(chosen, best, True, 1)
                    meets &= chosen
                i, j = np.nonzero(meets)
                for o, x in zip(out, (ask[at + i], unit[j], block[j], most[i, j]), strict=True):
                    o.append(x)
        kinds = (np.int64, np.int32, np.int32, np.float64)
        whole = [np.concatenate([np.empty(0, k), *o]).astype(k) for o, k in zip(out, kinds, strict=True)]
        return pa.table(dict(zip(("ask", "unit", "block", "most"), map(pa.array, whole), strict=True)))

    return choose


def _read(dims: int, same: bool, k: int):
    """The k best rows of the listed blocks for each ask and window."""

    def read(asks: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(4)]
        if asks.num_rows and held.num_rows:
            v, label, low, high = _asked(asks, dims)
            ask, own = asks.column("ask").to_numpy(), asks.column("row").to_numpy()
            held = held.sort_by([("block", "ascending")])
            rows, ids, labels, block = (held.column(c).to_numpy() for c in ("row", "vec_id", "label", "block"))
            x = _matrix(held.column("v"), dims)
            top = np.abs(v).max(initial=0) * np.abs(x).max(initial=0) * dims
            if top >= 2**63:
                raise ValueError("components are too large: scores would not fit 64 bits")
            if top >= 2**53:
                v, x = v.astype(np.int64), x.astype(np.int64)
            names, starts = np.unique(block, return_index=True)
            ends = np.append(starts[1:], len(block))
            lists = asks.column("blocks").combine_chunks()
            who, what = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            order = np.argsort(what, kind="stable")
            who, what = who[order], what[order]
            for name, s, e in zip(names.tolist(), starts.tolist(), ends.tolist(), strict=True):
                i = who[np.searchsorted(what, name) : np.searchsorted(what, name, "right")]
                for at in range(0, len(i), 1024):
                    q = i[at : at + 1024]
                    score = (v[q] @ x[s:e].T).astype(np.int64)
                    equal = label[q, None] == labels[None, s:e]
                    fine = (equal & (own[q, None] != rows[None, s:e])) if same else ~equal
                    for w in range(low.shape[1]):
                        a, b = np.nonzero(fine & (score >= low[q, w, None]) & (score <= high[q, w, None]))
                        got = score[a, b]
                        by = np.lexsort((ids[s + b], -got, a))
                        a, b, got = a[by], b[by], got[by]
                        first = np.arange(len(a)) - np.searchsorted(a, a) < k
                        for o, y in zip(out, (ask[q[a[first]]], np.full(first.sum(), w), ids[s + b[first]], got[first]), strict=True):
                            o.append(y)
        kinds = (np.int64, np.int32, np.int64, np.int64)
        whole = [np.concatenate([np.empty(0, t), *o]).astype(t) for o, t in zip(out, kinds, strict=True)]
        return pa.table(dict(zip(("ask", "window", "vec_id", "score"), map(pa.array, whole), strict=True)))

    return read


class Candidates:
    """The written blocks and their zone map."""

    def __init__(self, rows: DataFrame, dims: int, block_rows: int = BLOCK_ROWS, unit_rows: int = UNIT_ROWS, units: int = LEAST_UNITS, slice_rows: int = SLICE_ROWS, tile_blocks: int = TILE_BLOCKS):
        self.dims, self.slice_rows = dims, slice_rows
        self.held = blocks(rows, dims, block_rows, unit_rows, units)
        self.zones = zones(self.held, dims)
        self.blocks = self.zones.count()
        self.tiles = -(-self.blocks // tile_blocks)
        #: Blocks read, summed over asks, by the searches so far.
        self.visited = 0

    def _chosen(self, asks: DataFrame, same: bool, seeds: int | None) -> DataFrame:
        """(ask, unit, block, most): every ask meets every tile of the zone map, once."""
        tiled = self.zones.withColumn("tile", F.pmod(F.xxhash64("unit", "block"), F.lit(self.tiles)).cast("int"))
        spread = asks.select("ask", "v", "label", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(self.tiles - 1))).alias("tile"))
        n = F.lit(max(1, -(-asks.count() // self.slice_rows)))
        spread = spread.withColumn("slice", F.pmod(F.xxhash64("ask"), n).cast("int"))
        tiled = tiled.withColumn("slice", F.explode(F.sequence(F.lit(0), n - 1)))
        return spread.groupBy("tile", "slice").cogroup(tiled.groupBy("tile", "slice")).applyInArrow(_choose(self.dims, same, seeds), "ask long, unit int, block int, most double")

    def _found(self, asks: DataFrame, chosen: DataFrame, same: bool, k: int) -> DataFrame:
        """(ask, window, vec_id, score): the best rows of the chosen blocks, of each unit apart."""
        lists = written(chosen.groupBy("ask", "unit").agg(F.collect_list("block").alias("blocks")), "lists")
        self.visited += lists.agg(F.sum(F.size("blocks"))).first()[0] or 0
        sizes = written(lists.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / self.slice_rows).cast("int").alias("slices")), "slices")
        left = lists.join(asks, "ask").join(sizes, "unit").withColumn("slice", F.pmod(F.xxhash64("ask"), F.col("slices")).cast("int"))
        right = self.held.join(sizes, "unit").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        by = ["unit", "slice"]
        each = left.select(*by, "ask", "row", "v", "label", "low", "high", "blocks").groupBy(*by)
        return each.cogroup(right.select(*by, "block", "row", "vec_id", "label", "v").groupBy(*by)).applyInArrow(_read(self.dims, same, k), "ask long, window int, vec_id long, score long")

    def best(self, asks: DataFrame, same: bool, k: int, seeds: int = SEEDS) -> DataFrame:
        """(ask, window, rank, vec_id, score), written: the k best rows of each window of ``asks(ask, row, v, label, low, high)``, best first, ties
        by vec_id; rows of the ask's label other than its own row, or with ``same`` false those of other labels."""
        rank = F.row_number().over(Window.partitionBy("ask", "window").orderBy(F.desc("score"), "vec_id"))
        ranked = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k).select("ask", "window", "rank", "vec_id", "score")
        promise = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("most"), "unit", "block"))
        seeded = written(self._chosen(asks, same, seeds).withColumn("r", promise).where(F.col("r") <= seeds).select("ask", "unit", "block"), "seeds")
        begun = written(ranked(self._found(asks, seeded, same, k)), "begun")
        # the k-th best so far raises the lower end of its window
        floors = begun.where(F.col("rank") == k).groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("floors"))
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.col("floors")[i], x)))
        narrowed = written(asks.join(floors, "ask", "left").withColumn("low", raised).drop("floors"), "narrowed")
        rest = self._chosen(narrowed, same, None).join(seeded, ["ask", "unit", "block"], "left_anti")
        return written(ranked(begun.drop("rank").unionByName(self._found(narrowed, rest, same, k))), "best")


def mine(vectors: DataFrame, anchors: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, ratio: tuple[int, int] = (80, 100), scale: int = SCALE, period: int | None = PERIOD, found: list | None = None, **layout) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors(vec_id, embedding, label)``.

    Anchors are the rows whose vec_id is divisible by ``anchors``; rows are told apart by a number of their own, so rows that repeat a vec_id
    are anchors and candidates each. A window holds the scores of which ``ratio`` times the positive's is the least and the positive's the
    most; it is empty for negative positives. Rows without a label or vector, or with a component that is null or not finite, take no part;
    rows without a vec_id are no anchors, come last of ties, and are given back as null. Rows of another length than the
    commonest have no inner product with the others and take no part. An anchor without positives, or a pair without negatives, has no rows;
    an empty table gives none; other columns are ignored. ``found`` receives the ``Candidates``.
    """
    ship(vectors.sparkSession)
    sized = usable(vectors, scale, period)
    best = sized.groupBy(F.size("v").alias("size")).count().agg(F.max(F.struct("count", "size")).alias("x")).first()["x"]
    dims = best["size"] if best else 0
    rows = written(sized.where(F.size("v") == dims).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"), "candidates")
    held = Candidates(rows, dims, **layout)
    if found is not None:
        found.append(held)
    own = rows.where((F.col("vec_id") % anchors == 0) & (F.col("vec_id") != NO_ID))
    ends = lambda lo, hi: (F.array(lo).alias("low"), F.array(hi).alias("high"))
    asks = written(own.select(F.col("row").alias("ask"), "row", "v", "label", "vec_id", *ends(F.lit(_LOW), F.lit(_HIGH))), "anchors")
    if not held.blocks:
        return asks.select(*[F.lit(None).cast(t).alias(c) for c, t in (("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"))]).limit(0)
    near = held.best(asks.drop("vec_id"), True, positives)
    listed = near.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    # the ceiling of a quotient of integers; div cuts towards zero
    least = lambda s: F.call_function("div", s * ratio[0] + F.when(s > 0, ratio[1] - 1).otherwise(0), F.lit(ratio[1]).cast("long"))
    asking = written(asks.drop("low", "high").join(listed, "ask").select("ask", "row", "v", "label", "vec_id", "p", F.transform("p", lambda x: least(x["score"])).alias("low"), F.col("p.score").alias("high")), "windows")
    far = held.best(asking.drop("vec_id", "p"), False, negatives)
    id_of = lambda c: F.nullif(c, F.lit(NO_ID))
    pairs = asking.select("ask", F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("window", "x"))
    return pairs.join(far, ["ask", "window"]).select("anchor_id", id_of(F.col("x.vec_id")).alias("positive_id"), "rank", id_of(F.col("vec_id")).alias("negative_id"), F.col("x.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES: dict[str, str] = {
    "op13_hard_negatives": f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % {PERIOD} = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor({SCALE} * cast(c AS double))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, a.r = b.r AS own, cast(list_inner_product(a.v, b.v) AS bigint) AS score FROM e a JOIN e b ON a.vec_id % {ANCHORS} = 0),
p AS (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS n FROM s WHERE same AND NOT own QUALIFY n <= {POSITIVES}),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, cast(row_number() OVER (PARTITION BY p.a, p.n ORDER BY score DESC, vec_id) AS integer) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= {NEGATIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n"""
}
