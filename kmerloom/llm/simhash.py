"""SimHash near-duplicate classes by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a point that lies within half the radius of both. So every fingerprint emits
all variants within half the radius, the variants are shuffled, and whoever meets on one is compared.

The ball of radius 2 around 64 bits holds 2,081 points: 2,081 shuffled rows a text. As four differing bits leave one
32-bit half with at most two, the same emission is done first in each half, where the bound is 2 and half of it 1: 2 x 33 rows.
Whoever meets there is verified on all 64 bits. Meeting places with more than ``dense`` fingerprints, where that
would compare many pairs, are settled by the balls of the whole word instead: all who share a point there are linked
without comparison, and no point has more than 2,081 neighbours. Both ways find every link; ``halves=False`` uses the latter for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import components, let_go, ship, sliced, table, written

SEED = 42
SHINGLE = 4
RADIUS = 4
DENSE = 2048
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit majority vote of the XXH64 values of word shingles; 0 if there are no words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = words[at : min(at + _BLOCK, n) + shingle - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        first = np.concatenate(([0], ends[:-shingle])).tolist()
        last = (ends[shingle - 1 :] - 1).tolist()
        hashes = np.array([h(line[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (counts * 2 > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for b in sliced(batches):
        fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def masks(bits: int, radius: int) -> np.ndarray:
    """All words of ``bits`` bits with at most ``radius`` ones."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], dtype=np.uint64)


def _emit(radius: int, halves: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = masks(32, radius // 2 // 2) if halves else masks(64, radius // 2)
        step = max(1, (1 << 18) // len(flips))
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), step):
                x = fps[at : at + step]
                if halves:
                    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
                    keys = np.concatenate([(low[:, None] ^ flips).ravel(), (np.uint64(1) << np.uint64(33)) | (high[:, None] ^ flips).ravel()])
                    own = np.concatenate([np.repeat(x, len(flips))] * 2)
                else:
                    keys, own = (x[:, None] ^ flips).ravel(), np.repeat(x, len(flips))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own.view(np.int64))], names=["key", "fp"])

    return emit


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Runs of rows sorted by (key, fp): (keys, fps, open), where open marks a piece of a key with more than ``most`` rows."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
    large = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, b.column(1).to_numpy(zero_copy_only=False)])
        if large is not None:
            n = int(np.searchsorted(keys != large, True)) if keys[-1] != large else len(keys)
            yield keys[:n], fps[:n], True
            keys, fps = keys[n:], fps[n:]
            if not len(keys):
                continue
            large = None
        cut = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
        if cut:
            yield keys[:cut], fps[:cut], False
            keys, fps = keys[cut:], fps[cut:]
        if len(keys) > most:
            large = keys[0]
            yield keys, fps, True
            keys, fps = keys[:0], fps[:0]
    if len(keys):
        yield keys, fps, False


def _meet(radius: int, dense: int):
    """Verified links among those that share a key, as a tree for each linked group: (a, b); (a, null): settle it elsewhere."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps, large in _groups(batches, dense):
            a, b, rest = [], [], []
            if large:
                rest.append(np.unique(fps))
            else:
                start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                count = np.diff(np.append(start, len(keys)))
                two = start[count == 2]
                near = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= radius
                a.append(fps[two + 1][near])
                b.append(fps[two][near])
                for s, n in zip(start[count > 2].tolist(), count[count > 2].tolist(), strict=True):
                    x = fps[s : s + n]
                    if n > dense:
                        rest.append(np.unique(x))
                        continue
                    near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
                    label = np.arange(n)
                    while True:
                        low = np.where(near, label[None, :], n).min(1)
                        low = low[low]
                        if (low == label).all():
                            break
                        label = low
                    other = label != np.arange(n)
                    a.append(x[other])
                    b.append(x[label[other]])
            links, rest = np.concatenate(a) if a else np.empty(0, np.int64), np.concatenate(rest) if rest else np.empty(0, np.int64)
            if len(links):
                pairs = np.unique(np.stack([links, np.concatenate(b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            if len(rest):
                yield pa.RecordBatch.from_arrays([pa.array(rest), pa.nulls(len(rest), pa.int64())], names=["a", "b"])

    return meet


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whoever shares a point with others is linked to the first of them."""
    for keys, fps, _ in _groups(batches, 1 << 30):
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        first = np.repeat(fps[start], np.diff(np.append(start, len(keys))))
        other = fps != first
        if other.any():
            pairs = np.unique(np.stack([fps[other], first[other]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, halves: bool = True, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of fingerprints that span every class of fingerprints linked within ``radius`` (4 or 5 bits) of ``fps(fp)``."""
    spark = fps.sparkSession
    ship(spark)
    fps = fps.select("fp").distinct()
    sort = lambda df: df.repartition("key").sortWithinPartitions("key", "fp")
    whole = lambda df: sort(df.repartition("fp").mapInArrow(_emit(radius, False), "key long, fp long")).mapInArrow(_star, "a long, b long")
    if not halves:
        return whole(fps).distinct()
    met = written(sort(fps.mapInArrow(_emit(radius, True), "key long, fp long")).mapInArrow(_meet(radius, dense), "a long, b long").distinct(), "met")
    return met.where("b IS NOT NULL").unionByName(whole(met.where("b IS NULL").select(F.col("a").alias("fp")).distinct())).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, halves: bool = True, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over links of ``radius`` or fewer differing bits. Null and blank texts have
    fingerprint 0 and are linked like any other; a repeated doc_id keeps a row for each occurrence; a null doc_id takes
    part in links but is never a component_id unless its class has no other; an empty table gives an empty result; other columns are ignored.
    """
    own = written(fingerprints(docs), "fingerprints")
    each = own.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(own, radius, halves, dense)).select(F.col("node").alias("fp"), "root")
    # both sides of each join are tables of known size: the small side is sent if it is small, and else a hot key can be split
    each = written(each.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots")
    low = written(each.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    named = written(each.join(low, "root").select("fp", "component_id"), "named")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``number`` is among ``wanted(number)``. What is sent is a bit for each number, in blocks of 32,768, so no row is shuffled:
    some 1.6 MB for 13 million rows."""
    at = F.bitmap_bit_position("number")
    bits = wanted.groupBy(F.bitmap_bucket_number("number").alias("__block")).agg(F.bitmap_construct_agg(at).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1
    return rows.withColumn("__block", F.bitmap_bucket_number("number")).join(F.broadcast(bits), "__block").where(has).select(*rows.columns)


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with exactly one row of each near-duplicate class: that with the smallest doc_id, nulls last, and of several such rows that
    with the smallest text. Rows are told apart by a number of their own, so repeated and null ids join no classes; null and blank texts
    are one class. Columns pass through whatever their names; an empty table gives an empty one."""
    numbered = docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = written(numbered, "rows")
    found = near_duplicates(own.select(F.col("number").alias("doc_id"), "row.text"), **how).select(F.col("doc_id").alias("number"), F.col("component_id").alias("class"))
    each = written(found.join(own.select("number", F.col("row.doc_id").cast("long").alias("id")), "number"), "classes")
    # two steps of aggregation instead of a join of each class with its smallest id: a large class is combined before it is shuffled
    ids = each.groupBy("class", "id").agg(F.min("number").alias("number"), F.count(F.lit(1)).alias("n"))
    ends = written(ids.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number", "n")).alias("x")).select("class", "x.*"), "ends")
    # only where ids tie are texts compared
    tied = written(ends.where("n > 1").select("class", F.col("id").alias("least")), "ties")
    ties = written(each.join(tied, "class").where("id <=> least").select("class", "number"), "tied")
    ties = ties.join(among(own.select("number", "row.text"), ties), "number")
    least = ties.groupBy("class").agg(F.min(F.struct("text", "number")).alias("x")).select("x.number")
    best = written(ends.where("n = 1").select("number").unionByName(least), "kept")
    return among(own, best).select("row.*")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
ORACLES: dict[str, str] = {}
