"""Product codes of vectors: integer codebooks trained by member-resident Lloyd rounds, exact in integers.

Vectors are cut into parts, and each part lives with an owner: the shuffle partition of its (position, entry, salt). A round is one pass over the
owners. An owner takes in the parts that chose its entry in the round before, assigns all it has by the present codebook, and writes
three things into its own bucket: the parts that stay, those that move to another entry, and sums of its members. Tables are
bucketed by owner, so parts that stay are never shuffled again; the next pass shuffles only those that move. Sums are merged on
Spark to at most a row for each entry, which is all that the driver sees; the codebooks, whose size does not grow with the rows, go to the tasks.

An entry with many members has as many salts as keep an owner near ``OWNER_ROWS``, so that copies of one vector spread too. The
final codes need no owners: rows are encoded where they lie.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.common import fresh_path, remove, ship, sliced, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Members of an owner, about, and owners' members of a bucket.
OWNER_ROWS, BUCKET_ROWS = 1 << 14, 1 << 17
OWNER = ["position", "entry", "salt"]
#: What a pass writes: kind 0 parts that stay, 1 parts that move to (entry_to, salt_to), 2 sums of the members now at entry_to.
STAY, MOVE, SUM = 0, 1, 2
_PASS = "position int, entry int, salt int, entry_to int, salt_to int, h int, part array<int>, n long, sums array<long>, kind int"
_MEMBER = "position int, entry int, salt int, h int, part array<int>"


def usable(vectors: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """(row, vec_id, v) of the vectors that are not null and have only finite components; ``row`` is a struct of the carried columns."""
    v = F.col("embedding").cast("array<double>")
    own = vectors.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), "vec_id", v.alias("v"))
    return own.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def dimension(rows: DataFrame, parts: int, scale: int) -> int:
    """The commonest length of the vectors, the longer of equally common ones; 0 without vectors. An error if it cannot be cut into equal parts,
    or if squared distances of such vectors would not fit a long."""
    size = F.size("v").alias("size")
    tops = rows.groupBy(size).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))).alias("top"))
    best = tops.agg(F.max(F.struct("n", "size", "top")).alias("x")).first()["x"]
    if best is None:
        return 0
    if best["size"] % parts:
        raise ValueError(f"vectors of {best['size']} components cannot be cut into {parts} equal parts")
    top = int(best["top"]) * scale + scale
    if 4 * top**2 * max(best["size"] // parts, 1) >= 2**63 or top >= 2**31:
        raise ValueError(f"components of up to {best['top']} are too large: squared distances would not fit 64 bits")
    return best["size"]


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) as integers, a row for each vector."""
    return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row (the lowest of equally near ones) and its squared distance, exact."""
    top = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    # products of floats are exact while they stay below 2**53
    kind = np.float64 if 4 * int(top) ** 2 * max(x.shape[1], 1) < 2**53 else np.int64
    y = book.astype(kind)
    own = (y * y).sum(1)
    entry, error = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    for at in range(0, len(x), 4096):
        some = x[at : at + 4096].astype(kind)
        far = (some * some).sum(1)[:, None] - 2 * (some @ y.T) + own
        best = far.argmin(1)
        entry[at : at + 4096] = best
        error[at : at + 4096] = far[np.arange(len(some)), best].astype(np.int64)
    return entry, error


def _ints(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def _salt(h: np.ndarray, position: np.ndarray | int, entry: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return (h % salts[position, entry]).astype(np.int32)


def _first(books: np.ndarray, scale: int):
    """Parts of vectors with the entry they start at. Rows are numbered by their place, so that copies get different salts."""
    parts, _, width = books.shape

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            x = integers(b.column(1), parts * width, scale)
            h = ((b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int32)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                entry = nearest(own, books[p])[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(entry), pa.array(h), _lists(own, pa.int32())], names=["position", "entry", "h", "part"])

    return first


def _turn(books: np.ndarray, salts: np.ndarray):
    """One owner's pass: residents and arrivals are assigned by ``books``."""

    def turn(key: tuple, residents: pa.Table, arrivals: pa.Table) -> pa.Table:
        position, entry, salt = (k.as_py() for k in key)
        own = pa.concat_tables([residents.select(["h", "part"]), arrivals.select(["h", "part"])])
        x, h = _ints(own.column("part")), own.column("h").to_numpy()
        to = nearest(x, books[position])[0]
        moved = to != entry
        n = len(x)
        names, at = np.unique(to, return_inverse=True)
        sums = np.zeros((len(names), x.shape[1]), np.int64)
        np.add.at(sums, at, x)
        m = len(names)
        none = lambda k, kind: pa.nulls(k, kind)
        fixed = lambda v, k: pa.array(np.full(k, v, np.int32))
        columns = {
            "position": fixed(position, n + m),
            "entry": fixed(entry, n + m),
            "salt": fixed(salt, n + m),
            "entry_to": pa.array(np.concatenate([to, names]).astype(np.int32)),
            "salt_to": pa.concat_arrays([pa.array(np.where(moved, _salt(h, position, to, salts), salt).astype(np.int32)), none(m, pa.int32())]),
            "h": pa.concat_arrays([pa.array(h), none(m, pa.int32())]),
            "part": pa.concat_arrays([_lists(x, pa.int32()), none(m, pa.list_(pa.int32()))]),
            "n": pa.concat_arrays([none(n, pa.int64()), pa.array(np.bincount(at, minlength=m).astype(np.int64))]),
            "sums": pa.concat_arrays([none(n, pa.list_(pa.int64())), _lists(sums, pa.int64())]),
            "kind": pa.array(np.concatenate([np.where(moved, MOVE, STAY), np.full(m, SUM)]).astype(np.int32)),
        }
        return pa.table(columns)

    return turn


def _merged(sums: DataFrame) -> DataFrame:
    """(position, entry, n, sums): the sums of all owners, added up within tasks before they are shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for b in batches:
            for p, e, n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                one = found.setdefault((p, e), [0, np.zeros(len(s), np.int64)])
                one[0] += n
                one[1] += np.array(s, np.int64)
        if found:
            (p, e), (n, s) = zip(*found, strict=True), zip(*found.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n, pa.int64()), pa.array([x.tolist() for x in s], pa.list_(pa.int64()))], names=["position", "entry", "n", "sums"])

    schema = "position int, entry int, n long, sums array<long>"
    part = sums.select("position", F.col("entry_to").alias("entry"), "n", "sums").mapInArrow(add, schema)
    return part.repartition("position", "entry").mapInArrow(add, schema)


def _salts_of(counts: np.ndarray, owner_rows: int) -> np.ndarray:
    return np.maximum(1, -(-counts // owner_rows))


@contextmanager
def _tables(spark: SparkSession) -> Iterator:
    """Saves tables bucketed by owner in the shared folder; what is not asked for again goes, all of them in the end."""
    made: list[tuple[str, str]] = []

    def drop(keep: int) -> None:
        while len(made) > keep:
            name, path = made.pop(0)
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(spark, path)

    def save(df: DataFrame, buckets: int) -> DataFrame:
        name, path = f"kmerloom_owners_{uuid.uuid4().hex}", fresh_path(spark, "owners")
        made.append((name, path))
        df.write.partitionBy("kind").bucketBy(buckets, *OWNER).format("parquet").option("path", path).saveAsTable(name)
        drop(1)
        return spark.table(name)

    try:
        yield save
    finally:
        drop(0)


def train(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, owner_rows: int = OWNER_ROWS) -> np.ndarray:
    """Codebooks (parts x entries x width) of ``rows(vec_id, v)`` with vectors of parts * width components.

    They start as the parts of the rows with the smallest vec_ids (nulls last; equal ids by their vectors), fewer than ``entries`` if there are
    fewer rows. A round replaces each entry by the floor of its members' mean; entries without members stay.
    """
    spark = rows.sparkSession
    ship(spark)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    some = rows.orderBy(*order).select("v").limit(entries).collect()
    start = np.floor(scale * np.array([r["v"] for r in some], np.float64).reshape(len(some), parts * width)).astype(np.int64)
    books = np.ascontiguousarray(start.reshape(len(some), parts, width).transpose(1, 0, 2))
    if not len(some) or not width:
        return books
    numbered = rows.select(F.monotonically_increasing_id().alias("number"), "v")
    begun = written(numbered.mapInArrow(_first(books, scale), "position int, entry int, h int, part array<int>"), "parts")
    counts = np.zeros(books.shape[:2], np.int64)
    for r in begun.groupBy("position", "entry").count().collect():
        counts[r["position"], r["entry"]] = r["count"]
    # as many buckets as the session deals to at least: with fewer, Spark would shuffle the residents too
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-counts.sum() // BUCKET_ROWS)))
    salts = _salts_of(counts, owner_rows)
    of = F.array(*[F.array(*[F.lit(int(n)) for n in line]) for line in salts])
    arriving = begun.select("position", "entry", F.pmod("h", F.get(F.get(of, F.col("position")), F.col("entry"))).cast("int").alias("salt"), "h", "part")
    staying = spark.createDataFrame([], _MEMBER)
    with _tables(spark) as save:
        for _ in range(rounds):
            done = save(staying.groupBy(*OWNER).cogroup(arriving.groupBy(*OWNER)).applyInArrow(_turn(books, salts), _PASS), buckets)
            counts = np.zeros_like(counts)
            books = books.copy()
            for r in _merged(done.where(F.col("kind") == SUM)).collect():
                counts[r["position"], r["entry"]] = r["n"]
                books[r["position"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
            salts = _salts_of(counts, owner_rows)
            staying = done.where(F.col("kind") == STAY).select(*OWNER, "h", "part")
            arriving = done.where(F.col("kind") == MOVE).select("position", F.col("entry_to").alias("entry"), F.col("salt_to").alias("salt"), "h", "part")
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _encode(books: np.ndarray, scale: int):
    parts, _, width = books.shape

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            n, v = b.num_rows, b.column(1)
            fits = (v.value_lengths().to_numpy() == parts * width) if books.shape[1] else np.zeros(n, bool)
            x = integers(v.filter(pa.array(fits)), parts * width, scale)
            found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            code, error = np.full(n, None, object), np.full(n, None, object)
            code[fits] = ["".join(f"{e:02x}" for e in c) for c in zip(*[f[0].tolist() for f in found], strict=True)]
            error[fits] = sum(f[1] for f in found).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["row", "code", "error"])

    return encode


def compress(vectors: DataFrame, carry: tuple[str, ...] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, owner_rows: int = OWNER_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(row, code, error) for each usable row of ``vectors(vec_id, embedding)``, and the final codebooks; ``row`` is a struct of the carried
    columns, all by default, so no name of theirs meets one of ours.

    ``code`` is the 0-based entry of each part in order, two hex digits each, ``error`` the squared distances summed. Rows whose vector is null
    or holds a null or a value that is not finite go; rows that repeat a vec_id or vector are rows of their own. All vectors should be of one length: those
    of another length than the commonest are no members, and have a null code and error. An empty table gives no rows. Components so
    large that distances would not fit a long are an error, as are lengths that do not divide into the parts.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    ship(vectors.sparkSession)
    rows = usable(vectors, tuple(vectors.columns) if carry is None else carry)
    dims = dimension(rows, parts, scale)
    books = train(rows.where(F.size("v") == dims), dims // parts, parts, entries, rounds, scale, owner_rows)
    schema = T.StructType([rows.schema["row"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.select("row", "v").mapInArrow(_encode(books, scale), schema), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    found, books = compress(vectors, ("vec_id", "label"))
    found = written(found.select("row.vec_id", "row.label", "code", "error"), "codes")
    # a table of labels, of known size: it is sent if it is small, and else a hot label can be split
    sums = written(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = found.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


QUERIES = {"op12_vector_codes": op12_vector_codes}


def _oracle() -> str:
    """DuckDB: the rounds one after the other, in exact integers."""
    far = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT n, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT n, p, e, {far} AS d FROM x JOIN b{r} USING (p)) GROUP BY n, p)"
    steps = []
    for r in range(ROUNDS):
        steps += [
            near(r),
            f"m{r} AS (SELECT p, e, i, cast(floor(sum(x[i]) / count(*)) AS bigint) AS c FROM a{r} JOIN x USING (n, p), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, e, i)",
            f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(q.y, b{r}.y) AS y FROM b{r} LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS y FROM m{r} GROUP BY p, e) q USING (p, e))",
        ]
    steps.append(near(ROUNDS))
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT n, p, list_transform(embedding[p * len(embedding) // {PARTS} + 1 : (p + 1) * len(embedding) // {PARTS}], lambda c: cast(floor({SCALE} * cast(c AS double)) AS bigint)) AS x FROM v, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, n - 1 AS e, x AS y FROM x WHERE n <= {ENTRIES}),
{", ".join(steps)},
c AS (SELECT n, string_agg(printf('%02x', cast(e AS integer)), '' ORDER BY p) AS code, cast(sum(d) AS bigint) AS error FROM a{ROUNDS} GROUP BY n)
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256 FROM c JOIN v USING (n)"""


ORACLES: dict[str, str] = {"op12_vector_codes": _oracle()}
