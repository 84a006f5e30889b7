"""What the operators of this folder share: reading tables, the shared folder, shipping code, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.ship import ship  # noqa: F401

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this Python worker keeps from task to task: one thing at most, as workers are used again by other operators' tasks.
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` gives, kept by the worker for the next task that asks for the same key; anything else goes."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Frees what earlier tasks, of whichever operator, have left in this worker."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()


#: Rows that Python handles at once: batches of the session's size, ten thousand texts by default, are taken in slices of it.
BATCH_ROWS = 1000


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, none of them empty."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Only a local master, whose one machine runs
    everything, may go without; it gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark.sparkContext, "_kmerloom_shared", None)
        if not at:
            at = tempfile.mkdtemp(prefix="kmerloom-shared-")
            spark.sparkContext._kmerloom_shared = at
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _SCRATCH.get():
        made.append(path)
    return path


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows of df as a table in the shared folder: what follows does not depend on executors that may be lost. ``by`` names a column,
    of few values, that each have a folder of their own."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: The lists that this context's ``scratch`` blocks keep; other threads have their own, so none deletes what another has written.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what ``written`` and ``fresh_path`` made inside, in this thread; whoever needs a result later writes it before."""
    made: list[str] = []
    outer = _SCRATCH.set((*_SCRATCH.get(), made))
    try:
        yield
    finally:
        _SCRATCH.reset(outer)
        for path in made:
            remove(spark, path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (any orderable type) as ``(node, root)``, root the smallest node reached.

    Alternating large-star and small-star rounds, each an aggregate and a join over the edges, written to the shared
    folder; the number of rounds grows with the logarithm of the longest path. A round deletes what the one before it wrote. The smallest
    neighbours are a table too: a join with a table can be split where a centre has very many neighbours, one with an aggregate cannot.
    Nothing is collected but one checksum a round. Self-loops and repeated edges do no harm; null ends are ignored.
    """
    spark = edges.sparkSession

    def kept(e: DataFrame) -> tuple[DataFrame, str]:
        path = fresh_path(spark, "edges")
        e.write.parquet(path)
        return spark.read.schema(e.schema).parquet(path), path

    e, path = kept(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        # large star: each larger neighbour points to the smallest node around u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, first = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e, large = kept(e)
        # small star: u and its smaller neighbours point to the smallest of them
        low, second = kept(e.groupBy("u").agg(F.min("v").alias("m")))
        pairs = e.join(low, "u")
        e = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        used = (path, first, large, second)
        e, path = kept(e)
        for was in used:
            remove(spark, was)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
