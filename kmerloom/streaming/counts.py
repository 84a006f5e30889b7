"""Sequences that arrive over time: k-mer counts kept up to date by a stream, and the same analysis on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from kmerloom.functions.alphabet import PROTEIN, Alphabet
from kmerloom.functions.kmers import windows
from kmerloom.operators import diversity
from kmerloom.operators.entropy import with_entropy


def stream_counts(rows: DataFrame, k: int, a: Alphabet = PROTEIN) -> DataFrame:
    """(position, kmer, count) of a streaming ``rows(sequence)``: counts only add up, so no watermark is needed."""
    return windows(rows, k, a, keep=()).groupBy("position", "kmer").agg(F.count(F.lit(1)).alias("count"))


def keep_counts(rows: DataFrame, k: int, path: str, checkpoint: str, a: Alphabet = PROTEIN) -> StreamingQuery:
    """Append each batch's counts as a table of deltas under ``path``; a batch that runs again overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        windows(batch, k, a, keep=()).groupBy("position", "kmer").agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(deltas: DataFrame) -> DataFrame:
    """Counts as of now from the table of deltas."""
    return deltas.groupBy("position", "kmer").agg(F.sum("count").alias("count"))


def _folders(spark: SparkSession, path: str, key: str) -> list[int]:
    """The numbers of the complete tables key=<number> below a folder."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    at = fs_path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{key}=") and fs.exists(fs_path(f"{path}/{n}/_SUCCESS")))


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_COUNTS = "position int, kmer string, count long"


def kept(spark: SparkSession, path: str) -> DataFrame:
    """Counts as of now of ``keep_generations``: the last complete generation and the deltas after it."""
    bases = _folders(spark, f"{path}/base", "upto")
    after = [n for n in _folders(spark, f"{path}/deltas", "batch") if not bases or n > bases[-1]]
    parts = [f"{path}/base/upto={bases[-1]}"] if bases else []
    parts += [f"{path}/deltas/batch={n}" for n in after]
    return current(spark.read.schema(_COUNTS).parquet(*parts)) if parts else spark.createDataFrame([], _COUNTS)


def keep_generations(rows: DataFrame, k: int, path: str, checkpoint: str, a: Alphabet = PROTEIN, every: int = 16) -> StreamingQuery:
    """Keep each batch's counts as deltas, and after every ``every`` batches merge all into one generation, a row for each (position, kmer).

    So what is stored and read is bounded by the distinct (position, kmer) and the deltas of ``every`` batches, however many batches came. A
    generation counts once it is complete, and says which batches it holds: deltas of those are ignored, whether or not they
    were deleted, and a batch that runs again after a failure changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bases = _folders(spark, f"{path}/base", "upto")
        if bases and number <= bases[-1]:
            return
        windows(batch, k, a, keep=()).groupBy("position", "kmer").agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")
        if (number + 1) % every == 0:
            kept(spark, path).write.mode("overwrite").parquet(f"{path}/base/upto={number}")
            for old in bases:
                _drop(spark, f"{path}/base/upto={old}")
            for n in _folders(spark, f"{path}/deltas", "batch"):
                if n <= number:
                    _drop(spark, f"{path}/deltas/batch={n}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def positions_now(deltas: DataFrame, threshold: int, k: int) -> DataFrame:
    counts = current(deltas)
    every = deltas.agg(F.max("position").alias("n")).where("n IS NOT NULL").select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("position"))
    return with_entropy(diversity.position_stats(counts, threshold, every), threshold)
