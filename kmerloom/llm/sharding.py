"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters the rows into memory-sized buckets by seeded hashes of the id: the hash of the id with each shard's number names the
shard (the highest wins, so one more shard takes rows only into itself), a further hash the bucket within the shard. Pass
two sorts each bucket, so that it does not matter in which order rows arrived, puts it through a seeded Fisher-Yates shuffle (the built-in
``shuffle``) and writes it. A slot is the place in the bucket after all earlier buckets of the shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import fresh_path, table, written

SHARDS = 40
#: A bucket holds about this share of the memory of a task, within limits in bytes.
BUCKET_SHARE, BUCKET_LIMITS = 32, (4 << 20, 256 << 20)
#: Equal rows beyond which they are dealt to several buckets.
REPEATS = 10_000
SEED = 20240607
_UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def bucket_bytes_for(spark: SparkSession) -> int:
    """Bytes of texts of a bucket, from the memory of an executor and its cores."""
    said = spark.sparkContext.getConf().get("spark.executor.memory", "1g").lower().rstrip("b")
    memory = int(float(said[:-1]) * _UNITS[said[-1]]) if said[-1] in _UNITS else int(said)
    cores = int(spark.sparkContext.getConf().get("spark.executor.cores", "1"))
    return min(BUCKET_LIMITS[1], max(BUCKET_LIMITS[0], memory // cores // BUCKET_SHARE))


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: only the id and the number of shards decide."""
    best = F.array_max(F.array(*[F.struct(F.xxhash64(doc_id, F.lit(s), F.lit(seed)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))
    return best["s"]


def shard_rows(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int | None = None, seed: int = SEED, path: str | None = None, repeats: int = REPEATS) -> tuple[DataFrame, str]:
    """The written table (shard, bucket, place, and the columns of ``docs``) and its folder, one subfolder a shard.

    docs needs doc_id and text. Its columns named shard, bucket or place are kept under these names with underscores after them. Null ids
    share a shard, their buckets still follow the texts. Repeated rows all stay: those of more than ``repeats`` are dealt to several
    buckets by row number, and only their slots depend on how the input is cut; all other slots depend on the rows, the seed, the
    number of shards and the size of buckets alone. An empty table writes no rows.
    """
    spark = docs.sparkSession
    size = bucket_bytes or bucket_bytes_for(spark)
    names, taken = [], {"shard", "bucket", "place", *(c for c in docs.columns if c not in ("shard", "bucket", "place"))}
    for c in docs.columns:
        name = c
        while c in ("shard", "bucket", "place") and name in taken:
            name += "_"
        taken.add(name)
        names.append(F.col(f"`{c}`").alias(name))
    text = F.coalesce("text", F.lit("")).cast("binary")
    # rows are numbered next to the scan, where a task that runs again numbers them alike
    own = docs.select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("number"), F.xxhash64("doc_id", text, F.lit(seed + 1)).alias("h"), F.struct(*names).alias("row"))
    total, n = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.count(F.lit(1))).first()
    buckets = max(1, -(-(total or 0) // (shards * size)))
    often = written(own.groupBy("h").count().where(F.col("count") > repeats).select(F.col("h").alias("again"), F.ceil(F.col("count") / repeats).cast("int").alias("deals")), "repeats") if n > repeats and buckets > 1 else None
    if often is not None:
        own = own.join(often, F.col("h") == F.col("again"), "left")
        h = F.when(F.col("deals").isNull(), F.col("h")).otherwise(F.xxhash64("h", F.pmod("number", F.col("deals"))))
    else:
        h = F.col("h")
    scattered = own.select(shard_of(F.col("id"), shards, seed).alias("shard"), F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), "h", "row")
    # shuffle draws from a generator of the partition: which buckets a partition holds, and in which order, is fixed by their names
    dealt = scattered.repartition(int(buckets * shards), "shard", "bucket").sortWithinPartitions("shard", "bucket", "h")
    if _unordered(docs):
        first = lambda a, b, k: F.when(a[k] < b[k], -1).when(a[k] > b[k], 1)
        listed = F.array_sort(F.collect_list(F.struct("h", F.to_json(F.struct("row")).alias("said"), "row")), lambda a, b: F.coalesce(first(a, b, "h"), first(a, b, "said"), F.lit(0)))
    else:
        listed = F.array_sort(F.collect_list(F.struct("h", "row")))
    mixed = dealt.groupBy("shard", "bucket").agg(listed.alias("rows")).select("shard", "bucket", F.shuffle("rows", seed).alias("rows"))
    out = mixed.select("shard", "bucket", F.posexplode("rows").alias("place", "x")).select("shard", "bucket", "place", "x.row.*")
    at = path or fresh_path(spark, "shards")
    out.write.partitionBy("shard").parquet(at)
    return spark.read.schema(out.schema).parquet(at), at


def _unordered(docs: DataFrame) -> bool:
    """Whether a column holds a map or variant, which have no order."""
    return any(x in f.dataType.simpleString() for f in docs.schema.fields for x in ("map<", "variant"))


def with_slots(written: DataFrame) -> DataFrame:
    """The written rows with ``slot``, gapless from 0 in each shard. Only bucket sizes are summed in order."""
    sizes = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("__start"))
    return written.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("__start") + F.col("place")).drop("__start")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows, _ = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = with_slots(rows.select("shard", "bucket", "place", "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"))


QUERIES = {"op8_sharding": op8_sharding}
ORACLES: dict[str, str] = {}
