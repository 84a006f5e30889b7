"""A folder that driver and executors share, for tables that queries write and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's spark.checkpoint.dir; a local master, whose one machine runs everything, may go without."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="kmerloom-own-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows of df as a table in the shared folder, or under ``path``; its schema is known, so no job reads it from the files."""
    at = path or fresh_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def together(spark: SparkSession, *jobs: Callable[[], T]) -> list[T]:
    """What the jobs return, run at the same time: small ones that do not depend on one another need not wait in turn. An error of any is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]
