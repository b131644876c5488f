"""Structured Streaming counterparts: ledger ingest, windows, sessions, deduplication, and a stateful counter."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState


def stream_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream of files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    is_file = name.endswith(".parquet") and spark.read.format("binaryFile").load(path).select("path").limit(2).count() == 1
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)


def run_to(df: DataFrame, out: str, mode: str = "append", partition_by: list[str] | None = None) -> DataFrame:
    """Runs a stream over what there is, into Parquet with a checkpoint beside it, and reads the result.

    A second call goes on where the first stopped; what was written is written once.
    """
    w = df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True)
    (w.partitionBy(*partition_by) if partition_by else w).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/data")


def run_complete(df: DataFrame, out: str) -> DataFrame:
    """Runs an aggregation whose whole result is replaced with every batch."""
    df.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{out}/data")).option("checkpointLocation", f"{out}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{out}/data")


def windowed(df: DataFrame, time: str, length: str, slide: str | None, late: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums in tumbling or sliding windows of event time; rows later than ``late`` are dropped once their window is out."""
    t = df.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", length, slide) if slide else F.window("_t", length)
    return t.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, late: str, by: str) -> DataFrame:
    t = df.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.session_window("_t", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def deduplicated(df: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """The first of repeated rows within the watermark; state is dropped after it."""
    return df.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def _count(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
    n = state.get[0] if state.exists else 0
    n += sum(len(b) for b in batches)
    state.update((n,))
    yield pd.DataFrame({"key": [key[0]], "n": [n]})


def running_counts(df: DataFrame, key: str) -> DataFrame:
    """Running number of rows per key, kept as state across batches; emits the new total of each key that a batch touches."""
    return df.select(F.col(key).alias("key")).groupBy("key").applyInPandasWithState(_count, "key string, n long", "n long", "update", "NoTimeout")


def _admitted(quota: int):
    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for b in batches:
            place = n + b["id"].rank(method="first").astype("int64")
            n += len(b)
            yield pd.DataFrame({"key": key[0], "id": b["id"], "place": place, "within": place <= quota})
        state.update((n,))

    return run


def within_quota(df: DataFrame, key: str, id_: str, quota: int) -> DataFrame:
    """Each row once with its place among those of its key so far, and whether it is within the key's quota; the counter is state across batches.

    Rows of an earlier batch come first; within a batch of Arrow rows the order is that of ``id_``.
    """
    kind = df.schema[id_].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(id_).alias("id")).groupBy("key").applyInPandasWithState(_admitted(quota), f"key string, id {kind}, place long, within boolean", "n long", "append", "NoTimeout")
