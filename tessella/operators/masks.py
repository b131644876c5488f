"""Attention as long tables: patterns of masks, scores, softmax and products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def causal_pairs(spark: SparkSession, n: int) -> DataFrame:
    """(i, j) with j <= i < n; generated per i, without a cross join."""
    return spark.range(n).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("i"))))


def pattern(kind: str, window: int = 4, sinks: int = 2, stride: int = 4, random: float = 0.12, u: Column | None = None) -> Column:
    """Code of a cell: 0 not read, 1 near or dense, 2 sink or global, 3 chosen. For patterns that depend on (i, j) only."""
    i, j = F.col("i"), F.col("j")
    near = i - j < window
    if kind == "full":
        return F.lit(1)
    if kind == "window":
        return F.when(near, 1).otherwise(0)
    if kind == "sinks":
        return F.when(near, 1).when(j < sinks, 2).otherwise(0)
    if kind == "strided":
        return F.when(F.floor(i / stride) == F.floor(j / stride), 1).when((i - j) % stride == 0, 3).otherwise(0)
    if kind == "bigbird":
        return F.when(near, 1).when(j < 1, 2).when(u < random, 3).otherwise(0)
    raise ValueError(kind)


def top_k_cells(scores: DataFrame, k: int) -> DataFrame:
    """The k largest past scores per row; ties by column."""
    r = F.row_number().over(W.partitionBy("i").orderBy(F.desc("score"), "j"))
    return scores.withColumn("code", F.when(r <= k, 3).otherwise(0))


def top_blocks(scores: DataFrame, block: int, k: int, window: int | None = None) -> DataFrame:
    """The row's own block (or window) and the k past blocks with the largest mean score; ties by block."""
    cur, blk = F.floor(F.col("i") / block), F.floor(F.col("j") / block)
    b = scores.groupBy("i", blk.alias("blk")).agg(F.avg("score").alias("m")).where(F.col("blk") < F.floor(F.col("i") / block))
    chosen = b.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy(F.desc("m"), "blk"))).where(F.col("r") <= k).select(F.col("i").alias("ci"), F.col("blk").alias("cb"), F.lit(True).alias("c"))
    near = (cur == blk) if window is None else (F.col("i") - F.col("j") < window)
    return scores.join(chosen, (F.col("i") == F.col("ci")) & (blk == F.col("cb")), "left").select("i", "j", "score", F.when(near, 1).when(F.col("c"), 3).otherwise(0).alias("code"))


def heavy_hitters(scores: DataFrame, matrix: str, window: int, k: int) -> DataFrame:
    """Greedy eviction: of the positions beyond the window those k with the most attention so far stay, others never return.

    A scan with state, so one Python call per matrix; a matrix is bounded by the length of its sequence.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["i"].max()) + 1
        s = np.full((n, n), -np.inf)
        s[pdf["i"], pdf["j"]] = pdf["score"]
        mass, alive, out = np.zeros(n), np.zeros(n, bool), []
        for i in range(n):
            alive[i] = True
            at = np.flatnonzero(alive)
            e = np.exp(s[i, at])
            mass[at] += e / e.sum()
            old = at[i - at >= window]
            if len(old) > k:
                alive[old[np.argsort(mass[old], kind="stable")[: len(old) - k]]] = False
            out += [(pdf[matrix].iloc[0], i, j, 1 if i - j < window else 3) for j in np.flatnonzero(alive)]
        return pd.DataFrame(out, columns=[matrix, "i", "j", "code"])

    return scores.groupBy(matrix).applyInPandas(run, f"{matrix} {scores.schema[matrix].dataType.simpleString()}, i long, j long, code int")


def softmax(df: DataFrame, by: list[str], score: str, out: str = "p") -> DataFrame:
    """Softmax within groups; a group without a finite score gets zeros."""
    w = W.partitionBy(*by)
    m = F.max(F.when(F.col(score) > float("-inf"), F.col(score))).over(w)
    e = F.when(F.col("_m").isNotNull() & (F.col(score) > float("-inf")), F.exp(F.col(score) - F.col("_m"))).otherwise(F.lit(0.0))
    return df.withColumn("_m", m).withColumn("_e", e).withColumn(out, F.when(F.col("_m").isNull(), F.lit(0.0)).otherwise(F.col("_e") / F.sum("_e").over(w))).drop("_m", "_e")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices in long form (i, j, v)."""
    r = b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    return a.join(r, F.col("j") == F.col("_k")).groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))
