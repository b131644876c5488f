"""Order-dependent operators over long series, without a group as a whole in one task.

A window of Spark sorts and holds all rows of its partition key in one task. Where a key may hold a large share of the rows, the
operators here cut its series into blocks first: by a checkpointed range partitioning for running totals, and into
blocks with margins for frames of bounded reach.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.session import ensure_checkpoint_dir, parallelism


def running_totals(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name in ``values``, the sum over all rows before the row in its group (exclusive), and ``pos``, their number.

    Rows are sorted by range over (by, order); a part's totals are added from a table with a row per part and group.
    Ties in ``order`` are counted in any but the same order throughout. Nulls in ``by`` form a group; null values count as 0.
    """
    ensure_checkpoint_dir(df.sparkSession)
    names = list(values)
    cols = [*by, *order]
    x = df.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in values.items()})
    x = x.repartitionByRange(parallelism(df), *cols).withColumn("_part", F.spark_partition_id()).checkpoint()
    all_ = [("pos", F.lit(1)), *[(n, F.col(f"_v_{n}")) for n in names]]
    local = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumns({f"_r_{n}": F.sum(c).over(local) - c for n, c in all_})
    parts = x.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in all_])
    over = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_part").alias("_k_part"), *[F.coalesce(F.sum(f"_s_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n, _ in all_])
    on = F.col("_part") == F.col("_k_part")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = x.join(parts, on)  # a row per part and group: small against the rows
    return out.select(*[c for c in df.columns if c != "pos"], *[(F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n, _ in all_])


def last_and_next(df: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """``df`` with ``_last`` and ``_next``: the nearest values that aren't null at or before, and at or after, each row in its group.

    Within a range partition by windows; over partitions by a table with a row per part and group. Nulls in ``by`` form a group.
    """
    ensure_checkpoint_dir(df.sparkSession)
    x = df.withColumn("_v", value).repartitionByRange(parallelism(df), *by, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    w = W.partitionBy(*by, "_part").orderBy(*order)
    x = x.withColumn("_l", F.last("_v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_n", F.first("_v", ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing)))
    key = F.struct(*order)
    parts = x.groupBy(*by, "_part").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), key)).alias("_pl"), F.min_by("_v", F.when(F.col("_v").isNotNull(), key)).alias("_pn"))
    over = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_part")
    parts = parts.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_part").alias("_k_part"), F.last("_pl", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("_bl"), F.first("_pn", ignorenulls=True).over(over.rowsBetween(1, W.unboundedFollowing)).alias("_bn"))
    on = F.col("_part") == F.col("_k_part")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return x.join(parts, on).select(*df.columns, F.coalesce("_l", "_bl").alias("_last"), F.coalesce("_n", "_bn").alias("_next"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, to: str) -> DataFrame:
    """For each row of ``left`` the row of ``right`` in its group whose ``to`` is nearest to ``at`` (ties: the lower), however far off.

    Both are laid out in one order, and each row of the left takes the last of the right before it or the next one after it.
    Columns of ``right`` get the prefix ``r_``; rows without a match, or with a null ``at``, keep nulls. One row of the right per place counts (the least).
    """
    value = F.struct(*[F.col(c).alias(c) for c in right.columns if c not in by])
    r = right.where(F.col(to).isNotNull()).groupBy(*by, F.col(to).alias("_at")).agg(F.min(value).alias("_right"))
    kind = r.schema["_right"].dataType
    l = left.withColumn("_left", F.struct(*left.columns)).select(*by, F.col(at).cast(r.schema["_at"].dataType).alias("_at"), "_left")
    both = r.withColumn("_left", F.lit(None).cast(l.schema["_left"].dataType)).withColumn("_kind", F.lit(0)).unionByName(l.withColumn("_right", F.lit(None).cast(kind)).withColumn("_kind", F.lit(1)))
    found = last_and_next(both, by, ["_at", "_kind"], F.col("_right")).where("_kind = 1")
    near = F.when(F.col("_last").isNull() | (F.col(f"_next.{to}") - F.col("_at") < F.col("_at") - F.col(f"_last.{to}")), F.col("_next")).otherwise(F.col("_last"))
    near = F.when(F.col("_at").isNotNull(), near)
    return found.select("_left.*", *[near[c].alias(f"r_{c}") for c in right.columns if c not in by])


def with_frames(df: DataFrame, by: str, time: str, tie: str, reach: int, frames: Callable[[W], dict[str, Column]], block: int = 100_000) -> DataFrame:
    """``df`` with columns over window frames that reach at most ``reach`` rows to either side, in order of (time, tie).

    ``frames`` gets the window (partition and order) and returns the columns. Each row is computed in the block that it belongs
    to; blocks hold about ``block`` rows and margins of ``reach`` rows. Rows with a null time are left out.
    """
    pos = running_totals(df.where(F.col(time).isNotNull()), [by], [time, tie], {})
    b = F.floor(F.col("pos") / block)
    lo, hi = F.floor((F.col("pos") - reach) / block), F.floor((F.col("pos") + reach) / block)
    x = pos.withColumn("_own", b).withColumn("_block", F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)))
    w = W.partitionBy(by, "_block").orderBy("pos")
    return x.withColumns(frames(w)).where("_own = _block").drop("_own", "_block")
