"""Aggregates of aggregates: information, load, fits, extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information in bits of two columns, their entropies and chance agreement. Pairs with a null are left out.

    One aggregation over the rows; the margins are sums over the table of pairs.
    """
    c = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("c"))
    n = F.sum("c").over(W.partitionBy(F.lit(0)))
    c = c.withColumn("n", n).withColumn("cx", F.sum("c").over(W.partitionBy(x))).withColumn("cy", F.sum("c").over(W.partitionBy(y)))
    p, px, py = F.col("c") / F.col("n"), F.col("cx") / F.col("n"), F.col("cy") / F.col("n")
    share = F.col("c") / F.col("cx")  # of the row in its x: spreads the terms of x over its pairs
    return c.agg(
        F.round(F.coalesce(F.sum(p * F.log2(p / (px * py))), F.lit(0.0)), 6).alias("bits"),
        F.round(F.coalesce(-F.sum(share * px * F.log2(px)), F.lit(0.0)), 6).alias("entropy_x"),
        F.round(F.coalesce(F.sum(share * px * px), F.lit(0.0)), 6).alias("agreement_x"),
    )


def lift_top(df: DataFrame, group: str, item: str, k: int, least: int) -> DataFrame:
    """The k items per group with the highest lift (share in the group over share overall), of items seen ``least`` times; ties by item."""
    c = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(F.count("*").alias("c"))
    sums = lambda x, name: c.groupBy(*([F.col(x).alias(f"_{x}")] if x else [])).agg(F.sum("c").alias(name))
    m, o = sums(group, "m"), sums(item, "o").where(F.col("o") >= least)
    c = c.join(o, c[item] == o[f"_{item}"]).join(m, c[group] == m[f"_{group}"]).join(F.broadcast(sums("", "n")))  # one row
    lift = F.round((F.col("c") / F.col("m")) / (F.col("o") / F.col("n")), 6)
    r = F.row_number().over(W.partitionBy(group).orderBy(F.desc("lift"), F.asc(item)))
    return c.withColumn("lift", lift).withColumn("rank", r).where(F.col("rank") <= k).select(group, item, "lift", "rank")


def load_stats(df: DataFrame, expert: Column, n_experts: int, family: int) -> DataFrame:
    """Load over a dense range of experts: worst violation, dead and starved ones, and dead ones per family of ``family`` neighbours."""
    spark = df.sparkSession
    c = df.groupBy(expert.cast("long").alias("e")).agg(F.count("*").alias("c"))
    dense = spark.range(n_experts).select(F.col("id").alias("e")).join(c, "e", "left").select("e", F.coalesce("c", F.lit(0)).alias("c"))
    mean = dense.agg(F.avg("c").alias("mean"), F.max("c").alias("top"))
    x = dense.join(F.broadcast(mean))
    fam = x.groupBy(F.floor(F.col("e") / family).alias("f")).agg(F.count_if(F.col("c") == 0).alias("dead"))
    return x.agg(
        F.round((F.max("top") - F.max("mean")) / F.max("mean"), 6).alias("max_violation"), F.count_if(F.col("c") == 0).alias("n_dead"),
        F.count_if(F.col("c") < 0.1 * F.col("mean")).alias("n_starved"), F.round(F.sum(F.pow(F.try_divide("c", F.col("mean") * n_experts), F.lit(2))), 6).alias("agreement"),
    ).join(F.broadcast(fam.agg(F.max("dead").alias("most_dead_in_family"))))


def mean_pairwise_cosine(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean cosine of all pairs of different vectors per group, in one pass: (|sum of unit vectors|^2 - n) / (n (n - 1)).

    Null and zero vectors are left out; a group of one has null.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    x = df.where(F.col(vector).isNotNull()).withColumn("_n", norm).where("_n > 0")
    parts = x.select(*by, F.posexplode(F.transform(vector, lambda v: v.cast("double") / F.col("_n"))).alias("i", "u")).groupBy(*by, "i").agg(F.sum("u").alias("s"), F.count("*").alias("n"))
    n = F.max("n")
    return parts.groupBy(*by).agg(n.alias("n"), F.round(F.try_divide(F.sum(F.col("s") * F.col("s")) - n, n * (n - 1)), 5).alias("mean_cosine"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, to: str, width: float) -> DataFrame:
    """For each row of ``left`` the row of ``right`` in its group whose ``to`` is nearest to ``at`` (ties: the lower), within ``width``.

    Positions are cut into cells of ``width``; a row meets its own and the two neighbouring cells, by an equi-join. Columns of
    ``right`` get the prefix ``r_``. Rows without a match keep nulls.
    """
    l = left.withColumn("_id", F.monotonically_increasing_id()).withColumn("_cell", F.floor(F.col(at) / width))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by], *[F.col(c).alias(f"_by_{c}") for c in by])
    r = r.withColumn("_at", F.explode(F.array(*[F.floor(F.col(f"r_{to}") / width) + i for i in (-1, 0, 1)])))
    on = F.col("_cell") == F.col("_at")
    for c in by:
        on = on & (F.col(c) == F.col(f"_by_{c}"))
    cols = [c for c in r.columns if c.startswith("r_")]
    m = l.join(r, on)
    d = F.abs(F.col(f"r_{to}") - F.col(at))
    best = m.where(d <= width).groupBy("_id").agg(F.min_by(F.struct(*cols), F.struct(d, F.col(f"r_{to}"))).alias("m"))
    return l.join(best, "_id", "left").select(*left.columns, *[F.col(f"m.{c}").alias(c) for c in cols])
