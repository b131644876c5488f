"""Deterministic sampling by hash ranks, and budgets of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.functions.text import rank64
from tessella.operators.series import running_totals


def rank_candidates(df: DataFrame, by: list[str], key: Column, n_tokens: Column, target: int, slack: float = 1.08) -> DataFrame:
    """Rows whose 64-bit rank is under the share of tokens that is wanted, per group; the lowest rank where that leaves none.

    Adds ``rank`` (16 hex digits), ``t`` (tokens). Two passes: what is available per group, then a filter. Groups whose
    size isn't bounded are fine: nothing is sorted. Null tokens count as 0.
    """
    x = df.withColumn("rank", rank64(key)).withColumn("t", F.coalesce(n_tokens, F.lit(0)))
    avail = x.groupBy(*by).agg(F.sum("t").alias("_avail"), F.min("rank").alias("_lowest"))
    share = F.least(F.lit(1.0), F.lit(target * slack) / F.greatest("_avail", F.lit(1)))
    cut = F.when(share >= 1, F.lit("f" * 16)).otherwise(F.lpad(F.lower(F.conv((share * float(2**64)).cast("decimal(20,0)").cast("string"), 10, 16)), 16, "0"))
    avail = avail.withColumn("_cut", cut)
    y = _with(x, avail, by)
    some = y.where(F.col("rank") <= F.col("_cut")).groupBy(*by).agg(F.lit(True).alias("_some"))
    z = _with(y, some, by, "left")
    return z.where((F.col("rank") <= F.col("_cut")) | (F.col("_some").isNull() & (F.col("rank") == F.col("_lowest")))).drop("_avail", "_lowest", "_cut", "_some")


def _with(x: DataFrame, per: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``x`` with the columns of a table that has a row per group; null groups are equal."""
    per = per.withColumnsRenamed({c: f"_g_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return x.join(per, on, how).drop(*[f"_g_{c}" for c in by])


def greedy_fill(df: DataFrame, by: list[str], target: int, keep: list[str]) -> DataFrame:
    """In order of ``rank``: takes a row if it is the first of its group or still fits, skips it if not, ends at the target.

    Expects the output of :func:`rank_candidates`: the candidates of a group hold about ``1.08 * target`` tokens at most, so a
    group's rows are bounded by the target whatever the size of the data. One fold per group, inside the JVM.
    """
    item = F.struct("rank", F.col("t").cast("long").alias("t"), *keep)
    kind = df.select(item.alias("i")).schema["i"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast(f"array<{kind}>").alias("kept"))
    take = lambda a, x: (a["total"] < target) & ((F.size(a["kept"]) == 0) | (a["total"] + x["t"] <= target))
    step = lambda a, x: F.when(take(a, x), F.struct((a["total"] + x["t"]).alias("total"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("c"))
    return g.select(*by, F.explode(F.aggregate("c", start, step)["kept"]).alias("i")).select(*by, "i.*")


def capped_shuffle(df: DataFrame, by: list[str], key: Column, n_tokens: Column, cap: int) -> DataFrame:
    """Rows in the order of a hash until the cap is reached, the row that reaches it included; empty ones are skipped."""
    x = df.withColumn("rank", F.sha2(key, 256)).withColumn("t", F.coalesce(n_tokens, F.lit(0))).where("t > 0")
    return running_totals(x, by, ["rank"], {"before": F.col("t")}).where(F.col("before") < cap).drop("pos")


def seeded_split(df: DataFrame, key: Column, share: float) -> DataFrame:
    """``split``: the first ``max(1, floor(n * share))`` rows in the order of a hash are ``val``, the others ``train``."""
    x = running_totals(df.withColumn("rank", F.sha2(key, 256)), [], ["rank"], {})
    n = x.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("n_val"))
    return x.join(F.broadcast(n)).withColumn("split", F.when(F.col("pos") < F.col("n_val"), "val").otherwise("train")).drop("n_val", "pos")


def weighted_draw(u: Column, weights: dict[str, float]) -> Column:
    """The name whose interval of cumulative weights holds ``u`` in [0, 1)."""
    total = sum(weights.values())
    out, at = F.lit(list(weights)[-1]), 1.0
    for name, w in reversed(list(weights.items())[:-1]):
        at = sum(v for k, v in weights.items() if list(weights).index(k) <= list(weights).index(name)) / total
        out = F.when(u < at, F.lit(name)).otherwise(out)
    return out


def ordered_digest(df: DataFrame, by: list[str], order: list[str], line: Column) -> DataFrame:
    """SHA-256 over the lines of a group in order; for groups whose number of rows is bounded."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"])
    return df.groupBy(*by).agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"), F.count("*").alias("n"))
