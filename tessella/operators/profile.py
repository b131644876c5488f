"""Length profiles and corpus audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.functions import text as X


def evaluated_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns whose expressions run once a row however often they are used: the optimizer doesn't merge projections across a generator."""
    return df.select(F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("x")).select("x.*")


def length_profile(df: DataFrame, length: Column, by: list[str]) -> DataFrame:
    """Rows, total, mean, median, p95 and most of a length per group, from a histogram of lengths.

    The median interpolates; p95 is the value at index floor(0.95 * (n - 1)) in order. The histogram is aggregated map side
    and has a row per length, so no group is sorted row by row. Null lengths are left out; a group of nulls has no row.
    """
    h = df.select(*by, length.alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("c"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    h = h.withColumn("n", F.sum("c").over(w)).withColumn("hi", F.sum("c").over(w.orderBy("v")))

    def at(i: Column) -> Column:  # value at an index in order
        return F.min(F.when(F.col("hi") > i, F.col("v")))

    n = F.col("n")
    return h.groupBy(*by).agg(
        F.max("n").alias("n_rows"), F.sum(F.col("v") * F.col("c")).alias("total"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 4).alias("mean"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"), at(F.floor(0.95 * (n - 1))).alias("p95"), F.max("v").alias("most"),
    )


def audit_stages(df: DataFrame, text: str, lang: str, over: int = 2048) -> DataFrame:
    """The audit as (stage, metric, value): every stage is computed on all records.

    Null texts count as empty. One pass: the sums are formed per digest of the clean text, which counts exact duplicates, and then added up.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    clean = X.normalize(raw)
    base = evaluated_once(df, raw=raw, clean=clean, lang=F.col(lang))
    n_tok = X.tokens(F.col("clean"))
    sums = {
        ("manifest", "records"): F.count("*"),
        ("manifest", "raw_tokens"): F.sum(X.tokens(F.col("raw"))),
        ("normalize", "changed"): F.count_if(F.col("clean") != F.col("raw")),
        ("normalize", "controls_removed"): F.sum(X.control_count(F.col("raw"))),
        ("format", "empty"): F.count_if(F.col("clean") == ""),
        ("format", "over_length"): F.count_if(n_tok > over),
        ("language", "script_mismatch"): F.count_if((F.col("lang") == "en") & (X.ascii_script_ratio(F.col("clean")) < 0.5)),
        ("pii", "email"): F.sum(X.pattern_count(F.col("clean"), X.EMAIL)),
        ("pii", "phone"): F.sum(X.pattern_count(F.col("clean"), X.PHONE)),
        ("pii", "ipv4"): F.sum(X.pattern_count(F.col("clean"), X.IPV4)),
        ("pii", "url"): F.sum(X.pattern_count(F.col("clean"), X.URL)),
    }
    names = list(sums)
    per = base.groupBy(F.sha2("clean", 256).alias("h")).agg(*[c.cast("long").alias(f"m{i}") for i, c in enumerate(sums.values())])
    one = per.agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(len(sums))], (F.coalesce(F.sum("m0"), F.lit(0)) - F.count("*")).alias(f"m{len(sums)}"))
    names = [*names, ("dedup", "exact_duplicates")]
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(m).alias("metric"), F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("value")) for i, (s, m) in enumerate(names)])).alias("x")).select("x.*")


def top_k(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The k commonest values per group with their counts; ties by value. Counts first, so a group's window holds distinct values only."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return c.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), F.asc_nulls_last(value)))).where(F.col("rank") <= k)
