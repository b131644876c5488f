"""Queries over readings of training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.operators.anomalies import flag_readings, spike_rates
from tessella.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return flag_readings(table(spark, d, "main_midpoint_rev")).select("ledger_offset", "field").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return spike_rates(table(spark, d, "main_midpoint_rev"))


QUERIES = {f.__name__: f for f in (p2_found, p2_rates)}
SQL: dict[str, str] = {}
