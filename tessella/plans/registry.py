"""All queries of the core, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["ledger_queries", "corpus_queries", "stats_queries", "sample_queries", "model_queries", "io_queries", "check_queries", "shard_queries"]


def core_queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"tessella.plans.{m}").QUERIES
    return out


def core_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"tessella.plans.{m}").SQL
    return out
