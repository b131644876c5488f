"""Every query of the core with SQL, against that SQL, on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from tessella.plans.registry import core_queries, core_sql


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating, Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core_sql()))
def test_equals_sql(spark, duck, data, name):
    df = core_queries()[name](spark, data)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(core_sql()[name])
    assert got == rows([d[0] for d in cur.description], cur.fetchall())


def test_without_sql():
    assert set(core_queries()) - set(core_sql()) == {"p2_found", "p2_rates", "token_counts", "next_token_pairs", "mask_heavy_hitters"}  # each has a test of its own


@pytest.fixture(scope="module")
def texts(duck):
    from tessella.functions.tokens import encoding

    return [(lane, encoding().encode_ordinary(t or "")) for lane, t in duck.execute("SELECT lane, text FROM documents").fetchall()]


def test_token_counts(spark, data, texts):
    want = {}
    for lane, t in texts:
        n, total, most = want.get(lane, (0, 0, 0))
        want[lane] = (n + 1, total + len(t), max(most, len(t)))
    assert {r["lane"]: (r["n_docs"], r["n_tokens"], r["most"]) for r in core_queries()["token_counts"](spark, data).collect()} == want


def test_next_token_pairs(spark, data, texts):
    from collections import Counter

    n = Counter(p for _, t in texts for p in zip(t, t[1:]))
    want = sorted(n.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert [((r["a"], r["b"]), r["n"]) for r in core_queries()["next_token_pairs"](spark, data).collect()] == want


def test_rates_agree_with_what_is_found(spark, data):
    from collections import Counter

    found = Counter(r["field"] for r in core_queries()["p2_found"](spark, data).collect())
    rates = Counter()
    for r in core_queries()["p2_rates"](spark, data).collect():
        rates[r["field"]] += r["n_spike"] + r["n_stuck"] + r["n_impossible"]
        assert r["n_readings"] > 0
    assert sum(found.values()) > 0 and found == +rates


TAMPERINGS = {
    "evaluation firewall": ("shard_agent", "UPDATE x SET role = 'eval' WHERE doc_id = (SELECT doc_id FROM segments_x WHERE lane = 'agent' LIMIT 1)"),
    "ledger completeness": ("segments", "UPDATE x SET step = 5 WHERE step = 6"),
    "crash recovery": ("main_midpoint_rev", "INSERT INTO x SELECT ledger_offset + 10000000 AS ledger_offset, run_id, step, tokens + 1 AS tokens, loss, gnorm, lr, tok_per_s, logged_at FROM x WHERE step > 0 LIMIT 1"),
    "learning trace": ("main_midpoint_rev", "UPDATE x SET loss = 'nan'::DOUBLE WHERE ledger_offset = (SELECT min(ledger_offset) FROM x WHERE loss IS NOT NULL)"),
}


@pytest.mark.parametrize("check", sorted(TAMPERINGS))
def test_evidence_shows_tampering(spark, duck, data, tmp_path, check):
    """The check, and no other, has more violations than on the tables as they are."""
    import shutil

    at = tmp_path / "tables"
    shutil.copytree(data, at)
    for f in at.iterdir():
        f.chmod(0o644)
    name, change = TAMPERINGS[check]
    c = duckdb.connect()
    c.execute(f"CREATE TABLE segments_x AS SELECT * FROM '{data}/segments.parquet'; CREATE TABLE x AS SELECT * FROM '{data}/{name}.parquet'; {change}; COPY x TO '{at}/{name}.parquet' (FORMAT parquet)")
    run = lambda d: {r["name"]: r["violations"] for r in core_queries()["evidence_bundle"](spark, d).collect()}
    before, after = run(data), run(str(at))
    assert {k for k in before if after[k] > before[k]} == {check, "overall"}
