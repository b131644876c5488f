"""Series, sampling, packing, statistics and masks against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import masks, packing, profile, sampling, series, stats


def test_running_totals(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([None, *range(9)]), -1) for i in range(500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v int, pos int")
    got = {(x["g"], x["k"]): (x["before"], x["pos"]) for x in series.running_totals(df, ["g"], ["k"], {"before": F.col("v")}).collect()}
    want, at = {}, defaultdict(lambda: [0, 0])
    for g, k, v, _ in sorted(rows, key=lambda x: x[1]):
        want[g, k] = tuple(at[g])
        at[g][0] += v or 0
        at[g][1] += 1
    assert got == want
    assert series.running_totals(df.limit(0), ["g"], ["k"], {"before": F.col("v")}).count() == 0


@pytest.mark.parametrize("block", [7, 50, 10_000])
def test_frames_over_blocks(spark, block):
    df = spark.createDataFrame([("a", i, i * i % 17) for i in range(120)] + [("b", 3, 1), ("c", None, 1)], "g string, t int, v int")
    got = {(r["g"], r["t"]): r["s"] for r in series.with_frames(df, "g", "t", "v", 5, lambda w: {"s": F.sum("v").over(w.rowsBetween(-5, 0))}, block).collect()}
    assert got == {**{("a", i): sum(j * j % 17 for j in range(max(0, i - 5), i + 1)) for i in range(120)}, ("b", 3): 1}


def test_greedy_fill(spark):
    df = spark.createDataFrame([("g", i, t, f"{i:016x}") for i, t in enumerate([5, 9, 4, 2, 1, 0])] + [("h", 9, 50, "0" * 16), (None, 7, 3, "1" * 16)], "g string, id int, t int, rank string")
    got = defaultdict(list)
    for r in sampling.greedy_fill(df, ["g"], 10, ["id"]).collect():
        got[r["g"]].append(r["t"])
    assert got == {"g": [5, 4, 1], "h": [50], None: [3]}


def test_rank_candidates(spark):
    df = spark.createDataFrame([("a", i, 10) for i in range(2000)] + [("b", 1, 5)], "g string, id int, n int")
    got = sampling.rank_candidates(df, ["g"], F.concat(F.lit("k"), F.col("id").cast("string")), F.col("n"), 1000).groupBy("g").count().collect()
    n = {r["g"]: r["count"] for r in got}
    assert n["b"] == 1 and 60 < n["a"] < 160
    assert sampling.rank_candidates(df, ["g"], F.col("id").cast("string"), F.col("n"), 0).groupBy("g").count().count() == 2  # the lowest stays


def test_weighted_draw(spark):
    u = spark.range(1000).select(sampling.weighted_draw(F.col("id") / 1000, {"a": 0.5, "b": 0.3, "c": 0.2}).alias("x")).groupBy("x").count().collect()
    assert {r["x"]: r["count"] for r in u} == {"a": 500, "b": 300, "c": 200}


def walk(docs, first, needed):
    out, at, i = [], 0, first
    while at < needed:
        d, a, b = docs[i % len(docs)]
        take = min(b - a, needed - at)
        if take:
            out.append((d, a, a + take, at, at + take))
        at += take
        i += 1
    return out


def test_pack_isolated(spark):
    r = random.Random(3)
    docs, at = [], 0
    for i in range(23):
        n = r.choice([0, 1, 3, 8, 40])
        docs.append((f"d{i}", at, at + n))
        at += n
    df = spark.createDataFrame([("s", d, i, a, b) for i, (d, a, b) in enumerate(docs)], "shard_id string, doc_id string, doc_no long, start long, end long")
    draws = spark.createDataFrame([("s", i, i) for i in range(23)], "shard_id string, seq_id long, doc_no long")
    for needed in (5, 65, 3 * at):
        got = defaultdict(list)
        for x in packing.pack_isolated(df, draws, needed).collect():
            got[x["seq_id"]].append((x["doc_id"], x["token_start"], x["token_end"], x["seq_start"], x["seq_end"]))
        for i in range(23):
            assert sorted(got[i], key=lambda s: s[3]) == walk(docs, i, needed)


def test_assemble(spark):
    seg = spark.createDataFrame([(1, "a", 100, 104, 0), (1, "b", 7, 10, 4)], "seq_id int, seg string, token_start long, token_end long, seq_start long")
    p = packing.positions(seg, ["seq_id", "seg"]).withColumn("token", F.col("token_pos").cast("int")).withColumn("role", F.when(F.col("pos") >= 3, "assistant").otherwise("user"))
    r = packing.assemble(p, 6).first()
    assert r["input_ids"] == [100, 101, 102, 103, 7, 8] and r["target_ids"] == [101, 102, 103, 7, 8, 9]
    assert r["position_ids"] == [0, 1, 2, 3, 0, 1] and r["loss_mask"] == [0, 0, 1, 1, 1, 1]
    none = packing.assemble(p.withColumn("role", F.lit(None).cast("string")), 6)
    assert none.first()["loss_mask"] == [1] * 6
    h = lambda x: packing.content_hash(x).first()["content_hash"]
    assert h(packing.assemble(p, 6)) == h(packing.assemble(p.repartition(3), 6)) != h(none)


def test_length_profile(spark):
    v = [3, 9, 1, 7, 7, 2, 8, 4, 6, 5]
    r = profile.length_profile(spark.createDataFrame([(x, "clash") for x in v] + [(None, "")], "v int, n string"), F.col("v"), []).first()
    assert (r["n_rows"], r["total"], r["median"], r["p95"], r["most"]) == (10, 52, 5.5, sorted(v)[int(0.95 * 9)], 9)


def test_nearest(spark):
    l = spark.createDataFrame([("a", 10.0), ("a", 100.0), ("b", 5.0)], "g string, t double")
    r = spark.createDataFrame([("a", 8.0, 1), ("a", 12.0, 2), ("a", 94.0, 3), ("b", 50.0, 4)], "g string, u double, x int")
    got = {(x["g"], x["t"]): x["r_x"] for x in stats.nearest(l, r, ["g"], "t", "u", 7.0).collect()}
    assert got == {("a", 10.0): 1, ("a", 100.0): 3, ("b", 5.0): None}


@pytest.mark.parametrize("n", [0, 1, 40])
def test_nearest_without_a_width(spark, n):
    r = random.Random(n)
    left = [(r.choice(["a", "b", "c", None]), float(r.choice([*range(100), 50])), i) for i in range(60)] + [("a", None, 999)]
    right = [(r.choice(["a", "b", None]), float(r.randrange(0, 100, 3)), i) for i in range(n)]
    l, g = spark.createDataFrame(left, "g string, t double, u int"), spark.createDataFrame(right, "g string, u double, x int")
    got = {x["u"]: (x["r_u"], x["r_x"]) for x in series.nearest(l, g, ["g"], "t", "u").collect()}
    want = {}
    for k, t, i in left:
        m = [(abs(u - t), u, x) for kk, u, x in right if kk == k] if t is not None else []
        want[i] = min(m)[1:] if m else (None, None)
    assert got == want


def test_last_and_next(spark):
    v = [None, 3, None, None, 5, None, 7, None]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)] + [("b", 0, None)], "g string, k int, v int").repartition(3)
    got = {(r["g"], r["k"]): (r["_last"], r["_next"]) for r in series.last_and_next(df, ["g"], ["k"], F.col("v")).collect()}
    assert [got["a", i] for i in range(8)] == [(None, 3), (3, 3), (3, 5), (3, 5), (5, 5), (5, 7), (7, 7), (7, None)] and got["b", 0] == (None, None)


def test_pieces(spark):
    """A window from any place: its first document from within, and round at the end."""
    docs = spark.createDataFrame([("s", "d0", 0, 5), ("s", "d1", 5, 6), ("s", "d2", 6, 20)], "shard_id string, doc_id string, start long, end long")
    first = spark.createDataFrame([("s", i, i) for i in range(20)], "shard_id string, seq_id long, from long")
    flat = [(d, k) for d, a, b in (("d0", 0, 5), ("d1", 5, 6), ("d2", 6, 20)) for k in range(a, b)]
    got = defaultdict(dict)
    for r in packing.pieces(docs, first, 23).collect():
        for k in range(r["token_end"] - r["token_start"]):
            got[r["seq_id"]][r["seq_start"] + k] = (r["doc_id"], r["token_start"] + k)
    for i in range(20):
        assert [got[i][k] for k in range(23)] == [flat[(i + k) % 20] for k in range(23)]


def test_mean_cosine(spark):
    r = np.random.default_rng(0).normal(size=(30, 5))
    u = r / np.linalg.norm(r, axis=1, keepdims=True)
    want = (u @ u.T)[~np.eye(30, dtype=bool)].mean()
    df = spark.createDataFrame([(1, x.tolist()) for x in r] + [(1, None), (1, [0.0] * 5)], "g int, v array<double>")
    assert abs(stats.mean_pairwise_cosine(df, ["g"], "v").first()["mean_cosine"] - want) < 1e-5


def test_heavy_hitters_and_causality(spark):
    s = masks.causal_pairs(spark, 12).withColumn("score", F.rand(3)).withColumn("m", F.lit(1))
    rows = masks.heavy_hitters(s, "m", 3, 2).collect()
    alive = defaultdict(set)
    for r in rows:
        assert r["j"] <= r["i"]
        alive[r["i"]].add(r["j"])
    for i in range(1, 12):
        assert alive[i] - {i} <= alive[i - 1] and len([j for j in alive[i] if i - j >= 3]) <= 2  # the evicted never come back


def test_heavy_hitters_against_a_scan(spark):
    pairs = masks.causal_pairs(spark, 15).withColumn("score", F.rand(5)).withColumn("m", F.lit(1)).persist()
    s = {(r["i"], r["j"]): r["score"] for r in pairs.collect()}
    window, k = 3, 2
    mass, alive, want = defaultdict(float), set(), set()
    for i in range(15):
        alive.add(i)
        top = max(s[i, j] for j in alive)
        e = {j: np.exp(s[i, j] - top) for j in alive}
        for j in alive:
            mass[j] += e[j] / sum(e.values())
        old = sorted((j for j in alive if i - j >= window), key=lambda j: (-mass[j], j))
        alive -= set(old[k:])
        want |= {(i, j) for j in alive}
    got = {(r["i"], r["j"]) for r in masks.heavy_hitters(pairs, "m", window, k).where("code > 0").collect()}
    assert got == want


def test_softmax_of_nothing(spark):
    df = spark.createDataFrame([(1, float("-inf")), (1, float("-inf")), (2, 1.0), (2, float("-inf"))], "g int, s double")
    assert sorted((r["g"], r["p"]) for r in masks.softmax(df, ["g"], "s").collect()) == [(1, 0.0), (1, 0.0), (2, 0.0), (2, 1.0)]
