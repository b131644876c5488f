"""Spikes, stuck values and impossible readings, judged per source.

Method: peaks over threshold. From each reading the seasonal part of its source is taken, the swing that comes back with
a fixed number of readings, where there is one; what lies outside both of the running medians of the readings on either side
(the trend) is its residual. Per source and field the
excesses of the residuals over their 90 % point are fitted by a generalised
Pareto law (by moments, the shape between 0 and 0.15: a tail shorter than exponential is taken for exponential, which
puts its cutoff higher), and the cutoff is the value exceeded with a fixed risk per
reading. Two rules are added: stretches of one value that last longer than
the source's own habit allows, and values that the field cannot take.

Scale. A source may hold any share of the rows, so no step groups by source
alone. Readings are sorted by range over (source, time, key), written, and numbered within their source; blocks of
``block`` consecutive readings with a margin of ``halo`` on both sides are measured, one Python call each, whatever their times. What
was measured is written, so nothing is measured twice. What is known
of a source as a whole are histograms with logarithmic bins, aggregated map
side; their size doesn't grow with the readings. Stretches of equal values that reach over a block's edge are put together
from their parts, so their length has no limit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.session import ensure_checkpoint_dir, scratch

NO_SOURCE = "\x00none"
BINS_PER_OCTAVE = 16
ZERO_BIN = -(10**6)


@dataclass(frozen=True)
class Field:
    """A measured column. ``counter``: it normally advances by a constant; deviations from that advance are its residuals."""

    name: str
    counter: bool = False


@dataclass(frozen=True)
class SpikeRule:
    risk: float = 1e-6  # chance per reading of a source's normal noise to exceed its cutoff
    stuck_risk: float = 1e-3  # expected number per source and field of normal stretches that are called stuck
    stuck_least: int = 5
    side: int = 8  # readings of each running median
    top: float = 0.10  # share of residuals whose excesses are fitted
    season: float = 0.25  # autocorrelation from which a swing counts as the source's season
    cycles: int = 6  # of a season that a block must hold at least
    longest: int = 1024  # readings of a season
    block: int = 8192
    halo: int = 256
    salts: int = 16
    small: int = 100_000  # rows of a table per source up to which it is broadcast; beyond, it is joined with salt


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder; what is read again is read from there."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _blocks(rows: DataFrame, rule: SpikeRule) -> DataFrame:
    """Rows (each ``key`` once) with the blocks that need them: ``block``, and ``own`` where the row belongs to it rather than to its margin.

    Equal rows meet in one range, so dropping them needs no further shuffle. A row's number within its source is its number in the
    range, and the count of the source's rows in the ranges before: a row per source and range.
    """
    order = ["src", "t", "key"]
    x = rows.repartitionByRange(*order).dropDuplicates(order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    x = _written(x, "ranges").withColumn("range", F.shiftright("id", 33))
    w = W.partitionBy("src").orderBy("range")
    parts = x.groupBy("src", "range").agg(F.min("id").alias("first"), F.count("*").alias("n")).select("src", "range", (F.sum("n").over(w) - F.col("n") - F.col("first")).alias("shift")).checkpoint()
    x = x.join(F.broadcast(parts) if parts.count() <= rule.small else parts, ["src", "range"]).withColumn("pos", F.col("id") + F.col("shift"))
    b = lambda c: F.floor(c / rule.block)
    x = x.withColumn("b", b(F.col("pos"))).withColumn("block", F.explode(F.sequence(b(F.greatest(F.col("pos") - rule.halo, F.lit(0))), b(F.col("pos") + rule.halo))))
    return x.withColumn("own", F.col("b") == F.col("block")).drop("b", "pos", "id", "range", "shift")


def _medians(y: np.ndarray, k: int) -> np.ndarray:
    """Median of the k values before each position; of those there are, near the start."""
    n = len(y)
    out = np.full(n, np.nan)
    for i in range(1, min(k, n)):
        out[i] = np.median(y[:i])
    if n > k:
        out[k:] = np.median(np.lib.stride_tricks.sliding_window_view(y, k)[: n - k], axis=1)
    return out


def seasonal(y: np.ndarray, place: np.ndarray, rule: SpikeRule) -> np.ndarray:
    """The swing of y that comes back with a fixed number of places, or zeros: per phase the median of what is off the running median.

    The period is the lag with the largest autocorrelation, outliers being cut off at ten deviations; it has to reach
    ``season``, and five times the chance level. Places are those of all readings, so null ones don't shift the phase.
    """
    n, zero = len(y), np.zeros(len(y))
    if n < 4 * rule.cycles:
        return zero
    wide = 2 * rule.side + 1
    off = y - np.median(np.lib.stride_tricks.sliding_window_view(np.pad(y, rule.side, mode="edge"), wide), axis=1)
    scale = 1.4826 * np.median(np.abs(off))
    if scale == 0:
        scale = np.abs(off).mean()
    if scale == 0:
        return zero
    e = np.clip(off, -10 * scale, 10 * scale)
    line = np.zeros(place[-1] - place[0] + 1)
    line[place - place[0]] = e - e.mean()
    power = np.abs(np.fft.rfft(line, 1 << int(np.ceil(np.log2(2 * len(line)))))) ** 2
    ac = np.fft.irfft(power)[: min(len(line) // rule.cycles, rule.longest) + 1]
    if len(ac) < 4 or ac[0] <= 0:
        return zero
    ac = ac / ac[0]
    best = ac[2:].max()
    if best < max(rule.season, 5 / np.sqrt(n)):
        return zero
    period = 2 + int(np.argmax(ac[2:] >= 0.9 * best))
    phase = place % period
    order = np.argsort(phase, kind="stable")
    cuts = np.flatnonzero(np.diff(phase[order])) + 1
    profile = np.zeros(period)
    for g in np.split(order, cuts):
        profile[phase[g[0]]] = np.median(off[g])
    return profile[phase]


def residuals(x: np.ndarray, counter: bool, rule: SpikeRule, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Residual and length of the stretch of equal values, of each valid reading in order of time. ``place``: where it stands among all readings."""
    n = len(x)
    if n == 0:
        return np.zeros(0), np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(x) != 0)
    edges = np.concatenate([[-1], cuts, [n - 1]])
    length = np.repeat(np.diff(edges), np.diff(edges))
    if counter:
        y = x - np.median(np.diff(x)) * np.arange(n) if n > 1 else x
    else:
        y = x - seasonal(x, np.arange(n) if place is None else place, rule)
    left, right = _medians(y, rule.side), _medians(y[::-1], rule.side)[::-1]
    r = np.maximum(np.maximum(y - np.fmax(left, right), np.fmin(left, right) - y), 0)
    r[[0, -1]] = 0
    return np.where(np.isfinite(r), r, 0), length


def _measure(fields: tuple[Field, ...], rule: SpikeRule):
    """Row per own reading: of each field residual, length of its stretch, and for stretches at the block's edge which (1 first, 2 last, 3 both) and of what value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "key"], kind="stable")
        own = pdf["own"].to_numpy(bool)
        m = int(own.sum())
        out = {"src": pdf["src"].to_numpy()[own], "key": pdf["key"].to_numpy()[own], "block": pdf["block"].to_numpy()[own]}
        slot = np.cumsum(own) - 1
        for j, f in enumerate(fields):
            v = pdf[f"f{j}"].to_numpy(float)
            at = np.flatnonzero(np.isfinite(v) & (v > 0))
            r, length = residuals(v[at], f.counter, rule, at)
            mine = own[at]
            to = slot[at][mine]
            res, size, edge, value = np.full(m, np.nan, np.float32), np.zeros(m, np.int64), np.zeros(m, np.int8), np.full(m, np.nan)
            res[to], size[to] = r[mine], length[mine]
            if mine.any():
                x = v[at]
                group = np.concatenate([[0], np.cumsum(np.diff(x) != 0)])[mine]
                edge[to] = np.where(length[mine] >= rule.stuck_least, (group == group[0]) + 2 * (group == group[-1]), 0)
                value[to] = np.where(edge[to] > 0, x[mine], np.nan)
            out |= {f"r{j}": res, f"len{j}": size, f"edge{j}": edge, f"v{j}": value}
        return pd.DataFrame(out)

    return run


def tail_cutoff(value: np.ndarray, count: np.ndarray, rule: SpikeRule, exact: bool = False) -> float:
    """Cutoff from a histogram of residuals. Values beyond the cutoff found so far don't take part in the next fit.

    ``exact``: a counter. Where nine tenths of its residuals are zero it has no noise, and any deviation is beyond it.
    """
    order = np.argsort(value)
    v, c = value[order], count[order].astype(float)
    n = c.sum()
    if n == 0:
        return np.inf
    below = np.cumsum(c)
    u = v[np.searchsorted(below, (1 - rule.top) * n)]
    if exact and u == 0:
        return 0.0
    e, w = (v - u)[v > u], c[v > u]
    if not len(e):
        return np.inf
    half = e[np.searchsorted(np.cumsum(w), w.sum() / 2)]
    scale, shape = half / np.log(2), 0.0
    for i in range(4):
        odds = min(rule.top / rule.risk, np.exp(8)) if i == 0 else rule.top / rule.risk
        cut = scale * (np.log(odds) if shape < 1e-6 else (odds**shape - 1) / shape)
        kept = e <= cut
        m = np.average(e[kept], weights=w[kept]) if kept.any() else half
        var = np.average((e[kept] - m) ** 2, weights=w[kept]) if kept.any() else m * m
        size = w[kept].sum()
        shape = min(max(0.5 * (1 - m * m / max(var, 1e-12 * m * m)) * size / (size + 50), 0.0), 0.15)
        scale = m * (1 - shape)
    return float(u + scale * (np.log(odds) if shape < 1e-6 else (odds**shape - 1) / shape))


def stuck_length(length: np.ndarray, readings: np.ndarray, rule: SpikeRule) -> int:
    """Shortest stretch that is called stuck, from the readings by length of their stretch.

    Normal stretches come from chance ties; their lengths are geometric. Lengths that the source shows again and
    again are its habit, whatever their cause.
    """
    order = np.argsort(length)
    l, s = length[order], readings[order] / length[order]
    at_least = np.cumsum(s[::-1])[::-1]
    habit = l[at_least > max(5, 0.005 * s.sum())]
    habit = int(habit.max()) if len(habit) else 1
    least = max(rule.stuck_least, 2 * habit + 1 if habit > 2 else 0)
    for _ in range(5):
        k = l < least
        n, ties = (l * s)[k].sum(), ((l - 1) * s)[k].sum()
        p = min(ties / max(n, 1), 0.999)
        new = max(least, int(np.ceil(1 + np.log(rule.stuck_risk / max(n, 1)) / np.log(p))) if p > 0 else 0)
        if new == least:
            break
        least = new
    return least


def _fit(rule: SpikeRule, counters: set[str]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, l = pdf[pdf["kind"] == "r"], pdf[pdf["kind"] == "len"]
        b = r["bin"].to_numpy()
        value = np.where(b == ZERO_BIN, 0.0, np.exp2((b + 0.5) / BINS_PER_OCTAVE))
        cut = tail_cutoff(value, r["n"].to_numpy(), rule, key[1] in counters)
        least = stuck_length(l["bin"].to_numpy(), l["n"].to_numpy(), rule)
        return pd.DataFrame({"src": [key[0]], "field": [key[1]], "cut": [cut], "least": [least]})

    return run


def flag_readings(
    df: DataFrame,
    *,
    key: str = "ledger_offset",
    source: str = "run_id",
    time: str = "logged_at",
    fields: tuple[Field, ...] = (Field("loss"), Field("gnorm"), Field("step", counter=True)),
    rule: SpikeRule = SpikeRule(),
) -> DataFrame:
    """Rows ``(key, source, field, reason)`` for readings that are a ``spike``, ``stuck`` or ``impossible``, each once.

    Nulls: a null reading is never flagged and doesn't interrupt a stretch; rows without ``key`` can't be named and
    take no part; rows without ``time`` are judged by the plausibility rule only; a null source is a source. Whole
    rows repeated count once. Ties in time are ordered by ``key``. Nulls don't interrupt a stretch unless there are more than ``halo``
    of them. The first and the
    last valid reading are no spikes: they come from nowhere, or haven't come back.
    Extra columns are ignored. An empty table gives no rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    values = [F.col(f.name).cast("double") for f in fields]
    base = df.select(F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("src"), F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.array(*values).alias("f")).where(F.col("key").isNotNull())
    names = F.array(*[F.lit(f.name) for f in fields])
    wrong = F.filter(F.arrays_zip(names.alias("field"), F.col("f").alias("v")), lambda x: x["v"].isNotNull() & (F.isnan(x["v"]) | (x["v"] <= 0) | (x["v"] == float("inf"))))
    impossible = base.select("src", "key", F.explode(wrong).alias("x")).select("src", "key", F.col("x.field").alias("field"), F.lit("impossible").alias("reason")).distinct()

    kind = df.schema[key].dataType.simpleString()
    timed = base.where(F.col("t").isNotNull()).select("src", "key", "t", *[F.col("f")[j].alias(f"f{j}") for j in range(len(fields))])
    columns = "".join(f", r{j} float, len{j} long, edge{j} byte, v{j} double" for j in range(len(fields)))
    measured = _written(_blocks(timed, rule).groupBy("src", "block").applyInPandas(_measure(fields, rule), f"src string, key {kind}, block long{columns}"), "measured")
    each = F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f"r{j}").cast("double").alias("r"), F.col(f"len{j}").alias("len"), F.col(f"edge{j}").alias("edge"), F.col(f"v{j}").alias("v")) for j, f in enumerate(fields)])
    long = measured.select("src", "key", "block", F.explode(each).alias("x")).select("src", "key", "block", "x.*").where("len > 0")  # of valid readings

    # stretches over the edges of blocks: at most two parts a block and field
    parts = long.where("edge > 0").groupBy("src", "field", "block", "edge", "v").agg(F.count("*").alias("n"))
    w = W.partitionBy("src", "field").orderBy("block", "edge")
    before = lambda c: F.lag(c).over(w)
    goes_on = (before("block") == F.col("block") - 1) & (before("v") == F.col("v")) & (before("edge") >= 2) & F.col("edge").isin(1, 3)
    parts = parts.withColumn("stretch", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    parts = parts.withColumn("total", F.sum("n").over(W.partitionBy("src", "field", "stretch"))).select("src", "field", "block", "edge", "n", "total").checkpoint()

    r_bin = F.when(F.col("r") > 0, F.floor(F.log2("r") * BINS_PER_OCTAVE)).otherwise(F.lit(ZERO_BIN)).cast("long")
    one = lambda k, c: F.struct(F.lit(k).alias("kind"), c.alias("bin"))
    bins = long.select("src", "field", F.explode(F.array(one("r", r_bin), one("len", F.when(F.col("edge") == 0, F.col("len"))))).alias("x")).where("x.bin is not null")
    counts = bins.groupBy("src", "field", "x.kind", "x.bin").agg(F.count("*").alias("n"))
    counts = counts.unionByName(parts.groupBy("src", "field", F.lit("len").alias("kind"), F.col("total").alias("bin")).agg(F.sum("n").alias("n")))
    cutoffs = counts.groupBy("src", "field").applyInPandas(_fit(rule, {f.name for f in fields if f.counter}), "src string, field string, cut double, least long").checkpoint()
    edge = long.where("edge > 0").drop("len").join(parts.select("src", "field", "block", "edge", F.col("total").alias("len")), ["src", "field", "block", "edge"])
    suspect = long.where((F.col("edge") == 0) & ((F.col("r") > 0) | (F.col("len") >= rule.stuck_least))).unionByName(edge).select("src", "key", "field", "r", "len")
    if cutoffs.count() <= rule.small:
        judged = suspect.join(F.broadcast(cutoffs), ["src", "field"])
    else:  # a source may hold a third of the readings: both sides of the join are salted
        salted = cutoffs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(rule.salts - 1))))
        judged = suspect.withColumn("salt", F.pmod(F.hash("key"), F.lit(rule.salts))).join(salted, ["src", "field", "salt"])
    reason = F.when(F.col("len") >= F.col("least"), F.lit("stuck")).when(F.col("r") > F.col("cut"), F.lit("spike"))
    found = judged.select("src", "key", "field", reason.alias("reason")).where("reason is not null").unionByName(impossible)
    return found.select(F.col("key").alias(key), F.when(F.col("src") != NO_SOURCE, F.col("src")).alias(source), "field", "reason")


def spike_rates(df: DataFrame, **args) -> DataFrame:
    """Readings, and flagged readings by reason, per source and field."""
    source, key, fields = args.get("source", "run_id"), args.get("key", "ledger_offset"), args.get("fields", (Field("loss"), Field("gnorm"), Field("step", counter=True)))
    flagged = flag_readings(df, **args).groupBy(source, "field").agg(*[F.count_if(F.col("reason") == x).alias(f"n_{x}") for x in ("spike", "stuck", "impossible")])
    distinct = df.where(F.col(key).isNotNull()).select(F.col(source).cast("string").alias(source), key).distinct()
    total = distinct.groupBy(source).agg(F.count("*").alias("n_readings")).withColumn("field", F.explode(F.array(*[F.lit(f.name) for f in fields])))
    f = flagged.withColumnsRenamed({source: "_s", "field": "_f"})
    out = total.join(f, total[source].eqNullSafe(f["_s"]) & (total["field"] == f["_f"]), "left").drop("_s", "_f")
    return out.na.fill(0, ["n_spike", "n_stuck", "n_impossible"])
