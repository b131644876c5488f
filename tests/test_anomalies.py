"""Spikes, stuck values and impossible readings: planted cases, hot sources, blocks, and odd input."""

import datetime as dt

import numpy as np
import pytest

from tessella.operators.anomalies import Field, SpikeRule, flag_readings, residuals, seasonal, spike_rates, stuck_length, tail_cutoff

SCHEMA = "ledger_offset long, run_id string, step long, loss double, gnorm double, logged_at timestamp, field string"
START = dt.datetime(2030, 1, 1)


def series(n, run, first=0, seed=0, every=3):
    r = np.random.default_rng(seed)
    return [[first + i, run, 10 * (i + 1), float(4 + np.exp(-i / 50) + 0.02 * r.normal()), float(1 + 0.1 * r.normal()), START + dt.timedelta(seconds=every * i), "clash"] for i in range(n)]


def found(df, **args):
    return {(r["ledger_offset"], r["field"], r["reason"]) for r in flag_readings(df, **args).collect()}


def test_planted_cases(spark):
    rows = series(600, "a") + series(400, "b", 1000, 1, 20)
    rows[300][3] = 9.0
    rows[301][3] = 9.1
    for i in range(100, 110):
        rows[i][4] = 1.25
    rows[50][3] = -1.0
    rows[60][4] = float("nan")
    rows[61][4] = float("inf")
    rows[70][2] = 0
    rows[200][2] = 99999
    rows[210][3] = None
    for i in range(750, 1000):  # a new level that stays
        rows[i][3] += 3.0
    for i in range(400, 600):  # a run that resumes
        rows[i][2] -= 500
    got = found(spark.createDataFrame([tuple(r) for r in rows + rows[:20]], SCHEMA))
    want = {(300, "loss", "spike"), (301, "loss", "spike"), (50, "loss", "impossible"), (60, "gnorm", "impossible"), (61, "gnorm", "impossible"), (70, "step", "impossible"), (200, "step", "spike")}
    assert got == want | {(i, "gnorm", "stuck") for i in range(100, 110)}


def test_blocks_change_nothing(spark):
    rows = series(900, "a", seed=3)
    for i in (200, 399, 400, 401, 799):
        rows[i][3] += 2.5
    for i in range(390, 412):
        rows[i][4] = 0.9
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    whole = found(df)
    assert whole == found(df, rule=SpikeRule(block=60, halo=40))
    assert {(200, "loss", "spike"), (399, "loss", "spike")} <= whole and len([1 for x in whole if x[2] == "stuck"]) == 22


def test_late_rows_and_ties(spark):
    rows = series(300, "a", seed=4)
    rows[150][3] = 20.0
    late = list(reversed(rows))
    for i in range(5):
        late[i][5] = late[0][5]
    assert (150, "loss", "spike") in found(spark.createDataFrame([tuple(r) for r in late], SCHEMA))


def test_nulls_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == set()
    rows = [(1, None, None, None, None, None, None), (None, "a", 1, -1.0, 1.0, START, None), (3, None, -5, -2.0, 1.0, None, None), (4, "a", 1, 1.0, 1.0, START, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == {(3, "step", "impossible"), (3, "loss", "impossible")}
    assert {r["run_id"] for r in spike_rates(df).collect()} == {None, "a"}


def test_habits_are_no_cases(spark):
    rows = series(1200, "steps", seed=5)
    for i, r in enumerate(rows):
        r[3] = 5.0 + (3.0 if i % 40 == 0 else 0.0) + 0.01 * (i % 7)  # a regular swing
        r[4] = float(i // 6 % 9 + 1)  # each value is held for six readings
    assert found(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)) == set()
    for i in range(7, 1200, 50):  # nor do null readings among them change that
        rows[i][4] = None
    assert found(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)) == set()


def test_cutoff_follows_the_tail():
    r = np.random.default_rng(0)
    v = np.abs(r.normal(size=20000))
    cut = tail_cutoff(v, np.ones_like(v), SpikeRule())
    assert 4.5 < cut < 9
    heavy = np.abs(r.standard_t(4, size=20000))
    assert tail_cutoff(heavy, np.ones_like(heavy), SpikeRule()) > cut
    spiked = np.concatenate([v, np.full(100, 50.0)])
    assert tail_cutoff(spiked, np.ones_like(spiked), SpikeRule()) < 12


def test_stuck_length_follows_the_ties():
    assert stuck_length(np.array([1]), np.array([1000]), SpikeRule()) == 5
    assert stuck_length(np.array([1, 2, 3, 12]), np.array([900, 180, 24, 12]), SpikeRule()) in range(5, 12)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 9])
def test_short_series(n):
    r, length = residuals(np.arange(1.0, n + 1), False, SpikeRule())
    assert len(r) == len(length) == n


def test_other_fields(spark):
    rows = series(300, "a", seed=6)
    rows[100][3] = 30.0
    assert found(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), fields=(Field("loss"),)) == {(100, "loss", "spike")}


@pytest.mark.parametrize("at", [1, 2, 597, 598])
def test_spikes_near_the_ends(spark, at):
    rows = series(600, "a")
    rows[at][3] = 30.0
    assert found(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)) == {(at, "loss", "spike")}


def test_a_season_is_taken_off(spark):
    """A swing every 25 readings, much larger than the noise: spikes a fraction of its height are found, the swing itself isn't flagged."""
    rows = series(2000, "a", seed=7)
    for i, r in enumerate(rows):
        r[3] = 5.0 + 0.01 * float(np.random.default_rng(i).normal()) + (2.0 if i % 25 == 0 else 0.8 if i % 25 == 1 else 0.0)
    for i in (512, 1490):  # off the swing's phase
        rows[i][3] += 0.5
    rows[1000][3] += 0.5  # on top of it
    for i in (700, 1200):  # null readings don't shift the phase
        rows[i][3] = None
    assert {x for x in found(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)) if x[1] == "loss"} == {(i, "loss", "spike") for i in (512, 1000, 1490)}


def test_seasonal():
    r = np.random.default_rng(1)
    noise = r.normal(size=3000)
    assert not seasonal(noise, np.arange(3000), SpikeRule()).any()
    swing = np.where(np.arange(3000) % 40 == 3, 30.0, 0.0)
    got = seasonal(noise + swing, np.arange(3000), SpikeRule())
    assert np.abs(got[np.arange(3000) % 40 == 3] - 30).max() < 1.5 and np.abs(got[np.arange(3000) % 40 == 10]).max() < 1.5
    assert not seasonal(np.zeros(100), np.arange(100), SpikeRule()).any() and not seasonal(noise[:10], np.arange(10), SpikeRule()).any()


@pytest.mark.parametrize("spread", [0, 0.0001])
def test_burst(spark, spread):
    """More readings in one hour, or at one moment, than a block holds are cut by rank."""
    rows = series(1500, "a", seed=8)
    for i, r in enumerate(rows):
        r[5] = START + dt.timedelta(seconds=spread * i)
    for i in (77, 640, 641, 1301):
        rows[i][3] += 3.0
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    want = {(i, "loss", "spike") for i in (77, 640, 641, 1301)}
    assert found(df) == want == found(df, rule=SpikeRule(block=64, halo=32))


@pytest.mark.parametrize("n", [40, 300, 900])
def test_long_stretches(spark, n):
    """A stretch longer than a margin, over the edges of several blocks, counts whole; a habit of such stretches is no case."""
    rows = series(2400, "a", seed=9) + series(2400, "b", 5000, seed=10)
    for i in range(700, 700 + n):
        rows[i][4] = 1.5
    for i in range(2400, 4800):
        rows[i][4] = float(i // n)  # run b holds each value for n readings
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    want = {(i, "gnorm", "stuck") for i in range(700, 700 + n)}
    got = found(df, rule=SpikeRule(block=100, halo=32))
    assert {x for x in got if x[2] == "stuck" and x[0] < 5000} == want == {x for x in found(df) if x[2] == "stuck" and x[0] < 5000}
    if n < 900:  # two or three stretches are no habit yet
        assert not {x for x in got if x[2] == "stuck" and x[0] >= 5000}


def test_short_tails(spark):
    """Noise with a bounded tail: its cutoff is that of an exponential one, so beyond the noise, but a spike of a few times its width is found."""
    rows = series(3000, "a", seed=11)
    r = np.random.default_rng(12)
    for x in rows:
        x[3] = 5 + float(r.uniform(-0.1, 0.1))
    rows[1234][3] = 6.5
    assert {x for x in found(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)) if x[1] == "loss"} == {(1234, "loss", "spike")}


def test_many_sources(spark):
    """Tables per source that are too large to broadcast are joined with salt."""
    rows = [x for k in range(6) for x in series(200, f"r{k}", 1000 * k, seed=k)]
    rows[150][3] = 50.0
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    assert found(df) == found(df, rule=SpikeRule(small=0)) == {(150, "loss", "spike")}
