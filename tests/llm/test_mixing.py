"""Mixtures: raking, shares, repeats, and odd input."""

import numpy as np
import pytest

from tessella.llm.mixing import CORPUS, MixRule, _fill, mix_sources, rake
from tessella.functions.tokens import encoding

DOCS = "doc_id long, text string, source string, lang string, lane string, n_tokens string"
TARGETS = "source string, target_share double, max_repeats int"


def test_rake():
    a = np.random.default_rng(0).random((4, 3, 2)) * 100
    m = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2]), np.array([0.7, 0.3])]
    w = rake(a, m)
    for i, x in enumerate(m):
        assert np.allclose(w.sum(axis=tuple(j for j in range(3) if j != i)), x, atol=1e-6)
    a[2] = 0
    w = rake(a, [m[0], None, None])
    assert np.allclose(w.sum(axis=(1, 2)), np.array([0.5, 0.375, 0, 0.125]))
    assert rake(np.zeros((2, 2, 2)), [np.array([0.5, 0.5]), None, None]).sum() == 0


def docs(n=4000):
    r = np.random.default_rng(1)
    names = ["big", "mid ", "Small", None, "spare"]
    out = []
    for i in range(n):
        k = int(r.choice(5, p=[0.6, 0.25, 0.03, 0.02, 0.1]))
        out.append((i, "token text " * int(r.integers(1, 60)), names[k], ["en", "hi", None, "xx"][i % 4], ["code", "prose"][i % 2], "x"))
    return out + out[:50] + [(None, "x", "big", "en", "code", ""), (n, None, "big", "en", "code", ""), (n + 1, "", "big", "en", "code", "")]


def test_shares(spark):
    t = spark.createDataFrame([("big", 0.3, 1), ("MID", 0.3, 2), ("small", 0.3, 3), ("absent", 0.1, 5)], TARGETS)
    sel, rep = mix_sources(spark.createDataFrame(docs(), DOCS), t)
    rep = {r["source"]: r for r in rep.collect()}
    for s in ("big", "mid", "small"):
        assert abs(rep[s]["actual_share"] - 1 / 3) < 0.004 and rep[s]["most_uses"] <= rep[s]["max_repeats"]
    assert rep["small"]["used_tokens"] == 3 * rep["small"]["available_tokens"]  # the source that binds is used up
    assert rep["absent"]["n_docs"] == 0 and rep["absent"]["used_tokens"] == 0
    assert rep["spare"]["target_share"] is None and rep["spare"]["used_tokens"] == 0 and "unknown" in rep
    rows = sel.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and min(r["n_uses"] for r in rows) == 1
    texts = {d[0]: d[1] for d in docs()}
    assert all(r["n_tokens"] == len(encoding().encode_ordinary(texts[r["doc_id"]])) for r in rows[:50])
    again, _ = mix_sources(spark.createDataFrame(docs(), DOCS).repartition(7), t)
    assert {(r["doc_id"], r["n_uses"]) for r in again.collect()} == {(r["doc_id"], r["n_uses"]) for r in rows}


def test_margins(spark):
    t = spark.createDataFrame([("big", 0.6, 3), ("mid", 0.4, 3)], TARGETS)
    rule = MixRule(language_share={"en": 0.5, "hi": 0.2, "other": 0.3}, topic_share={"code": 0.7, "prose": 0.3})
    rows = mix_sources(spark.createDataFrame(docs(), DOCS), t, rule=rule)[0].toPandas()
    rows["t"] = rows["n_tokens"] * rows["n_uses"]
    share = lambda c: (rows.groupby(c)["t"].sum() / rows["t"].sum()).to_dict()
    assert abs(share("source")["big"] - 0.6) < 0.004
    assert abs(share("lang")["en"] - 0.5) < 0.05 and abs(share("topic")["code"] - 0.7) < 0.05


def test_total_that_is_too_large(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], TARGETS)
    rep = {r["source"]: r for r in mix_sources(spark.createDataFrame(docs(), DOCS), t, rule=MixRule(total_tokens=60_000.0))[1].collect()}
    assert abs(rep["big"]["used_tokens"] - 30_000) < 200 and rep["small"]["used_tokens"] == 2 * rep["small"]["available_tokens"] < 30_000


@pytest.mark.parametrize("rows,targets", [([], []), ([], [("a", 1.0, 1)]), ([(1, "x", "b", None, None, "")], [("a", 1.0, 1)]), ([(1, "x", "a", None, None, "")], [("a", None, None), (None, 1.0, 2)]), ([(1, "x", "a", None, None, "")], [("a", 1.0, 0)])])
def test_nothing(spark, rows, targets):
    sel, rep = mix_sources(spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS))
    assert sel.count() == 0
    rep.collect()


def test_caps():
    a = np.array([[[90.0, 10.0]], [[50.0, 50.0]]])
    m = [np.array([0.5, 0.5]), None, np.array([0.3, 0.7])]
    cap = np.array([[[1.0, 0.2]], [[1.0, 1.0]]])
    w = rake(a, m, cap=cap)
    assert np.allclose(w.sum(axis=(1, 2)), m[0]) and (w <= cap + 1e-12).all() and np.isclose(w[0, 0, 1], 0.2) and w[1, 0, 1] > 0.45  # the other source makes up for what the cap takes
    assert np.allclose(_fill(np.array([1.0, 1, 0]), np.array([0.1, 9, 9]), 0.5), [0.1, 0.4, 0]) and np.allclose(_fill(np.array([1.0, 2]), np.array([1.0, 1]), 5), [1, 1])


def test_corpus_margins_and_rare_cells(spark):
    """One rare cell must not bound the total, and all three margins are reported."""
    rows = [(i, "token text " * 20, "big" if i % 5 else "mid", "de" if i % 50 == 1 else "en", ["code", "prose"][i % 2], "") for i in range(3000)] + [(9000, "token text " * 20, "big", "xx", "rare", "")]
    t = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.5, 2)], TARGETS)
    sel, rep = mix_sources(spark.createDataFrame(rows, DOCS), t, rule=MixRule(language_share=CORPUS, topic_share=CORPUS))
    rep = rep.toPandas()
    of = lambda axis, c: rep[rep["axis"] == axis].set_index(c)
    s = of("source", "source")
    assert s.loc["mid", "used_tokens"] == 2 * s.loc["mid", "available_tokens"] and abs(s.loc["big", "actual_share"] - 0.5) < 0.002
    assert set(of("language", "lang").index) == {"en", "de", "xx"} and set(of("topic", "topic").index) == {"code", "prose", "rare"}
    topic = of("topic", "topic")
    assert (topic["target_share"] - topic["actual_share"]).abs().max() < 0.01 and rep["most_uses"].max() <= 2
    assert np.isclose(topic["target_share"].sum(), 1) and np.isclose(topic["actual_share"].sum(), 1, atol=1e-4)
