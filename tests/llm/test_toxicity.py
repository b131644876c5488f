"""Passages and compression distance: disguises, held-out accuracy, and odd input."""

import random

import pytest

from tessella.llm.passages import passages
from tessella.llm.toxicity import Scorer, ToxicityRule, fit_scorer, fit_texts, score_documents, toxicity_rates

DOCS = "doc_id long, text string, source string, score string"
LABELS = "doc_id long, rater string, toxic int, reviewed_at timestamp"
NAMES, VERBS, THINGS = "ledger sampler shard reader writer router".split(), "packs joins drains counts moves sorts".split(), "tokens rows spans blocks pages lanes".split()
BAD_A, BAD_B = "you worthless rotten|you pathetic miserable|listen you filthy".split("|"), "scum nobody wants you here|worm go and vanish|rat everybody hates you".split("|")


def line(r):
    return f"The {r.choice(NAMES)} {r.choice(VERBS)} {r.randint(1, 999)} {r.choice(THINGS)} before the {r.choice(NAMES)} {r.choice(VERBS)}."


def document(r, toxic):
    lines = [line(r) for _ in range(r.randint(4, 14))]
    if r.random() < 0.3:
        lines.insert(0, f"The policy tells raters to flag {r.choice(['insults', 'threats'])} in the {r.choice(NAMES)}.")
    if toxic:
        lines.insert(r.randrange(len(lines)), f"{r.choice(BAD_A)} {r.choice(BAD_B)}!")
    return "\n".join(lines)


@pytest.mark.parametrize("shown", ["w o r t h l e s s scum", "w.o.r.t.h.l.e.s.s scum", "w0rthl3ss scum", "woooorthlesssss scum", "wor​thless scum", "wоrthless scum", "Wörthless  SCUM"])
def test_disguises(shown):
    p, at = passages([f"A first line here.\n{shown}\n"])
    words = b" ".join(p).split()
    assert (b"worthless" in words or b"worthles" in words) and b"scum" in words and set(at.tolist()) == {0}


def test_passages_lose_nothing():
    p, at = passages(["", None, "x", "ab. cd. " * 3, "word " * 500, "हिन्दी वाक्य। दूसरा", "a" * 1000])
    assert max(map(len, p)) <= 220 and 0 not in at and 1 not in at
    assert sum(x.count(b"word") for x, i in zip(p, at) if i == 4) == 500
    assert set(at.tolist()) == {2, 3, 4, 5, 6}


def labelled(n, seed):
    r = random.Random(seed)
    y = [r.random() < 0.25 for _ in range(n)]
    return [document(r, t) for t in y], y


def test_held_out_accuracy(spark):
    texts, y = labelled(800, 1)
    r = random.Random(2)
    noisy = [t if r.random() > 0.05 else not t for t in y]
    scorer = fit_texts(texts, noisy, [True] * 800, ToxicityRule(size=16_384))
    new, truth = labelled(400, 3)
    df = spark.createDataFrame([(i, t, "s" if i % 2 else " S", "clash") for i, t in enumerate(new)], DOCS)
    got = {r["doc_id"]: r for r in score_documents(df, scorer).collect()}
    tp = sum(got[i]["flagged"] and t for i, t in enumerate(truth))
    assert tp / max(1, sum(x["flagged"] for x in got.values())) > 0.9 and tp / sum(truth) > 0.9
    rates = toxicity_rates(score_documents(df, scorer)).collect()
    assert [r["source"] for r in rates] == ["s"] and rates[0]["n_docs"] == 400


def test_rare_content(spark):
    """One document in twenty, fitted on labels of which one in four is: the corpus decides the cutoff."""
    texts, y = labelled(800, 11)
    scorer = fit_texts(texts, y, [True] * 800, ToxicityRule(size=16_384))
    r = random.Random(12)
    truth = [r.random() < 0.05 for _ in range(3000)]
    df = spark.createDataFrame([(i, document(r, t), "s", "clash") for i, t in enumerate(truth)], DOCS)
    got = {r["doc_id"]: r["flagged"] for r in score_documents(df, scorer).collect()}
    tp = sum(got[i] and t for i, t in enumerate(truth))
    assert tp / max(1, sum(got.values())) >= 0.9 and tp / sum(truth) >= 0.9


def test_cutoff_follows_the_corpus():
    """The same labels: a corpus in which ordinary documents often reach a margin of 6 gets a higher cutoff than one in which they don't."""
    import numpy as np

    scorer = Scorer(b"", b"", b"", 3, tuple([7] * 5 + [20] * 95), tuple([0] * 500 + [6] * 2), 0.2)
    quiet = scorer.calibrate(np.array([0.0, 7, 20]), np.array([9500.0, 25, 475]))
    loud = scorer.calibrate(np.array([0.0, 7, 20]), np.array([9000.0, 525, 475]))
    assert 6 < quiet <= 7 < loud <= 20


def test_labels(spark):
    texts, y = labelled(300, 4)
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)
    rows = [(i, f"r{k}", int(t), None) for i, t in enumerate(y) for k in range(2)] + [(0, "r9", None, None), (None, "r1", 1, None), (1, "a", 1, None), (1, "b", 0, None)]
    labels = spark.createDataFrame(rows + rows[:10], LABELS)
    rule = ToxicityRule(size=16_384)
    a, b = fit_scorer(docs, labels, rule=rule), fit_scorer(docs.repartition(5), labels.repartition(3), rule=rule)
    assert a == b and a.cutoff < 1000
    small = fit_scorer(docs, labels, rule=ToxicityRule(most_docs=20, size=4096))
    assert len(small.toxic) < len(a.toxic) * 2


def test_odd_input(spark):
    texts, y = labelled(200, 5)
    scorer = fit_texts(texts, y, [False] * 200, ToxicityRule(size=8192))
    rows = [(1, None, None, ""), (2, "", "a", ""), (3, " \n ", "a", ""), (4, "x" * 300_000, "a", ""), (5, line(random.Random(1)) * 3000, "a", ""), (5, "twice", "a", ""), (None, "no id", "a", "")]
    got = score_documents(spark.createDataFrame(rows, DOCS), scorer).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["margin"] is None and r["score"] == 0 and not r["flagged"] for r in got if r["doc_id"] in (1, 2, 3))
    assert score_documents(spark.createDataFrame([], DOCS), scorer).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a text of no interest", "s", "")], DOCS)
    for labels in ([], [(1, "r", 0, None)], [(1, "r", 1, None)], [(9, "r", 1, None)]):
        scorer = fit_scorer(docs, spark.createDataFrame(labels, LABELS))
        assert not score_documents(docs, scorer).first()["flagged"]
