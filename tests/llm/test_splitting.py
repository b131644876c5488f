"""Cuts: limits, overlap, cover, turns, and odd input."""

import pytest
from hypothesis import given, settings, strategies as st

from tessella.llm.splitting import cut_span, oversized, piece_checks, split_oversized
import tessella.llm.splitting as splitting

SEG = "segment_id string, lane string, doc_id string, token_start long, token_end long, kind string"
SHARD = "doc_id string, lane string, token_start long, token_end long, turns array<struct<role:string,start:long,stop:long>>"
LIM = "lane string, max_tokens int, overlap_tokens int, capacity_tokens int"


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 500), st.integers(1, 4000), st.integers(1, 300), st.integers(0, 320), st.lists(st.integers(0, 4500), max_size=40))
def test_pieces(start, length, limit, overlap, bounds):
    end = start + length
    p = cut_span(start, end, sorted({(b, 1 + b % 2) for b in bounds}), limit, overlap)
    real = min(overlap, limit - 1)
    assert p[0][0] == start and p[-1][1] == end
    assert all(0 < b - a <= limit for a, b, *_ in p)
    for (_, b0, *_), (a1, _, c1, at) in zip(p, p[1:]):
        assert b0 - a1 == real and c1 == b0
        assert not at or c1 in bounds


def test_cuts_at_turns():
    p = cut_span(0, 1000, [(100, 1), (480, 1), (520, 2), (900, 1)], 600, 50)
    assert [x[2] for x in p] == [0, 520] and p[1] == (470, 1000, 520, True)


def test_tables(spark):
    lim = spark.createDataFrame([("agent", 100, 10, 0), ("code", 50, None, 0), (None, 1, 1, 1)], LIM)
    seg = spark.createDataFrame(
        [("s1", "AGENT ", "d1", 1000, 1250, "x"), ("s1", "AGENT ", "d1", 1000, 1250, "x"), ("s2", "agent", "d1", 1000, 1100, "x"), ("s3", "code", "d9", 5, 200, "x"), ("s4", "agent", None, 0, 101, "x"), ("s5", "agent", "d1", None, 400, "x"), ("s6", "agent", "d1", 500, 100, "x"), ("s7", None, "d1", 0, 900, "x"), (None, "agent", "d1", 0, 900, "x"), ("s8", "other", "d1", 0, 900, "x")],
        SEG,
    )
    turns = [("user", 0, 20), ("assistant", 20, 120), ("user", 120, 120), (None, None, 5), ("user", 120, 200), ("user", 120, 200), ("tool", 60, 70)]
    sh = spark.createDataFrame([("d1", "agent", 1000, 1300, turns), ("d1", "agent", 1000, 1300, turns), ("d2", "agent", 0, 90, []), ("d3", "agent", 0, 190, None), ("d4", "agent", None, 900, None)], SHARD)
    got = split_oversized(seg, sh, lim).collect()
    assert {r["item_id"] for r in got} == {"s1", "s3", "s4", "d1", "d3"}
    s1 = sorted((r["piece_start"], r["piece_end"], r["at_turn"]) for r in got if r["item_id"] == "s1")
    assert s1[0][0] == 1000 and s1[-1][1] == 1250 and all(b - a <= 100 for a, b, _ in s1)
    assert any(a == 1110 and t for a, _, t in s1)  # the cut is at 1120, the piece reaches back by 10
    assert split_oversized(seg.limit(0), sh.limit(0), lim).count() == 0
    items, pieces = oversized(seg, sh, lim), split_oversized(seg, sh, lim)
    assert all(r["within"] and r["covers"] and r["overlaps"] for r in piece_checks(pieces, items).collect())
    wrong = pieces.withColumn("piece_start", pieces["piece_start"] + (pieces["piece"] == 1).cast("long"))
    assert {(r["within"], r["covers"], r["overlaps"]) for r in piece_checks(wrong, items).collect()} == {(True, True, False)}
    assert not any(r["covers"] for r in piece_checks(pieces.where("piece > 0"), items).collect())


def test_far_boundaries():
    assert len(cut_span(0, 4000, [(3990, 1)], 2048, 64)) == 3  # a boundary that would cost a piece is left
    assert [x[2] for x in cut_span(0, 1000, [(300, 1), (460, 1)], 600, 50)] == [0, 460]
    assert [x[2] for x in cut_span(0, 1000, [(430, 1), (580, 2)], 600, 50)] == [0, 580]  # in one band the stronger
    assert [x[2] for x in cut_span(0, 1000, [(460, 1), (700, 2)], 600, 50)] == [0, 460]  # a band nearer to the middle comes first


@pytest.mark.parametrize("hot", [1, 1000])
def test_hot_document(spark, monkeypatch, hot):
    monkeypatch.setattr(splitting, "HOT", hot)
    lim = spark.createDataFrame([("agent", 100, 10, 0)], LIM)
    seg = spark.createDataFrame([(f"s{i}", "agent", "d1", 1000, 1150 + i, "x") for i in range(40)], SEG)
    sh = spark.createDataFrame([("d1", "agent", 1000, 1300, [("user", 80, 100)]), ("d9", "agent", 0, 50, [("user", 1, 2)])], SHARD)
    got = split_oversized(seg, sh, lim).collect()
    assert {r["item_id"] for r in got} == {f"s{i}" for i in range(40)} | {"d1"} and sum(r["core_start"] == 1080 for r in got) >= 40
