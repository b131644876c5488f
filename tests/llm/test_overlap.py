"""Cross-split overlap against brute force, and its edge cases."""

import random
import re

import pytest

from tessella.llm.overlap import OverlapRule, overlap_classes, overlap_pairs, overlap_report

SCHEMA = "doc_id string, source string, text string, lane string, sig string"
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru") for b in ("lan", "mor", "net", "pil", "rus", "tek", "van", "wex", "yon", "zim")]


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def pairs(df, **args):
    return {(x[0], x[1]) for x in overlap_pairs(df, **args).collect()}


def corpus():
    r = random.Random(5)
    rows = []
    for i in range(60):
        t = text(r, r.randint(30, 200))
        rows.append((f"e{i:03d}", "S", t, r.choice(["eval", "valid", "heldout"])))
        w = t.split()
        kind = i % 6
        if kind == 0:
            u = t.upper().replace(" ", "\n\t")
        elif kind == 1:
            for k in range(0, len(w), 60):
                w[k] = "edited"
            u = " ".join(w)
        elif kind == 2:
            u = text(r, 80) + " " + t + " " + text(r, 80)
        elif kind == 3:
            u = " ".join(w[: max(28, len(w) // 2)])
        elif kind == 4:
            u = text(r, 100)
        else:
            u = " ".join(x if k % 7 else r.choice(WORDS) for k, x in enumerate(w))
        rows.append((f"t{i:03d}", "s", u, r.choice(["code", "prose"])))
    return [(*x, "clash") for x in rows]


def brute(rows, rule):
    """All pairs, by sets of word tuples; nothing of the library is used. For plain texts of small letters and numbers."""

    def sketch(text):
        words, tokens = re.findall("[a-z]+", text.lower()), re.findall("[a-z]+|[0-9]+", text.lower())
        inside = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
        return words, tokens, list(dict.fromkeys(inside))

    sk = {x[0]: sketch(x[2]) for x in rows}
    out = set()
    for a in rows:
        for b in rows:
            if a[3] not in rule.evaluation or b[3] not in rule.training:
                continue
            small, large = sorted((sk[a[0]], sk[b[0]]), key=lambda x: len(x[2]))
            shared = [x in set(large[2]) for x in small[2]]
            o, n = sum(shared), len(small[2])
            short = [len(x[0]) < rule.short for x in (small, large)]
            if all(short):
                ok = f" {' '.join(small[1])} " in f" {' '.join(large[1])} "
            elif any(short):
                ok = o == n
            else:
                own = shared.index(True) if True in shared else n, shared[::-1].index(True) if True in shared else n
                ok = o >= rule.share * n - 1e-9 and not (n - o in own and n - o > 10)
            if ok:
                out.add(tuple(sorted((a[0], b[0]))))
    return out


def test_against_brute_force(spark):
    rows = corpus()
    want = brute(rows, OverlapRule())
    assert 30 <= len(want) < 60
    df = spark.createDataFrame(rows, SCHEMA)
    assert pairs(df) == want
    assert pairs(df, rule=OverlapRule(filter_bits=1 << 15)) == want  # a filter that lets much through changes nothing
    assert pairs(df, rule=OverlapRule(heavy=2, steps=(2, 3), small=0)) == want  # nor do split shingles, other steps and filters in place of tables
    assert pairs(df, slice_=1) == want


def test_copies_and_families(spark):
    t = text(random.Random(1), 120)
    rows = [(f"e{i}", None, t, "eval", "") for i in range(30)] + [(f"t{i}", None, t + " " * i, "code", "") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(pairs(df)) == 1200
    members, links = overlap_classes(df)
    assert links.count() == 1 and members.count() == 70
    assert {(r["n_overlapping"], r["n_links"], r["source"]) for r in overlap_report(df).collect()} == {(30, 30, "unknown")}


def test_forms_and_stubs_are_no_cases(spark):
    r = random.Random(2)
    notice = text(r, 60)
    rows = [(f"{s}{i:02d}", "x", notice + " " + text(r, 70), lane, "") for s, lane in (("e", "eval"), ("t", "code")) for i in range(40)]
    rows += [("e90", "x", "alpha: gather the ledger at the end of the epoch 1.2.3", "eval", ""), ("t90", "x", "omega: gather the ledger at the end of the epoch 1.2.3", "code", "")]
    rows += [("e91", "x", "gamma: gather the ledger 1.2.3", "eval", ""), ("t91", "x", "Gamma - gather the ledger 1.2.3", "code", ""), ("t92", "x", "gamma: gather the ledger 1.2.4", "code", "")]
    assert pairs(spark.createDataFrame(rows, SCHEMA)) == {("e91", "t91")}


def test_spelling(spark):
    t = 'def load(path):\n    """Reads the ledger of the run, and each line of its manifest."""\n    return [parse(line) for line in open(path) if line.strip() and not line.startswith("#") and keep]\n'
    same = [t.replace("\n", "\\n"), t.replace('"', "&quot;"), t.replace("e", "е"), t.replace("a", "a​"), t.upper(), t.replace('"', "”").replace("    ", "\t")]
    rows = [("e", "x", t, "eval", "")] + [(f"t{i}", "x", s, "prose", "") for i, s in enumerate(same)]
    assert pairs(spark.createDataFrame(rows, SCHEMA)) == {("e", f"t{i}") for i in range(len(same))}


@pytest.mark.parametrize("rows", [[], [("e", None, None, "eval", None), ("t", None, None, "code", None), ("x", None, "", "eval", None), (None, "s", "some text", "code", None), ("y", "s", "123 456", "code", None), ("z", "s", "some text", None, None)]])
def test_nothing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert pairs(df) == set()
    overlap_report(df).collect()


def test_long_text(spark):
    t = text(random.Random(9), 60_000)
    rows = [("e", "x", t, "eval", ""), ("t", "x", "more " + t, "code", ""), ("e", "x", t, "eval", "")]
    assert pairs(spark.createDataFrame(rows, SCHEMA)) == {("e", "t")}


def test_families_of_edited_copies(spark):
    r = random.Random(3)
    base, rows = text(r, 120).split(), []
    for i in range(80):
        w = list(base)
        w[r.randrange(20, 100)] = f"edited{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}"
        rows.append((f"{'et'[i % 2]}{i:02d}", "x", " ".join(w), ["eval", "code"][i % 2], ""))
    want = brute(rows, OverlapRule())
    assert len(want) == 1600  # every shingle is in more records than form_least
    notice = text(r, 130)
    rows += [(f"{s}n{i:02d}", "x", notice + " " + text(r, 16), lane, "") for s, lane in (("e", "eval"), ("t", "code")) for i in range(40)]
    assert pairs(spark.createDataFrame(rows, SCHEMA)) == want


def test_edited_copies_under_a_notice(spark):
    r = random.Random(4)
    notice = text(r, 60)
    rows = [(f"{s}{i:02d}", "x", notice + " " + text(r, 70), lane, "") for s, lane in (("e", "eval"), ("t", "code")) for i in range(40)]
    body = text(r, 70).split()
    edited = [w if k not in (20, 40, 60) else "edited" for k, w in enumerate(body)]
    rows += [("e90", "x", notice + " " + " ".join(body), "eval", ""), ("t90", "x", notice + " " + " ".join(edited), "code", "")]
    want = brute(rows, OverlapRule())
    assert want == {("e90", "t90")}  # 0.88 of all shingles, 0.79 of those outside the notice
    assert pairs(spark.createDataFrame(rows, SCHEMA)) == want


def test_texts_without_letters(spark):
    rows = [("e1", "x", "12 34\n56 | 78", "eval", ""), ("t1", "x", "12 34 56  | 78 ", "code", ""), ("t2", "x", "12 34 56 | 79", "code", ""), ("e2", "x", " \n", "eval", ""), ("t3", "x", "\t", "prose", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert pairs(df) == {("e1", "t1")}
    assert [(r["n_records"], r["n_exact"]) for r in overlap_report(df).collect()] == [(1, 1)]


def test_entities_wide_digits_and_numbers(spark):
    rows = [
        ("e1", "x", "it's the ledger of run 12 that drains", "eval", ""), ("t1", "x", "it&#39;s the ledger of run 12 that drains", "code", ""),
        ("t2", "x", "it's the ledger of run １２ that drains", "prose", ""), ("t3", "x", "it's the ledger of run 13 that drains", "code", ""),
    ]
    body = text(random.Random(6), 40)
    rows += [("e4", "x", f"{body} 77 {body[:40]}", "valid", ""), ("t4", "x", f"{body} 78 {body[:40]}", "code", ""), ("e5", "x", f"{body} 79 {body[::-1]}", "heldout", ""), ("t5", "x", f"{body}\n79  {body[::-1]}", "code", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {("e1", "t1"), ("e1", "t2"), ("e4", "t4"), ("e5", "t5")} <= pairs(df) and ("e1", "t3") not in pairs(df)
    report = {r["lane"]: (r["n_exact"], r["n_near"]) for r in overlap_report(df).collect()}
    assert report == {"eval": (1, 0), "valid": (0, 1), "heldout": (1, 0)}  # texts that differ in a number only are near, not exact


def test_short_records_inside_others(spark):
    rows = [
        ("e1", "x", "drain the ledger of the run", "eval", ""), ("t1", "x", "first drain the ledger of the run, then stop 7", "code", ""), ("t2", "x", "drain the ledger 3 of the run", "code", ""),
        ("t3", "x", text(random.Random(7), 30) + " drain the ledger of the run " + text(random.Random(8), 30), "prose", ""),
    ]
    assert pairs(spark.createDataFrame(rows, SCHEMA)) == {("e1", "t1"), ("e1", "t3")}


def test_an_ordinary_word_of_a_hot_group(spark):
    """A third of all records are copies of one text, another third edited copies of another: all links, nothing else."""
    r = random.Random(10)
    hot, base = text(r, 60), text(r, 100).split()
    rows = [(f"{s}h{i}", "x", hot, lane, "") for s, lane in (("e", "eval"), ("t", "code")) for i in range(30)]
    for i in range(60):
        w = list(base)
        w[20 + i] = f"own{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}"
        rows.append((f"{'et'[i % 2]}f{i}", "x", " ".join(w), ["eval", "code"][i % 2], ""))
    rows += [(f"{s}o{i}", "x", text(r, 60), lane, "") for s, lane in (("e", "eval"), ("t", "code")) for i in range(30)]
    want = brute(rows, OverlapRule())
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(want) == 1800 and pairs(df) == want == pairs(df, rule=OverlapRule(heavy=5, small=0), slice_=7)
