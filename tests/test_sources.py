"""File formats and streams: round trips, order of verdicts, resuming."""

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import files as S
from tessella.streaming import streams as T


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1, "y": "a"}, {"x": None, "y": "b"}], indent=1))
    assert S.read_json_array(spark, str(tmp_path / "a.json"), "x int, y string").count() == 2
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n   \n{"x": 2}\n')
    assert [r["x"] for r in S.read_jsonl(spark, str(tmp_path / "b.jsonl"), "x int").orderBy("x").collect()] == [1, 2]


def test_delimited(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" one \n<|endoftext|>\n\n<|endoftext|>two\nlines<|endoftext|>cut o")
    assert sorted(r["text"] for r in S.read_delimited(spark, str(tmp_path)).collect()) == ["one", "two\nlines"]
    assert S.read_delimited(spark, str(tmp_path), drop_last=False).count() == 3


def test_glob(spark, tmp_path):
    for i in range(3):
        spark.range(i + 1).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        next((tmp_path / f"w{i}").glob("*.parquet")).rename(tmp_path / f"{'train' if i else 'val'}-{i}.parquet")
    got = S.read_parquet_glob(spark, str(tmp_path), "train-*.parquet")
    assert got.count() == 5 and got.select("file").distinct().count() == 2


def test_tokens_and_verdicts(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [3, 4]), ("a", 0, [1, 2]), ("b", 0, [9]), ("c", 0, []), ("c", 1, None)], "s string, o int, t array<int>")
    m = S.write_tokens(df, str(tmp_path), "s", "o", "t").cache()
    assert {r["shard"]: r["n_tokens"] for r in m.collect()} == {"a": 4, "b": 1, "c": 0}
    live = S.read_tokens(spark, str(tmp_path))
    assert {r["file"]: r["tokens"] for r in live.collect()}["a.bin"] == [1, 2, 3, 4]
    manifest = m.withColumn("tokenizer_hash", F.when(F.col("shard") == "c", "old").otherwise("new"))
    (tmp_path / "b.bin").write_bytes(b"\x00\x00\x00\x00")
    gone = spark.createDataFrame([("z", "", 0, "", "new")], manifest.schema)
    got = S.verify_shards(manifest.unionByName(gone), S.file_digests(spark, str(tmp_path)), "new")
    assert {r["shard"]: r["verdict"] for r in got.collect()} == {"a": "ok", "b": "content mismatch", "c": "tokenizer mismatch", "z": "missing"}
    assert S.tokenizer_fingerprint("x", 10, [1]) != S.tokenizer_fingerprint("x", 10, [2])


@pytest.mark.parametrize("part", [3, 5, 1 << 20])
def test_large_shards_are_cut(spark, tmp_path, part):
    docs = [("a", i, list(range(100 * i, 100 * i + n))) for i, n in enumerate([0, 4, 7, 1, 3])] + [("b", 9, [1, 2, 3])]
    laid = S.laid_out(spark.createDataFrame(docs, "s string, o int, t array<int>"), "s", "o", "t")
    m = S.write_laid_out(laid, str(tmp_path / "x"), part=part).collect()
    assert sum(r["n_tokens"] for r in m) == 18 and max(r["n_tokens"] for r in m) <= part and ("a" in {r["shard"] for r in m})
    flat = b"".join((tmp_path / "x" / f"{r['shard']}.bin").read_bytes() for r in sorted(m, key=lambda r: r["shard"]) if r["shard"].startswith("a"))
    assert np.frombuffer(flat, "<i4").tolist() == [t for s, _, ts in docs if s == "a" for t in ts]
    got = {(r["s"], r["o"]): r["tokens"] for r in S.read_documents(laid, str(tmp_path / "x"), part=part).collect()}
    assert got == {(s, o): t for s, o, t in docs} and not (tmp_path / "x" / "_temporary").exists()


def test_ledger_goes_on(spark, tmp_path):
    at = str(tmp_path / "ledger")
    S.append_ledger(spark.range(5).withColumnRenamed("id", "step"), at, ["step"])
    S.append_ledger(spark.range(5, 8).withColumnRenamed("id", "step"), at, ["step"])
    rows = sorted((r["ledger_offset"], r["step"]) for r in spark.read.json(at).collect())
    assert rows == [(i, i) for i in range(8)]


def test_two_writers(spark, tmp_path):
    at = str(tmp_path / "ledger")
    with ThreadPoolExecutor(3) as ex:
        list(ex.map(lambda k: S.append_ledger(spark.range(10 * k, 10 * k + 10).withColumnRenamed("id", "step"), at, ["step"]), range(3)))
    rows = S.read_ledger(spark, at).collect()
    assert sorted(r["ledger_offset"] for r in rows) == list(range(30)) and sorted(r["step"] for r in rows) == list(range(30))


def test_log_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("one", True, "fine"), ("two", False, None)], "name string, passed boolean, detail string")
    S.write_log(df, str(tmp_path / "log"))
    assert {(r["name"], r["passed"], r["detail"]) for r in S.read_log(spark, str(tmp_path / "log")).collect()} == {("one", True, "fine"), ("two", False, None)}
    t = S.markdown_table(df, ["name"]).first()[0]
    assert t == "| name | passed | detail |\n|---|---|---|\n| one | true | fine |\n| two | false |  |"
    text = "a <!-- x:begin -->old<!-- x:end --> b"
    assert S.replace_block(text, "x", t).count("| one |") == 1 and "old" not in S.replace_block(text, "x", t)
    S.write_manifests(df, str(tmp_path / "m"))


def test_conversations(spark):
    chat = "USER: Hi there\n\n\nASSISTANT: Hello <|endoftext|>\nFUNCTION RESPONSE: {\"a\": 1}\nUSER: " + "x" * 300 + "\nASSISTANT: late"
    df = spark.createDataFrame([(chat,), ("USER: a\nUSER: b\nUSER: c",), ("",), (None,)], "c string").select(S.parse_conversation(F.col("c")).alias("t"))
    rows = [r["t"] for r in df.collect()]
    assert [t["role"] for t in rows[0]] == ["user", "assistant", "user", "user"] and len(rows[0][3]["text"]) == 150
    assert rows[1:] == [None, None, None]
    assert df.select(S.render_turns(F.col("t")).alias("x")).first()[0].startswith("[user] Hi there\n[assistant] Hello")


def test_synthetic_and_seed(spark):
    a, b = S.synthetic_corpus(spark, 60).collect(), S.synthetic_corpus(spark, 60).repartition(5).collect()
    assert sorted(a) == sorted(b) and {r["lane"] for r in a} == {"prose", "code", "agent"}
    assert S.seed_rows(S.synthetic_corpus(spark, 300), "lane", "doc_id", "text", 3, 8).count() <= 8
    assert S.with_fallback(spark.range(0), spark.range(3)).count() == 3 and S.with_fallback(None, spark.range(3)).count() == 3


def test_stream_resumes(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.range(10).write.parquet(str(src))
    read = lambda: T.stream_parquet(spark, str(src))
    assert T.run_to(read(), out).count() == 10
    spark.range(10, 15).write.mode("append").parquet(str(src))
    assert T.run_to(read(), out).count() == 15
    assert T.run_to(read(), out).count() == 15


def test_quota_goes_on(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.range(6).selectExpr("id", "if(id % 2 = 0, 'a', 'b') as k").write.parquet(str(src))
    read = lambda: T.within_quota(T.stream_parquet(spark, str(src)), "k", "id", 4)
    assert {r["id"]: (r["place"], r["within"]) for r in T.run_to(read(), out).collect()} == {i: (i // 2 + 1, True) for i in range(6)}
    spark.range(6, 12).selectExpr("id", "if(id % 2 = 0, 'a', 'b') as k").coalesce(1).write.mode("append").parquet(str(src))
    got = {r["id"]: (r["place"], r["within"]) for r in T.run_to(read(), out).collect()}
    assert got == {i: (i // 2 + 1, i < 8) for i in range(12)}


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_windows(spark, data, tmp_path, slide):
    e = T.stream_parquet(spark, f"{data}/events.parquet").select("ts", "event_type", "value")
    got = T.run_complete(T.windowed(e, "ts", "1 hour", slide, "1 day", ["event_type"], "value"), str(tmp_path / "w"))
    n = spark.read.parquet(f"{data}/events.parquet").count()
    assert got.agg(F.sum("n")).first()[0] == n * (2 if slide else 1)
