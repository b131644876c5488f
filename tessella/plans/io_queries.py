"""Round trips through file formats, and streams run over what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.sources import files as S
from tessella.sources.tables import table
from tessella.streaming import streams as T
from tessella.plans.base import Book
from tessella.plans.stats_queries import SQL as STATS_SQL, shard_verdicts

book = Book()
QUERIES, SQL = book.queries, book.sql


@book("SELECT doc_id, source, text FROM (SELECT DISTINCT doc_id, source, text FROM code_commitpack_sample) WHERE text IS NOT NULL")
def jsonl_round_trip(spark, d):
    """Written as JSON lines and read again."""
    at = S.scratch(spark, "jsonl")
    table(spark, d, "code_commitpack_sample").where("text is not null").select("doc_id", "source", "text").distinct().write.json(at)
    return S.read_jsonl(spark, at, "doc_id string, source string, text string")


TEMPLATE = "Lanes of the corpus.\n<!-- lanes:begin -->\nnothing yet\n<!-- lanes:end -->\nEnd."


@book("""WITH c AS (SELECT coalesce(lane, '') AS lane, count(*) AS n FROM documents GROUP BY 1) SELECT 'Lanes of the corpus.' || chr(10) || '<!-- lanes:begin -->' || chr(10) || '| lane | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || replace(lane, '|', '\\|') || ' | ' || n || ' |', chr(10) ORDER BY lane) || chr(10) || '<!-- lanes:end -->' || chr(10) || 'End.' AS shown FROM c""")
def markdown_rows(spark, d):
    """A small table as Markdown, put between the markers of a text."""
    c = table(spark, d, "documents").groupBy(F.coalesce("lane", F.lit("")).alias("lane")).agg(F.count("*").alias("n"))
    return S.markdown_table(c, ["lane"]).select(S.block_replaced(F.lit(TEMPLATE), "lanes", F.col("table")).alias("shown"))


@book("SELECT lane, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def glob_scan(spark, d):
    """The Parquet files of a folder that holds other files, too."""
    at = S.scratch(spark, "glob")
    x = table(spark, d, "documents").select("lane", "text")
    x.write.parquet(at)
    x.where("text is not null").write.mode("append").json(at)
    return S.read_parquet_glob(spark, at).groupBy("lane").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@book("SELECT doc_id, source, sha256(text) AS digest FROM documents")
def json_array_scan(spark, d):
    """Files of one JSON array each, written in groups of bounded size and read again."""
    at = S.scratch(spark, "arrays")
    x = table(spark, d, "documents").select("doc_id", "source", "text")
    rows = x.groupBy(F.floor(F.col("doc_id") / 500).alias("k")).agg(F.to_json(F.collect_list(F.struct("doc_id", "source", "text"))).alias("value"))
    rows.write.partitionBy("k").text(at)  # a folder, and so a file, per array
    return S.read_json_array(spark, at, "doc_id long, source string, text string").select("doc_id", "source", F.sha2("text", 256).alias("digest"))


MARK = "<|record|>"


@book(r"""WITH x AS (SELECT doc_id, coalesce(lane, 'none') || '-' || doc_id // 1000 AS file, regexp_replace(text, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+\z', '', 'g') AS text FROM documents WHERE text IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id DESC) AS k FROM x) SELECT doc_id, sha256(text) AS digest FROM y WHERE k > 1 AND text <> ''""")
def delimited_scan(spark, d):
    """Texts between marks in files of bounded size; the last one of a file, which may be cut off, is dropped, and so are empty ones."""
    at = S.scratch(spark, "delimited")
    x = table(spark, d, "documents").where("text is not null").select(F.concat_ws("-", F.coalesce("lane", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string")).alias("part"), "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\x1f"), "text").alias("value"))
    x.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").option("lineSep", MARK).text(at)
    t = S.read_delimited(spark, at, MARK).select(F.substring_index("text", "\x1f", 1).cast("long").alias("doc_id"), F.regexp_replace(F.regexp_replace("text", "^\\d+\x1f", ""), "^\\s+|\\s+\\z", "").alias("t"))
    return t.where("t <> ''").select("doc_id", F.sha2("t", 256).alias("digest"))


@book("""WITH s AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE length(text) > 20 AND length(text) < 220) SELECT lang, doc_id, sha256(text) AS digest FROM (SELECT * FROM s WHERE k <= 10 ORDER BY lang NULLS FIRST, doc_id LIMIT 50)""")
def seed_corpus(spark, d):
    """A small seed: the first short texts of each language, 50 in all; a synthetic corpus where there are none."""
    x = S.seed_rows(table(spark, d, "documents"), "lang", "doc_id", "text", 10, 50)
    other = S.synthetic_corpus(spark, 50).select(F.lit("en").alias("lang"), F.monotonically_increasing_id().alias("doc_id"), "text")
    return S.with_fallback(x, other).select("lang", "doc_id", F.sha2("text", 256).alias("digest"))


@book("SELECT shard_id, count(*) AS n_docs, CAST(sum(token_end - token_start) AS BIGINT) AS n_tokens FROM (SELECT DISTINCT shard_id, doc_id, token_start, token_end FROM shard_agent) GROUP BY 1")
def manifest_round_trip(spark, d):
    """Indented JSON manifests, one per shard, written and read again."""
    at = S.scratch(spark, "manifests")
    m = table(spark, d, "shard_agent").select("shard_id", "doc_id", "token_start", "token_end").distinct().groupBy("shard_id").agg(F.count("*").alias("n_docs"), F.sum(F.col("token_end") - F.col("token_start")).alias("n_tokens"))
    S.write_manifests(m, at)
    return S.read_manifests(spark, at, "shard_id string, n_docs long, n_tokens long")


@book("SELECT step % 2 AS part, row_number() OVER (ORDER BY step % 2, segment_id) - 1 AS ledger_offset, segment_id FROM (SELECT DISTINCT segment_id, step FROM segments)")
def ledger_append(spark, d):
    """Two batches appended to a ledger; the second's offsets go on from the first's."""
    at = S.scratch(spark, "append")
    x = table(spark, d, "segments").select("segment_id", "step").distinct().withColumn("part", F.col("step") % 2)
    for k in (0, 1):
        S.append_ledger(x.where(F.col("part") == k).select("part", "segment_id"), at, ["segment_id"])
    return S.read_ledger(spark, at).select("part", "ledger_offset", "segment_id")


@book("SELECT verdict = 'ok' AS passed, 'shard:' || shard_id AS name, CASE WHEN verdict <> 'ok' THEN verdict END AS detail FROM (" + STATS_SQL["shard_verdicts"] + ")")
def run_log(spark, d):
    """Checks as lines of a log, written, read and taken apart again."""
    at = S.scratch(spark, "log")
    ok = F.col("verdict") == "ok"
    S.write_log(shard_verdicts(spark, d).select(F.concat(F.lit("shard:"), "shard_id").alias("name"), ok.alias("passed"), F.when(~ok, F.col("verdict")).alias("detail")), at)
    return S.read_log(spark, at)


@book("SELECT lane, octet_length(encode(n || chr(10))) AS length, sha256(n || chr(10)) AS sha256 FROM (SELECT coalesce(lane, 'none') AS lane, CAST(count(*) AS VARCHAR) AS n FROM documents GROUP BY 1)")
def file_digests(spark, d):
    """Size and SHA-256 of files."""
    at = S.scratch(spark, "files")
    table(spark, d, "documents").groupBy(F.coalesce("lane", F.lit("none")).alias("lane")).agg(F.count("*").cast("string").alias("value")).write.partitionBy("lane").text(at)
    return S.file_digests(spark, at, ["lane"]).select("lane", "length", "sha256")


CHAT_SQL = r"regexp_replace(regexp_replace(text, '(^|\n)\[user\] ', '\1USER: ', 'g'), '(^|\n)\[assistant\] ', '\1ASSISTANT: ', 'g')"


@book(rf"""WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace({CHAT_SQL}, '((?:USER|ASSISTANT|FUNCTION RESPONSE):)', chr(30) || '\1', 'g'), chr(30)), lambda x: regexp_matches(x, '^(USER|ASSISTANT|FUNCTION RESPONSE):')) AS parts FROM documents WHERE lane = 'agent' AND text IS NOT NULL),
    t AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: {{'role': CASE WHEN starts_with(x, 'ASSISTANT:') THEN 'assistant' ELSE 'user' END, 'text': substr(trim(regexp_replace(regexp_replace(x, '^(USER|ASSISTANT|FUNCTION RESPONSE):', ''), '<\|endoftext\|>|[\n\r]+', ' ', 'g')), 1, 150)}}), lambda y: y.text <> '')[1:4] AS turns FROM p)
    SELECT doc_id, CASE WHEN len(turns) >= 3 AND len(list_filter(turns, lambda y: y.role = 'assistant')) > 0 THEN len(turns) END AS n_turns, CASE WHEN len(turns) >= 3 AND len(list_filter(turns, lambda y: y.role = 'assistant')) > 0 THEN array_to_string(list_transform(turns, lambda y: '[' || y.role || '] ' || y.text), chr(10)) END AS shown FROM t""")
def conversations(spark, d):
    """Transcripts taken apart into turns, and the turns shown as lines; null where there are too few."""
    chat = F.regexp_replace(F.regexp_replace("text", "(^|\n)\\[user\\] ", "$1USER: "), "(^|\n)\\[assistant\\] ", "$1ASSISTANT: ")
    t = table(spark, d, "documents").where("lane = 'agent' and text is not null").select("doc_id", S.parse_conversation(chat).alias("t"))
    return t.select("doc_id", F.when(F.col("t").isNotNull(), F.size("t")).cast("long").alias("n_turns"), S.render_turns(F.col("t")).alias("shown"))


@book("SELECT ['agent', 'code', 'prose'][k + 1] AS lane, CAST(1000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS n_different, TRUE AS lengths_hold, TRUE AS words_hold, TRUE AS again FROM range(3) r(k)")
def synthetic_corpus(spark, d):
    """Documents of three lanes from word banks: as many per lane, all different, 20 to 79 words, only words of the bank, and the same when made again."""
    x, again = S.synthetic_corpus(spark, 3000), S.synthetic_corpus(spark, 3000).repartition(3)
    bank = F.when(F.col("lane") == "prose", S.BANK_PATTERN["prose"]).when(F.col("lane") == "code", S.BANK_PATTERN["code"]).otherwise(S.BANK_PATTERN["agent"])
    n = F.size(F.split("text", " "))
    y = x.join(again.select("doc_id", F.col("text").alias("t")), "doc_id", "left").withColumn("words", F.regexp(F.col("text"), bank))
    return y.groupBy("lane").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_different"), F.bool_and(n.between(20, 79)).alias("lengths_hold"), F.bool_and("words").alias("words_hold"), F.bool_and(F.col("text").eqNullSafe(F.col("t"))).alias("again"))


@book("SELECT segment_id, batch_id, step FROM segments GROUP BY ALL")
def stream_ledger(spark, d):
    """The ledger as a stream of files into an append-only table, in two runs of which the second goes on where the first ended; then each row once."""
    source, target = S.scratch(spark, "incoming"), S.scratch(spark, "ledger")
    x = table(spark, d, "segments").select("segment_id", "batch_id", "step")
    for part in (0, 1):
        x.where(F.pmod(F.coalesce("step", F.lit(0)), F.lit(2)) == part).write.mode("append").parquet(source)
        out = T.run_to(T.stream_parquet(spark, source), target)
    return out.distinct()


@book("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_windows_hourly(spark, d):
    """Tumbling windows of event time, complete."""
    e = T.stream_parquet(spark, f"{d}/events.parquet").select("ts", "event_type", "value")
    w = T.windowed(e, "ts", "1 hour", None, "1 day", ["event_type"], "value")
    return T.run_complete(w, S.scratch(spark, "windows")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@book("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT date_trunc('hour', ts + INTERVAL 30 MINUTE) - INTERVAL 30 MINUTE, event_type, count(*) FROM events GROUP BY 1, 2")
def stream_windows_sliding(spark, d):
    """Windows of an hour every half hour, complete."""
    e = T.stream_parquet(spark, f"{d}/events.parquet").select("ts", "event_type", "value")
    w = T.windowed(e, "ts", "1 hour", "30 minutes", "1 day", ["event_type"], "value")
    return T.run_complete(w, S.scratch(spark, "sliding")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@book("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT event_id, user_id FROM events) GROUP BY 1")
def stream_deduplicated(spark, d):
    """Each event once, by a stream with a watermark."""
    e = T.stream_parquet(spark, f"{d}/events.parquet").select("event_id", "user_id", "ts")
    return T.run_to(T.deduplicated(e, "ts", "1 day", ["event_id"]).select("event_id", "user_id"), S.scratch(spark, "dedup")).groupBy("user_id").agg(F.count("*").alias("n"))


@book("SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def stream_running_counts(spark, d):
    """A stateful counter per key; the last emitted total counts."""
    e = T.stream_parquet(spark, f"{d}/events.parquet").select("event_type")
    at = S.scratch(spark, "state")
    q = T.running_counts(e, "event_type").writeStream.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{at}/data"))
    q.option("checkpointLocation", f"{at}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/data").groupBy("key").agg(F.max("n").alias("n"))


@book("SELECT event_type AS key, count(*) AS n, CAST(least(count(*), 500) AS BIGINT) AS n_within, count(*) AS last_place FROM events GROUP BY 1")
def stream_quota(spark, d):
    """Rows within a quota per key, by a stateful counter, in two runs of the stream of which the second goes on where the first ended."""
    source, target = S.scratch(spark, "arriving"), S.scratch(spark, "quota")
    x = table(spark, d, "events").select("event_id", "event_type")
    for part in (0, 1):
        x.where(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        out = T.run_to(T.within_quota(T.stream_parquet(spark, source), "event_type", "event_id", 500), target)
    return out.groupBy("key").agg(F.count("*").alias("n"), F.count_if("within").alias("n_within"), F.max("place").alias("last_place"))


@book("SELECT user_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events FROM (SELECT user_id, sid, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY 1, 2) GROUP BY 1")
def stream_sessions(spark, d):
    """Sessions of event time by a stream."""
    e = T.stream_parquet(spark, f"{d}/events.parquet").select("user_id", "ts")
    s = T.run_complete(T.sessions(e, "ts", "30 minutes", "1 day", "user_id"), S.scratch(spark, "sessions"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))
