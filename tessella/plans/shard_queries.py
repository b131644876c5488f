"""Shards of tokens: written, verified, packed into sequences, hashed, replayed, and the evidence over all that."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.functions import text as X, tokens as T
from tessella.operators import packing as K, series
from tessella.plans import check_queries as C
from tessella.plans.base import Book
from tessella.plans.sample_queries import SQL as SAMPLE_SQL, U
from tessella.plans.stats_queries import RUNS
from tessella.sources import files as S
from tessella.sources.tables import spread, table

book = Book()
QUERIES, SQL = book.queries, book.sql

PART = 1 << 22  # tokens of a file
BLOCK, DRAWS, EACH = 64, 32, 4  # tokens of a sequence (and one more), sequences drawn per shard, sequences of a batch


# --- token files -------------------------------------------------------------------------------------------------------


def _laid(spark, d) -> DataFrame:
    texts = spread(table(spark, d, "documents").where("text <> ''").select("doc_id", F.coalesce("lane", F.lit("none")).alias("lane"), "text"))
    return S.laid_out(T.with_tokens(texts, "text", ["doc_id", "lane"]), "lane", "doc_id", "tokens")


@book("SELECT doc_id, coalesce(lane, 'none') AS shard, sha256(text) AS digest FROM documents WHERE text <> ''")
def token_shards(spark, d):
    """Texts as tokens of a public tokenizer in one shard per lane: written, read back by their spans, and decoded to the same texts."""
    laid, at = _laid(spark, d), S.scratch(spark, "tokens")
    S.write_laid_out(laid, at, part=PART)

    @F.pandas_udf("string")
    def decoded(s):
        return s.map(lambda t: T.decode(t.tolist()))

    return S.read_documents(laid, at, part=PART).select(F.col("o").alias("doc_id"), F.col("s").alias("shard"), F.sha2(decoded("tokens"), 256).alias("digest"))


OLD = "an older tokenizer"


@book("SELECT shard, CASE shard WHEN 'code' THEN 'content mismatch' WHEN 'prose' THEN 'tokenizer mismatch' WHEN 'gone' THEN 'missing' ELSE 'ok' END AS verdict FROM (SELECT DISTINCT coalesce(lane, 'none') AS shard FROM documents WHERE text <> '' UNION SELECT 'gone')")
def shard_verification(spark, d):
    """Manifests against the files, with every verdict: one manifest has another digest, one another tokenizer, one no file."""
    laid, at = _laid(spark, d), S.scratch(spark, "tokens")
    m = S.write_laid_out(laid, at, part=PART).withColumn("tokenizer_hash", F.when(F.col("shard") == "prose", OLD).otherwise(fingerprint()))
    m = m.withColumn("sha256", F.when(F.col("shard") == "code", F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    gone = spark.createDataFrame([("gone", "", 1, "0" * 64, fingerprint())], m.schema)
    v = S.verify_shards(m.unionByName(gone), S.file_digests(spark, at), fingerprint())
    worst = F.array_position(F.array(*map(F.lit, ("missing", "content mismatch", "tokenizer mismatch", "ok"))), F.col("verdict"))
    stem = F.regexp_replace("shard", "\\.\\d{5}$", "")  # further files of a shard
    return v.groupBy(stem.alias("shard")).agg(F.min_by("verdict", worst).alias("verdict"))


CANARY = "Shards, ledgers and 42 tokens."
CANARY_IDS = [2484, 1371, 11, 2957, 5355, 290, 5433, 16326, 13]


def fingerprint() -> str:
    e = T.encoding()
    return S.tokenizer_fingerprint("byte_bpe_50k", e.n_vocab, e.encode_ordinary(CANARY))


@book(f"SELECT sha256('byte_bpe_50k:50256:{CANARY_IDS}') AS fingerprint")
def tokenizer_fingerprint(spark, d):
    """Digest of the tokenizer's name, size and its ids of a known text."""
    return spark.createDataFrame([(fingerprint(),)], "fingerprint string")


# --- sequences ---------------------------------------------------------------------------------------------------------
# Tokens are words here, numbered by their digest, so that both engines have the same ones.

WORD_ID = "CAST('0x' || substr(sha256({}), 1, 7) AS INTEGER)"
TOKENS_SQL = rf"""k AS (SELECT lane, doc_id, role, unnest(w) AS word, ln, unnest(range(len(w))) AS wi FROM (SELECT lane, doc_id, ln, CASE WHEN lane = 'agent' THEN nullif(regexp_extract(line, '^\[([a-z]+)\] ', 1), '') END AS role, regexp_extract_all(line, '[^ \t\n\r\f]+') AS w
        FROM (SELECT lane, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS ln FROM (SELECT lane, doc_id, CASE WHEN lane = 'agent' THEN string_split(text, chr(10)) ELSE [text] END AS lines FROM documents WHERE lane IN ('agent', 'code', 'prose') AND text IS NOT NULL)))),
    t AS (SELECT lane, doc_id, role, {WORD_ID.format('word')} AS id, row_number() OVER (PARTITION BY lane ORDER BY doc_id, ln, wi) - 1 AS pos FROM k),
    d AS (SELECT lane, doc_id, min(pos) AS s, max(pos) + 1 AS e, row_number() OVER (PARTITION BY lane ORDER BY doc_id) - 1 AS no FROM t GROUP BY 1, 2), z AS (SELECT lane, count(*) AS docs, sum(e - s) AS size FROM d GROUP BY 1),
    q AS (SELECT lane, b AS seq, size, docs, {U.format('seq:', "(lane || ':' || b)")} AS u FROM z, range({DRAWS}) r(b) WHERE size >= {BLOCK + 1}),
    f AS (SELECT q.lane, q.seq, d.s AS f FROM q JOIN d ON d.lane = q.lane AND d.no = CAST(floor(q.u * q.docs) AS BIGINT) WHERE q.lane <> 'prose' UNION ALL SELECT lane, seq, CAST(floor(u * (size - {BLOCK})) AS BIGINT) FROM q WHERE lane = 'prose'),
    l AS (SELECT d.lane, d.doc_id, d.s, d.s + c * size AS lo, d.e + c * size AS hi FROM d JOIN z ON z.lane = d.lane, range(0, 2) r(c)),
    g AS (SELECT f.lane, f.seq, l.doc_id, l.s + greatest(lo, f) - lo AS ts, l.s + least(hi, f + {BLOCK + 1}) - lo AS te, greatest(lo, f) - f AS ss FROM f JOIN l ON l.lane = f.lane AND l.lo < f + {BLOCK + 1} AND l.hi > f)"""


def _assembled_sql(name: str, g: str) -> str:
    """The content of sequences from their pieces ``g``, in the other engine."""
    return f"""{name}_p AS (SELECT g.lane, g.seq, g.ss + t.pos - g.ts AS pos, CASE WHEN g.lane = 'prose' THEN g.ss + t.pos - g.ts ELSE t.pos - g.ts END AS pid, t.id, t.role FROM {g} g JOIN t ON t.lane = g.lane AND t.pos >= g.ts AND t.pos < g.te),
    {name}_r AS (SELECT *, lead(id) OVER w AS target, lead(role) OVER w AS next_role, bool_or(role IS NOT NULL) OVER (PARTITION BY lane, seq) AS roles FROM {name}_p WINDOW w AS (PARTITION BY lane, seq ORDER BY pos)),
    {name}_m AS (SELECT *, CASE WHEN NOT roles OR next_role IS NOT DISTINCT FROM 'assistant' THEN 1 ELSE 0 END AS mask FROM {name}_r WHERE target IS NOT NULL),
    {name} AS (SELECT lane, seq, CAST(count(*) FILTER (WHERE pid = 0) AS BIGINT) AS n_segments, CAST(sum(mask) AS BIGINT) AS n_loss, sha256(string_agg(id, ',' ORDER BY pos) || '|' || string_agg(target, ',' ORDER BY pos) || '|' || string_agg(mask, ',' ORDER BY pos) || '|' || string_agg(pid, ',' ORDER BY pos)) AS content_hash FROM {name}_m GROUP BY 1, 2)"""


def _batches_sql(name: str, a: str) -> str:
    return f"{name} AS (SELECT lane, seq // {EACH} AS step, sha256(string_agg(content_hash, '' ORDER BY seq)) AS batch_hash, CAST(sum(n_loss) AS BIGINT) AS n_loss, CAST(count(*) * {BLOCK} AS BIGINT) AS n_slots FROM {a} GROUP BY 1, 2)"


NAME_B = "b.lane || '-step' || printf('%04d', b.step) || '-' || substr(b.batch_hash, 1, 12)"
NAME = "lane || '-step' || printf('%04d', step) || '-' || substr(batch_hash, 1, 12)"
ROLE = r"^\[([a-z]+)\] "


def _texts(spark, d) -> DataFrame:
    """Documents of the three lanes with their words and, in the lane of conversations, the role of each."""
    t = table(spark, d, "documents").where(F.col("lane").isin("agent", "code", "prose") & F.col("text").isNotNull())
    lines = F.when(F.col("lane") == "agent", F.split("text", "\n")).otherwise(F.array("text"))
    words = lambda x: F.regexp_extract_all(x, F.lit(X.TOKEN), F.lit(0))
    role = lambda x: F.when(F.col("lane") == "agent", F.nullif(F.regexp_extract(x, ROLE, 1), F.lit("")))
    return t.select("lane", "doc_id", F.flatten(F.transform(lines, words)).alias("words"), F.flatten(F.transform(lines, lambda x: F.transform(words(x), lambda _: role(x)))).alias("roles"))


def _documents(spark, d) -> DataFrame:
    """Spans of the documents in their lane's shard."""
    t = table(spark, d, "documents").where(F.col("lane").isin("agent", "code", "prose")).select(F.col("lane").alias("shard_id"), "doc_id", X.tokens(F.col("text")).cast("long").alias("n")).where("n > 0")
    x = series.running_totals(t, ["shard_id"], ["doc_id"], {"start": F.col("n")})
    return x.select("shard_id", "doc_id", F.col("pos").cast("long").alias("doc_no"), "start", (F.col("start") + F.col("n")).alias("end"))


def _chosen(spark, d) -> DataFrame:
    """Pieces of documents that the drawn sequences take: whole documents from a drawn one on, or (prose) a window from a drawn place."""
    docs = _documents(spark, d)
    size = docs.groupBy("shard_id").agg(F.count("*").alias("docs"), F.max("end").alias("size")).where(F.col("size") > BLOCK)
    q = size.withColumn("seq_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DRAWS - 1).cast("long"))))
    q = q.withColumn("u", X.unit_hash(F.concat(F.lit("seq:"), "shard_id", F.lit(":"), F.col("seq_id").cast("string"))))
    whole = q.where("shard_id <> 'prose'").select("shard_id", "seq_id", F.floor(F.col("u") * F.col("docs")).alias("doc_no")).join(docs.select("shard_id", "doc_no", F.col("start").alias("from")), ["shard_id", "doc_no"]).drop("doc_no")
    window = q.where("shard_id = 'prose'").select("shard_id", "seq_id", F.floor(F.col("u") * (F.col("size") - BLOCK)).alias("from"))
    return K.pieces(docs, whole.unionByName(window), BLOCK + 1).join(docs.select("shard_id", "doc_id", F.col("start").alias("doc_start")), ["shard_id", "doc_id"])


def assembled(chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """Inputs, targets, mask and positions of sequences from their pieces: a pure function of both. Only the words of the pieces are exploded."""
    first, n = (F.col("token_start") - F.col("doc_start") + 1).cast("int"), (F.col("token_end") - F.col("token_start")).cast("int")
    x = chosen.join(texts.withColumnRenamed("lane", "shard_id"), ["shard_id", "doc_id"])
    cut = F.arrays_zip(F.slice("words", first, n).alias("word"), F.slice("roles", first, n).alias("role"))
    x = x.select("shard_id", "seq_id", "seq_start", F.posexplode(cut).alias("i", "x"))
    pos = F.col("seq_start") + F.col("i")
    x = x.select(
        F.struct("shard_id", "seq_id").alias("seq_id"), pos.alias("pos"), F.conv(F.substring(F.sha2("x.word", 256), 1, 7), 16, 10).cast("int").alias("token"), F.col("x.role").alias("role"),
        F.col("seq_start").alias("seg"), F.when(F.col("shard_id") == "prose", pos).otherwise(F.col("i")).alias("position_id"),
    )
    return K.content_hash(K.assemble(x, BLOCK)).withColumns({"shard_id": F.col("seq_id.shard_id"), "seq_id": F.col("seq_id.seq_id")})


def _sequences(spark, d, chosen: DataFrame) -> DataFrame:
    a = assembled(chosen, _texts(spark, d))
    return a.select(F.col("shard_id").alias("lane"), F.col("seq_id").alias("seq"), F.size(F.filter("position_ids", lambda p: p == 0)).cast("long").alias("n_segments"), F.aggregate("loss_mask", F.lit(0).cast("long"), lambda s, v: s + v).alias("n_loss"), "content_hash", "position_ids", "seg_ids")


def _named(batches: DataFrame) -> DataFrame:
    return batches.withColumn("batch_id", F.concat("lane", F.lit("-step"), F.format_string("%04d", "step"), F.lit("-"), F.substring("batch_hash", 1, 12)))


def _batched(sequences: DataFrame) -> DataFrame:
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("seq", "content_hash"))), lambda x: x["content_hash"])
    return _named(sequences.groupBy("lane", F.floor(F.col("seq") / EACH).alias("step")).agg(F.sha2(F.array_join(hashes, ""), 256).alias("batch_hash"), F.sum("n_loss").alias("n_loss"), (F.count("*") * BLOCK).alias("n_slots")))


@book(f"WITH {TOKENS_SQL}, {_assembled_sql('a', 'g')} SELECT lane, seq, n_segments, n_loss, content_hash FROM a")
def assembled_sequences(spark, d):
    """Sequences of 64 tokens with shifted targets, positions that start anew per document, and the mask of the assistant's targets, as a hash of their content."""
    return _sequences(spark, d, _chosen(spark, d)).select("lane", "seq", "n_segments", "n_loss", "content_hash")


@book(f"WITH {TOKENS_SQL}, {_assembled_sql('a', 'g')}, {_batches_sql('b', 'a')} SELECT {NAME} AS batch_id, lane, step, batch_hash, n_loss, n_slots FROM b")
def content_hashes(spark, d):
    """Batches of four sequences: hash over the sequences' hashes, and the name made from it."""
    return _batched(_sequences(spark, d, _chosen(spark, d))).select("batch_id", "lane", "step", "batch_hash", "n_loss", "n_slots")


def _tampered(chosen: DataFrame) -> DataFrame:
    """The pieces as a ledger has them in which some were changed afterwards: every seventh sequence starts one token later, with one token less."""
    first = (F.col("seq_start") == 0) & (F.col("seq_id") % 7 == 3) & (F.col("token_end") - F.col("token_start") > 1)
    return chosen.withColumn("token_start", F.when(first, F.col("token_start") + 1).otherwise(F.col("token_start"))).withColumn("seq_start", F.when(first, 1).otherwise(F.col("seq_start")))


TAMPERED_SQL = "h AS (SELECT lane, seq, doc_id, CASE WHEN ss = 0 AND seq % 7 = 3 AND te - ts > 1 THEN ts + 1 ELSE ts END AS ts, te, CASE WHEN ss = 0 AND seq % 7 = 3 AND te - ts > 1 THEN 1 ELSE ss END AS ss FROM g)"


def _replayed(recorded: DataFrame, again: DataFrame) -> DataFrame:
    """Recorded batches against those built again, by hash and by name; a batch that can't be built again doesn't match."""
    a = again.select("lane", "step", F.col("batch_hash").alias("hash_again"), F.col("batch_id").alias("id_again"))
    return recorded.join(a, ["lane", "step"], "left").select("lane", "step", "batch_id", (F.col("batch_hash").eqNullSafe(F.col("hash_again")) & F.col("batch_id").eqNullSafe(F.col("id_again"))).alias("match"))


@book(f"WITH {TOKENS_SQL}, {_assembled_sql('a', 'g')}, {_batches_sql('b', 'a')}, {TAMPERED_SQL}, {_assembled_sql('c', 'h')}, {_batches_sql('e', 'c')} SELECT b.lane, b.step, {NAME_B} AS batch_id, b.batch_hash IS NOT DISTINCT FROM e.batch_hash AS match FROM b LEFT JOIN e ON e.lane = b.lane AND e.step = b.step")
def replay_interval(spark, d):
    """All recorded batches built again from a ledger's pieces, of which some were tampered with: those, and only those, don't match."""
    chosen = _chosen(spark, d).checkpoint()
    return _replayed(_batched(_sequences(spark, d, chosen)), _batched(_sequences(spark, d, _tampered(chosen))))


def packing_violations(sequences: DataFrame) -> DataFrame:
    """Per sequence: pairs of positions that attend ahead or across documents, and documents whose positions don't start at 0.

    A position attends to those at or before it in its segment; with positions that count up from 0 in unbroken runs of a segment that is so. What breaks a run is counted.
    """
    n = F.size("position_ids")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct((F.get("seg_ids", i) == F.get("seg_ids", i - 1)).alias("same"), (F.get("seg_ids", i) < F.get("seg_ids", i - 1)).alias("back"), (F.get("position_ids", i) - F.get("position_ids", i - 1)).alias("step"), F.get("position_ids", i).alias("p")))
    count = lambda f: F.size(F.filter(pairs, f))
    isolated = F.col("lane") != "prose"
    return sequences.select("lane", "seq", (count(lambda x: x["back"]) + count(lambda x: x["same"] & (x["step"] != 1))).alias("mask_violations"), F.when(isolated, count(lambda x: ~x["same"] & (x["p"] != 0)) + (F.get("position_ids", F.lit(0)) != 0).cast("int")).otherwise(0).alias("reset_violations"))


@book(f"WITH {TOKENS_SQL}, {_assembled_sql('a', 'g')} SELECT lane, count(*) AS n_sequences, CAST(0 AS BIGINT) AS mask_violations, CAST(0 AS BIGINT) AS reset_violations, CAST(sum(n_segments) AS BIGINT) AS n_starts FROM a GROUP BY 1")
def packing_check(spark, d):
    """Rebuilt sequences per lane: none attends ahead or across documents, each document starts at position 0."""
    s = _sequences(spark, d, _chosen(spark, d))
    v = packing_violations(s).join(s.select("lane", "seq", "n_segments"), ["lane", "seq"])
    return v.groupBy("lane").agg(F.count("*").alias("n_sequences"), F.sum("mask_violations").cast("long").alias("mask_violations"), F.sum("reset_violations").cast("long").alias("reset_violations"), F.sum("n_segments").alias("n_starts"))


# --- evidence ----------------------------------------------------------------------------------------------------------

CHECKS = ["tokenizer integrity", "evaluation firewall", "packing correctness", "mixture compliance", "ledger completeness", "crash recovery", "replay", "learning trace", "throughput"]


@book(f"""WITH {TOKENS_SQL}, {_assembled_sql('a', 'g')}, {_batches_sql('b', 'a')}, u AS (SELECT DISTINCT * FROM segments), m AS (SELECT DISTINCT doc_id, role FROM shard_agent), compliance AS ({C.SQL['mixture_compliance']}), resumed AS ({C.SQL['resume_report']}), rates AS ({SAMPLE_SQL['throughput']}),
    x AS (SELECT 'tokenizer integrity' AS name, count(DISTINCT coalesce(lane, 'none')) AS checked, 0 AS violations FROM documents WHERE text <> ''
    UNION ALL SELECT 'evaluation firewall', count(*), count(*) FILTER (WHERE m.doc_id IS NOT NULL AND m.role IS DISTINCT FROM 'train') FROM u LEFT JOIN m ON m.doc_id = u.doc_id
    UNION ALL SELECT 'packing correctness', count(*), 0 FROM a UNION ALL SELECT 'mixture compliance', count(*), count(*) FILTER (WHERE NOT holds) FROM compliance
    UNION ALL SELECT 'ledger completeness', count(*), count(*) FILTER (WHERE n <> 1) FROM (SELECT s.step, count(DISTINCT batch_id) AS n FROM (SELECT unnest(range(min(step), max(step) + 1)) AS step FROM u) s LEFT JOIN u ON u.step = s.step GROUP BY 1)
    UNION ALL SELECT 'crash recovery', count(*), count(*) FILTER (WHERE NOT match) FROM resumed UNION ALL SELECT 'replay', count(*), 0 FROM b
    UNION ALL SELECT 'learning trace', count(*), count(*) FILTER (WHERE isnan(loss) OR isinf(loss) OR r.run_id IS NULL) FROM (SELECT DISTINCT ledger_offset, run_id, loss FROM main_midpoint_rev WHERE loss IS NOT NULL) x LEFT JOIN (SELECT DISTINCT run_id FROM {RUNS}) r ON r.run_id = x.run_id
    UNION ALL SELECT 'throughput', count(*), 0 FROM rates)
    SELECT name, CAST(checked AS BIGINT) AS checked, CAST(violations AS BIGINT) AS violations, checked > 0 AND violations = 0 AS passed FROM x UNION ALL SELECT 'overall', CAST(sum(checked) AS BIGINT), CAST(sum(violations) AS BIGINT), bool_and(checked > 0 AND violations = 0) FROM x""")
def evidence_bundle(spark, d):
    """Nine checks recomputed from the tables and files, and whether all hold. A check of nothing doesn't hold."""
    from tessella.plans import sample_queries as Q, stats_queries as R

    def one(name: str, x: DataFrame, wrong) -> DataFrame:
        return x.agg(F.lit(name).alias("name"), F.count("*").alias("checked"), F.count_if(F.coalesce(wrong, F.lit(False))).alias("violations"))

    laid, at = _laid(spark, d), S.scratch(spark, "tokens")
    manifest = S.write_laid_out(laid, at, part=PART).withColumn("tokenizer_hash", F.lit(fingerprint()))
    verified = S.verify_shards(manifest, S.file_digests(spark, at), fingerprint()).groupBy(F.regexp_replace("shard", "\\.\\d{5}$", "").alias("shard")).agg(F.bool_and(F.col("verdict") == "ok").alias("ok"))
    u = table(spark, d, "segments").dropDuplicates(["segment_id"])
    m = table(spark, d, "shard_agent").select("doc_id", "role", F.lit(True).alias("known")).distinct()
    chosen = _chosen(spark, d).checkpoint()  # a drawn number of sequences per shard
    sequences = _sequences(spark, d, chosen).checkpoint()
    batches = _batched(sequences)
    steps = u.agg(F.min("step").alias("a"), F.max("step").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("step"))
    per_step = steps.join(u.select("step", "batch_id").distinct(), "step", "left").groupBy("step").agg(F.count("batch_id").alias("n"))
    readings = table(spark, d, "main_midpoint_rev").where("loss is not null").select("ledger_offset", "run_id", "loss").distinct()
    known = R.runs(spark, d).select("run_id", F.lit(True).alias("run")).distinct()
    rates = Q.throughput(spark, d)
    spans = u.where("token_end > token_start").groupBy(F.lower("lane").alias("lane"), "batch_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"), F.sum(F.col("seq_end") - F.col("seq_start")).alias("slots"))
    again = spans.groupBy("lane").agg(F.round(F.sum("n") / F.sum("slots"), 6).alias("again"))
    checks = [
        one(CHECKS[0], verified, ~F.col("ok")),
        one(CHECKS[1], u.join(m, "doc_id", "left"), F.col("known") & ~F.col("role").eqNullSafe(F.lit("train"))),
        one(CHECKS[2], packing_violations(sequences), F.col("mask_violations") + F.col("reset_violations") > 0),
        one(CHECKS[3], C.mixture_compliance(spark, d), ~F.col("holds")),
        one(CHECKS[4], per_step, F.col("n") != 1),
        one(CHECKS[5], C.resume_report(spark, d), ~F.col("match")),
        one(CHECKS[6], _replayed(batches, _batched(_sequences(spark, d, chosen))), ~F.col("match")),
        one(CHECKS[7], readings.join(known, "run_id", "left"), F.isnan("loss") | (F.abs("loss") == float("inf")) | F.col("run").isNull()),
        one(CHECKS[8], rates.join(again, "lane", "left"), ~F.col("used_share").eqNullSafe(F.col("again"))),
    ]
    # a row each, found one after the other: a plan of all nine at once would be very large
    rows = [tuple(c.first()) for c in checks]
    x = spark.createDataFrame(rows, "name string, checked long, violations long").withColumn("passed", (F.col("checked") > 0) & (F.col("violations") == 0))
    return x.unionByName(x.agg(F.lit("overall").alias("name"), F.sum("checked").alias("checked"), F.sum("violations").alias("violations"), F.bool_and("passed").alias("passed")))
