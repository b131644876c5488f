"""Sampling, schedules, packing, ledgers and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import packing as K, sampling as S, series
from tessella.plans.base import Book
from tessella.plans.corpus_queries import ALLOWED, ALLOWED_SQL, N_SHARDS
from tessella.plans.stats_queries import RUNS, runs
from tessella.sources.tables import table

book = Book()
QUERIES, SQL = book.queries, book.sql

TOK = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+'))"
SRC = "coalesce(nullif(lower(trim(source)), ''), 'unknown')"
TARGET = 4000


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", X.missing(F.lower(F.trim("source")), "unknown").alias("source"), "lane", X.tokens(F.col("text")).cast("long").alias("n_tokens"))


def _key(prefix):
    return F.concat(F.lit(prefix), F.col("doc_id").cast("string"))


CANDIDATES = f"""x AS (SELECT doc_id, {SRC} AS source, substr(sha256('sample:' || doc_id), 1, 16) AS rank, {TOK} AS t FROM documents),
    a AS (SELECT source, sum(t) AS avail, min(rank) AS lowest, least(1.0::DOUBLE, {TARGET} * 1.08::DOUBLE / greatest(sum(t), 1)) AS share FROM x GROUP BY 1),
    c AS (SELECT x.*, CAST(('0x' || rank) AS UBIGINT)::HUGEINT <= CAST(share * 18446744073709551616.0::DOUBLE AS HUGEINT) AS inside, lowest FROM x JOIN a ON x.source = a.source),
    k AS (SELECT source, doc_id, rank, t FROM (SELECT *, bool_or(inside) OVER (PARTITION BY source) AS has FROM c) WHERE inside OR (NOT has AND rank = lowest))"""


def _candidates(spark, d):
    return S.rank_candidates(_docs(spark, d), ["source"], _key("sample:"), F.col("n_tokens"), TARGET)


@book(f"WITH {CANDIDATES} SELECT source, doc_id, rank, CAST(t AS BIGINT) AS n_tokens FROM k")
def rank_sample(spark, d):
    """Two-pass deterministic sample by rank, per source."""
    return _candidates(spark, d).select("source", "doc_id", "rank", "n_tokens")


FILL = f"""WITH RECURSIVE {CANDIDATES}, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, t, doc_id) AS i FROM k),
    f AS (SELECT source, i, doc_id, t, rank, TRUE AS taken, CAST(t AS BIGINT) AS total, 1 AS n FROM o WHERE i = 1
    UNION ALL SELECT o.source, o.i, o.doc_id, o.t, o.rank, f.total < {TARGET} AND (f.n = 0 OR f.total + o.t <= {TARGET}), f.total + CASE WHEN f.total < {TARGET} AND (f.n = 0 OR f.total + o.t <= {TARGET}) THEN o.t ELSE 0 END, f.n + CASE WHEN f.total < {TARGET} AND (f.n = 0 OR f.total + o.t <= {TARGET}) THEN 1 ELSE 0 END
    FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)"""


@book(FILL + " SELECT source, doc_id, CAST(t AS BIGINT) AS n_tokens FROM f WHERE taken")
def greedy_fill(spark, d):
    """Budget of tokens per source: what doesn't fit is skipped."""
    return S.greedy_fill(_candidates(spark, d), ["source"], TARGET, ["doc_id"]).select("source", "doc_id", F.col("t").alias("n_tokens"))


@book(FILL + " SELECT source, sha256(string_agg(rank || ':' || t || chr(10), '' ORDER BY rank)) AS digest, count(*) AS n FROM f WHERE taken GROUP BY 1")
def sample_manifest(spark, d):
    """Digest of each source's sample, in order of rank."""
    s = S.greedy_fill(_candidates(spark, d), ["source"], TARGET, ["doc_id"])
    return S.ordered_digest(s, ["source"], ["rank"], F.concat_ws("", "rank", F.lit(":"), F.col("t").cast("string"), F.lit("\n")))


@book(f"""SELECT lane, doc_id, CAST(before AS BIGINT) AS before FROM (SELECT lane, doc_id, sum(t) OVER (PARTITION BY lane ORDER BY h) - t AS before FROM (SELECT lane, doc_id, {TOK} AS t, sha256('seed7:' || doc_id) AS h FROM documents) WHERE t > 0) WHERE before < 6000""")
def capped_shuffle(spark, d):
    """Shuffled until a cap of tokens is reached, per lane."""
    return S.capped_shuffle(_docs(spark, d), ["lane"], _key("seed7:"), F.col("n_tokens"), 6000).select("lane", "doc_id", F.col("before").cast("long").alias("before"))


@book("""SELECT doc_id, CASE WHEN k <= greatest(1, floor(n * 0.05)) THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('split:' || doc_id)) AS k, count(*) OVER () AS n FROM documents)""")
def seeded_split(spark, d):
    return S.seeded_split(_docs(spark, d), _key("split:"), 0.05).select("doc_id", "split")


#: Weights of the lanes per stage.
WEIGHTS = {"warmup": {"prose": 0.7, "code": 0.2, "agent": 0.1}, "mid": {"prose": 0.4, "code": 0.35, "agent": 0.25}, "anneal": {"prose": 0.2, "code": 0.5, "agent": 0.3}}
SCHEDULE = "(SELECT CAST(s AS BIGINT) AS step, CASE WHEN s <= 16 THEN 'warmup' WHEN s <= 32 THEN 'mid' ELSE 'anneal' END AS stage FROM range(1, 49) r(s))"


def _schedule(spark):
    """Steps with their stage and weights: a range join with a fixed table."""
    rows = [("warmup", 1, 16), ("mid", 17, 32), ("anneal", 33, 48)]
    v = spark.createDataFrame([(n, a, b, WEIGHTS[n]) for n, a, b in rows], "stage string, first_step int, last_step int, weights map<string,double>")
    return spark.range(1, 49).withColumnRenamed("id", "step").join(F.broadcast(v), F.col("step").between(F.col("first_step"), F.col("last_step")))


@book(f"SELECT step, stage, CASE stage WHEN 'warmup' THEN 0.7 WHEN 'mid' THEN 0.4 ELSE 0.2 END::DOUBLE AS prose, CASE stage WHEN 'warmup' THEN 0.1 WHEN 'mid' THEN 0.175 ELSE 0.25 END::DOUBLE AS floor_code FROM {SCHEDULE}")
def mixture_schedule(spark, d):
    """A row per step with the stage's weights (map lookups) and the protected share."""
    return _schedule(spark).select("step", "stage", F.element_at("weights", "prose").alias("prose"), (F.element_at("weights", "code") * 0.5).alias("floor_code"))


U = "CAST(('0x' || substr(sha256('{}' || {}), 1, 13)) AS BIGINT) / 4503599627370496.0"


@book(f"""SELECT step, stage, CASE stage WHEN 'warmup' THEN CASE WHEN u < 0.7 THEN 'prose' WHEN u < 0.9 THEN 'code' ELSE 'agent' END WHEN 'mid' THEN CASE WHEN u < 0.4 THEN 'prose' WHEN u < 0.75 THEN 'code' ELSE 'agent' END ELSE CASE WHEN u < 0.2 THEN 'prose' WHEN u < 0.7 THEN 'code' ELSE 'agent' END END AS lane FROM (SELECT *, {U.format('draw:', 'step')} AS u FROM {SCHEDULE})""")
def lane_draw(spark, d):
    """Weighted draw of a lane per step; a hash takes the place of the generator, so a resumed run draws the same."""
    u = X.unit_hash(F.concat(F.lit("draw:"), F.col("step").cast("string")))
    lane = F.lit(None).cast("string")
    for stage, w in WEIGHTS.items():
        lane = F.when(F.col("stage") == stage, S.weighted_draw(u, w)).otherwise(lane)
    return _schedule(spark).select("step", "stage", lane.alias("lane"))


@book(f"""WITH l AS (SELECT lane, sum({TOK}) AS n FROM documents GROUP BY 1) SELECT lane, k, CAST(floor({U.format("win:", "(lane || ':' || k)")} * (n - 65 + 1)) AS BIGINT) AS token_start FROM l, range(8) r(k) WHERE n >= 65""")
def window_draw(spark, d):
    """Random contiguous windows of 65 tokens per lane."""
    n = _docs(spark, d).groupBy("lane").agg(F.sum("n_tokens").alias("n")).where("n >= 65")
    x = n.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    u = X.unit_hash(F.concat(F.lit("win:"), "lane", F.lit(":"), F.col("k").cast("string")))
    return x.select("lane", "k", F.floor(u * (F.col("n") - 65 + 1)).alias("token_start"))


@book(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, c AS chunk, sha256(array_to_string(w[c * 64 + 1 : c * 64 + 64], ' ')) AS digest FROM t, range(0, 2000) r(c) WHERE c * 64 < len(w) - 64""")
def fixed_chunks(spark, d):
    """Chunks of 64 tokens; the tail goes, and so does the last full chunk where the length is a multiple."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_extract_all("text", F.lit(X.TOKEN), F.lit(0)).alias("w"))
    n = F.ceil((F.size("w") - 64) / 64)
    x = t.where(F.size("w") > 64).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return x.select("doc_id", "chunk", F.sha2(F.array_join(F.slice("w", (F.col("chunk") * 64 + 1).cast("int"), F.lit(64)), " "), 256).alias("digest"))


@book(f"""WITH l AS (SELECT lane, CAST(sum({TOK}) AS BIGINT) AS n FROM documents GROUP BY 1) SELECT lane, w AS batch, row_ AS row_no, (w * 256 + row_ * 64) % n AS first_pos, (w * 256 + row_ * 64 + 64) % n AS last_pos FROM l, range(0, 12) b(w), range(4) r(row_)""")
def stream_windows(spark, d):
    """Contiguous (4, 65) batches of a lane's stream, overlapping by one token, going round at the end."""
    n = _docs(spark, d).groupBy("lane").agg(F.sum("n_tokens").alias("n"))
    long = lambda a, b: F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"))
    x = n.withColumn("batch", F.explode(long(0, 11))).withColumn("row_no", F.explode(long(0, 3)))
    at = F.col("batch") * 256 + F.col("row_no") * 64
    return x.select("lane", "batch", "row_no", (at % F.col("n")).alias("first_pos"), ((at + 64) % F.col("n")).alias("last_pos"))


SHARD = """s AS (SELECT shard_id, doc_id, n, row_number() OVER (PARTITION BY shard_id ORDER BY doc_id) - 1 AS doc_no, sum(n) OVER (PARTITION BY shard_id ORDER BY doc_id) - n AS start FROM (SELECT DISTINCT shard_id, doc_id, token_end - token_start AS n FROM shard_agent WHERE token_end > token_start)),
    z AS (SELECT shard_id, count(*) AS n_docs, sum(n) AS size FROM s GROUP BY 1)"""


def _spans(spark, d):
    x = table(spark, d, "shard_agent").where("token_end > token_start").select("shard_id", "doc_id", (F.col("token_end") - F.col("token_start")).alias("n")).distinct()
    y = series.running_totals(x, ["shard_id"], ["doc_id"], {"start": F.col("n")})
    return y.select("shard_id", "doc_id", F.col("pos").cast("long").alias("doc_no"), "start", (F.col("start") + F.col("n")).alias("end"))


def _packed(spark, d):
    docs = _spans(spark, d)
    n = docs.groupBy("shard_id").agg(F.count("*").alias("n_docs"))
    draws = n.withColumn("seq_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    u = X.unit_hash(F.concat(F.lit("iso:"), F.col("shard_id"), F.lit(":"), F.col("seq_id").cast("string")))
    return K.pack_isolated(docs, draws.select("shard_id", "seq_id", F.floor(u * F.col("n_docs")).alias("doc_no")), 1025)


@book(f"""WITH {SHARD}, q AS (SELECT z.shard_id, b AS seq_id, size, CAST(floor({U.format("iso:", "(z.shard_id || ':' || b)")} * n_docs) AS BIGINT) AS k FROM z, range(64) r(b)),
    f AS (SELECT q.*, s.start AS f FROM q JOIN s ON s.shard_id = q.shard_id AND s.doc_no = q.k),
    l AS (SELECT s.shard_id, s.doc_id, s.n, s.start, s.start + c * size AS lo FROM s JOIN z ON s.shard_id = z.shard_id, range(0, 3) r(c))
    SELECT f.shard_id, f.seq_id, l.doc_id, CAST(l.start AS BIGINT) AS token_start, CAST(l.start + least(l.lo + l.n, f + 1025) - l.lo AS BIGINT) AS token_end, CAST(l.lo - f AS BIGINT) AS seq_start, CAST(least(l.lo + l.n, f + 1025) - f AS BIGINT) AS seq_end
    FROM f JOIN l ON l.shard_id = f.shard_id AND l.lo >= f.f AND l.lo < f.f + 1025""")
def pack_isolated(spark, d):
    """Sequences of 1025 tokens of whole documents from a drawn one on."""
    return _packed(spark, d)


@book("""WITH s AS (SELECT DISTINCT segment_id, batch_id, token_start, token_end FROM segments WHERE token_end > token_start) SELECT batch_id, count(*) AS n_segments, CAST(sum(token_end - token_start) AS BIGINT) AS n_tokens, CAST(sum((token_end - token_start) * (token_end - token_start - 1) // 2) AS BIGINT) AS position_sum, CAST(sum((token_end - token_start) * (token_end - token_start + 1) // 2) AS BIGINT) AS n_pairs FROM s GROUP BY 1""")
def position_reset(spark, d):
    """Position ids that start anew in each segment, and the pairs that causal attention within segments allows: in closed form, not token by token."""
    s = table(spark, d, "segments").where("token_end > token_start").select("segment_id", "batch_id", (F.col("token_end") - F.col("token_start")).alias("n")).dropDuplicates(["segment_id"])
    n = F.col("n")
    half = lambda x: F.sum(F.expr(f"n * (n {x} 1) div 2"))
    return s.groupBy("batch_id").agg(F.count("*").alias("n_segments"), F.sum(n).alias("n_tokens"), half("-").alias("position_sum"), half("+").alias("n_pairs"))


@book("""WITH m AS (SELECT DISTINCT doc_id, token_start, turns FROM shard_agent), t AS (SELECT DISTINCT m.doc_id, m.token_start + u.start AS a, m.token_start + u.stop AS b FROM m, unnest(m.turns) AS x(u) WHERE u.role = 'assistant' AND u.start IS NOT NULL AND u.stop > u.start),
    o AS (SELECT DISTINCT m.doc_id FROM m, unnest(m.turns) AS x(u) WHERE u.role IS NOT NULL), s AS (SELECT DISTINCT segment_id, doc_id, token_start, token_end FROM segments WHERE token_end > token_start),
    e AS (SELECT doc_id, a AS p, 1 AS v FROM t UNION ALL SELECT doc_id, b, -1 FROM t), c AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q, sum(sum(v)) OVER (PARTITION BY doc_id ORDER BY p) AS depth FROM e GROUP BY doc_id, p),
    k AS (SELECT s.segment_id, sum(greatest(0, least(s.token_end, c.q) - greatest(s.token_start + 1, c.p))) AS n FROM s JOIN c ON c.doc_id = s.doc_id WHERE c.depth > 0 GROUP BY 1)
    SELECT s.segment_id, o.doc_id IS NOT NULL AS has_roles, CAST(CASE WHEN o.doc_id IS NULL THEN s.token_end - s.token_start - 1 ELSE coalesce(k.n, 0) END AS BIGINT) AS n_loss FROM s LEFT JOIN o ON o.doc_id = s.doc_id LEFT JOIN k ON k.segment_id = s.segment_id""")
def role_loss_mask(spark, d):
    """Tokens per segment whose target is the assistant's; turns that overlap count once, and a segment of a document without roles counts all its targets.

    Turns are merged per document, in its row. A few documents are used far more often: equal spans are counted once before the join, and come back by span.
    """
    a = table(spark, d, "shard_agent").where("turns is not null").select("doc_id", "token_start", "turns").distinct()
    talk = F.filter("turns", lambda u: (u["role"] == "assistant") & u["start"].isNotNull() & (u["stop"] > u["start"]))
    span = F.array_sort(F.transform(talk, lambda u: F.struct((F.col("token_start") + u["start"]).alias("a"), (F.col("token_start") + u["stop"]).alias("b"))))
    # each turn from where those before it end
    free = F.aggregate(span, F.struct(F.lit(None).cast("long").alias("seen"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("out")), lambda acc, x: F.struct(F.greatest(acc["seen"], x["b"]).alias("seen"), F.concat(acc["out"], F.array(F.struct(F.greatest(x["a"], acc["seen"]).alias("a"), x["b"].alias("b")))).alias("out")))["out"]
    t = a.select("doc_id", F.exists("turns", lambda u: u["role"].isNotNull()).alias("has"), free.alias("free")).where("has").groupBy("doc_id").agg(F.max("free").alias("free"))
    s = table(spark, d, "segments").where("token_end > token_start").select("segment_id", "doc_id", "token_start", "token_end").dropDuplicates(["segment_id"])
    spans = s.select("doc_id", "token_start", "token_end").distinct().join(t, "doc_id", "left")
    inside = lambda x: F.greatest(F.lit(0), F.least(F.col("token_end"), x["b"]) - F.greatest(F.col("token_start") + 1, x["a"]))
    n = F.when(F.col("free").isNull(), F.col("token_end") - F.col("token_start") - 1).otherwise(F.aggregate("free", F.lit(0).cast("long"), lambda acc, x: acc + inside(x)))
    counted = spans.select(F.col("doc_id").alias("_d"), F.col("token_start").alias("_a"), F.col("token_end").alias("_b"), F.col("free").isNotNull().alias("has_roles"), n.alias("n_loss"))
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("token_start") == F.col("_a")) & (F.col("token_end") == F.col("_b"))
    return s.join(counted, on).select("segment_id", "has_roles", "n_loss")


BATCH = """s AS (SELECT DISTINCT * FROM segments), h AS (SELECT batch_id, sha256(string_agg(concat_ws(':', shard_id, doc_id, token_start, token_end, seq_start, seq_end), chr(10) ORDER BY seq_start, segment_id)) AS batch_hash, min(step) AS step, min(lower(lane)) AS lane, count(*) AS n_segments FROM s GROUP BY 1)"""


def _hashes(spark, d):
    return K.span_hash(table(spark, d, "segments").dropDuplicates(["segment_id"]))


@book(f"WITH {BATCH} SELECT batch_id, batch_hash, lane || '-step' || printf('%04d', step) || '-' || substr(batch_hash, 1, 12) AS name, n_segments FROM h")
def batch_hashes(spark, d):
    """A batch's hash and the name derived from it."""
    name = F.concat("lane", F.lit("-step"), F.format_string("%04d", "step"), F.lit("-"), F.substring("batch_hash", 1, 12))
    return _hashes(spark, d).select("batch_id", "batch_hash", name.alias("name"), "n_segments")


@book("""WITH s AS (SELECT DISTINCT * FROM segments WHERE token_end > token_start) SELECT lower(lane) AS lane, count(DISTINCT batch_id) AS n_batches, CAST(sum(token_end - token_start) AS BIGINT) AS n_tokens, round(sum(token_end - token_start) / sum(seq_end - seq_start), 6) AS used_share,
    round(sum(token_end - token_start) / greatest(epoch(max(logged_at)) - epoch(min(logged_at)), 1), 3) AS tok_per_s FROM s GROUP BY 1""")
def throughput(spark, d):
    """Tokens, utilisation and rate per lane."""
    s = table(spark, d, "segments").where("token_end > token_start").dropDuplicates(["segment_id"])
    n, sec = F.sum(F.col("token_end") - F.col("token_start")), F.unix_micros(F.col("logged_at").cast("timestamp")) / 1e6
    return s.groupBy(F.lower("lane").alias("lane")).agg(
        F.countDistinct("batch_id").alias("n_batches"), n.alias("n_tokens"), F.round(n / F.sum(F.col("seq_end") - F.col("seq_start")), 6).alias("used_share"), F.round(n / F.greatest(F.max(sec) - F.min(sec), F.lit(1.0)), 3).alias("tok_per_s")
    )


@book("""WITH r AS (SELECT DISTINCT ledger_offset, run_id, step FROM main_midpoint_rev), s AS (SELECT run_id, step, min(ledger_offset) AS first, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT run_id, min(first) AS first_offset, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE n > 1 AND step > 0) AS BIGINT) AS n_taken_again, min(step) FILTER (WHERE n > 1 AND step > 0) AS forked_at FROM s GROUP BY 1""")
def run_lineage(spark, d):
    """Runs with their first offset and readings, and where they went on from an earlier step: the first step that was taken again, and how many were."""
    r = table(spark, d, "main_midpoint_rev").select("run_id", "ledger_offset", "step").distinct()
    s = r.groupBy("run_id", "step").agg(F.min("ledger_offset").alias("first"), F.count("*").alias("k"))
    again = (F.col("k") > 1) & (F.col("step") > 0)
    return s.groupBy("run_id").agg(F.min("first").alias("first_offset"), F.sum("k").alias("n"), F.count_if(again).alias("n_taken_again"), F.min(F.when(again, F.col("step"))).alias("forked_at"))


@book("""WITH m AS ({}), s AS (SELECT DISTINCT segment_id, lower(lane) AS lane, step, seq_start, seq_end, logged_at FROM segments WHERE token_end > token_start), x AS (SELECT s.lane, count(DISTINCT s.step) AS n_steps, sum(seq_end - seq_start) AS n_slots, sum(n_loss) AS n_useful, greatest(epoch(max(logged_at)) - epoch(min(logged_at)), 1) AS seconds FROM s JOIN m ON m.segment_id = s.segment_id GROUP BY 1)
    SELECT lane, n_steps, CAST(n_slots AS BIGINT) AS n_slots, CAST(n_useful AS BIGINT) AS n_useful, round(n_useful / n_slots, 4) AS utilisation, round(n_slots / seconds, 2) AS slots_per_s, round(n_useful / seconds, 2) AS useful_per_s FROM x""".format(SQL["role_loss_mask"]))
def performance_summary(spark, d):
    """Slots, tokens that bear a loss, what share they are, and both per second, per lane."""
    m = role_loss_mask(spark, d).select("segment_id", "n_loss")
    s = table(spark, d, "segments").where("token_end > token_start").dropDuplicates(["segment_id"]).join(m, "segment_id")
    sec = F.unix_micros(F.col("logged_at").cast("timestamp")) / 1e6
    x = s.groupBy(F.lower("lane").alias("lane")).agg(F.countDistinct("step").alias("n_steps"), F.sum(F.col("seq_end") - F.col("seq_start")).alias("n_slots"), F.sum("n_loss").alias("n_useful"), F.greatest(F.max(sec) - F.min(sec), F.lit(1.0)).alias("seconds"))
    r = lambda a, b, n: F.round(F.col(a) / F.col(b), n)
    return x.select("lane", "n_steps", "n_slots", "n_useful", r("n_useful", "n_slots", 4).alias("utilisation"), r("n_slots", "seconds", 2).alias("slots_per_s"), r("n_useful", "seconds", 2).alias("useful_per_s"))


EVIDENCE = """WITH s AS (SELECT DISTINCT * FROM segments), a AS (SELECT DISTINCT doc_id, token_start, token_end FROM shard_agent),
    c AS (SELECT 'unique_segment_ids' AS name, CAST(count(*) - count(DISTINCT segment_id) AS BIGINT) AS violations FROM s
    UNION ALL SELECT 'bounds_in_order', CAST(count(*) AS BIGINT) FROM s WHERE token_start IS NULL OR token_end IS NULL OR token_end <= token_start
    UNION ALL SELECT 'same_length_in_sequence', CAST(count(*) AS BIGINT) FROM s WHERE token_end - token_start <> seq_end - seq_start
    UNION ALL SELECT 'inside_document', CAST(count(*) AS BIGINT) FROM s JOIN a ON a.doc_id = s.doc_id WHERE s.token_start < a.token_start OR s.token_end > a.token_end
    UNION ALL SELECT 'dense_offsets', CAST(max(ledger_offset) + 1 - count(DISTINCT ledger_offset) AS BIGINT) FROM main_midpoint_rev)"""


@book(EVIDENCE + " SELECT name, violations, violations = 0 AS passed FROM c UNION ALL SELECT 'overall', sum(violations)::BIGINT, bool_and(violations = 0) FROM c")
def ledger_checks(spark, d):
    """Structural checks of the ledgers recomputed from the tables, and whether all hold."""
    s, a = table(spark, d, "segments").dropDuplicates(["segment_id"]), table(spark, d, "shard_agent").select("doc_id", F.col("token_start").alias("lo"), F.col("token_end").alias("hi")).distinct()
    raw = table(spark, d, "segments").distinct()
    one = lambda x, name: x.select(F.lit(name).alias("name"), F.col("violations").cast("long").alias("violations"))
    count = lambda x: x.agg(F.count("*").alias("violations"))
    r = table(spark, d, "main_midpoint_rev").select("ledger_offset").distinct()
    checks = [
        one(raw.groupBy("segment_id").agg((F.count("*") - 1).alias("v")).agg(F.sum("v").alias("violations")), "unique_segment_ids"),
        one(count(s.where("token_start is null or token_end is null or token_end <= token_start")), "bounds_in_order"),
        one(count(s.where("token_end - token_start <> seq_end - seq_start")), "same_length_in_sequence"),
        one(count(s.join(a, "doc_id").where("token_start < lo or token_end > hi")), "inside_document"),
        one(r.agg((F.max("ledger_offset") + 1 - F.count("*")).alias("violations")), "dense_offsets"),
    ]
    c = checks[0]
    for x in checks[1:]:
        c = c.unionByName(x)
    c = c.withColumn("passed", F.col("violations") == 0)
    return c.unionByName(c.agg(F.lit("overall").alias("name"), F.sum("violations").alias("violations"), F.bool_and("passed").alias("passed")))


PEAKS = "p AS (SELECT CAST(k * 64 AS BIGINT) AS b, CAST(1000000 + sum(n) OVER (ORDER BY k) AS BIGINT) AS peak FROM (SELECT row_no // 64 + 1 AS k, sum(length(text)) AS n, count(*) AS c FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_no, coalesce(text, '') AS text FROM documents) GROUP BY 1) WHERE c = 64)"


@book(f"""WITH {PEAKS}, f AS (SELECT regr_slope(peak, b) AS k, regr_intercept(peak, b) AS c FROM p WHERE b IN (64, 256)), m AS (SELECT max(peak) * 0.6 AS budget FROM p)
    SELECT round(k, 4) AS slope, round(c, 2) AS base, CAST(floor((budget - c) / k / 64) * 64 AS BIGINT) AS predicted, (SELECT max(b) FROM p, m WHERE peak <= budget) AS largest, (SELECT max(peak) FROM p, m WHERE peak <= budget) AS peak FROM f, m""")
def largest_batch(spark, d):
    """Peaks of memory by batch (multiples of 64, here the characters of so many texts): a line through two probes, its prediction under a budget, and the largest batch that fits as measured."""
    t = table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    rows = series.running_totals(t, [], ["doc_id"], {"before": F.col("n")})
    full = rows.where((F.col("pos") + 1) % 64 == 0).select((F.col("pos") + 1).cast("long").alias("b"), (F.col("before") + F.col("n") + 1_000_000).alias("peak"))
    fit = full.agg(F.regr_slope(F.when(F.col("b").isin(64, 256), F.col("peak")), "b").alias("k"), F.regr_intercept(F.when(F.col("b").isin(64, 256), F.col("peak")), "b").alias("c"), (F.max("peak") * 0.6).alias("budget"))
    best = full.join(F.broadcast(fit), F.col("peak") <= F.col("budget")).agg(F.max("b").alias("largest"), F.max("peak").alias("peak"))
    predicted = (F.floor((F.col("budget") - F.col("c")) / F.col("k") / 64) * 64).alias("predicted")
    return fit.join(F.broadcast(best)).select(F.round("k", 4).alias("slope"), F.round("c", 2).alias("base"), predicted, "largest", "peak")


@book(f"""WITH r AS {RUNS}, l AS (SELECT run_id, arg_max(loss, ledger_offset) AS final_loss FROM r GROUP BY 1), f AS (SELECT regexp_replace(run_id, '_[0-9]+$', '') AS family, run_id, final_loss FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY final_loss, run_id) AS rank FROM f) SELECT family, run_id AS best_run, round(final_loss, 6) AS final_loss FROM k WHERE rank = 1""")
def best_config(spark, d):
    """The run of each family with the lowest final loss."""
    last = runs(spark, d).groupBy("run_id").agg(F.max_by("loss", "ledger_offset").alias("final_loss"))
    x = last.groupBy(F.regexp_replace("run_id", "_[0-9]+$", "").alias("family")).agg(F.min(F.struct("final_loss", "run_id")).alias("b"))
    return x.select("family", F.col("b.run_id").alias("best_run"), F.round("b.final_loss", 6).alias("final_loss"))


#: Shares of the lanes in three mixtures of a small proxy model, and its budgets.
MIXTURES = {
    "A": ({"indic": 20 / 24, "agent": 2.5 / 24, "reasoning": 0.75 / 24, "longcontext": 0.75 / 24}, False),
    "B": ({"indic": 25 / 29, "agent": 2.5 / 29, "reasoning": 0.75 / 29, "longcontext": 0.75 / 29}, False),
    "C": ({"indic": 20 / 24, "agent": 2.5 / 24, "reasoning": 0.75 / 24, "longcontext": 0.75 / 24}, True),
}
TRAIN_BUDGET, VAL_BUDGET, CHUNK, LONG = 900_000, 100_000, 256, 2_000
STAGE = {"indic": 1, "agent": 1, "reasoning": 2, "longcontext": 3}
PLAN = [(h, lane, int(w * TRAIN_BUDGET), int(w * VAL_BUDGET), STAGE[lane] if ordered else 0) for h, (weights, ordered) in MIXTURES.items() for lane, w in weights.items()]
PLAN_SQL = "(VALUES " + ", ".join(f"('{h}', '{lane}', {n}, {v}, {g})" for h, lane, n, v, g in PLAN) + ") m(mixture, lane, budget, val_budget, stage)"
POOLS = f"""x AS (SELECT doc_id, lane, {TOK} AS t, sha256('pool:' || doc_id) AS h FROM documents WHERE lane IN ('indic', 'agent', 'reasoning', 'longcontext')), w AS (SELECT *, lane IN ('reasoning', 'longcontext') AND t >= {LONG} AS withheld FROM x),
    s AS (SELECT *, row_number() OVER (PARTITION BY lane, withheld ORDER BY h) <= greatest(1, floor(count(*) OVER (PARTITION BY lane, withheld) * 0.1)) AS first FROM w), p AS (SELECT lane, t, doc_id, CASE WHEN withheld THEN 'heldout' WHEN first THEN 'val' ELSE 'train' END AS part FROM s)"""


def _pools(spark, d):
    """Documents of four lanes in training, validation (a tenth of each lane, by hash) and, for long ones of two lanes, held out."""
    x = _docs(spark, d).where(F.col("lane").isin(*STAGE)).withColumn("h", F.sha2(_key("pool:"), 256)).withColumn("withheld", F.col("lane").isin("reasoning", "longcontext") & (F.col("n_tokens") >= LONG))
    n = x.groupBy("lane", "withheld").agg(F.greatest(F.lit(1), F.floor(F.count("*") * 0.1)).alias("n_val"))
    y = series.running_totals(x, ["lane", "withheld"], ["h"], {}).join(F.broadcast(n), ["lane", "withheld"])
    part = F.when(F.col("withheld"), "heldout").when(F.col("pos") < F.col("n_val"), "val").otherwise("train")
    return y.select("doc_id", "lane", "n_tokens", part.alias("part"))


@book(f"WITH {POOLS} SELECT lane, part, count(*) AS n_docs, CAST(sum(t) AS BIGINT) AS n_tokens, CAST(CASE part WHEN 'val' THEN least(sum(t), max(val_budget)) WHEN 'heldout' THEN sum(t) END AS BIGINT) AS shared FROM p JOIN {PLAN_SQL} USING (lane) WHERE mixture = 'A' GROUP BY 1, 2")
def lane_pools(spark, d):
    """Pools per lane, and what of them goes to the validation set that all mixtures share and to the held-out set."""
    plan = spark.createDataFrame([(lane, v) for h, lane, _, v, _ in PLAN if h == "A"], "lane string, val_budget long")
    x = _pools(spark, d).groupBy("lane", "part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).join(F.broadcast(plan), "lane")
    return x.select("lane", "part", "n_docs", "n_tokens", F.when(F.col("part") == "val", F.least("n_tokens", "val_budget")).when(F.col("part") == "heldout", F.col("n_tokens")).alias("shared"))


@book(f"""WITH {POOLS}, n AS (SELECT lane, CAST(sum(t) AS BIGINT) AS n FROM p WHERE part = 'train' GROUP BY 1), c AS (SELECT mixture, m.lane, stage, unnest(range(0, greatest(least(n, budget) - {CHUNK}, 0), {CHUNK})) // {CHUNK} AS chunk FROM n JOIN {PLAN_SQL} ON m.lane = n.lane)
    SELECT mixture, lane, CAST(chunk AS BIGINT) AS chunk, row_number() OVER (PARTITION BY mixture ORDER BY stage, sha256(mixture || ':' || lane || ':' || CAST(chunk AS BIGINT))) - 1 AS pos FROM c""")
def mixture_chunks(spark, d):
    """Chunks of 256 tokens of each lane's budget in three mixtures: two shuffled as a whole, one lane after lane as a curriculum."""
    n = _pools(spark, d).where("part = 'train'").groupBy("lane").agg(F.sum("n_tokens").alias("n"))
    plan = spark.createDataFrame([(h, lane, b, g) for h, lane, b, _, g in PLAN], "mixture string, lane string, budget long, stage int")
    take = F.least("n", "budget")
    c = n.join(F.broadcast(plan), "lane").where(take > CHUNK).select("mixture", "lane", "stage", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((take - CHUNK) / CHUNK) - 1)).alias("chunk"))
    c = c.withColumn("h", F.sha2(F.concat_ws(":", "mixture", "lane", F.col("chunk").cast("string")), 256))
    return series.running_totals(c, ["mixture"], ["stage", "h"], {}).select("mixture", "lane", "chunk", F.col("pos").cast("long").alias("pos"))


PERMITTED = f"lower(trim(license)) IN ({ALLOWED_SQL})"
DEEP = FILL.replace(f"SELECT doc_id, {SRC} AS source", f"SELECT doc_id, 'all' AS source, text").replace("AS t FROM documents)", f"AS t FROM documents WHERE {PERMITTED})").replace("SELECT source, doc_id, rank, t FROM (", "SELECT source, doc_id, rank, t FROM (")


@book(f"""{DEEP}, y AS (SELECT coalesce(d.text, '') AS text, f.t, f.rank FROM f JOIN documents d ON d.doc_id = f.doc_id WHERE f.taken), whole AS (SELECT count(*) AS n, sum({TOK}) AS t, count(*) FILTER (WHERE {PERMITTED}) AS pn, sum({TOK}) FILTER (WHERE {PERMITTED}) AS pt FROM documents)
    SELECT 'rows' AS metric, CAST(n AS VARCHAR) AS value FROM whole UNION ALL SELECT 'tokens', CAST(t AS VARCHAR) FROM whole UNION ALL SELECT 'permitted_rows', CAST(pn AS VARCHAR) FROM whole UNION ALL SELECT 'permitted_tokens', CAST(coalesce(pt, 0) AS VARCHAR) FROM whole UNION ALL SELECT 'tokens_in_all_shards', CAST(t * {N_SHARDS} AS VARCHAR) FROM whole
    UNION ALL SELECT 'sampled_rows', CAST(count(*) AS VARCHAR) FROM y UNION ALL SELECT 'sampled_tokens', CAST(coalesce(sum(t), 0)::BIGINT AS VARCHAR) FROM y UNION ALL SELECT 'sampled_duplicates', CAST(count(*) - count(DISTINCT sha256(text)) AS VARCHAR) FROM y
    UNION ALL SELECT 'sampled_emails', CAST(coalesce(sum(len(regexp_extract_all(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}\\b'))), 0)::BIGINT AS VARCHAR) FROM y UNION ALL SELECT 'sample_digest', sha256(coalesce(string_agg(rank || ':' || t || chr(10), '' ORDER BY rank), '')) FROM y""")
def licence_audit(spark, d):
    """One report on licences: what there is and what is permitted, carried on to all shards, and of a sample of the permitted texts duplicates, addresses and the digest of its manifest."""
    x = table(spark, d, "documents").select("doc_id", "text", X.tokens(F.col("text")).cast("long").alias("n_tokens"), F.coalesce(F.lower(F.trim("license")).isin(*ALLOWED), F.lit(False)).alias("ok"))
    stats = x.agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"), F.count_if("ok").alias("permitted_rows"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n_tokens"))), F.lit(0)).alias("permitted_tokens"), (F.sum("n_tokens") * N_SHARDS).alias("tokens_in_all_shards"))
    ids = S.greedy_fill(S.rank_candidates(x.where("ok").select("doc_id", "n_tokens", F.lit("all").alias("source")), ["source"], _key("sample:"), F.col("n_tokens"), TARGET), ["source"], TARGET, ["doc_id"])
    y = ids.join(x.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")  # a sample: bounded by its budget of tokens
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda r: F.concat(r["rank"], F.lit(":"), r["t"].cast("string"), F.lit("\n"))), "")
    sample = y.agg(F.count("*").alias("sampled_rows"), F.coalesce(F.sum("t"), F.lit(0)).alias("sampled_tokens"), (F.count("*") - F.countDistinct(F.sha2("text", 256))).alias("sampled_duplicates"), F.coalesce(F.sum(X.pattern_count(F.col("text"), X.EMAIL)), F.lit(0)).alias("sampled_emails"), F.sha2(lines, 256).alias("sample_digest"))
    long = lambda z: z.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in z.columns])).alias("r")).select("r.*")
    return long(stats).unionByName(long(sample))


@book(f"SELECT lane, CAST(sum({TOK}) AS BIGINT) AS n_tokens, CAST(least(floor(CASE lane WHEN 'prose' THEN 0.4 WHEN 'code' THEN 0.35 ELSE 0.05 END * 100000), sum({TOK})) AS BIGINT) AS budget FROM documents GROUP BY 1")
def lane_budgets(spark, d):
    """Budgets of a weighted mixture, cut off to whole tokens and to what there is."""
    w = F.when(F.col("lane") == "prose", 0.4).when(F.col("lane") == "code", 0.35).otherwise(0.05)
    n = _docs(spark, d).groupBy("lane").agg(F.sum("n_tokens").alias("n_tokens"))
    return n.select("lane", "n_tokens", F.least(F.floor(w * 100000), F.col("n_tokens")).alias("budget"))


@book(f"""SELECT lane, doc_id, CASE WHEN lane IN ('indic', 'agent') THEN 1 WHEN lane = 'reasoning' THEN 2 ELSE 3 END AS stage, row_number() OVER (ORDER BY CASE WHEN lane IN ('indic', 'agent') THEN 1 WHEN lane = 'reasoning' THEN 2 ELSE 3 END, sha256('cur:' || doc_id)) - 1 AS pos FROM documents""")
def curriculum_order(spark, d):
    """Order by stage and then by hash, with dense positions."""
    stage = F.when(F.col("lane").isin("indic", "agent"), 1).when(F.col("lane") == "reasoning", 2).otherwise(3)
    x = _docs(spark, d).withColumn("stage", stage).withColumn("h", F.sha2(_key("cur:"), 256))
    return series.running_totals(x, [], ["stage", "h"], {}).select("lane", "doc_id", "stage", F.col("pos").cast("long").alias("pos"))


@book("SELECT segment_id, row_number() OVER (ORDER BY logged_at, segment_id) - 1 AS ledger_offset FROM (SELECT DISTINCT segment_id, logged_at FROM segments WHERE logged_at IS NOT NULL)")
def ledger_offsets(spark, d):
    """Dense offsets in order of logging, over ranges."""
    x = table(spark, d, "segments").where("logged_at is not null").select("segment_id", "logged_at").distinct()
    return series.running_totals(x, [], ["logged_at", "segment_id"], {}).select("segment_id", F.col("pos").cast("long").alias("ledger_offset"))
