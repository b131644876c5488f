"""Tokens, comparisons of ledgers and schedules, and smaller operators over arrays and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X, tokens as K
from tessella.plans.base import Book
from tessella.plans.sample_queries import WEIGHTS
from tessella.plans.stats_queries import STAGES, STAGES_SQL
from tessella.sources.tables import table

book = Book()
QUERIES, SQL = book.queries, book.sql


@book()
def token_counts(spark, d):
    """Sizes of texts in tokens, per lane."""
    t = K.with_sizes(table(spark, d, "documents"), "text", ["doc_id", "lane"])
    return t.groupBy("lane").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most"))


@book()
def next_token_pairs(spark, d):
    """The commonest pairs of a token and the next, from real ids; counted map side."""
    t = K.with_tokens(table(spark, d, "documents"), "text", ["doc_id"])
    p = t.where(F.size("tokens") > 1).select(F.explode(F.arrays_zip(F.slice("tokens", F.lit(1), F.size("tokens") - 1).alias("a"), F.slice("tokens", F.lit(2), F.size("tokens") - 1).alias("b"))).alias("p"))
    return p.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(20)


@book(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t) SELECT doc_id, CAST(count(*) FILTER (WHERE i < len(w)) AS BIGINT) AS n_next, CAST(count(*) FILTER (WHERE i + 2 <= len(w)) AS BIGINT) AS n_after_next,
    CAST(count(*) FILTER (WHERE i < len(w) AND w[i] = w[i + 1]) AS BIGINT) AS n_same, CAST(count(*) FILTER (WHERE i + 2 <= len(w) AND w[i] = w[i + 2]) AS BIGINT) AS n_same_after FROM p GROUP BY 1""")
def shifted_targets(spark, d):
    """Targets shifted by one and by two, within a text, without a window."""
    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_extract_all("text", F.lit(X.TOKEN), F.lit(0)).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    same = lambda k: F.size(F.filter(F.zip_with(F.slice("w", F.lit(1), F.greatest(n - k, F.lit(0))), F.slice("w", F.lit(k + 1), F.greatest(n - k, F.lit(0))), lambda a, b: a == b), lambda x: x)).cast("long")
    left = lambda k: F.greatest(n - k, F.lit(0)).cast("long")
    return w.select("doc_id", left(1).alias("n_next"), left(2).alias("n_after_next"), same(1).alias("n_same"), same(2).alias("n_same_after"))


@book("SELECT coalesce(role, 'none') AS role, count(*) AS n_docs, CAST(count(*) FILTER (WHERE role IS DISTINCT FROM 'train') AS BIGINT) AS n_blocked FROM (SELECT DISTINCT doc_id, role FROM shard_agent) GROUP BY 1")
def eval_firewall(spark, d):
    """Documents that may not be trained on: any role but train."""
    a = table(spark, d, "shard_agent").select("doc_id", "role").distinct()
    return a.groupBy(F.coalesce("role", F.lit("none")).alias("role")).agg(F.count("*").alias("n_docs"), F.count_if(~F.col("role").eqNullSafe(F.lit("train"))).alias("n_blocked"))


PLAN_SQL = "(VALUES " + ", ".join(f"('{s}', '{lane}', {w}::DOUBLE)" for s, m in WEIGHTS.items() for lane, w in m.items()) + ") p(stage, lane, weight)"


@book(f"""WITH s AS (SELECT stage, lower(lane) AS lane, sum(token_end - token_start) AS n FROM (SELECT DISTINCT * FROM segments) x JOIN {STAGES_SQL} ON x.step % 48 + 1 BETWEEN first_step AND last_step WHERE token_end > token_start GROUP BY 1, 2), t AS (SELECT stage, sum(n) AS total FROM s GROUP BY 1)
    SELECT p.stage, p.lane, p.weight, round(coalesce(n, 0) / total, 6) AS actual, coalesce(n, 0) / total >= 0.5 * p.weight - 1e-9 AS holds FROM {PLAN_SQL} JOIN t ON t.stage = p.stage LEFT JOIN s ON s.stage = p.stage AND s.lane = p.lane""")
def mixture_compliance(spark, d):
    """Shares consumed per stage against the schedule, with half the weight as the floor; stages without tokens are left out."""
    v = spark.createDataFrame(STAGES, "stage string, first_step int, last_step int")
    s = table(spark, d, "segments").dropDuplicates(["segment_id"]).where("token_end > token_start").withColumn("k", F.col("step") % 48 + 1).join(F.broadcast(v), F.col("k").between(F.col("first_step"), F.col("last_step")))
    n = s.groupBy("stage", F.lower("lane").alias("lane")).agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"))
    plan = spark.createDataFrame([(a, lane, w) for a, m in WEIGHTS.items() for lane, w in m.items()], "stage string, lane string, weight double")
    share = F.coalesce("n", F.lit(0)) / F.col("total")
    return plan.join(n.groupBy("stage").agg(F.sum("n").alias("total")), "stage").join(n, ["stage", "lane"], "left").select("stage", "lane", "weight", F.round(share, 6).alias("actual"), (share >= 0.5 * F.col("weight") - 1e-9).alias("holds"))


@book("""WITH r AS (SELECT run_id, step, ledger_offset, tokens FROM (SELECT DISTINCT * FROM main_midpoint_rev) WHERE step > 0), a AS (SELECT run_id, step, min(ledger_offset) AS first, max(ledger_offset) AS last, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT a.run_id, a.step, x.tokens AS expected, y.tokens AS resumed, a.n AS n_times, x.tokens = y.tokens AS match FROM a JOIN r x ON x.ledger_offset = a.first JOIN r y ON y.ledger_offset = a.last""")
def resume_report(spark, d):
    """Steps that a run took more than once (it resumed at an earlier step): what was counted first and last."""
    r = table(spark, d, "main_midpoint_rev").where("step > 0").dropDuplicates(["ledger_offset"])
    p = F.struct("ledger_offset", "tokens")
    a = r.groupBy("run_id", "step").agg(F.min(p).alias("a"), F.max(p).alias("b"), F.count("*").alias("n")).where("n >= 2")
    return a.select("run_id", "step", F.col("a.tokens").alias("expected"), F.col("b.tokens").alias("resumed"), F.col("n").alias("n_times"), F.col("a.tokens").eqNullSafe(F.col("b.tokens")).alias("match"))


@book("""WITH c AS (SELECT repo_name, min(created_at) AS first_seen FROM documents WHERE coalesce(repo_name, '') <> '' GROUP BY 1) SELECT d.doc_id, CASE WHEN c.first_seen IS NULL OR d.created_at IS NULL THEN 'MISSING' WHEN CAST(d.created_at AS DATE) >= CAST(c.first_seen AS DATE) + 30 THEN 'BAD' ELSE 'OK' END AS verdict, strftime(d.created_at, '%Y-%m-%d') AS day FROM documents d LEFT JOIN c ON c.repo_name = d.repo_name""")
def date_verdicts(spark, d):
    """Dates against those of a catalogue: missing, bad or fine (left outer join on a table with a row per repository)."""
    x = table(spark, d, "documents").select("doc_id", "repo_name", "created_at")
    c = x.where("coalesce(repo_name, '') <> ''").groupBy("repo_name").agg(F.min("created_at").alias("first_seen"))
    v = F.when(F.col("first_seen").isNull() | F.col("created_at").isNull(), "MISSING").when(F.to_date("created_at") >= F.date_add(F.to_date("first_seen"), 30), "BAD").otherwise("OK")
    return x.join(c, "repo_name", "left").select("doc_id", v.alias("verdict"), F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@book("SELECT lane, count(*) AS n, round(greatest(0, 1 - 0.2 - 0.15 - count(*) * 1.0 / (SELECT count(*) FROM documents)), 6) AS lower_bound, round((1 - 0.2) * (1 - 0.15) * (1 - count(*) * 1.0 / (SELECT count(*) FROM documents)), 6) AS upper_bound FROM documents GROUP BY 1")
def budget_bracket(spark, d):
    """What is left after three losses: none of which overlap, or all independent."""
    x = table(spark, d, "documents").groupBy("lane").agg(F.count("*").alias("n"))
    n = F.col("n") / F.col("all")
    return x.join(F.broadcast(x.agg(F.sum("n").alias("all")))).select("lane", "n", F.round(F.greatest(F.lit(0.0), 1 - 0.2 - 0.15 - n), 6).alias("lower_bound"), F.round((1 - 0.2) * (1 - 0.15) * (1 - n), 6).alias("upper_bound"))


@book("SELECT lane, list_sort(list(doc_id))[1:12] AS ids FROM documents GROUP BY 1")
def flatten_cap(spark, d):
    """Lists flattened up to a cap: partial lists are cut before they are merged, so none grows with the data."""
    x = table(spark, d, "documents").select("lane", "doc_id", F.pmod("doc_id", F.lit(64)).alias("part"))
    w = F.expr("row_number() over (partition by lane, part order by doc_id)")
    p = x.withColumn("k", w).where("k <= 12").groupBy("lane", "part").agg(F.collect_list("doc_id").alias("l"))
    return p.groupBy("lane").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, 12).alias("ids"))


@book("SELECT vec_id, i, j, round(embedding[i + 1]::DOUBLE * embedding[j + 5]::DOUBLE, 6) + 0.0 AS v FROM embeddings, range(4) a(i), range(4) b(j)")
def outer_features(spark, d):
    """Products of two parts of a vector, all with all."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice(F.col("embedding").cast("array<double>"), 1, 4)).alias("i", "a"), "embedding")
    f = e.select("vec_id", "i", "a", F.posexplode(F.slice(F.col("embedding").cast("array<double>"), 5, 4)).alias("j", "b"))
    return f.select("vec_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round(F.col("a") * F.col("b"), 6).alias("v"))


@book("""WITH a AS (SELECT a.vec_id, a.embedding[1:8]::DOUBLE[] AS x, b.embedding[1:8]::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), p AS (SELECT vec_id, list_dot_product(x, y) ** 2 AS power, (SELECT sum(x[i + 1] * x[j + 1] * y[i + 1] * y[j + 1]) FROM range(8) r(i), range(8) s(j)) AS products FROM a)
    SELECT vec_id // 100 AS grp, count(*) AS n, round(sum(power), 4) AS power, round(sum(products), 4) AS products, max(abs(power - products)) < 1e-9 AS same FROM p GROUP BY 1""")
def bilinear_proof(spark, d):
    """The square of a product of vectors is the product of their outer products: both sides, and whether they differ at most by rounding."""
    v = table(spark, d, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("x"))
    p = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, t: s + t)
    outer = lambda c: F.flatten(F.transform(c, lambda a: F.transform(c, lambda b: a * b)))
    p = p.select("vec_id", F.pow(add(F.zip_with("x", "y", lambda a, b: a * b)), F.lit(2.0)).alias("power"), add(F.zip_with(outer("x"), outer("y"), lambda a, b: a * b)).alias("products"))
    return p.groupBy(F.floor(F.col("vec_id") / 100).alias("grp")).agg(F.count("*").alias("n"), F.round(F.sum("power"), 4).alias("power"), F.round(F.sum("products"), 4).alias("products"), (F.max(F.abs(F.col("power") - F.col("products"))) < 1e-9).alias("same"))


@book("SELECT kind, count(*) AS n, CAST(count(DISTINCT id) AS BIGINT) AS n_ids FROM (SELECT 'segment' AS kind, segment_id AS id FROM segments UNION ALL SELECT 'document', doc_id FROM shard_agent UNION ALL SELECT 'record', doc_id FROM code_commitpack_sample) GROUP BY 1")
def union_all(spark, d):
    """Ledgers put one after another."""
    one = lambda t, kind, c: table(spark, d, t).select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return one("segments", "segment", "segment_id").unionByName(one("shard_agent", "document", "doc_id")).unionByName(one("code_commitpack_sample", "record", "doc_id")).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))
