"""Joins, aggregates and windows over ledgers, vectors and the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tessella.functions.text import unit_hash
from tessella.operators import series, stats
from tessella.plans.base import Book
from tessella.sources.tables import table

book = Book()
QUERIES, SQL = book.queries, book.sql

RUNS = "(SELECT DISTINCT * FROM main_midpoint_rev WHERE isfinite(loss) AND loss > 0 AND isfinite(gnorm) AND gnorm > 0 AND step > 0)"


def runs(spark, d):
    """Valid readings, each once."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    return table(spark, d, "main_midpoint_rev").where(good("loss") & good("gnorm") & (F.col("step") > 0)).dropDuplicates(["ledger_offset"])


# --- filters -------------------------------------------------------------------------------------------------------


@book("SELECT CAST(count(*) FILTER (WHERE isnan(loss)) AS BIGINT) AS n_nan, CAST(count(*) FILTER (WHERE isinf(loss)) AS BIGINT) AS n_inf, CAST(count(*) FILTER (WHERE loss IS NULL) AS BIGINT) AS n_null FROM main_midpoint_rev")
def divergence(spark, d):
    x = table(spark, d, "main_midpoint_rev")
    return x.agg(F.count_if(F.isnan("loss")).alias("n_nan"), F.count_if(F.abs("loss") == float("inf")).alias("n_inf"), F.count_if(F.col("loss").isNull()).alias("n_null"))


@book("SELECT ledger_offset, run_id, step FROM (SELECT DISTINCT * FROM main_midpoint_rev) WHERE ledger_offset BETWEEN 100 AND 220")
def ledger_range(spark, d):
    """A range of offsets, both ends in; the filter reaches the scan."""
    return table(spark, d, "main_midpoint_rev").where(F.col("ledger_offset").between(100, 220)).select("ledger_offset", "run_id", "step").distinct()


# --- joins ---------------------------------------------------------------------------------------------------------


@book("SELECT lower(lane) AS lane, count(*) AS n_segments FROM (SELECT DISTINCT * FROM segments) s WHERE NOT EXISTS (SELECT 1 FROM shard_agent a WHERE a.doc_id = s.doc_id AND a.role IS DISTINCT FROM 'train') GROUP BY 1")
def trainable_segments(spark, d):
    """Segments without those of documents that may not be trained on (left anti join)."""
    blocked = table(spark, d, "shard_agent").where(~F.col("role").eqNullSafe(F.lit("train"))).select("doc_id").distinct()
    s = table(spark, d, "segments").dropDuplicates(["segment_id"])
    return s.join(blocked, "doc_id", "left_anti").groupBy(F.lower("lane").alias("lane")).agg(F.count("*").alias("n_segments"))


@book("""WITH r AS (SELECT DISTINCT * FROM main_midpoint_rev), a AS (SELECT DISTINCT run_id, step FROM r WHERE loss IS NOT NULL), b AS (SELECT DISTINCT run_id, step FROM r WHERE gnorm IS NOT NULL)
    SELECT coalesce(a.run_id, b.run_id) AS run_id, CAST(count(*) FILTER (WHERE b.run_id IS NULL) AS BIGINT) AS only_first, CAST(count(*) FILTER (WHERE a.run_id IS NULL) AS BIGINT) AS only_second, CAST(count(*) FILTER (WHERE a.run_id IS NOT NULL AND b.run_id IS NOT NULL) AS BIGINT) AS both FROM a FULL JOIN b ON a.run_id = b.run_id AND a.step = b.step GROUP BY 1""")
def ledger_pairs(spark, d):
    """Two ledgers of (run, step), one of losses and one of norms, against each other (full outer join): what one has and the other hasn't."""
    r = table(spark, d, "main_midpoint_rev")
    one = lambda c, name: r.where(F.col(c).isNotNull()).select("run_id", "step").distinct().withColumn(name, F.lit(True))
    x = one("loss", "a").join(one("gnorm", "b"), ["run_id", "step"], "full")
    return x.groupBy("run_id").agg(F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(F.col("a") & F.col("b")).alias("both"))


@book("SELECT lower(lane) AS lane, count(*) AS n_segments FROM (SELECT DISTINCT * FROM segments) s WHERE NOT EXISTS (SELECT 1 FROM shard_agent a WHERE a.doc_id = s.doc_id) GROUP BY 1")
def orphan_segments(spark, d):
    """Segments without a document in the manifest (left anti join)."""
    s = table(spark, d, "segments").dropDuplicates(["segment_id"])
    return s.join(table(spark, d, "shard_agent").select("doc_id").distinct(), "doc_id", "left_anti").groupBy(F.lower("lane").alias("lane")).agg(F.count("*").alias("n_segments"))


@book("""SELECT a.shard_id, count(*) AS n_segments, CAST(sum(s.token_end - s.token_start) AS BIGINT) AS n_tokens, CAST(count(*) FILTER (WHERE s.token_start < a.token_start OR s.token_end > a.token_end) AS BIGINT) AS n_outside
    FROM (SELECT DISTINCT * FROM segments) s JOIN (SELECT DISTINCT shard_id, doc_id, token_start, token_end FROM shard_agent) a ON a.doc_id = s.doc_id WHERE s.token_end > s.token_start GROUP BY 1""")
def segment_spans(spark, d):
    """Segments against the spans of their documents. A few documents are used far more often: the rows are pre-aggregated by span."""
    s = table(spark, d, "segments").dropDuplicates(["segment_id"]).where("token_end > token_start").groupBy("doc_id", "token_start", "token_end").agg(F.count("*").alias("c"))
    a = table(spark, d, "shard_agent").select("shard_id", "doc_id", F.col("token_start").alias("lo"), F.col("token_end").alias("hi")).distinct()
    out = (F.col("token_start") < F.col("lo")) | (F.col("token_end") > F.col("hi"))
    return s.join(a, "doc_id").groupBy("shard_id").agg(
        F.sum("c").alias("n_segments"), F.sum(F.col("c") * (F.col("token_end") - F.col("token_start"))).alias("n_tokens"), F.coalesce(F.sum(F.when(out, F.col("c"))), F.lit(0)).alias("n_outside")
    )


@book("""WITH t AS (SELECT DISTINCT a.doc_id, a.token_start AS d0, u.role, u.start, u.stop FROM (SELECT DISTINCT doc_id, token_start, turns FROM shard_agent WHERE turns IS NOT NULL) a, unnest(a.turns) AS x(u) WHERE u.start IS NOT NULL AND u.stop > u.start),
    s AS (SELECT DISTINCT segment_id, doc_id, token_start, token_end FROM segments WHERE token_end > token_start)
    SELECT coalesce(t.role, 'none') AS role, count(*) AS n_parts, CAST(sum(least(s.token_end, d0 + t.stop) - greatest(s.token_start, d0 + t.start)) AS BIGINT) AS n_tokens
    FROM s JOIN t ON s.doc_id = t.doc_id AND s.token_start < d0 + t.stop AND d0 + t.start < s.token_end GROUP BY 1""")
def turn_overlap(spark, d):
    """Tokens of segments by the role of the turn that they fall in (range join within a document, on spans instead of positions)."""
    a = table(spark, d, "shard_agent").where("turns is not null").select("doc_id", F.col("token_start").alias("d0"), F.explode("turns").alias("u")).where("u.start is not null and u.stop > u.start")
    t = a.select("doc_id", "d0", "u.role", "u.start", "u.stop").distinct()
    s = table(spark, d, "segments").where("token_end > token_start").select("segment_id", "doc_id", "token_start", "token_end").distinct().groupBy("doc_id", "token_start", "token_end").agg(F.count("*").alias("c"))
    lo, hi = F.greatest(F.col("token_start"), F.col("d0") + F.col("start")), F.least(F.col("token_end"), F.col("d0") + F.col("stop"))
    return s.join(t, "doc_id").where(lo < hi).groupBy(F.coalesce("role", F.lit("none")).alias("role")).agg(F.sum("c").alias("n_parts"), F.sum(F.col("c") * (hi - lo)).alias("n_tokens"))


#: Stages and their steps.
STAGES = [("warmup", 1, 16), ("mid", 17, 32), ("anneal", 33, 48)]
STAGES_SQL = "(VALUES ('warmup', 1, 16), ('mid', 17, 32), ('anneal', 33, 48)) v(stage, first_step, last_step)"


@book(f"SELECT stage, count(*) AS n_segments, CAST(sum(token_end - token_start) AS BIGINT) AS n_tokens FROM (SELECT DISTINCT * FROM segments) s JOIN {STAGES_SQL} ON s.step % 48 + 1 BETWEEN first_step AND last_step WHERE token_end > token_start GROUP BY 1")
def step_stage(spark, d):
    """Range join of steps with a fixed table of stages."""
    v = spark.createDataFrame(STAGES, "stage string, first_step int, last_step int")
    s = table(spark, d, "segments").dropDuplicates(["segment_id"]).where("token_end > token_start").withColumn("k", F.col("step") % 48 + 1)
    return s.join(F.broadcast(v), F.col("k").between(F.col("first_step"), F.col("last_step"))).groupBy("stage").agg(F.count("*").alias("n_segments"), F.sum(F.col("token_end") - F.col("token_start")).alias("n_tokens"))


@book("""WITH o AS (SELECT DISTINCT shard_id, lane FROM shard_agent), s AS (SELECT shard_id, count(*) AS n FROM (SELECT DISTINCT * FROM segments) GROUP BY 1)
    SELECT coalesce(o.shard_id, s.shard_id) AS shard_id, CASE WHEN o.shard_id IS NULL THEN 'missing' WHEN s.shard_id IS NULL THEN 'unused' ELSE 'ok' END AS verdict, coalesce(n, 0) AS n_segments FROM o FULL JOIN s ON o.shard_id = s.shard_id""")
def shard_verdicts(spark, d):
    """Manifest against use, with a verdict in order of severity (full outer join)."""
    o = table(spark, d, "shard_agent").select(F.col("shard_id").alias("a")).distinct()
    s = table(spark, d, "segments").dropDuplicates(["segment_id"]).groupBy(F.col("shard_id").alias("b")).agg(F.count("*").alias("n"))
    v = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unused").otherwise("ok")
    return o.join(s, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("shard_id"), v.alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_segments"))


@book(f"""WITH r AS {RUNS}, b AS (SELECT run_id, tokens, arg_min(loss, ledger_offset) AS loss FROM r GROUP BY 1, 2), t AS (SELECT run_id, min(tokens) + k * 1000000 AS t FROM r, range(1, 60, 7) s(k) GROUP BY run_id, k),
    c AS (SELECT t.run_id, t.t, b.tokens, b.loss, row_number() OVER (PARTITION BY t.run_id, t.t ORDER BY abs(b.tokens - t.t), b.tokens) AS k FROM t JOIN b ON b.run_id = t.run_id) SELECT run_id, t, tokens AS r_tokens, round(loss, 6) AS r_loss FROM c WHERE k = 1""")
def nearest_by_tokens(spark, d):
    """The readings of each run that are nearest to some numbers of tokens, however far off (as-of join to either side)."""
    r = runs(spark, d).select("run_id", "tokens", "ledger_offset", "loss")
    steps = F.explode(F.sequence(F.lit(1), F.lit(59), F.lit(7)))
    m = r.groupBy("run_id").agg(F.min("tokens").alias("least")).withColumn("k", steps).select("run_id", (F.col("least") + F.col("k") * 1_000_000).alias("t"))
    best = r.groupBy("run_id", "tokens").agg(F.min_by("loss", "ledger_offset").alias("loss"))
    out = series.nearest(m, best, ["run_id"], "t", "tokens")
    return out.select("run_id", "t", "r_tokens", F.round("r_loss", 6).alias("r_loss"))


@book(f"""WITH r AS (SELECT run_id, step, min(loss) AS loss FROM {RUNS} GROUP BY 1, 2) SELECT b.run_id, count(*) AS n_steps, round(avg(a.loss - b.loss), 5) + 0.0 AS mean_gap FROM r a JOIN r b ON a.step = b.step WHERE a.run_id = 'main_midpoint_rev' AND b.run_id <> 'main_midpoint_rev' GROUP BY 1""")
def run_gap(spark, d):
    """Loss of one run against each other at the same steps."""
    r = runs(spark, d).groupBy("run_id", "step").agg(F.min("loss").alias("loss"))
    a = r.where("run_id = 'main_midpoint_rev'").select("step", F.col("loss").alias("a"))
    return r.where("run_id <> 'main_midpoint_rev'").join(a, "step").groupBy("run_id").agg(F.count("*").alias("n_steps"), F.round(F.avg(F.col("a") - F.col("loss")), 5).alias("mean_gap"))


@book("""WITH o AS (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1)
    SELECT n_name, r_name, count(*) AS n_customers, CAST(count(n_orders) AS BIGINT) AS n_active, CAST(sum(coalesce(n_orders, 0)) AS BIGINT) AS n_orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1, 2""")
def star_join(spark, d):
    """Dimensions joined to a fact that is aggregated first."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    c = table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("n_customers"), F.count("n_orders").alias("n_active"), F.coalesce(F.sum("n_orders"), F.lit(0)).alias("n_orders"))


# --- aggregates ----------------------------------------------------------------------------------------------------


@book("""SELECT l_returnflag, l_linestatus, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity, round(avg(l_discount), 6) AS discount, CAST(count(*) FILTER (WHERE l_discount > 0.05) AS BIGINT) AS n_discounted FROM lineitem GROUP BY 1, 2""")
def conditional_aggregates(spark, d):
    """Plain and conditional aggregates at scale."""
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted")
    )


@book(f"SELECT run_id, round(sum(loss * tok_per_s) / sum(tok_per_s), 5) AS weighted, round(avg(loss), 5) AS macro FROM {RUNS} WHERE isfinite(tok_per_s) GROUP BY 1")
def weighted_mean(spark, d):
    """Ratio of sums against mean of means."""
    r = runs(spark, d).where("tok_per_s is not null and not isnan(tok_per_s) and abs(tok_per_s) < double('inf')")
    return r.groupBy("run_id").agg(F.round(F.sum(F.col("loss") * F.col("tok_per_s")) / F.sum("tok_per_s"), 5).alias("weighted"), F.round(F.avg("loss"), 5).alias("macro"))


@book(f"SELECT step, count(*) AS n_runs, round(avg(loss) + 1e-9, 5) AS mean_loss, round(stddev_pop(loss) + 1e-9, 5) AS sd_loss FROM (SELECT run_id, step, min(loss) AS loss FROM {RUNS} GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 3")
def curve_bands(spark, d):
    """Mean and population deviation over runs, per step."""
    r = runs(spark, d).groupBy("run_id", "step").agg(F.min("loss").alias("loss"))
    return r.groupBy("step").agg(F.count("*").alias("n_runs"), F.round(F.avg("loss") + 1e-9, 5).alias("mean_loss"), F.round(F.stddev_pop("loss") + 1e-9, 5).alias("sd_loss")).where("n_runs >= 3")


@book("""WITH c AS (SELECT lane AS x, lang AS y, count(*) AS c FROM documents WHERE lane IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY x) AS cx, sum(c) OVER (PARTITION BY y) AS cy FROM c)
    SELECT round(sum(c / n * log2((c / n) / (cx / n * cy / n))), 6) AS bits, (SELECT round(-sum(p * log2(p)), 6) FROM (SELECT sum(c) / max(n) AS p FROM m GROUP BY x)) AS entropy_x, (SELECT round(sum(p * p), 6) FROM (SELECT sum(c) / max(n) AS p FROM m GROUP BY x)) AS agreement_x FROM m""")
def mutual_information(spark, d):
    return stats.mutual_information(table(spark, d, "documents"), "lane", "lang")


@book("""WITH c AS (SELECT lane, source, count(*) AS c FROM documents WHERE lane IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY lane) AS m, sum(c) OVER (PARTITION BY source) AS o FROM c)
    SELECT lane, source, lift, rank FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY lift DESC, source) AS rank FROM (SELECT lane, source, round((c / m) / (o / n), 6) AS lift FROM m WHERE o >= 20)) WHERE rank <= 8""")
def lift_top(spark, d):
    return stats.lift_top(table(spark, d, "documents"), "lane", "source", 8, 20)


@book("SELECT lane, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lane), 6) AS share FROM documents GROUP BY 1, 2")
def crosstab_share(spark, d):
    """Row-normalised crosstab."""
    c = table(spark, d, "documents").groupBy("lane", "lang").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("lane")), 6))


@book("SELECT lane, CAST(count(*) FILTER (WHERE lang = 'en') AS BIGINT) AS en, CAST(count(*) FILTER (WHERE lang = 'hi') AS BIGINT) AS hi, CAST(count(*) FILTER (WHERE lang = 'de') AS BIGINT) AS de FROM documents GROUP BY 1")
def language_pivot(spark, d):
    return table(spark, d, "documents").groupBy("lane").pivot("lang", ["en", "hi", "de"]).agg(F.count(F.lit(1))).na.fill(0)


@book("""WITH c AS (SELECT doc_id % 37 % 32 AS e, count(*) AS c FROM documents GROUP BY 1), x AS (SELECT r.e, coalesce(c, 0) AS c FROM range(40) r(e) LEFT JOIN c ON c.e = r.e), m AS (SELECT avg(c) AS mean, max(c) AS top FROM x)
    SELECT round((top - mean) / mean, 6) AS max_violation, CAST((SELECT count(*) FROM x WHERE c = 0) AS BIGINT) AS n_dead, CAST((SELECT count(*) FROM x WHERE c < 0.1 * mean) AS BIGINT) AS n_starved, (SELECT round(sum((c / (mean * 40)) ** 2), 6) FROM x) AS agreement,
    (SELECT max(dead) FROM (SELECT count(*) FILTER (WHERE c = 0) AS dead FROM x GROUP BY e // 4)) AS most_dead_in_family FROM m""")
def load_stats(spark, d):
    """Load over experts, those without any load included."""
    return stats.load_stats(table(spark, d, "documents"), F.col("doc_id") % 37 % 32, 40, 4)


@book(f"SELECT run_id, max(loss) AS most, arg_max(ledger_offset, (loss, -ledger_offset)) AS at_most, min(loss) AS least, arg_min(ledger_offset, (loss, ledger_offset)) AS at_least FROM {RUNS} GROUP BY 1")
def extremes(spark, d):
    """Where each run is highest and lowest; the first wins."""
    k = F.col("ledger_offset")
    return runs(spark, d).groupBy("run_id").agg(F.max("loss").alias("most"), F.max_by(k, F.struct(F.col("loss"), -k)).alias("at_most"), F.min("loss").alias("least"), F.min_by(k, F.struct(F.col("loss"), k)).alias("at_least"))


@book(f"SELECT run_id, round(regr_slope(ln(loss), ln(step)), 5) + 0.0 AS slope, round(regr_intercept(ln(loss), ln(step)), 4) + 0.0 AS intercept, round(regr_r2(ln(loss), ln(step)), 5) AS r2 FROM {RUNS} GROUP BY 1")
def power_law(spark, d):
    """Log-log regression of loss on step, per run."""
    y, x = F.log("loss"), F.log(F.col("step").cast("double"))
    return runs(spark, d).groupBy("run_id").agg(F.round(F.regr_slope(y, x), 5).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 5).alias("r2"))


@book("SELECT label, count(*) AS n, round(sqrt(sum(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 3) AS norm FROM embeddings GROUP BY 1")
def group_norms(spark, d):
    """L2 norm of all numbers of a group."""
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sqrt(F.sum(sq)), 3).alias("norm"))


@book("""WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)
    SELECT a.label, (SELECT count(*) FROM u b WHERE b.label = a.label) AS n, round(avg(list_dot_product(a.u, b.u)), 5) + 0.0 AS mean_cosine FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1""")
def mean_pairwise_cosine(spark, d):
    return stats.mean_pairwise_cosine(table(spark, d, "embeddings"), ["label"], "embedding")


@book("""WITH g AS (SELECT list(s ORDER BY i) AS v FROM (SELECT i, avg(x) AS s FROM (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings WHERE label = 0) GROUP BY i))
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 5) + 0.0 AS cosine FROM embeddings, g""")
def golden_cosine(spark, d):
    """Cosine of every vector to the mean vector of a label; the mean is one row of fixed width."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    g = e.where("label = 0").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("g"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    x = e.join(F.broadcast(g))
    return x.select("vec_id", F.round(dot("v", "g") / F.sqrt(dot("v", "v") * dot("g", "g")), 5).alias("cosine"))


@book("SELECT vec_id, i, score, rank FROM (SELECT vec_id, i, round(x, 6) + 0.0 AS score, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rank FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)) WHERE rank <= 2")
def top_experts(spark, d):
    """Top-2 of each row's scores, without a shuffle."""
    p = F.transform("embedding", lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    top = F.posexplode(F.slice(F.array_sort(p), 1, 2)).alias("k", "t")
    return table(spark, d, "embeddings").select("vec_id", top).select("vec_id", F.col("t.i").cast("long").alias("i"), F.round(-F.col("t.s"), 6).alias("score"), (F.col("k") + 1).cast("long").alias("rank"))


@book("""WITH w AS (SELECT vec_id, list_reverse_sort(embedding::DOUBLE[])[1:2] AS t FROM embeddings) SELECT vec_id, round(exp(t[1] - t[1]) / (1 + exp(t[2] - t[1])), 6) AS w1, round(exp(t[2] - t[1]) / (1 + exp(t[2] - t[1])), 6) AS w2 FROM w""")
def router_weights(spark, d):
    """Weights of the two chosen experts, renormalised."""
    t = F.slice(F.array_sort(F.transform("embedding", lambda x: -x.cast("double"))), 1, 2)
    e = F.exp(F.col("t")[0] - F.col("t")[1])
    return table(spark, d, "embeddings").select("vec_id", t.alias("t")).select("vec_id", F.round(1 / (1 + e), 6).alias("w1"), F.round(e / (1 + e), 6).alias("w2"))


@book("""WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), p AS (SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p + (i % 5) * 0.01 DESC, i) AS rank FROM p) SELECT vec_id, i, rank, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS weight FROM r WHERE rank <= 2""")
def router_with_bias(spark, d):
    """Experts chosen by probability and a bias that balances their load; their weights are of the probabilities alone."""
    e = F.transform("embedding", lambda x: F.exp(x.cast("double")))
    x = table(spark, d, "embeddings").select("vec_id", e.alias("e")).withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    scored = F.transform("e", lambda v, i: F.struct((-(v / F.col("sum") + i % 5 * 0.01)).alias("s"), i.alias("i"), (v / F.col("sum")).alias("p")))
    top = x.select("vec_id", F.slice(F.array_sort(scored), 1, 2).alias("t"))
    total = F.aggregate("t", F.lit(0.0), lambda a, v: a + v["p"])
    return top.select("vec_id", total.alias("total"), F.posexplode("t").alias("k", "x")).select("vec_id", F.col("x.i").cast("long").alias("i"), (F.col("k") + 1).cast("long").alias("rank"), F.round(F.col("x.p") / F.col("total"), 6).alias("weight"))


@book("""WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), u AS (SELECT *, (CAST(('0x' || substr(sha256('gumbel:' || vec_id || ':' || i), 1, 13)) AS BIGINT)) / 4503599627370496.0 AS u FROM e),
    r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x - ln(-ln(greatest(u, 1e-300))) DESC, i) AS rank FROM u) SELECT vec_id, i, rank FROM r WHERE rank <= 2""")
def gumbel_top_k(spark, d):
    """Draw of two without replacement by Gumbel noise from a hash."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    u = F.greatest(unit_hash(F.concat(F.lit("gumbel:"), F.col("vec_id").cast("string"), F.lit(":"), F.col("i").cast("string"))), F.lit(1e-300))
    g = e.withColumn("s", F.col("x") - F.log(-F.log(u))).withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("s"), "i")))
    return g.where("rank <= 2").select("vec_id", F.col("i").cast("long").alias("i"), F.col("rank").cast("long").alias("rank"))


@book("SELECT CAST(e // 8 AS BIGINT) AS family, count(*) AS n FROM (SELECT vec_id % 64 * 4 + c AS e FROM embeddings, range(4) r(c)) GROUP BY 1")
def clone_families(spark, d):
    """Each expert becomes four clones."""
    x = table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c")).select((F.col("vec_id") % 64 * 4 + F.col("c")).alias("e"))
    return x.groupBy(F.floor(F.col("e") / 8).alias("family")).agg(F.count("*").alias("n"))


@book("SELECT label, round(exp(avg(abs(embedding[1]))), 6) AS perplexity, round(ln(count(DISTINCT label) OVER () * 1.0 + 1), 6) AS ceiling FROM embeddings GROUP BY label")
def perplexity(spark, d):
    """exp of the mean loss, against ln of the number of classes and one."""
    g = table(spark, d, "embeddings").groupBy("label").agg(F.round(F.exp(F.avg(F.abs(F.col("embedding")[0].cast("double")))), 6).alias("perplexity"))
    n = g.agg((F.count("*") + 1).cast("double").alias("n"))
    return g.join(F.broadcast(n)).select("label", "perplexity", F.round(F.log("n"), 6).alias("ceiling"))


@book(f"SELECT run_id, round(sum(CASE WHEN step % 3 = 0 THEN loss ELSE 0 END) / greatest(sum(CASE WHEN step % 3 = 0 THEN 1 ELSE 0 END), 1), 5) AS masked, round(max(abs(loss - gnorm) / greatest(abs(gnorm), 0.01)), 4) AS max_relative, round(avg(abs(loss - gnorm) / greatest(abs(gnorm), 0.01)), 4) AS mean_relative FROM {RUNS} GROUP BY 1")
def masked_mean(spark, d):
    """Masked mean, and relative errors with a floor under the denominator."""
    m = F.when(F.col("step") % 3 == 0, 1).otherwise(0)
    rel = F.abs(F.col("loss") - F.col("gnorm")) / F.greatest(F.abs("gnorm"), F.lit(0.01))
    return runs(spark, d).groupBy("run_id").agg(F.round(F.sum(F.col("loss") * m) / F.greatest(F.sum(m), F.lit(1)), 5).alias("masked"), F.round(F.max(rel), 4).alias("max_relative"), F.round(F.avg(rel), 4).alias("mean_relative"))


@book("""WITH c AS (SELECT event_id // 1000 AS part, count(value) AS n, sum(CAST(value * 1000000 AS BIGINT)) AS s FROM events GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS total, count(*) AS n_parts FROM c""")
def chunked_sum(spark, d):
    """Sum of partial sums, in whole millionths so that the order doesn't matter."""
    c = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 1000)).agg(F.count("value").alias("n"), F.sum(F.round(F.col("value") * 1_000_000).cast("long")).alias("s"))
    return c.agg(F.sum("n").alias("n"), F.sum("s").alias("total"), F.count("*").alias("n_parts"))


@book("SELECT sha256(string_agg(h || ':' || c || chr(10), '' ORDER BY h)) AS digest, count(*) AS n FROM (SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2) AS h, count(*) AS c FROM orders GROUP BY 1)")
def ordered_digest(spark, d):
    """Digest over (key, count) lines in order of the key, of at most 256 groups."""
    g = table(spark, d, "orders").groupBy(F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 2).alias("h")).agg(F.count("*").alias("c"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("h", "c"))), lambda x: F.concat(x["h"], F.lit(":"), x["c"].cast("string"), F.lit("\n")))
    return g.agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"), F.count("*").alias("n"))


# --- windows -------------------------------------------------------------------------------------------------------


@book(f"""WITH r AS {RUNS}, s AS (SELECT ledger_offset, run_id, gnorm, count(*) OVER w AS n, avg(gnorm) OVER w AS m, stddev_pop(gnorm) OVER w AS sd, lead(gnorm) OVER (PARTITION BY run_id ORDER BY logged_at, ledger_offset) AS nx FROM r WINDOW w AS (PARTITION BY run_id ORDER BY logged_at, ledger_offset ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
    SELECT ledger_offset, run_id, round((gnorm - m) / (sd + 1e-8), 2) + 0.0 AS z FROM s WHERE n = 10 AND nx IS NOT NULL AND (gnorm - m) / (sd + 1e-8) > 3""")
def zscore_spikes(spark, d):
    """Readings beyond three deviations of the ten before them (the reading itself left out)."""
    r = runs(spark, d).select("ledger_offset", "run_id", "gnorm", "logged_at")

    def frames(w):
        back = w.rowsBetween(-10, -1)
        return {"n": F.count("*").over(back), "m": F.avg("gnorm").over(back), "sd": F.stddev_pop("gnorm").over(back), "nx": F.lead("gnorm").over(w)}

    z = (F.col("gnorm") - F.col("m")) / (F.col("sd") + 1e-8)
    x = series.with_frames(r, "run_id", "logged_at", "ledger_offset", 11, frames)
    return x.where((F.col("n") == 10) & F.col("nx").isNotNull() & (z > 3)).select("ledger_offset", "run_id", F.round(z, 2).alias("z"))


@book(f"""WITH s AS (SELECT ledger_offset, run_id, loss - lag(loss) OVER w AS now, lead(loss) OVER w - loss AS nxt FROM {RUNS} WINDOW w AS (PARTITION BY run_id ORDER BY logged_at, ledger_offset))
    SELECT run_id, ledger_offset, round(nxt - now, 5) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY nxt - now DESC, ledger_offset) AS k FROM s WHERE now <= 0 AND nxt > 0) WHERE k = 1""")
def sharpest_turn(spark, d):
    """Where each run's fall turns sharpest into a rise (lead and lag, then the best)."""
    r = runs(spark, d).select("ledger_offset", "run_id", "loss", "logged_at")
    x = series.with_frames(r, "run_id", "logged_at", "ledger_offset", 1, lambda w: {"now": F.col("loss") - F.lag("loss").over(w), "nxt": F.lead("loss").over(w) - F.col("loss")})
    x = x.where("now <= 0 and nxt > 0").withColumn("t", F.col("nxt") - F.col("now"))
    return x.groupBy("run_id").agg(F.max_by("ledger_offset", F.struct(F.col("t"), -F.col("ledger_offset"))).alias("ledger_offset"), F.round(F.max("t"), 5).alias("turn"))


@book(f"""WITH s AS (SELECT run_id, loss, row_number() OVER (PARTITION BY run_id ORDER BY logged_at DESC, ledger_offset DESC) AS k FROM {RUNS}) SELECT run_id, round(avg(loss), 5) AS last_mean, count(*) AS n FROM s WHERE k <= 10 GROUP BY 1""")
def mean_of_last(spark, d):
    """Mean of the last ten readings; only a bounded heap per run moves."""
    r = runs(spark, d).select("run_id", "loss", "logged_at", "ledger_offset")
    top = r.withColumn("salt", F.pmod(F.hash("ledger_offset"), F.lit(32)))
    k = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("logged_at"), F.desc("ledger_offset")))
    top = top.withColumn("k", k("run_id", "salt")).where("k <= 10").withColumn("k", k("run_id")).where("k <= 10")
    return top.groupBy("run_id").agg(F.round(F.avg("loss"), 5).alias("last_mean"), F.count("*").alias("n"))


@book("""WITH s AS (SELECT user_id, event_type = lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS same FROM events) SELECT round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM s WHERE same IS NOT NULL""")
def same_as_next(spark, d):
    """Share of events of the same type as the next of their user."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    x = series.with_frames(e, "user_id", "ts", "event_id", 1, lambda w: {"same": F.col("event_type") == F.lead("event_type").over(w)}).where("same is not null")
    return x.agg(F.round(F.avg(F.col("same").cast("double")), 6).alias("rate"), F.count("*").alias("n"))


@book("""WITH s AS (SELECT lane, doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL) SELECT lane, doc_id, CAST(sum(n) OVER w - n AS BIGINT) AS token_start, CAST(sum(n) OVER w AS BIGINT) AS token_end, row_number() OVER w - 1 AS pos FROM s WINDOW w AS (PARTITION BY lane ORDER BY doc_id)""")
def doc_spans(spark, d):
    """Half-open spans of documents laid end to end, per lane, and their dense offsets."""
    x = table(spark, d, "documents").where("text is not null").select("lane", "doc_id", F.length("text").alias("n"))
    y = series.running_totals(x, ["lane"], ["doc_id"], {"token_start": F.col("n")})
    return y.select("lane", "doc_id", "token_start", (F.col("token_start") + F.col("n")).alias("token_end"), F.col("pos").cast("long").alias("pos"))


@book("""SELECT doc_id, turn, role, start - min(start) OVER (PARTITION BY doc_id) AS t0, sum(stop - start) OVER (PARTITION BY doc_id ORDER BY turn) - (stop - start) AS packed_start FROM (SELECT DISTINCT a.doc_id, g.i AS turn, a.turns[g.i].role AS role, a.turns[g.i].start AS start, a.turns[g.i].stop AS stop FROM shard_agent a, range(1, 200) g(i) WHERE g.i <= len(a.turns)) WHERE start IS NOT NULL""")
def turn_offsets(spark, d):
    """Running offsets of turns within their document."""
    t = table(spark, d, "shard_agent").where("turns is not null").select("doc_id", F.posexplode("turns").alias("i", "u")).distinct().select("doc_id", (F.col("i") + 1).cast("long").alias("turn"), "u.role", "u.start", "u.stop").where("start is not null")
    w = W.partitionBy("doc_id")
    n = F.col("stop") - F.col("start")
    return t.select("doc_id", "turn", "role", (F.col("start") - F.min("start").over(w)).alias("t0"), (F.sum(n).over(w.orderBy("turn")) - n).alias("packed_start"))


@book("""SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, sid, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def sessions(spark, d):
    """Sessions of users with a gap of thirty minutes."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@book("""WITH e AS (SELECT ts, event_id, CASE WHEN event_id % 3 = 2 THEN -CAST(value AS BIGINT) ELSE CAST(value AS BIGINT) END AS delta FROM events WHERE value IS NOT NULL), r AS (SELECT *, sum(delta) OVER (ORDER BY ts, event_id) AS level FROM e) SELECT CAST(max(level) AS BIGINT) AS peak, arg_max(event_id, (level, -event_id)) AS at_event FROM r""")
def peak_of_running_total(spark, d):
    """Peak of a ledger of puts and drops, and where it is; the total is run over ranges, not over all rows in one task."""
    v = F.rint("value").cast("long")
    e = table(spark, d, "events").where("value is not null").select("ts", "event_id", F.when(F.col("event_id") % 3 == 2, -v).otherwise(v).alias("delta"))
    r = series.running_totals(e, [], ["ts", "event_id"], {"before": F.col("delta")}).withColumn("level", F.col("before") + F.col("delta"))
    return r.agg(F.max("level").alias("peak"), F.max_by("event_id", F.struct(F.col("level"), -F.col("event_id"))).alias("at_event"))


@book("""WITH e AS (SELECT ts, event_id, event_type, CASE WHEN event_id % 3 = 2 THEN -CAST(value AS BIGINT) ELSE CAST(value AS BIGINT) END AS delta FROM events WHERE value IS NOT NULL), r AS (SELECT *, sum(delta) OVER (ORDER BY ts, event_id) AS level FROM e), p AS (SELECT arg_max(ts, (level, -event_id)) AS ts, arg_max(event_id, (level, -event_id)) AS event_id FROM r)
    SELECT event_type, CAST(sum(delta) AS BIGINT) AS held FROM e, p WHERE (e.ts, e.event_id) <= (p.ts, p.event_id) GROUP BY 1""")
def peak_breakdown(spark, d):
    """What each category holds at the peak of the running total."""
    v = F.rint("value").cast("long")
    e = table(spark, d, "events").where("value is not null").select("ts", "event_id", "event_type", F.when(F.col("event_id") % 3 == 2, -v).otherwise(v).alias("delta"))
    r = series.running_totals(e.drop("event_type"), [], ["ts", "event_id"], {"before": F.col("delta")}).withColumn("level", F.col("before") + F.col("delta"))
    peak = r.agg(F.max_by(F.struct("ts", "event_id"), F.struct(F.col("level"), -F.col("event_id"))).alias("peak"))
    return e.join(F.broadcast(peak), F.struct("ts", "event_id") <= F.col("peak")).groupBy("event_type").agg(F.sum("delta").alias("held"))


@book("""SELECT event_type, get_bit AS k, n FROM (SELECT event_type, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.device'), 'none') AS get_bit, count(*) AS n FROM events GROUP BY 1, 2)""")
def json_fields(spark, d):
    """Fields out of JSON."""
    k = F.coalesce(F.get_json_object("props", "$.page"), F.get_json_object("props", "$.device"), F.lit("none"))
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@book("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2000-01-01' GROUP BY 1, 2")
def daily_counts(spark, d):
    return table(spark, d, "events").where("ts >= timestamp_ntz '2000-01-01 00:00:00'").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
