"""Closed forms, schedules, masks and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import numeric as N
from tessella.functions.text import numeral, unit_hash
from tessella.operators import masks as M
from tessella.plans.base import Book
from tessella.sources.tables import table

book = Book()
QUERIES, SQL = book.queries, book.sql


@book("""WITH t AS (SELECT CAST(2 ** k AS BIGINT) AS len FROM range(10, 18) r(k)), v AS (SELECT len, unnest(['mha', 'gqa', 'mqa', 'kivi', 'mla', 'swa', 'hybrid', 'csa', 'linear']) AS scheme,
    unnest([2.0*48*64*128*len*2, 2.0*48*8*128*len*2, 2.0*48*128*len*2, 2.0*48*8*128*len*2*0.125, 48*576.0*len*2, 2.0*48*8*128*least(len, 4096)*2, 2.0*12*8*128*len*2 + 36*16*128*128*4, (24*576.0*(ceil(len/4) + least(len, 128)) + 24*576.0*(ceil(len/128) + least(len, 128)))*2, 48*16*128*128*4.0]) AS bytes FROM t) SELECT len, scheme, bytes::DOUBLE AS bytes FROM v""")
def cache_schemes(spark, d):
    """Cache of nine attention schemes over lengths."""
    x = spark.range(10, 18).select(F.pow(F.lit(2.0), F.col("id")).cast("long").alias("len"))
    s = N.cache_schemes(F.col("len"))
    return x.select("len", F.explode(F.create_map(*[y for k, v in s.items() for y in (F.lit(k), v.cast("double"))])).alias("scheme", "bytes"))


@book("SELECT p AS pos, i, round(CASE WHEN i % 2 = 0 THEN sin(p / 10000 ** (2.0 * (i // 2) / 16)) ELSE cos(p / 10000 ** (2.0 * (i // 2) / 16)) END, 6) + 0.0 AS v FROM range(64) a(p), range(16) b(i)")
def sinusoidal(spark, d):
    x = spark.range(64).withColumnRenamed("id", "pos").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    a = F.col("pos") / F.pow(F.lit(10000.0), 2.0 * F.floor(F.col("i") / 2) / 16)
    return x.select("pos", "i", F.round(F.when(F.col("i") % 2 == 0, F.sin(a)).otherwise(F.cos(a)), 6).alias("v"))


@book("SELECT m, n, round(cos((m - n) * 0.3) * (1 * 0.5 + 2 * 1.5) + sin((m - n) * 0.3) * (1 * 1.5 - 2 * 0.5), 6) + 0.0 AS score FROM range(12) a(m), range(12) b(n)")
def rope_scores(spark, d):
    """Rotated scores depend on the distance only: both vectors are turned here, one closed form there."""
    x = spark.range(12).withColumnRenamed("id", "m").withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    turn = lambda a, b, t: (a * F.cos(t) - b * F.sin(t), a * F.sin(t) + b * F.cos(t))
    (q0, q1), (k0, k1) = turn(1.0, 2.0, F.col("m") * 0.3), turn(0.5, 1.5, F.col("n") * 0.3)
    return x.select("m", "n", F.round(q0 * k0 + q1 * k1, 6).alias("score"))


@book("SELECT h, i, 2.0 ** (-8.0 * (i + 1) / h) AS slope FROM (SELECT unnest([4, 8, 16])::BIGINT AS h), range(16) r(i) WHERE i < h")
def alibi_slopes(spark, d):
    x = spark.createDataFrame([(4,), (8,), (16,)], "h long").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)))
    return x.select("h", "i", F.pow(F.lit(2.0), -8.0 * (F.col("i") + 1) / F.col("h")).alias("slope"))


@book("""WITH p AS (SELECT i, 10000.0::DOUBLE ** (-2.0 * i / 128) AS th, (10000.0::DOUBLE * 8.0 ** (128.0 / 126)) ** (-2.0 * i / 128) AS ntk FROM range(64) r(i)), r AS (SELECT *, 4096 / (2 * pi() / th) AS turns FROM p) SELECT i, 0.125::DOUBLE AS pi_scale, round(ntk / th, 6) AS ntk_scale,
    round((1 - CASE WHEN turns < 1 THEN 0 WHEN turns > 32 THEN 1 ELSE (turns - 1) / 31 END) / 8 + CASE WHEN turns < 1 THEN 0 WHEN turns > 32 THEN 1 ELSE (turns - 1) / 31 END, 6) AS yarn_scale, round(2 * pi() / th, 4) AS wavelength FROM r""")
def context_scales(spark, d):
    """Three ways of stretching rotary positions by 8."""
    i = F.col("i")
    th = F.pow(F.lit(10000.0), -2.0 * i / 128)
    ntk = F.pow(F.lit(10000.0 * 8.0 ** (128 / 126)), -2.0 * i / 128)
    turns = 4096 / (2 * F.pi() / th)
    g = F.when(turns < 1, 0.0).when(turns > 32, 1.0).otherwise((turns - 1) / 31)
    return spark.range(64).withColumnRenamed("id", "i").select("i", F.lit(0.125).alias("pi_scale"), F.round(ntk / th, 6).alias("ntk_scale"), F.round((1 - g) / 8 + g, 6).alias("yarn_scale"), F.round(2 * F.pi() / th, 4).alias("wavelength"))


@book("""WITH n AS (SELECT unnest([1, 2, 8, 32, 64])::BIGINT AS n), v AS (SELECT n, s.stage, s.a, s.b, s.c FROM n, (VALUES ('dp', 16, 0, 2), ('zero1', 4, 12, 2), ('zero2', 2, 14, 2), ('zero3', 0, 16, 3)) s(stage, a, b, c)) SELECT n, stage, round(a + b * 1.0 / n, 6) AS bytes_per_weight, round(c * (n - 1.0) / n, 6) AS copies_sent, round(30e9 * (a + b * 1.0 / n) / 1073741824, 3) AS gib FROM v""")
def sharding_costs(spark, d):
    """Bytes per weight, traffic and memory of four ways of dividing the state."""
    x = spark.createDataFrame([(n,) for n in (1, 2, 8, 32, 64)], "n long")
    n = F.col("n").cast("double")
    row = [F.struct(F.lit(s).alias("stage"), F.round(N.bytes_per_weight(s, n), 6).alias("bytes_per_weight"), F.round(N.copies_sent(s, n), 6).alias("copies_sent"), F.round(30e9 * N.bytes_per_weight(s, n) / N.GIB, 3).alias("gib")) for s in N.SHARDING]
    return x.select("n", F.explode(F.array(*row)).alias("r")).select("n", "r.*")


@book("""WITH c AS (SELECT k, 1.0 / 3 + 1.0 * 2 / 3 / 12 * 2 * (k + 1) AS ready FROM range(6) r(k)) SELECT k, round(ready, 6) AS ready, round(max(ready - k * (0.01 + 0.8 / 6)) OVER (ORDER BY k) + k * (0.01 + 0.8 / 6), 6) AS sent_from, round(max(ready - k * (0.01 + 0.8 / 6)) OVER (ORDER BY k) + (k + 1) * (0.01 + 0.8 / 6), 6) AS sent_to FROM c""")
def bucket_timeline(spark, d):
    """Transfers that queue on one link, without a walk: the start is the largest (ready - cost before) so far plus the cost before."""
    cost = 0.01 + 0.8 / 6
    ready = 1.0 / 3 + 1.0 * 2 / 3 / 12 * 2 * (F.col("k") + 1)
    x = spark.range(6).withColumnRenamed("id", "k").withColumn("ready", ready)
    start = F.expr(f"max(ready - k * {cost}) over (partition by 0 order by k)") + F.col("k") * cost
    return x.select("k", F.round("ready", 6).alias("ready"), F.round(start, 6).alias("sent_from"), F.round(start + cost, 6).alias("sent_to"))


@book("""SELECT s AS step, round(CASE WHEN s < 20 THEN 3e-4 * (s + 1) / 20 ELSE 3e-5 + 0.9 * 3e-4 * 0.5 * (1 + cos(pi() * (s - 20) / 280.0)) END, 10) AS cosine, round(CASE WHEN s < 20 THEN 3e-4 * (s + 1) / 20 WHEN s < 240 THEN 3e-4 ELSE 3e-4 * (0.1 + 0.9 * (1 - (s - 240) / 60.0)) END, 10) AS plateau,
    round(least(1.0, (s * 8192 - 1000000 + 8192) / 500000.0) * 3e-4, 10) AS rewarmed, round(least(0.002, 3e-4 * sqrt((s + 1) / 64.0)), 10) AS scaled FROM range(300) r(s)""")
def learning_rates(spark, d):
    """Schedules over steps: cosine, plateau, a rise after a restart, and the root rule for batch sizes with a cap."""
    s = F.col("step")
    r = lambda c: F.round(c, 10)
    return spark.range(300).withColumnRenamed("id", "step").select(
        "step", r(N.cosine_rate(s, 3e-4, 20, 300)).alias("cosine"), r(N.plateau_rate(s, 3e-4, 20, 300)).alias("plateau"),
        r(N.rewarmed(F.lit(3e-4), s * 8192.0, 1e6, 8192.0, 500000.0)).alias("rewarmed"), r(F.least(F.lit(0.002), 3e-4 * F.sqrt((s + 1) / 64.0))).alias("scaled"),
    )


@book("""WITH b AS (SELECT v.b, p.p FROM (VALUES (0.9::DOUBLE), (0.999::DOUBLE)) v(b), (VALUES (0.05::DOUBLE), (0.01::DOUBLE), (0.001::DOUBLE)) p(p)), s AS (SELECT b, p, min(t) AS step FROM b, range(1, 8000) r(t) WHERE 1 / (1 - b ** t) - 1 <= p GROUP BY 1, 2) SELECT b AS beta, p AS within, step FROM s""")
def bias_correction_steps(spark, d):
    """First step at which the correction is within a share of 1, in closed form."""
    x = spark.createDataFrame([(b, p) for b in (0.9, 0.999) for p in (0.05, 0.01, 0.001)], "beta double, within double")
    return x.select("beta", "within", F.ceil(F.log(1 - 1 / (1 + F.col("within"))) / F.log("beta")).alias("step"))


@book("""WITH RECURSIVE g AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS t, unnest(embedding::DOUBLE[]) AS g FROM embeddings), a AS (SELECT vec_id, 0 AS t, 0.5::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM embeddings
    UNION ALL SELECT a.vec_id, a.t + 1, a.w - 0.1 * ((0.9 * a.m + 0.1 * g.g) / (1 - 0.9 ** (a.t + 1))) / (sqrt((0.999 * a.v + 0.001 * g.g * g.g) / (1 - 0.999 ** (a.t + 1))) + 1e-8), 0.9 * a.m + 0.1 * g.g, 0.999 * a.v + 0.001 * g.g * g.g FROM a JOIN g ON g.vec_id = a.vec_id AND g.t = a.t + 1)
    SELECT vec_id, CAST(t AS BIGINT) AS t, round(w, 6) + 0.0 AS w, round(m, 6) + 0.0 AS m, round(v, 6) + 0.0 AS v FROM a WHERE t IN (1, 2, 16, 64)""")
def adam_trace(spark, d):
    """Adam as a fold over an array of gradients (each vector's numbers), at some of its steps."""
    x = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("g"))
    st = lambda t, w, m, v, kept: F.struct(t.cast("long").alias("t"), w.alias("w"), m.alias("m"), v.alias("v"), kept.alias("kept"))
    zero = st(F.lit(0), F.lit(0.5), F.lit(0.0), F.lit(0.0), F.array().cast("array<struct<t:bigint,w:double,m:double,v:double>>"))

    def step(p, g):
        t, m, v = p["t"] + 1, 0.9 * p["m"] + 0.1 * g, 0.999 * p["v"] + 0.001 * g * g
        w = p["w"] - 0.1 * (m / (1 - F.pow(F.lit(0.9), t))) / (F.sqrt(v / (1 - F.pow(F.lit(0.999), t))) + 1e-8)
        now = F.array(F.struct(t.cast("long").alias("t"), w.alias("w"), m.alias("m"), v.alias("v")))
        return st(t, w, m, v, F.when(t.isin(1, 2, 16, 64), F.concat(p["kept"], now)).otherwise(p["kept"]))

    r = lambda c: F.round(f"s.{c}", 6).alias(c)
    return x.select("vec_id", F.explode(F.aggregate("g", zero, step)["kept"]).alias("s")).select("vec_id", "s.t", r("w"), r("m"), r("v"))


@book("""WITH w AS (SELECT vec_id // 64 AS grp, vec_id % 4 AS k, vec_id, embedding[1]::DOUBLE AS v FROM embeddings) SELECT grp, k, round(sum(v), 6) + 0.0 AS additive, round(arg_max(v, vec_id), 6) + 0.0 AS delta FROM w GROUP BY 1, 2""")
def state_writes(spark, d):
    """Additive and delta-rule writes to a fixed state of four slots, as folds over a group's writes in order: a later value of a key adds to the earlier ones, or replaces them."""
    w = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("grp"), "vec_id", (F.col("vec_id") % 4).cast("int").alias("k"), F.col("embedding")[0].cast("double").alias("v"))
    g = w.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("vec_id", "k", "v"))).alias("w"))  # 64 writes a group
    one_hot = lambda k: [F.when(k == i, 1.0).otherwise(0.0) for i in range(4)]

    def write(delta):
        def f(s, x):
            key = one_hot(x["k"])
            held = sum((s[i] * key[i] for i in range(1, 4)), s[0] * key[0])
            add = x["v"] - held if delta else x["v"]
            return F.array(*[s[i] + add * key[i] for i in range(4)])

        return f

    zero = F.array(*[F.lit(0.0)] * 4)
    y = g.select("grp", "w", F.aggregate("w", zero, write(False)).alias("a"), F.aggregate("w", zero, write(True)).alias("b"))
    rows = y.select("grp", "w", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.round(F.col("a")[i], 6).alias("additive"), F.round(F.col("b")[i], 6).alias("delta")) for i in range(4)])).alias("r"))
    return rows.where(F.exists("w", lambda x: x["k"] == F.col("r.k"))).select("grp", F.col("r.k").cast("long").alias("k"), "r.additive", "r.delta")


@book("SELECT n, round(6.0 * 5226752 * n / (5.2e12 * 14 / 16), 6) AS mfu, round((6.0 * 2.1e7 * least(n * 1e4, 1.5e8) + 6.0 * 3.9e7 * greatest(0, n * 1e4 - 1.5e8)) / 1e15, 6) AS pflops FROM (SELECT unnest([10000, 20000, 35907])::BIGINT AS n)")
def utilisation(spark, d):
    """Use of the peak rate, and work that changes its price at a number of tokens."""
    n = F.col("n")
    x = spark.createDataFrame([(v,) for v in (10000, 20000, 35907)], "n long")
    t = n * 1e4
    work = 6 * 2.1e7 * F.least(t, F.lit(1.5e8)) + 6 * 3.9e7 * F.greatest(F.lit(0.0), t - 1.5e8)
    return x.select("n", F.round(6.0 * 5226752 * n / (5.2e12 * 14 / 16), 6).alias("mfu"), F.round(work / 1e15, 6).alias("pflops"))


@book("SELECT v AS vocab, w AS width, CAST(v * w + 128 * w + 4 * (12 * w * w + 13 * w) + 2 * w AS BIGINT) AS tied, CAST(2 * v * w + 128 * w + 4 * (12 * w * w + 13 * w) + 2 * w AS BIGINT) AS untied, round(v * w * 1.0 / (2 * v * w + 128 * w + 4 * (12 * w * w + 13 * w) + 2 * w), 6) AS saved FROM (SELECT unnest([4000, 6000, 8192])::BIGINT AS v), (SELECT unnest([128, 256])::BIGINT AS w)")
def parameter_counts(spark, d):
    """Weights of a small model with and without a tied head."""
    x = spark.createDataFrame([(v, w) for v in (4000, 6000, 8192) for w in (128, 256)], "vocab long, width long")
    v, w = F.col("vocab"), F.col("width")
    body = v * w + 128 * w + 4 * (12 * w * w + 13 * w) + 2 * w
    return x.select("vocab", "width", body.alias("tied"), (body + v * w).alias("untied"), F.round(v * w / (body + v * w), 6).alias("saved"))


@book("SELECT e AS n_experts, k AS top_k, CAST(t AS BIGINT) AS total, CAST(t - 4 * (e - k) * 8 * 256 * 256 AS BIGINT) AS active FROM (SELECT e, k, 8192 * 256 + 128 * 256 + 4 * (4 * 256 * 256 + 13 * 256 + e * 8 * 256 * 256 + e * 256) + 2 * 256 AS t FROM (SELECT unnest([4, 8, 16])::BIGINT AS e), (SELECT unnest([1, 2])::BIGINT AS k))")
def active_parameters(spark, d):
    """Weights of a mixture of experts, and those that one token uses: all but the experts that it isn't sent to."""
    x = spark.createDataFrame([(e, k) for e in (4, 8, 16) for k in (1, 2)], "n_experts long, top_k long")
    w, layers, expert = 256, 4, 2 * 4 * 256 * 256
    total = 8192 * w + 128 * w + layers * (4 * w * w + 13 * w + F.col("n_experts") * (expert + w)) + 2 * w
    return x.select("n_experts", "top_k", total.alias("total"), (total - layers * (F.col("n_experts") - F.col("top_k")) * expert).alias("active"))


IJ = "(SELECT i, j FROM range(24) a(i), range(24) b(j) WHERE j <= i)"
SCORE = "CAST(('0x' || substr(sha256('score:' || i || ':' || j), 1, 13)) AS BIGINT) / 4503599627370496.0"


@book(f"""WITH c AS (SELECT i, j, CAST(('0x' || substr(sha256('big:' || i || ':' || j), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM {IJ}), m AS (SELECT 'full' AS kind, 1 AS code FROM c UNION ALL SELECT 'window', CASE WHEN i - j < 4 THEN 1 ELSE 0 END FROM c UNION ALL SELECT 'sinks', CASE WHEN i - j < 4 THEN 1 WHEN j < 2 THEN 2 ELSE 0 END FROM c
    UNION ALL SELECT 'strided', CASE WHEN i // 4 = j // 4 THEN 1 WHEN (i - j) % 4 = 0 THEN 3 ELSE 0 END FROM c UNION ALL SELECT 'bigbird', CASE WHEN i - j < 4 THEN 1 WHEN j < 1 THEN 2 WHEN u < 0.12 THEN 3 ELSE 0 END FROM c) SELECT kind, code, count(*) AS n FROM m GROUP BY 1, 2""")
def mask_patterns(spark, d):
    """Cells by code of the patterns that depend on the place alone."""
    p = M.causal_pairs(spark, 24)
    u = unit_hash(F.concat(F.lit("big:"), F.col("i").cast("string"), F.lit(":"), F.col("j").cast("string")))
    rows = [F.struct(F.lit(k).alias("kind"), M.pattern(k, u=u).alias("code")) for k in ("full", "window", "sinks", "strided", "bigbird")]
    return p.select(F.explode(F.array(*rows)).alias("m")).groupBy("m.kind", "m.code").agg(F.count("*").alias("n"))


def _scores(spark):
    return M.causal_pairs(spark, 24).withColumn("score", unit_hash(F.concat(F.lit("score:"), F.col("i").cast("string"), F.lit(":"), F.col("j").cast("string"))))


@book(f"SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM (SELECT i, j, {SCORE} AS s FROM {IJ})) WHERE r <= 4")
def mask_top_k(spark, d):
    return M.top_k_cells(_scores(spark), 4).where("code = 3").select("i", "j")


@book(f"""WITH c AS (SELECT i, j, {SCORE} AS s FROM {IJ}), b AS (SELECT i, j // 4 AS k, row_number() OVER (PARTITION BY i ORDER BY avg(s) DESC, j // 4) AS r FROM c WHERE j // 4 < i // 4 GROUP BY 1, 2)
    SELECT c.i, c.j, CASE WHEN c.i // 4 = c.j // 4 THEN 1 WHEN b.r <= 1 THEN 3 ELSE 0 END AS code FROM c LEFT JOIN b ON b.i = c.i AND b.k = c.j // 4""")
def mask_blocks(spark, d):
    """Own block and the best past one."""
    return M.top_blocks(_scores(spark), 4, 1).select("i", "j", "code")


@book(f"""WITH c AS (SELECT i, j, {SCORE} AS s FROM {IJ}), b AS (SELECT i, j // 4 AS k, row_number() OVER (PARTITION BY i ORDER BY avg(s) DESC, j // 4) AS r FROM c WHERE j // 4 < i // 4 GROUP BY 1, 2)
    SELECT c.i, c.j, CASE WHEN c.i - c.j < 4 THEN 1 WHEN b.r <= 2 THEN 3 ELSE 0 END AS code FROM c LEFT JOIN b ON b.i = c.i AND b.k = c.j // 4""")
def mask_window_and_blocks(spark, d):
    """A window and the two best past blocks."""
    return M.top_blocks(_scores(spark), 4, 2, window=4).select("i", "j", "code")


@book()
def mask_heavy_hitters(spark, d):
    """Greedy eviction over one matrix."""
    return M.heavy_hitters(_scores(spark).withColumn("matrix", F.lit(0)), "matrix", 4, 4)


@book(f"""WITH c AS (SELECT i, j, {SCORE} AS s FROM {IJ}), e AS (SELECT i, j, exp(s - max(s) OVER (PARTITION BY i)) AS e FROM c) SELECT i, j, round(e / sum(e) OVER (PARTITION BY i), 8) AS p FROM e""")
def attention_softmax(spark, d):
    return M.softmax(_scores(spark), ["i"], "score").select("i", "j", F.round("p", 8).alias("p"))


@book("""WITH x AS (SELECT vec_id % 8 AS i, j, avg(x) AS v FROM (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2), s AS (SELECT a.i, b.i AS j, sum(a.v * b.v) / 8 AS s FROM x a JOIN x b ON a.j = b.j WHERE b.i <= a.i GROUP BY 1, 2), e AS (SELECT i, j, exp(s - max(s) OVER (PARTITION BY i)) AS e FROM s), p AS (SELECT i, j, e / sum(e) OVER (PARTITION BY i) AS p FROM e)
    SELECT p.i, x.j, round(sum(p.p * x.v), 6) + 0.0 AS v FROM p JOIN x ON x.i = p.j GROUP BY 1, 2""")
def attention_output(spark, d):
    """Scores, mask, softmax and output of eight positions, as joins and aggregates over long matrices."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 8).alias("i"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "x"))
    x = e.groupBy("i", F.col("j").cast("long").alias("j")).agg(F.avg("x").alias("v"))
    t = x.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    s = M.matmul(x, t).where("j <= i").withColumn("v", F.col("v") / 8)
    p = M.softmax(s, ["i"], "v").select("i", "j", F.col("p").alias("v"))
    return M.matmul(p, x).select("i", "j", F.round("v", 6).alias("v"))


@book("""WITH e AS (SELECT vec_id, vec_id // 64 AS grp, embedding::DOUBLE[] AS k, embedding[1]::DOUBLE AS v FROM embeddings), q AS (SELECT grp, arg_min(k, vec_id) AS q FROM e GROUP BY 1),
    a AS (SELECT e.grp, sum(list_dot_product(q.q, e.k) * e.v) AS direct FROM e JOIN q ON q.grp = e.grp GROUP BY 1), u AS (SELECT grp, v, unnest(k) AS x, unnest(range(len(k))) AS i FROM e), s AS (SELECT grp, i, sum(x * v) AS s FROM u GROUP BY 1, 2),
    b AS (SELECT q.grp, list_dot_product(q.q, (SELECT list(s.s ORDER BY s.i) FROM s WHERE s.grp = q.grp)) AS regrouped FROM q) SELECT a.grp, round(direct, 5) + 0.0 AS direct, round(regrouped, 5) + 0.0 AS regrouped, abs(direct - regrouped) < 1e-9 AS same FROM a JOIN b ON b.grp = a.grp""")
def linear_regrouping(spark, d):
    """Without softmax the sum over the past can be kept as a state: (q k) v summed, against q times the sum of k v."""
    e = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 64).alias("grp"), F.col("embedding").cast("array<double>").alias("k")).withColumn("v", F.col("k")[0])
    q = e.groupBy("grp").agg(F.min_by("k", "vec_id").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    direct = e.join(q, "grp").groupBy("grp").agg(F.sum(dot("q", "k") * F.col("v")).alias("direct"))
    state = e.select("grp", "v", F.posexplode("k").alias("i", "x")).groupBy("grp", "i").agg(F.sum(F.col("x") * F.col("v")).alias("s"))
    state = state.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("s"))
    x = direct.join(q.join(state, "grp").select("grp", dot("q", "s").alias("regrouped")), "grp")
    return x.select("grp", F.round("direct", 5).alias("direct"), F.round("regrouped", 5).alias("regrouped"), (F.abs(F.col("direct") - F.col("regrouped")) < 1e-9).alias("same"))


@book("""WITH t AS (SELECT DISTINCT p_brand AS token FROM part), b AS (SELECT token, unnest(range(least(octet_length(encode(token)), 32))) AS position FROM t) SELECT token, CAST(('0x' || substr(hex(encode(token)), position * 2 + 1, 2)) AS INTEGER) AS byte, CAST(position AS INTEGER) AS position, round(1 / sqrt(least(octet_length(encode(token)), 32)), 9) AS weight FROM b""")
def byte_positions(spark, d):
    """Sparse byte x position code of tokens."""
    return N.byte_positions(table(spark, d, "part").select(F.col("p_brand").alias("token")).distinct(), "token")


ODD = ["1e5", "-2.5E-3", "1_000", "1__0", "_1", "inf", "-Infinity", "nan", "1f", "2d", "0x10", ".5", "5.", ".", "+7", "--1", "1e", "e5", " 12 ", ""]  # spellings that texts seldom hold


@book(rf"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+')) AS token FROM documents UNION ALL SELECT unnest([{", ".join(f"'{x}'" for x in ODD)}])), d AS (SELECT DISTINCT token FROM t),
    n AS (SELECT token, CASE WHEN regexp_full_match(trim(token), '[+-]?(?:(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?)') THEN CAST(replace(trim(token), '_', '') AS DOUBLE)
        WHEN regexp_full_match(lower(trim(token)), '[+]?inf(inity)?') THEN 'inf'::DOUBLE WHEN regexp_full_match(lower(trim(token)), '-inf(inity)?') THEN '-inf'::DOUBLE WHEN regexp_full_match(lower(trim(token)), '[+-]?nan') THEN 'nan'::DOUBLE END AS n FROM d)
    SELECT token, n IS NOT NULL AS is_number, CASE WHEN n IS NULL THEN 0.0 WHEN isnan(n) THEN NULL ELSE sign(n)::DOUBLE END AS sign, CASE WHEN n IS NULL THEN 0.0 WHEN NOT isfinite(n) THEN NULL ELSE round(ln(abs(n) + 1e-6), 6) + 0.0 END AS log, CASE WHEN n IS NULL THEN 0.0 WHEN NOT isfinite(n) THEN NULL ELSE round(n / 1000, 6) + 0.0 END AS lin FROM n""")
def numeral_codes(spark, d):
    """Tokens with whether they spell a number, and its sign, log size and scaled value (null where these aren't finite)."""
    t = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._+-]+"), F.lit(0))).alias("token"))
    t = t.unionByName(spark.createDataFrame([(x,) for x in ODD], "token string")).distinct()
    x = t.withColumn("n", numeral(F.col("token"))).withColumn("c", N.meaning_code(F.col("n")))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, 6))
    return x.select("token", F.col("n").isNotNull().alias("is_number"), finite("c.sign").alias("sign"), finite("c.log").alias("log"), finite("c.lin").alias("lin"))


@book("SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round((a + b) * 1.0, 4) AS sum, round((a - b) * 1.0, 4) AS difference, round(exp(ln(a + 1e-6) + ln(b + 1e-6)) - 1e-12, 4) AS product, round(exp(ln(a + 1e-6) - ln(b + 1e-6)), 6) AS quotient FROM range(1, 40) x(a), range(1, 40) y(b)")
def meaning_algebra(spark, d):
    """Arithmetic on codes instead of numbers."""
    x = spark.range(1, 40).withColumnRenamed("id", "a").withColumn("b", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(39).cast("long"))))
    y = x.withColumn("ca", N.meaning_code(F.col("a").cast("double"))).withColumn("cb", N.meaning_code(F.col("b").cast("double")))
    o = N.decoded(F.col("ca"), F.col("cb"))
    return y.select("a", "b", F.round(o["sum"], 4).alias("sum"), F.round(o["difference"], 4).alias("difference"), F.round(o["product"], 4).alias("product"), F.round(o["quotient"], 6).alias("quotient"))


@book("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / greatest(stddev_samp(p_retailprice) OVER (), 1e-6), 6) + 0.0 AS z FROM part")
def z_normalise(spark, d):
    """Columns less their mean over their sample deviation; the two numbers are a row that is broadcast."""
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    m = p.agg(F.avg("p_retailprice").alias("m"), F.greatest(F.stddev_samp("p_retailprice"), F.lit(1e-6)).alias("s"))
    return p.join(F.broadcast(m)).select("p_partkey", F.round((F.col("p_retailprice") - F.col("m")) / F.col("s"), 6).alias("z"))


NAMES = "CASE p_partkey % 4 WHEN 0 THEN 'blocks.' || p_size || '.attn.' || p_partkey WHEN 1 THEN 'blocks.' || p_size || '.mlp' WHEN 2 THEN 'head.weight' ELSE 'embedding' END"


@book(f"SELECT p_partkey, name, CASE WHEN starts_with(name, 'blocks.') THEN 'block' || split_part(name, '.', 2) || '.' || split_part(name, '.', 3) ELSE split_part(name, '.', 1) END AS grouped FROM (SELECT p_partkey, {NAMES} AS name FROM part)")
def group_names(spark, d):
    """Parameter names to their groups: ``blocks.i.sub`` to ``block{i}.sub``, others to their first part."""
    x = table(spark, d, "part").select("p_partkey", F.expr(NAMES).alias("name"))
    return x.select("p_partkey", "name", N.group_name(F.col("name")).alias("grouped"))


@book("""WITH g AS (SELECT 'block' || label || '.' || CASE vec_id % 2 WHEN 0 THEN 'attn' ELSE 'mlp' END AS grp, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS w, list_dot_product(list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7) / 1000), list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7) / 1000)) AS u FROM embeddings) SELECT grp, count(*) AS n, round(sqrt(sum(u)) / (sqrt(sum(w)) + 1e-12), 8) AS ratio FROM g GROUP BY 1""")
def group_norm_ratios(spark, d):
    """Norm of a group's updates over that of its weights."""
    name = F.concat(F.lit("blocks."), F.col("label").cast("string"), F.when(F.col("vec_id") % 2 == 0, ".attn.w").otherwise(".mlp.w"))
    e = table(spark, d, "embeddings").select(N.group_name(name).alias("grp"), "vec_id", F.col("embedding").cast("array<double>").alias("w"))
    square = lambda v, k=1.0: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * k * x * k)
    return e.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sqrt(F.sum(square("w", F.col("vec_id") % 7 / 1000))) / (F.sqrt(F.sum(square("w"))) + 1e-12), 8).alias("ratio"))


@book("""WITH x AS (SELECT p_partkey, p_retailprice::DOUBLE AS v, floor(log2(p_retailprice::DOUBLE))::BIGINT AS e FROM part WHERE p_retailprice IS NOT NULL), u AS (SELECT p_partkey, (e + 127) * 8388608 + CAST(round_even((v / 2.0 ** e - 1) * 8388608, 0) AS BIGINT) AS u FROM x), h AS (SELECT p_partkey, u, (u + 32767 + (u // 65536) % 2) // 65536 AS h FROM u)
    SELECT p_partkey, lpad(bin(u), 32, '0') AS b32, lpad(bin(h), 16, '0') AS b16, (1 + (u % 8388608) / 8388608.0::DOUBLE) * 2.0::DOUBLE ** ((u // 8388608) - 127) AS float32, (1 + (h % 128) / 128.0::DOUBLE) * 2.0::DOUBLE ** ((h // 128) - 127) AS bfloat16 FROM h""")
def float_layouts(spark, d):
    """Bits of two float formats, and the value decoded from them."""
    x = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("v")).where("v is not null")
    y = x.select("p_partkey", "v", N.bits_float32("v").alias("b32"), N.bits_bfloat16("v").alias("b16"))
    return y.select("p_partkey", "b32", "b16", N.decode_bits(F.col("b32"), 8, 127).alias("float32"), N.decode_bits(F.col("b16"), 8, 127).alias("bfloat16"))


@book("""WITH e AS (SELECT label, unnest(embedding::DOUBLE[]) AS x FROM embeddings), t AS (SELECT label, max(abs(x)) AS amax FROM e GROUP BY 1), y AS (SELECT e.label, x, amax, x * (448.0::DOUBLE / amax) AS s FROM e JOIN t ON t.label = e.label), a AS (SELECT *, least(abs(s), 448.0) AS a FROM y),
    b AS (SELECT *, 2.0::DOUBLE ** (greatest(floor(log2(CASE WHEN a > 0 THEN a ELSE 1.0 END)), -6) - 3) AS step FROM a), q AS (SELECT label, x, sign(s) * least(round_even(a / step, 0) * step, 448.0) * amax / 448.0 AS q FROM b) SELECT label, count(*) AS n, round(max(abs(q - x)), 6) AS worst, round(avg(abs(q - x)), 6) AS mean FROM q GROUP BY 1""")
def fp8_quantise(spark, d):
    """Scaled to the range of the 8-bit format, rounded, and scaled back, per label."""
    e = table(spark, d, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    top = e.groupBy("label").agg(F.max(F.abs("x")).alias("amax"))

    y = e.join(top, "label").withColumn("q", N.quantised(F.col("x") * (448.0 / F.col("amax"))) * F.col("amax") / 448.0)
    return y.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("q") - F.col("x"))), 6).alias("worst"), F.round(F.avg(F.abs(F.col("q") - F.col("x"))), 6).alias("mean"))
