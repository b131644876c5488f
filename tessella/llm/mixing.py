"""Mixing sources to target shares of the total size.

Method: iterative proportional fitting. The tokens available per cell (source, language, topic) are raked until their
margins are the wanted ones, no cell being used more often than its source allows; a cell's factor says how often each of its texts is to be used. The whole part of the
factor is used for every text; for the rest texts are drawn with the calibrated probabilities by sequential Poisson
sampling: in order of (uniform hash / probability) until the source's tokens are reached. So the share of a source
misses its target by half a text at most, and the draw is the same at every run.

The margins are wanted shares of the sources and, for languages and topics, given shares, those of the corpus
(``CORPUS``), or none (None: free). They may contradict each other (a source of one language); sources are fitted last, so theirs hold, and the report has the others.

The total is the largest at which every source that has texts can fill its share without being repeated more often
than allowed, and the repeats move no language's or topic's share by more than ``slack``; or the total asked for, where sources that run
out are short and the report says so. A cell that reaches
its repeats is held there and the source's other cells make up for it, so a rare cell doesn't bound the total.

Cells are counted map side. Languages and topics are told apart as the data have them, the ``most`` largest of each, the rest
together as ``other``; so the number of cells is bounded by the table of targets, whatever the number of texts. Only cells and one row
per source go to the driver. The draw finds the
source's crossing point from a histogram of the order, so no source is sorted or collected as a whole, and the documents are joined
with tables of bounded size only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.functions.tokens import DEFAULT, with_sizes
from tessella.session import ensure_checkpoint_dir


CORPUS = "corpus"


@dataclass(frozen=True)
class MixRule:
    language_share: dict | str | None = None  # wanted shares, CORPUS, or None: what the sources' own texts imply
    topic_share: dict | str | None = None
    most: int = 32  # languages and topics told apart, where no shares name them
    slack: float = 0.01
    total_tokens: float | None = None
    rounds: int = 200
    buckets: int = 65_536
    seed: int = 11


def _fill(w: np.ndarray, cap: np.ndarray, target: float) -> np.ndarray:
    """``min(f * w, cap)`` with the one f that makes the sum the target; the caps where they don't reach it."""
    on = w > 0
    out = np.zeros_like(w)
    x, c = w[on], cap[on]
    if c.sum() <= target * (1 + 1e-12):
        out[on] = c
        return out
    order = np.argsort(c / x)
    x, c = x[order], c[order]
    held = np.concatenate([[0.0], np.cumsum(c)[:-1]])  # the sum of the caps that are reached first
    with np.errstate(over="ignore", divide="ignore"):  # weights of next to nothing at the end
        f = (target - held) / np.cumsum(x[::-1])[::-1]
    k = int(np.argmax(f * x <= c * (1 + 1e-12)))
    out[on] = np.minimum(f[k] * w[on], cap[on])
    return out


def rake(available: np.ndarray, margins: list[np.ndarray | None], rounds: int = 200, tol: float = 1e-10, cap: np.ndarray | None = None) -> np.ndarray:
    """Weights with the given margins along each axis (None: free), as near to ``available`` as may be. Axis 0 is fitted last.

    ``cap``: no weight is above it; what a cell can't take goes to the others at its place on axis 0, in proportion.

    Margins that no cell can serve are left out and the rest scaled to sum 1; the result sums to 1.
    """
    w = available / max(available.sum(), 1e-300)
    wanted = []
    for axis, m in enumerate(margins):
        if m is not None:
            m = np.where(available.sum(axis=tuple(i for i in range(w.ndim) if i != axis)) > 0, m, 0.0)
            m = m / max(m.sum(), 1e-300)
        wanted.append(m)
    for _ in range(rounds):
        moved = 0.0
        for axis in range(w.ndim - 1, -1, -1):
            if wanted[axis] is None:
                continue
            now = w.sum(axis=tuple(i for i in range(w.ndim) if i != axis))
            f = np.divide(wanted[axis], now, out=np.zeros_like(now), where=now > 0)
            w = w * f.reshape([-1 if i == axis else 1 for i in range(w.ndim)])
            moved = max(moved, float(np.abs(now - wanted[axis]).max()))
            if axis == 0 and cap is not None:
                w = np.stack([_fill(x.ravel(), c.ravel(), t).reshape(x.shape) for x, c, t in zip(w, cap, wanted[0])])
        if moved < tol:
            break
    return w


def _largest(fit, wanted: list[np.ndarray | None], top: float, slack: float) -> float:
    """The largest total up to ``top`` at which caps move the margins by no more than ``slack`` from where they are without."""
    ends = lambda w: np.concatenate([w.sum(axis=tuple(i for i in range(w.ndim) if i != axis)) for axis in range(1, w.ndim) if wanted[axis] is not None] or [np.zeros(1)])
    free = ends(fit(0.0))
    ok = lambda total: float(np.abs(ends(fit(total)) - free).max()) <= slack
    if ok(top):
        return top
    low, high = 0.0, top
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def _told_apart(cells: DataFrame, c: str, share: dict | str | None, most: int) -> list[str]:
    """Names on an axis that are told apart: those that the shares name, or the largest of the data; ``other`` is the last."""
    if isinstance(share, dict):
        return [*(k for k in share if k != "other"), "other"]
    rows = cells.groupBy(c).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), c).limit(most).collect()
    return [*(r[c] for r in rows if r[c] != "other"), "other"]


def mix_sources(documents: DataFrame, targets: DataFrame, *, id_: str = "doc_id", text: str = "text", source: str = "source", language: str = "lang", topic: str = "lane", tokenizer: str = DEFAULT, rule: MixRule = MixRule()) -> tuple[DataFrame, DataFrame]:
    """The selection ``(id_, source, lang, topic, n_tokens, n_uses)`` with ``n_uses >= 1``, and the report.

    report: ``axis, source, lang, topic, target_share, max_repeats, n_docs, n_selected, available_tokens, used_tokens, actual_share, most_uses``;
    a row per source (``axis`` is ``source``), and per language and topic where they have margins; the names off the axis are null.

    Sources are compared without case and blanks around them. A source without texts gets nothing and its share falls
    to the others in proportion; a source without a target isn't used; both are reported. A null source is the source
    ``unknown``, a null language or topic ``unknown``, too; those not told apart are ``other``. Texts that are null or empty take no part. Repeated
    ids count once; rows without an id are left out. A null or negative share counts as 0, null repeats as 1. Empty tables
    give an empty selection. Extra columns are ignored.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    name = lambda c: F.coalesce(F.nullif(F.lower(F.trim(F.col(c))), F.lit("")), F.lit("unknown"))
    base = documents.select(F.col(id_).alias("id"), F.coalesce(F.lower(F.trim(F.col(source))), F.lit("unknown")).alias("source"), name(language).alias("lang"), name(topic).alias("topic"), F.col(text).alias("text")).where("id is not null")
    cols = ["id", "source", "lang", "topic"]
    sized = with_sizes(base, "text", cols, tokenizer).groupBy("id").agg(F.min(F.struct("source", "lang", "topic", "n_tokens")).alias("x")).select("id", "x.*").checkpoint()
    share = F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))
    wanted = targets.select(F.lower(F.trim("source")).alias("source"), share.alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats")).where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = wanted.orderBy("source").collect()  # the table of targets
    names = [r["source"] for r in rows]

    raw = sized.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("n_docs"))
    known = spark.createDataFrame([(x,) for x in names], "source string")
    usable = raw.where("n > 0").join(F.broadcast(known), "source").checkpoint()
    langs, topics = _told_apart(usable, "lang", rule.language_share, rule.most), _told_apart(usable, "topic", rule.topic_share, rule.most)
    of = lambda c, told: F.when(F.col(c).isin(*told), F.col(c)).otherwise(F.lit("other"))
    merged = lambda x: x.withColumn("lang", of("lang", langs)).withColumn("topic", of("topic", topics))
    have = np.zeros((len(names), len(langs), len(topics)))
    for r in merged(usable).groupBy("source", "lang", "topic").agg(F.sum("n").alias("n")).collect():  # bounded by targets x languages x topics
        have[names.index(r["source"]), langs.index(r["lang"]), topics.index(r["topic"])] = r["n"]
    target = np.array([r["target_share"] for r in rows])
    repeats = np.array([r["max_repeats"] for r in rows], float)
    use, quota, margins = np.zeros_like(have), np.zeros(len(names)), {}
    if have.sum() > 0 and (target * repeats * have.sum(axis=(1, 2))).sum() > 0:
        live = have * ((target > 0) & (repeats > 0)).reshape(-1, 1, 1)
        on = live.sum(axis=(1, 2)) > 0
        aim = np.where(on, target, 0.0) / target[on].sum()

        def margin(share: dict | str | None, told: list[str], axes: tuple[int, int]) -> np.ndarray | None:
            if share is None:
                return None
            m = live.sum(axis=axes) if share == CORPUS else np.array([share.get(k, 0.0) for k in told])
            m = np.where(live.sum(axis=axes) > 0, m, 0.0)
            return m / m.sum() if m.sum() > 0 else None

        margins = {"lang": margin(rule.language_share, langs, (0, 2)), "topic": margin(rule.topic_share, topics, (0, 1))}
        wanted_ = [aim, margins["lang"], margins["topic"]]
        fit = lambda total: rake(live, wanted_, rule.rounds, cap=repeats.reshape(-1, 1, 1) * live / max(total, 1e-300))
        total = rule.total_tokens if rule.total_tokens is not None else _largest(fit, wanted_, float(((repeats * live.sum(axis=(1, 2)))[on] / aim[on]).min()), rule.slack)
        w = fit(total)
        use = np.divide(w * total, live, out=np.zeros_like(w), where=live > 0)
        quota = (use * live).sum(axis=(1, 2))
    factor = spark.createDataFrame([(names[i], langs[j], topics[k], float(use[i, j, k])) for i, j, k in zip(*np.nonzero(use > 0))], "source string, lang string, topic string, w double")

    w_, n = F.col("w"), F.col("n_tokens")
    u = (F.pmod(F.xxhash64(F.lit(rule.seed), F.col("id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    whole = F.floor(w_ + 1e-9)
    weighed = merged(sized.where(n > 0)).join(F.broadcast(factor), ["source", "lang", "topic"]).withColumn("whole", whole).withColumn("part", F.greatest(w_ - whole, F.lit(0.0)))
    weighed = weighed.withColumn("xi", F.when(F.col("part") > 1e-9, u / F.col("part"))).withColumn("bucket", F.floor(F.col("xi") / (1 + F.col("xi")) * rule.buckets))
    run = W.partitionBy("source").orderBy("bucket")
    counts = weighed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("whole") * n).alias("used"))  # a null bucket: nothing is drawn
    left = spark.createDataFrame([(s, float(q)) for s, q in zip(names, quota)], "source string, quota double")
    counts = counts.withColumn("want", F.sum("used").over(W.partitionBy("source"))).where("bucket is not null").withColumn("before", F.sum("t").over(run) - F.col("t")).join(F.broadcast(left), "source").withColumn("want", F.col("quota") - F.col("want"))
    at = F.when((F.col("before") < F.col("want")) & (F.col("before") + F.col("t") >= F.col("want")), F.col("bucket"))
    # sources whose draw never reaches what is wanted take all of it
    cross = counts.groupBy("source").agg(F.coalesce(F.min(at), F.when(F.max("want") > 0, F.lit(rule.buckets + 1)).otherwise(F.lit(-1))).alias("cross"), F.coalesce(F.min_by(F.col("want") - F.col("before"), at), F.lit(0.0)).alias("rest")).collect()
    edges = spark.createDataFrame([(r["source"], int(r["cross"]), float(r["rest"])) for r in cross], "source string, cross long, rest double")  # a row per target
    placed = weighed.join(F.broadcast(edges), "source", "left")
    keep = ["id", "source", "lang", "topic", "n_tokens"]
    edge = placed.where(F.col("bucket") == F.col("cross")).withColumn("sum", F.sum("n_tokens").over(W.partitionBy("source").orderBy("xi", "id"))).withColumn("extra", (F.col("sum") - n / 2 <= F.col("rest")).cast("int"))
    clear = placed.where(F.col("bucket").isNull() | F.col("cross").isNull() | (F.col("bucket") != F.col("cross"))).withColumn("extra", F.coalesce((F.col("bucket") < F.col("cross")).cast("int"), F.lit(0)))
    uses = [x.select(*keep, (F.col("whole") + F.col("extra")).cast("int").alias("n_uses")).where("n_uses > 0") for x in (clear, edge)]
    selection = uses[0].unionByName(uses[1])

    had = merged(raw).groupBy("source", "lang", "topic").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("available_tokens"))
    got = selection.groupBy("source", "lang", "topic").agg(F.count("*").alias("n_selected"), F.sum(F.col("n_tokens") * F.col("n_uses")).alias("used_tokens"), F.max("n_uses").alias("most_uses"))
    cells = had.join(got, ["source", "lang", "topic"], "left").checkpoint()
    all_ = cells.agg(F.sum("used_tokens").alias("all_tokens"))
    reports = []
    for axis in ["source", *(k for k, m in margins.items() if m is not None)]:
        x = cells.groupBy(F.col(axis).alias("name")).agg(*[F.sum(c).alias(c) for c in ("n_docs", "available_tokens", "n_selected", "used_tokens")], F.max("most_uses").alias("most_uses"))
        if axis == "source":
            aims = wanted.withColumnRenamed("source", "name")
        else:
            aims = spark.createDataFrame([(k, float(v), None) for k, v in zip(langs if axis == "lang" else topics, margins[axis]) if v > 0], "name string, target_share double, max_repeats int")
        x = x.join(aims, "name", "full").na.fill(0, ["n_docs", "available_tokens", "n_selected", "used_tokens", "most_uses"]).join(F.broadcast(all_))
        reports.append(x.select(
            F.lit({"source": "source", "lang": "language", "topic": "topic"}[axis]).alias("axis"), *[(F.col("name") if c == axis else F.lit(None).cast("string")).alias(c) for c in ("source", "lang", "topic")],
            "target_share", "max_repeats", "n_docs", "n_selected", "available_tokens", "used_tokens", F.round(F.coalesce(F.try_divide("used_tokens", "all_tokens"), F.lit(0.0)), 6).alias("actual_share"), "most_uses",
        ))
    report = reports[0]
    for x in reports[1:]:
        report = report.unionByName(x)
    return selection.withColumnRenamed("id", id_), report
