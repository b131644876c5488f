"""Abusive, hateful or sexual content by compression distance.

Zstandard dictionaries are trained on passages with such content and on ordinary ones: of the latter one on a sample of
all and one on the hard cases, which would be crowded out of the first. A passage is compressed with each; the margin
is the number of bytes that the toxic dictionary saves over the better one of the ordinary ones. A document's margin is the largest
of its passages, as one passage is enough. The cutoff is calibrated on labelled documents that the dictionaries in
question were not trained on, and on the margins of the whole corpus: labelled documents aren't drawn evenly, so how rare the content is,
and how many ordinary documents reach a margin, is counted where the scorer is used (``calibrate``).

Labels are verdicts on documents, so the toxic passages have to be found first: of the documents called toxic, those
passages are taken whose words occur in such documents beyond what they do in the others (each document is left out
of its own counts), and that the dictionaries trained on the other half of the documents also find closer to the
toxic side. Hard cases are the ordinary passages that look most like toxic ones, by their words or by the first
dictionaries: talk about such content, curses at things, medical words, rare languages.

Fitting takes a bounded sample of the labelled documents (``most_docs`` of either verdict), on the driver. Scoring
reads every passage of every document once, in place: one narrow stage whose margins are checkpointed (a row of some thirty bytes per
document) and counted; what is sent to the workers are three dictionaries of ``size`` bytes, what comes back is a count per margin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from tessella.llm.passages import passages
from tessella.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class ToxicityRule:
    most_docs: int = 3000  # labelled documents of either verdict that are fitted on
    size: int = 225_280  # bytes of a dictionary
    level: int = 3
    toxic_quantile: float = 0.995  # of ordinary passages' word odds, beyond which a passage of a toxic document is toxic
    hard_quantile: float = 0.95  # of the same, beyond which an ordinary passage is a hard one
    mined_quantile: float = 0.93  # of ordinary passages' margins by the first dictionaries, beyond which they are hard cases too
    prior_docs: int = 20  # documents of the labels' own mix that count beside the corpus when its share of toxic ones is estimated
    seed: int = 7


@dataclass(frozen=True)
class Scorer:
    """What was learnt: the dictionaries, and the margins (in bytes) of labelled documents by dictionaries that didn't see them."""

    toxic: bytes
    ordinary: bytes
    hard: bytes
    level: int
    toxic_margins: tuple[int, ...] = ()
    clean_margins: tuple[int, ...] = ()
    toxic_share: float = 0.0  # of the labels
    prior_docs: int = 20

    def compressors(self) -> tuple:
        return tuple(_compressor(x, self.level) for x in (self.toxic, self.ordinary, self.hard))

    @property
    def cutoff(self) -> float:
        """The cutoff by the labels alone."""
        return self.calibrate(np.zeros(0), np.zeros(0))

    def calibrate(self, margin: np.ndarray, count: np.ndarray) -> float:
        """Cutoff with the best expected F1 on a corpus, given how many of its documents have each margin.

        Of N documents with a share p of toxic ones, at least p * N * TPR(t) reach a margin t, where TPR is the labelled
        toxic documents' share that does; the largest p that the counts allow at every t is the estimate. What reaches t
        beyond that is clean. Both rates are pooled with those of the labels, which decide where the corpus is small.
        """
        if not self.toxic_margins or not self.clean_margins:
            return float("inf")
        t = np.unique(np.concatenate([np.maximum(self.toxic_margins, 1), np.maximum(self.clean_margins, 1), np.maximum(margin, 1)]).astype(int))
        at_least = lambda x, w: np.array([w[x >= k].sum() for k in t], float)
        tox, clean = np.array(self.toxic_margins), np.array(self.clean_margins)
        tpr = at_least(tox, np.ones(len(tox))) / len(tox)
        false = at_least(clean, np.ones(len(clean)))
        n, flagged = float(count.sum()), at_least(margin, count)
        usual = tpr >= min(0.5, tpr.max())
        toxic = float((flagged / np.maximum(tpr, 1e-9))[usual].min())
        share = (toxic + self.prior_docs * self.toxic_share) / (n + self.prior_docs)
        fpr = (np.maximum(flagged - toxic * tpr, 0) + false) / (n - toxic + len(clean))
        f1 = 2 * share * tpr / (share * tpr + (1 - share) * fpr + share)
        return float(t[int(f1.argmax())] - 0.5)


def _compressor(data: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on; their text itself serves
        return b"\n".join(samples)[-size:] or b"\n"


def _lengths(c: zstandard.ZstdCompressor, p: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, map(c.compress, p)), np.int32, len(p))


def margins(compressors: tuple, p: list[bytes]) -> np.ndarray:
    """Bytes that the toxic dictionary saves over the ordinary ones, per passage."""
    toxic, ordinary, hard = (_lengths(c, p) for c in compressors)
    return np.minimum(ordinary, hard) - toxic


def _evidence(p: list[bytes], at: np.ndarray, toxic: np.ndarray, each: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Per passage: the sum of the largest log odds of its words and pairs of words, and that plus the sum of the smallest.

    Odds are of documents called toxic against the others; a document is left out of its own counts.
    """
    known: dict[bytes, int] = {}
    words = [x.split() for x in p]
    size = np.fromiter(map(len, words), np.int64, len(p))
    ids = np.fromiter((known.setdefault(w, len(known)) for x in words for w in x), np.int64, int(size.sum()))
    of = np.repeat(np.arange(len(p)), size)
    pair = of[1:] == of[:-1]
    feature = np.concatenate([ids, len(known) + ids[:-1][pair] * len(known) + ids[1:][pair]])
    of = np.concatenate([of, of[:-1][pair]])
    _, feature = np.unique(feature, return_inverse=True)
    n_features = int(feature.max()) + 1 if len(feature) else 0
    doc = at[of]
    once = np.unique(doc * n_features + feature)
    t = toxic[once // n_features]
    with_t = np.bincount(once[t] % n_features, minlength=n_features)
    with_c = np.bincount(once[~t] % n_features, minlength=n_features)
    n = np.bincount(toxic.astype(int), minlength=2)
    own = toxic[doc].astype(float)
    odds = np.log((with_t[feature] - own + 0.3) / (n[1] + 1)) - np.log((with_c[feature] - 1 + own + 0.3) / (n[0] + 1))
    out = []
    for sign in (-1, 1):
        order = np.lexsort((sign * odds, of))
        o = of[order]
        start = np.searchsorted(o, np.arange(len(p)))
        rank = np.arange(len(o)) - start[o]
        keep = rank < each
        out.append(np.bincount(o[keep], weights=odds[order][keep], minlength=len(p)))
    return out[0], out[0] + out[1]


def fit_texts(texts: list[str], toxic: list[bool], sure: list[bool], rule: ToxicityRule = ToxicityRule()) -> Scorer:
    """Dictionaries and held-out margins from labelled texts. ``sure``: the raters agreed; the margins are of these where there are enough."""
    y, sure_ = np.array(toxic, bool), np.array(sure, bool)
    p, at = passages(texts)
    if not p or not y[at].any() or y[at].all():
        return Scorer(b"\n", b"\n", b"\n", rule.level)
    rng = np.random.default_rng(rule.seed)
    of_toxic = y[at]
    most, odds = _evidence(p, at, y)
    ordinary = np.flatnonzero(~of_toxic)
    high = np.quantile(odds[ordinary], rule.toxic_quantile)
    chosen = of_toxic & (odds > high)
    if not chosen.any():
        chosen = of_toxic
    # what stands out like a toxic passage in a document called clean is more often a reviewer's error than a hard case
    mild = ~of_toxic & (odds <= high)
    hard = mild & (most > np.quantile(most[ordinary], rule.hard_quantile))

    def train(chosen: np.ndarray, hard: np.ndarray, take: np.ndarray) -> tuple[bytes, bytes, bytes]:
        t, h = np.flatnonzero(chosen & take), np.flatnonzero(hard & take)
        s = rng.permutation(ordinary[take[ordinary]])
        return tuple(_dictionary([p[i] for i in x], rule.size) for x in (t, s, h))

    half = rng.integers(0, 2, len(y))[at]

    def crossed(chosen: np.ndarray, hard: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p))
        for k in (0, 1):
            if (half == k).any() and (half != k).any():
                c = tuple(_compressor(x, rule.level) for x in train(chosen, hard, half != k))
                out[half == k] = margins(c, [p[i] for i in np.flatnonzero(half == k)])
        return out

    d = crossed(chosen, hard)
    kept = chosen & (d > 2)
    chosen = kept if kept.any() else chosen
    hard |= mild & (d > np.quantile(d[ordinary], rule.mined_quantile))
    d = crossed(chosen, hard)
    best = np.full(len(y), -99.0)
    np.maximum.at(best, at, d)
    use = sure_ if (sure_ & y).sum() >= 20 and (sure_ & ~y).sum() >= 20 else np.ones(len(y), bool)
    pick = lambda k: tuple(sorted(int(x) for x in best[use & k]))
    return Scorer(*train(chosen, hard, np.ones(len(p), bool)), rule.level, pick(y), pick(~y), float(y.mean()), rule.prior_docs)


def fit_scorer(documents: DataFrame, labels: DataFrame, *, id_: str = "doc_id", text: str = "text", verdict: str = "toxic", rater: str = "rater", rule: ToxicityRule = ToxicityRule()) -> Scorer:
    """A scorer from reviewers' verdicts. Repeated rows count once, ties between raters and null verdicts are left out.

    The labelled documents that are fitted on are those with the smallest hash of their id, at most ``most_docs`` of
    either verdict; their ids are broadcast, so the documents are read once and not shuffled.
    """
    votes = labels.select(F.col(id_).alias("id"), F.col(rater).alias("rater"), F.col(verdict).alias("v")).where("id is not null and v is not null").distinct()
    per = votes.groupBy("id").agg(F.avg("v").alias("m"), F.count("*").alias("n")).where("m <> 0.5")
    per = per.select("id", (F.col("m") > 0.5).alias("toxic"), ((F.col("n") >= 2) & F.col("m").isin(0.0, 1.0)).alias("sure"))
    ranked = [per.where(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(rule.most_docs) for t in (True, False)]
    sample = ranked[0].unionByName(ranked[1])
    docs = documents.select(F.col(id_).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    rows = docs.join(F.broadcast(sample), "id").collect()  # bounded by 2 * most_docs
    rows.sort(key=lambda r: str(r["id"]))
    return fit_texts([r["text"] for r in rows], [r["toxic"] for r in rows], [r["sure"] for r in rows], rule)


def score_documents(documents: DataFrame, scorer: Scorer, *, id_: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of ``documents`` as ``(id_, source, margin, score, n_passages, n_over, flagged)``.

    The cutoff is calibrated on the margins of all these rows; score is 0 to 1, and 0.5 at the cutoff. Texts that are null
    or hold no word score 0 with a margin of null and are not flagged. Repeated rows come out as
    often as they went in. Extra columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext.broadcast(scorer)
    kind = documents.schema[id_].dataType.simpleString()

    def run(batches):
        compressors = shared.value.compressors()
        for pdf in batches:
            for k in range(0, len(pdf), 512):
                part = pdf.iloc[k : k + 512]
                p, at = passages(list(part["text"]))
                n = len(part)
                d = margins(compressors, p) if p else np.empty(0, np.int32)
                best = np.full(n, -np.inf)
                np.maximum.at(best, at, d)
                over = d > 0
                cuts = np.searchsorted(at[over], np.arange(1, n))
                yield pd.DataFrame({
                    "id": part["id"], "source": part["source"], "margin": np.where(np.isfinite(best), best, np.nan),
                    "n_passages": np.bincount(at, minlength=n), "above": np.split(d[over], cuts) if n else [],
                })

    raw = documents.select(F.col(id_).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, source string, margin double, n_passages long, above array<int>")
    raw = raw.withColumn("margin", F.when(~F.isnan("margin"), F.col("margin"))).checkpoint()
    counts = raw.where("margin is not null").groupBy("margin").agg(F.count("*").alias("n")).collect()  # a row per margin: at most the bytes of a passage
    cutoff = scorer.calibrate(np.array([r["margin"] for r in counts], float), np.array([r["n"] for r in counts], float))
    z = F.greatest(F.least(F.col("margin") - F.lit(cutoff), F.lit(60.0)), F.lit(-60.0)) / 2
    return raw.select(
        F.col("id").alias(id_), "source", "margin", F.when(F.col("margin").isNull(), 0.0).otherwise(1 / (1 + F.exp(-z))).alias("score"), "n_passages",
        F.size(F.filter("above", lambda x: x >= F.lit(cutoff))).cast("long").alias("n_over"), F.coalesce(F.col("margin") >= F.lit(cutoff), F.lit(False)).alias("flagged"),
    )


def toxicity_rates(scored: DataFrame, *, source: str = "source") -> DataFrame:
    """Per source (without case and blanks around; null as ``unknown``): documents, flagged ones, their share and the mean score."""
    s = F.coalesce(F.lower(F.trim(F.col(source))), F.lit("unknown"))
    return scored.groupBy(s.alias("source")).agg(F.count("*").alias("n_docs"), F.count_if("flagged").alias("n_flagged"), F.round(F.avg(F.col("flagged").cast("double")), 6).alias("share_flagged"), F.round(F.avg("score"), 6).alias("mean_score"))
