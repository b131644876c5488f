"""Filling containers of fixed capacity with texts.

Method: cost-balanced packing. A text of n tokens costs ``linear * n + quadratic * n^2`` (its attention doesn't look
beyond it). Texts are taken in descending order, each goes to the container of lowest cost that has room for it. A
group is given as many containers as its tokens need; texts that fit in none are packed in the same way into further ones.

Among containers of the same cost the fullest that has room is taken. With ``step`` costs are compared in steps of that share of the mean
container's cost, which trades balance for space.

Texts over the capacity are cut into pieces of just the capacity and a rest. A lane may hold any share of the texts:
lanes are divided by a hash of the text's id and piece into groups of about ``group_tokens`` tokens, which are packed apart, at
a loss of about a container each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessella.functions.tokens import DEFAULT, with_sizes
from tessella.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class PackRule:
    linear: float = 1.0
    quadratic: float = 1 / 4096
    step: float = 0.0  # of the mean container's cost; 0: the lowest cost exactly
    group_tokens: int = 2_000_000
    default_capacity: int = 2048


def pack(sizes: np.ndarray, capacity: int, rule: PackRule = PackRule()) -> np.ndarray:
    """Container of each item; no item may be over the capacity. Items of size 0 get -1."""
    out = np.full(len(sizes), -1, np.int64)
    todo = np.flatnonzero(sizes > 0)
    todo = todo[np.argsort(-sizes[todo], kind="stable")]
    cost_of = rule.linear * sizes + rule.quadratic * sizes.astype(float) ** 2
    base = 0
    while len(todo):
        k = max(1, int(np.ceil(sizes[todo].sum() / capacity)))
        room, cost = np.full(k, capacity, np.int64), np.zeros(k)
        step = rule.step * cost_of[todo].sum() / k
        rest = []
        for i in todo:
            n = sizes[i]
            # the lowest cost (or step of it), then the least room that is enough
            level = np.where(room >= n, np.floor(cost / step) if step else cost, np.inf)
            least = level.min()
            if least == np.inf:
                rest.append(i)
                continue
            j = int(np.where(level == least, room, capacity + 1).argmin())
            out[i] = base + j
            room[j] -= n
            cost[j] += cost_of[i]
        base += k
        todo = np.array(rest, np.int64)
    _, names = np.unique(out[out >= 0], return_inverse=True)
    out[out >= 0] = names
    return out


def pack_documents(documents: DataFrame, limits: DataFrame, *, id_: str = "doc_id", text: str = "text", lane: str = "lane", tokenizer: str = DEFAULT, rule: PackRule = PackRule()) -> DataFrame:
    """A row per piece of text: ``id_, lane, piece, token_start, n_tokens, capacity, has_limit, container, container_offset``.

    Lanes are compared without case and blanks around them; a null lane is the lane ``unknown``, and lanes without a
    capacity have ``default_capacity``, and ``has_limit`` is false. Texts that are null or empty come out as one piece of size 0 in no container. Repeated
    ids count once; rows without an id are left out. Extra columns are ignored; an empty table gives no rows.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    clean = documents.select(F.col(id_).alias("id"), F.coalesce(F.lower(F.trim(F.col(lane))), F.lit("unknown")).alias("lane"), F.col(text).alias("text")).where("id is not null")
    sized = with_sizes(clean, "text", ["id", "lane"], tokenizer).groupBy("id").agg(F.min_by("lane", F.struct("lane", "n_tokens")).alias("lane"), F.min_by("n_tokens", F.struct("lane", "n_tokens")).alias("n")).checkpoint()
    cap = limits.select(F.lower(F.trim("lane")).alias("lane"), F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity > 0").dropDuplicates(["lane"])
    sized = sized.join(F.broadcast(cap), "lane", "left").withColumn("has_limit", F.col("capacity").isNotNull()).withColumn("capacity", F.coalesce("capacity", F.lit(rule.default_capacity)))
    # a row per lane
    groups = sized.groupBy("lane").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / rule.group_tokens)).cast("int").alias("groups"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / F.col("capacity")).cast("int") - 1)
    pieces = sized.join(groups, "lane").select(
        "id", "lane", "capacity", "has_limit", "n", "groups", F.explode(F.sequence(F.lit(0), last)).alias("piece")
    ).withColumn("group", F.pmod(F.xxhash64("id", "piece"), F.col("groups"))).drop("groups")
    pieces = pieces.withColumn("token_start", F.col("piece") * F.col("capacity")).withColumn("n_tokens", F.least("capacity", F.col("n") - F.col("token_start"))).drop("n")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        box = pack(pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iloc[0]), rule)
        pdf["container"] = [f"{key[0]}-{key[1]}-{b}" if b >= 0 else None for b in box]
        pdf["container_offset"] = (pdf.groupby("container", dropna=False)["n_tokens"].cumsum() - pdf["n_tokens"]).astype("int64")
        return pdf[["id", "lane", "piece", "token_start", "n_tokens", "capacity", "has_limit", "container", "container_offset"]]

    kind = documents.schema[id_].dataType.simpleString()
    out = pieces.groupBy("lane", "group").applyInPandas(run, f"id {kind}, lane string, piece int, token_start long, n_tokens long, capacity long, has_limit boolean, container string, container_offset long")
    return out.withColumnRenamed("id", id_)


def utilisation(packed: DataFrame) -> DataFrame:
    """Per lane: capacity and whether the lane's own, containers, tokens, share of the capacity used, and the spread of the containers' squared sizes (attention cost)."""
    per = packed.where("container is not null").groupBy("lane", "container").agg(F.sum("n_tokens").alias("used"), F.max("capacity").alias("capacity"), F.max("has_limit").alias("has_limit"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("cost"), F.count("*").alias("pieces"))
    return per.groupBy("lane").agg(
        F.max("capacity").alias("capacity"), F.max("has_limit").alias("has_limit"), F.count("*").alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / F.sum("capacity"), 6).alias("used_share"), F.round(F.coalesce(F.stddev_pop("cost") / F.avg("cost"), F.lit(0.0)), 6).alias("cost_spread"),
    )
