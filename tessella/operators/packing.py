"""Spans of tokens: packing sequences from shards, positions, masks and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def pieces(docs: DataFrame, first: DataFrame, needed: int) -> DataFrame:
    """What sequences of ``needed`` tokens from a place ``from`` on take of a shard's documents, going round at its end.

    docs: ``shard_id, doc_id``, ``start, end`` (positions in the shard, documents laid end to end from 0); first: ``shard_id, seq_id, from``.
    Instead of walking, the shard's spans are laid out as often as a sequence may go
    round, and a sequence takes those that its interval meets: prefix sums make the walk a range join. Cells of ``needed``
    tokens keep that join an equi-join.
    """
    n = F.col("end") - F.col("start")
    size = docs.groupBy("shard_id").agg(F.max("end").alias("_size")).where("_size > 0")
    d = docs.where(n > 0).join(size, "shard_id")
    copies = F.sequence(F.lit(0), F.floor(F.lit(needed) / F.col("_size")) + 1)
    laid = d.withColumn("_k", F.explode(copies)).select("shard_id", "doc_id", "start", (F.col("start") + F.col("_k") * F.col("_size")).alias("lo"), (F.col("end") + F.col("_k") * F.col("_size")).alias("hi"))
    cell = lambda c: F.floor(c / needed)
    laid = laid.withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    first = first.withColumn("_cell", F.explode(F.array(cell(F.col("from")), cell(F.col("from")) + 1)))
    to = F.col("from") + needed
    hit = first.join(laid, ["shard_id", "_cell"]).where((F.col("lo") < to) & (F.col("hi") > F.col("from"))).dropDuplicates(["shard_id", "seq_id", "lo"])
    at, end = F.greatest("lo", "from"), F.least(F.col("hi"), to)
    token = F.col("start") + at - F.col("lo")
    return hit.select("shard_id", "seq_id", "doc_id", token.alias("token_start"), (token + end - at).alias("token_end"), (at - F.col("from")).alias("seq_start"), (end - F.col("from")).alias("seq_end"))


def pack_isolated(docs: DataFrame, draws: DataFrame, needed: int) -> DataFrame:
    """Sequences of ``needed`` tokens of whole documents, taken round from a drawn one, the last cut off.

    docs: as in :func:`pieces`, with ``doc_no`` (dense from 0); draws: ``shard_id, seq_id, doc_no``.
    """
    first = draws.join(docs.select("shard_id", "doc_no", F.col("start").alias("from")), ["shard_id", "doc_no"]).drop("doc_no")
    return pieces(docs, first, needed)


def positions(segments: DataFrame, keep: list[str]) -> DataFrame:
    """A row per token of each segment: ``pos`` in the sequence, ``token_pos`` in the shard, ``position_id`` counted anew per segment."""
    n = F.col("token_end") - F.col("token_start")
    x = segments.where(n > 0).select(*keep, "token_start", "seq_start", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("position_id"))
    return x.select(*keep, (F.col("seq_start") + F.col("position_id")).alias("pos"), (F.col("token_start") + F.col("position_id")).alias("token_pos"), "position_id")


def assemble(tokens: DataFrame, block: int) -> DataFrame:
    """Sequences from a row per token: ``seq_id, pos, token, role, seg, position_id`` -> inputs, targets, loss mask and positions.

    The target is the next token; the mask is 1 where the target's role is assistant, or everywhere in a sequence without
    roles. A sequence has ``block + 1`` tokens, which bounds its row. Needs no order of the input: the same rows give the same row.
    """
    w = W.partitionBy("seq_id").orderBy("pos")
    x = tokens.where(F.col("pos") <= block).withColumn("target", F.lead("token").over(w)).withColumn("next_role", F.lead("role").over(w))
    x = x.withColumn("roles", F.max(F.col("role").isNotNull()).over(W.partitionBy("seq_id")))
    x = x.where(F.col("target").isNotNull()).withColumn("mask", F.when(~F.col("roles") | F.col("next_role").eqNullSafe(F.lit("assistant")), 1).otherwise(0))
    s = F.array_sort(F.collect_list(F.struct("pos", "token", "target", "mask", "position_id", "seg")))
    part = lambda c: F.transform("s", lambda y: y[c])
    return x.groupBy("seq_id").agg(s.alias("s")).select("seq_id", part("token").alias("input_ids"), part("target").alias("target_ids"), part("mask").alias("loss_mask"), part("position_id").alias("position_ids"), part("seg").alias("seg_ids"))


def content_hash(assembled: DataFrame) -> DataFrame:
    """SHA-256 of a sequence's inputs, targets, mask and positions in a canonical spelling."""
    one = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return assembled.withColumn("content_hash", F.sha2(F.concat_ws("|", one("input_ids"), one("target_ids"), one("loss_mask"), one("position_ids")), 256))


def attention_pairs(n: Column) -> Column:
    """Allowed (i, j) of a segment of n tokens: causal, within it."""
    return n * (n + 1) / 2


def span_hash(segments: DataFrame, batch: str = "batch_id") -> DataFrame:
    """A batch's hash over its spans in order of place in the sequence; of a batch's bounded number of segments."""
    line = F.concat_ws(":", "shard_id", "doc_id", "token_start", "token_end", "seq_start", "seq_end")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq_start", "segment_id", line.alias("l")))), lambda x: x["l"])
    return segments.groupBy(batch).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("batch_hash"), F.min("step").alias("step"), F.min(F.lower("lane")).alias("lane"), F.count("*").alias("n_segments"))
