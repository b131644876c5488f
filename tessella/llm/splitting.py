"""Cutting spans of tokens that are longer than a limit at natural boundaries.

Method: recursive bisection. A span longer than the limit less the overlap is cut at the strongest boundary near its
middle and both halves are treated alike; then each piece but the first is extended to the left by the overlap.
Pieces are thus at most as long as the limit, cover the item, and consecutive ones share exactly the overlap.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, functions as F

BANDS = (1 / 8, 1 / 4)  # of a span's length, on either side of its middle
HOT = 1000  # oversized items of a document, from which its turns are sent to several tasks


def _halvings(length: int, most: int) -> int:
    """Pieces that halving makes of a length."""
    return 1 << max(0, -(-length // most) - 1).bit_length()


def cut_span(start: int, end: int, bounds: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    """Pieces ``(piece_start, piece_end, core_start, at_boundary)`` of [start, end).

    ``bounds``: (position, strength) in order of position. A cut leaves at least the overlap on its left, so that the
    next piece can reach back. The strongest boundary (then the nearest to the middle) in the narrowest of the bands about the
    middle that has one is taken; outside of the bands the nearest one, if halving what it leaves makes no more pieces than a cut
    in the middle does. Where there is none the cut is in the middle.
    A limit under 1 counts as 1, an overlap that isn't under the limit as limit less 1.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if end - start <= limit:
        return [(start, end, start, False)]
    most = limit - overlap
    at = [b[0] for b in bounds]
    cores: list[tuple[int, int, bool]] = []
    stack = [(start, end, False)]
    while stack:
        lo, hi, natural = stack.pop()
        # the first piece has no overlap to carry and may be as long as the limit
        if hi - lo <= (most if lo > start else limit):
            cores.append((lo, hi, natural))
            continue
        low, high = max(lo + 1, start + max(overlap, 1)), hi - 1
        mid = min(max((lo + hi) // 2, low), high)
        i, j = bisect.bisect_left(at, low), bisect.bisect_right(at, high)
        best = None
        for band in BANDS:
            reach = band * (hi - lo)
            a, b = max(i, bisect.bisect_left(at, mid - reach)), min(j, bisect.bisect_right(at, mid + reach))
            if a < b:
                best = min((-bounds[k][1], abs(at[k] - mid), at[k]) for k in range(a, b))
                break
        if best is None and i < j:
            k = bisect.bisect_left(at, mid, i, j)
            far = min((abs(at[x] - mid), at[x]) for x in (k - 1, k) if i <= x < j)[1]
            if _halvings(far - lo, most) + _halvings(hi - far, most) <= _halvings(mid - lo, most) + _halvings(hi - mid, most):
                best = (0, 0, far)
        cut = best[2] if best else mid
        stack.append((cut, hi, best is not None))
        stack.append((lo, cut, natural))
    cores.sort()
    return [(lo - overlap if lo > start else lo, hi, lo, natural) for lo, hi, natural in cores]


def _cut(batches):
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            bounds = sorted({(int(b["p"]), int(b["s"])) for b in (r.bounds if r.bounds is not None else [])})
            seen: dict[int, int] = {}
            for p, s in bounds:
                seen[p] = max(s, seen.get(p, 0))
            for n, (a, b, core, natural) in enumerate(cut_span(int(r.lo), int(r.hi), sorted(seen.items()), int(r.max_tokens), int(r.overlap_tokens))):
                out.append((r.kind, r.item_id, n, a, b, core, natural))
        yield pd.DataFrame(out, columns=["kind", "item_id", "piece", "piece_start", "piece_end", "core_start", "at_turn"])


def oversized(segments: DataFrame, shards: DataFrame, limits: DataFrame) -> DataFrame:
    """The items that are to be cut, each once: ``kind, item_id, lane, lo, hi, doc_id, max_tokens, overlap_tokens``."""
    clean = lambda c: F.lower(F.trim(F.col(c)))
    lim = limits.select(clean("lane").alias("lane"), F.col("max_tokens").cast("long").alias("max_tokens"), F.coalesce(F.col("overlap_tokens").cast("long"), F.lit(0)).alias("overlap_tokens")).where("lane is not null and max_tokens is not null").dropDuplicates(["lane"])
    items = segments.select(F.lit("segment").alias("kind"), F.col("segment_id").alias("item_id"), clean("lane").alias("lane"), F.col("token_start").alias("lo"), F.col("token_end").alias("hi"), "doc_id").unionByName(
        shards.select(F.lit("document").alias("kind"), F.col("doc_id").alias("item_id"), clean("lane").alias("lane"), F.col("token_start").alias("lo"), F.col("token_end").alias("hi"), "doc_id")
    )
    return items.where("item_id is not null").join(F.broadcast(lim), "lane").where(F.col("hi") - F.col("lo") > F.col("max_tokens")).dropDuplicates(["kind", "item_id"])


def split_oversized(segments: DataFrame, shards: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every segment and shard document that is longer than ``max_tokens`` of its lane.

    Columns: ``kind`` (segment or document), ``item_id``, ``piece``, ``piece_start``, ``piece_end`` (positions in the
    shard), ``core_start`` (where the cut is), ``at_turn`` (whether the cut is at a turn's start).

    Lanes are compared without case and blanks around them; an item whose lane is null or has no limit isn't cut. Items
    with a null or reversed bound, or a null id, are left out. Repeated rows count once. Turns without a start, of no length or
    outside the item are no boundaries; turns of the user are the stronger ones. Extra columns are ignored; empty
    tables give no rows. A null overlap counts as none.

    Only oversized items are joined with turns, and only documents that such items use are sent. A document may be used by any
    number of segments: one that more than ``HOT`` of them use (more, where a 65,536th of them is more, which bounds the table of such
    documents) is sent in several copies, each for a part of its items. ``limits`` holds a row per lane; it is broadcast as a table of fixed size.
    """
    long = oversized(segments, shards, limits)
    turn = F.filter("turns", lambda t: t["start"].isNotNull() & (t["stop"].isNull() | (t["stop"] > t["start"])) & (t["start"] > 0))
    bounds = F.transform(turn, lambda t: F.struct((F.col("token_start") + t["start"]).alias("p"), F.when(t["role"] == "user", 2).otherwise(1).alias("s")))
    docs = shards.where("doc_id is not null and turns is not null and token_start is not null").select("doc_id", bounds.alias("bounds")).dropDuplicates(["doc_id"])
    uses = long.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    hot = max(HOT, long.count() // 65_536)
    copies = F.ceil(F.col("n") / hot).cast("int")
    few = F.broadcast(uses.where(F.col("n") > hot).select("doc_id", copies.alias("copies")))
    sent = docs.join(uses, "doc_id").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("n")
    salt = F.pmod(F.hash("item_id"), F.coalesce("copies", F.lit(1)))
    joined = long.join(few, "doc_id", "left").withColumn("salt", salt).join(sent, ["doc_id", "salt"], "left")
    inside = F.filter("bounds", lambda b: (b["p"] > F.col("lo")) & (b["p"] < F.col("hi")))
    ready = joined.select("kind", "item_id", "lo", "hi", "max_tokens", "overlap_tokens", inside.alias("bounds"))
    return ready.mapInPandas(_cut, "kind string, item_id string, piece int, piece_start long, piece_end long, core_start long, at_turn boolean")


def piece_checks(pieces: DataFrame, items: DataFrame) -> DataFrame:
    """Per item of :func:`oversized` whether its pieces are within the limit, cover it from end to end in order, and share just the overlap: ``kind, item_id, within, covers, overlaps``."""
    p = pieces.groupBy("kind", "item_id").agg(F.array_sort(F.collect_list(F.struct("piece", "piece_start", "piece_end", "core_start"))).alias("p"))
    x = items.join(p, ["kind", "item_id"], "left")
    most = F.greatest(F.col("max_tokens"), F.lit(1))
    share = F.least("overlap_tokens", most - 1)
    within = F.forall("p", lambda q: (q["piece_end"] > q["piece_start"]) & (q["piece_end"] - q["piece_start"] <= most))
    steps = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda a, b: (a["piece_end"] == b["core_start"]) & (a["piece_end"] - b["piece_start"] == share))
    covers = (F.element_at("p", 1)["piece_start"] == F.col("lo")) & (F.element_at("p", -1)["piece_end"] == F.col("hi")) & (F.size("p") > 1)
    no = lambda c: F.coalesce(c, F.lit(False))
    return x.select("kind", "item_id", no(within).alias("within"), no(covers).alias("covers"), no(F.forall(steps, lambda s: s)).alias("overlaps"))
