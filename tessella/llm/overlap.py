"""Cross-split overlap: the same or nearly the same record in an evaluation and a training split.

Method: an exact prefix-filter join between the two sides on shingles of five words. The evaluation side is
indexed by the rarest shingles of each record, the training side probes with its shingles (and the other way round
where the training record is the smaller one); candidates that pass the length and position filters are verified by
their overlap, which must reach 0.8 of the smaller record.

Details, in the order of the plan:

* Records are folded (case, entities, invisible characters, accents, look-alikes, escaped line ends); words are runs
  of letters. Records whose words are the same form one class; of records under ``short`` words the numbers count
  too; texts without a letter are compared as they are, but for layout. ``full`` tells the records of a class apart by
  their numbers. Everything up to the last step works on one row per class and side, so groups of copies cost nothing.
* Training shingles that occur in no evaluation record can't match. They are left out before any shuffle by a bit
  filter over all evaluation shingles of at most ``filter_bits`` bits. Shingles of both sides are counted; a filter for
  those that both sides have, and one for each of the ``steps`` of frequency, are sent to the workers, which order the
  shingles of a record by them, the rarest step first and by hash within a step, without a shuffle. A wrong yes of a
  filter is the same for all records, so the order is one order; filters that are too small cost time, not pairs.
* Of a record with N shingles ``ceil(0.8 N)`` must be found. If M of its shingles pass the filter, the first
  ``M - ceil(0.8 N) + 1`` in that order hold one match; a record with M below ``ceil(0.8 N)`` is in no larger one.
* Length filter: the other record has at least as many shingles, and at least ``ceil(0.8 N)`` that pass the filter.
  Position filter: a first hit at positions p of M and q of the other's L leaves room for 1 + min(M - p - 1, L - q - 1).
* A shingle that more than ``heavy`` classes have (more, where a 65,536th of all shingles is more, which bounds the table
  that is sent) is split: the probing rows are spread over parts, the indexed ones are repeated for each part.
* Of a pair that shares all but one block of more than ``2 words`` shingles at the head or tail of the smaller record, that
  block is what the record states, and the rest a notice: it is no case. The rule looks at the pair alone, so a
  pair's verdict doesn't depend on the other records.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.text import NUMBER, TOKEN, WORD, fold
from tessella.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class OverlapRule:
    words: int = 5
    share: float = 0.8  # of the smaller record's shingles
    short: int = 24  # records under so many words match as they are, or stand whole inside another one
    steps: tuple[int, ...] = (4, 16, 128)  # classes that have a shingle, from which it is of the next step
    heavy: int = 1000
    small: int = 500_000  # hashes of 8 bytes up to which a set of classes is broadcast as a table
    filter_bits: int = 1 << 28
    evaluation: tuple[str, ...] = ("eval", "valid", "heldout")
    training: tuple[str, ...] = ("code", "prose")


_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


_SPACES = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))


class _Words(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@dataclass
class Sketch:
    sig: bytes | None  # class; None: blank
    full: bytes | None  # with the numbers
    n_words: int
    shingles: np.ndarray  # distinct, in order of their first place in the text, signed 64-bit hashes
    tokens: list[int] | None  # words and numbers in order, of short records


class Shingler:
    """What is kept of a text. Keeps word hashes between calls, up to a bound."""

    def __init__(self, rule: OverlapRule):
        self.rule, self.known = rule, _Words()

    def __call__(self, text: str) -> Sketch:
        folded = fold(text)
        plain = folded.isascii()
        words = folded.encode().translate(_SPACES).split() if plain else [w.encode() for w in WORD.findall(folded)]
        numbers = NUMBER.findall(folded)
        if len(self.known) > 500_000:
            self.known.clear()
        ids = np.array(list(map(self.known.__getitem__, words)), np.uint64)
        k = min(self.rule.words, len(ids))
        if k == 0:  # numbers or symbols only: one class per text, but for layout
            shown = " ".join(folded.split())
            key = xxhash.xxh3_128_digest(b"#" + shown.encode("utf-8", "replace")) if shown else None
            return Sketch(key, key, 0, np.empty(0, np.int64), None)
        short = len(words) < self.rule.short
        full = xxhash.xxh3_128_digest(ids.tobytes() + b"|" + "|".join(numbers).encode())
        n = len(ids) - k + 1
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h += ids[j : j + n] * _MULT[j % 5] + np.uint64(j)
        h = _mix(h).view(np.int64)
        _, first = np.unique(h, return_index=True)
        tokens = [xxhash.xxh3_64_intdigest(t.encode()) >> 1 for t in TOKEN.findall(folded)] if short else None
        return Sketch(full if short else xxhash.xxh3_128_digest(ids.tobytes()), full, len(words), h[np.sort(first)], tokens)


PAGE = 32_768  # bits of a page of the filter


def _places(u: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Page of each shingle and its two bits in it."""
    return ((u >> np.uint64(1)) % np.uint64(pages)).astype(np.int64), ((u >> np.uint64(28)) & np.uint64(PAGE - 1)).astype(np.int64), ((u >> np.uint64(46)) & np.uint64(PAGE - 1)).astype(np.int64)


def _passes(table: np.ndarray, s: np.ndarray) -> np.ndarray:
    pages = len(table) * 8 // PAGE
    page, a, b = _places(s.view(np.uint64), pages)
    at = page * (PAGE // 8)
    return ((table[at + (a >> 3)] >> (a & 7).astype(np.uint8)) & (table[at + (b >> 3)] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _lists(flat: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind))


def _flat(lists: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists, and the list of each."""
    if not len(lists):
        return np.empty(0, kind), np.empty(0, np.int64)
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(kind, copy=False), np.repeat(np.arange(len(lists)), np.diff(offsets))


SKETCH = "sig binary, full binary, n_words int, n int, s array<long>, at array<int>, tokens array<long>"


def _sketch(rule: OverlapRule, table=None):
    """Row per record: class, number of words and of shingles, those shingles that pass the filter and their places among all."""

    def run(batches):
        shingle = Shingler(rule)
        t = table.value if table is not None else None
        for batch in batches:
            got = [shingle(x) for x in batch.column("text").to_pylist()]
            sizes = np.array([len(g.shingles) for g in got], np.int64)
            values = np.concatenate([g.shingles for g in got]) if got else np.empty(0, np.int64)
            at = np.concatenate([np.arange(k) for k in sizes]) if got else np.empty(0, np.int64)
            if t is not None and len(values):
                keep = _passes(t, values)
                left = np.bincount(np.repeat(np.arange(len(got)), sizes)[keep], minlength=len(got))
                values, at = values[keep], at[keep]
            else:
                left = sizes
            new = [pa.array([g.sig for g in got], pa.binary()), pa.array([g.full for g in got], pa.binary()), pa.array([g.n_words for g in got], pa.int32()), pa.array(sizes, pa.int32())]
            new += [_lists(values, left, pa.int64()), _lists(at, left, pa.int32()), pa.array([g.tokens for g in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "lane", "source")], *new], ["id", "lane", "source", "sig", "full", "n_words", "n", "s", "at", "tokens"])

    return run


def _order(tables):
    """Rows of classes with the shingles that both sides have in the common order: by steps of frequency, then by hash."""

    def run(batches):
        both, *steps = tables.value
        for batch in batches:
            h, of = _flat(batch.column("s"), np.int64)
            at, _ = _flat(batch.column("at"), np.int32)
            keep = _passes(both, h) if len(h) else np.zeros(0, bool)
            h, of, at = h[keep], of[keep], at[keep]
            step = np.zeros(len(h), np.int8)
            for t in steps:
                step += _passes(t, h) if len(h) else step
            order = np.lexsort((h, step, of))
            sizes = np.bincount(of, minlength=batch.num_rows)
            new = {"s": _lists(h[order], sizes, pa.int64()), "at": _lists(at[order], sizes, pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return run


def _tally(pages: int, most: int = 4_000_000):
    """Shingles of classes with their page and number, counted within a task over up to ``most`` at a time."""

    def counted(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        page, _, _ = _places(h.view(np.uint64), pages)
        for i in range(0, len(h), 65_536):
            cut = slice(i, i + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array(page[cut]), pa.array(h[cut]), pa.array(n[cut].astype(np.int64))], ["page", "h", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            h, _ = _flat(batch.column("s"), np.int64)
            held.append(h)
            size += len(h)
            if size > most:
                yield from counted(held)
                held, size = [], 0
        if size:
            yield from counted(held)

    return run


def _probe(table):
    """Shingles of classes that a prefix has, with their positions in the common order: a row per shingle."""

    def run(batches):
        t = table.value
        for batch in batches:
            h, of = _flat(batch.column("s"), np.int64)
            sizes = np.bincount(of, minlength=batch.num_rows)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(_passes(t, h)) if len(h) else np.empty(0, np.int64)
            row = pa.array(of[keep])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in ("side", "sig", "n")], pa.array(sizes[of[keep]], pa.int32()), pa.array(pos[keep], pa.int32()), pa.array(h[keep])], ["side_large", "sig_large", "n_large", "m_large", "pos_large", "h"])

    return run


def _verify(rule: OverlapRule):
    """Of candidates those that are a case, with their overlap."""

    def run(batches):
        for batch in batches:
            overlap, keep = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, bool)
            small, large, at = batch.column("s"), batch.column("s_large"), batch.column("at")
            n, words, words_large = (batch.column(c).to_numpy() for c in ("n", "n_words", "n_words_large"))
            for i in range(batch.num_rows):
                shared = np.isin(small[i].values.to_numpy(zero_copy_only=False), large[i].values.to_numpy(zero_copy_only=False))
                overlap[i] = o = shared.sum()
                if o < np.ceil(n[i] * rule.share - 1e-9):
                    continue
                if min(words[i], words_large[i]) >= rule.short:
                    place = at[i].values.to_numpy(zero_copy_only=False)[shared]
                    one_block = place.max() == o - 1 or place.min() == n[i] - o
                    keep[i] = not (one_block and n[i] - o > 2 * rule.words)
                elif max(words[i], words_large[i]) >= rule.short:
                    keep[i] = o == n[i]
                elif o == n[i]:
                    inner, outer = (" ".join(map(str, batch.column(c)[i].as_py())) for c in ("tokens", "tokens_large"))
                    keep[i] = f" {inner} " in f" {outer} "
            cols = {c: batch.column(c) for c in ("side", "sig", "sig_large", "n", "n_large")} | {"overlap": pa.array(overlap)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols)).filter(pa.array(keep))

    return run


def _pages(n: int, most_bits: int) -> int:
    """Pages of a filter for n shingles: 12 bits each, up to ``most_bits``."""
    return max(31, min(most_bits // PAGE, 12 * n // PAGE + 1))


def _paged(shingles: DataFrame, pages: int, width: int) -> DataFrame:
    """Shingles ``h`` distributed by their page, so that counts, joins and filters on them need no further shuffle."""
    return shingles.withColumn("page", F.shiftrightunsigned("h", 1) % pages).repartition(width, "page")


@contextmanager
def _joined_in_place(spark):
    """Lets a join on (page, h) use the distribution by page that both sides have. For plans that are made and run inside."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _filters_of(paged: DataFrame, pages: int, steps: dict[str, str] | None = None) -> list[np.ndarray]:
    """The bits of shingles distributed by page; a page is made where its shingles are. ``steps``: a filter for each of these conditions, too."""
    two = F.explode(F.array(F.shiftrightunsigned("h", 28).bitwiseAND(PAGE - 1), F.shiftrightunsigned("h", 46).bitwiseAND(PAGE - 1)))
    names = {"bits": "true", **(steps or {})}
    made = paged.withColumn("p", two).groupBy("page").agg(*[F.expr(f"bitmap_construct_agg(p) filter (where {c})").alias(k) for k, c in names.items()])
    tables = [np.zeros(pages * PAGE // 8, np.uint8) for _ in names]
    for row in made.collect():  # 4 KB a page and filter
        for t, bits in zip(tables, row[1:]):
            if bits is not None:
                t[row["page"] * PAGE // 8 : (row["page"] + 1) * PAGE // 8] = np.frombuffer(bits, np.uint8)
    return tables


def _among(x: DataFrame, key: Column, hashes: DataFrame, rule: OverlapRule) -> tuple[DataFrame, DataFrame]:
    """Rows of x whose ``key`` is among ``h`` of a table, and the others. Up to ``small`` hashes are joined, more go into a bit filter, which lets some more in."""
    n = hashes.count()
    if n <= rule.small:
        table = F.broadcast(hashes.select(F.col("h").alias("_h")))
        return x.join(table, key == F.col("_h"), "left_semi"), x.join(table, key == F.col("_h"), "left_anti")
    pages = _pages(n, rule.filter_bits)
    bits = hashes.sparkSession.sparkContext.broadcast(_filters_of(_paged(hashes, pages, 1 + n // 300_000), pages)[0])
    passes = F.pandas_udf(lambda h: pd.Series(_passes(bits.value, h.to_numpy(np.int64))), "boolean")(key)
    return x.where(passes), x.where(~passes)


def overlap_classes(df: DataFrame, *, id_: str = "doc_id", text: str = "text", lane: str = "lane", source: str = "source", rule: OverlapRule = OverlapRule()) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: the class of each record that takes part, and the linked classes of the two sides.

    members: ``id_, side ('e' or 't'), lane, source, sig, full``; links: ``sig_e, sig_t, overlap, n_e, n_t, exact``
    (``exact``: some record of either class has the same words and numbers).

    Records without lane, id or text, and blank texts, take no part; repeated rows count once; a null source
    is kept. Lanes are compared without case and blanks around them. Empty tables give no rows. Extra columns are ignored.
    A record of less than ``words`` words matches as it is only.
    """
    spark = df.sparkSession
    share = spark.sparkContext.broadcast
    ensure_checkpoint_dir(spark)
    clean = F.lower(F.trim(F.col(lane)))
    base = df.select(F.col(id_).alias("id"), clean.alias("lane"), F.col(source).alias("source"), F.col(text).alias("text")).where("id is not null and text is not null")
    schema = f"id {base.schema['id'].dataType.simpleString()}, lane string, source string, {SKETCH}"
    held: list[DataFrame] = []

    def kept(x: DataFrame) -> DataFrame:
        held.append(x.persist(StorageLevel.MEMORY_AND_DISK))
        return x

    def classes(side: str, lanes: tuple[str, ...], table=None) -> tuple[DataFrame, DataFrame]:
        rows = kept(base.where(F.col("lane").isin(*lanes)).mapInArrow(_sketch(rule, table), schema).where("sig is not null"))
        # only the rows of classes with several records are moved to find one of each
        again = rows.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select(F.xxhash64("sig").alias("h")).checkpoint()
        of_class = ("sig", "n_words", "n", "s", "at", "tokens")
        several, single = _among(rows.select(*of_class), F.xxhash64("sig"), again, rule)
        one = several.groupBy("sig").agg(*[F.first(c).alias(c) for c in of_class[1:]]).unionByName(single).coalesce(max(1, base.rdd.getNumPartitions()))
        return rows.select("id", F.lit(side).alias("side"), "lane", "source", "sig", "full"), kept(one.select(F.lit(side).alias("side"), "*"))

    # evaluation side: classes, frequencies, filter
    me, ce = classes("e", rule.evaluation)
    n_shingles = ce.agg(F.sum(F.size("s"))).first()[0] or 0
    pages, width = _pages(n_shingles, rule.filter_bits), 1 + n_shingles // 300_000
    tally = lambda c, name: c.select("s").mapInArrow(_tally(pages), "page long, h long, n long").repartition(width, "page").groupBy("page", "h").agg(F.sum("n").alias(name))
    counts_e = kept(tally(ce, "e"))
    table_e = share(_filters_of(counts_e, pages)[0])
    # training side: only what the evaluation side has
    mt, ct = classes("t", rule.training, table_e)
    with _joined_in_place(spark):
        counts = kept(counts_e.hint("shuffle_hash").join(tally(ct, "t"), ["page", "h"]).select("page", "h", (F.col("e") + F.col("t")).alias("df")))
        tables = share(_filters_of(counts, pages, {f"step{k}": f"df >= {k}" for k in rule.steps}))
    members = me.unionByName(mt).distinct().checkpoint()
    table_e.unpersist()  # sent again if lost parts have to be made again

    found = kept(ce.unionByName(ct).mapInArrow(_order(tables), f"side string, {SKETCH.replace('full binary, ', '')}").where("size(s) > 0").withColumn("need", F.ceil(F.col("n") * rule.share - 1e-9).cast("int")))
    m = F.size("s")
    prefix = found.where(m >= F.col("need")).select("side", "sig", "n", "need", m.alias("m"), F.posexplode(F.slice("s", F.lit(1), m - F.col("need") + 1)).alias("pos", "h"))
    few = _pages(prefix.count(), rule.filter_bits)
    probed = share(_filters_of(_paged(prefix.select("h"), few, width), few)[0])
    tables.unpersist()
    others = found.select("side", "sig", "n", "s").mapInArrow(_probe(probed), "side_large string, sig_large binary, n_large int, m_large int, pos_large int, h long")
    # a heavy shingle's probing rows are spread over parts; there are at most 65,536 heavy ones
    limit = max(rule.heavy, (counts.agg(F.sum("df")).first()[0] or 0) // 65_536)
    heavy = F.broadcast(counts.where(F.col("df") > limit).select("h", F.ceil(F.col("df") / limit).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    index = prefix.join(heavy, "h", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    probes = others.join(heavy, "h", "left").withColumn("part", F.pmod(F.xxhash64("sig_large"), parts).cast("int")).drop("parts")
    room = F.least(F.col("m") - F.col("pos"), F.col("m_large") - F.col("pos_large"))  # the hit and what follows it on either side
    hit = index.join(probes, ["h", "part"]).where((F.col("side") != F.col("side_large")) & (F.col("sig") != F.col("sig_large")) & (F.col("n") <= F.col("n_large")) & (F.col("m_large") >= F.col("need")) & (room >= F.col("need")))
    pairs = hit.select("side", "sig", "sig_large").distinct().checkpoint()

    # the shingles of those that are in a pair
    known = pairs.select(F.explode(F.array(F.xxhash64("sig"), F.xxhash64("sig_large"))).alias("h")).distinct().checkpoint()
    some = _among(found, F.xxhash64("sig"), known, rule)[0].select("side", "sig", "n", "n_words", "s", "at", "tokens")
    large = some.select(F.when(F.col("side") == "e", "t").otherwise("e").alias("side"), *[F.col(c).alias(f"{c}_large") for c in ("sig", "n", "n_words", "s", "tokens")])
    near = pairs.join(some, ["side", "sig"]).join(large, ["side", "sig_large"]).mapInArrow(_verify(rule), "side string, sig binary, sig_large binary, n int, n_large int, overlap int")
    e_small = F.col("side") == "e"
    either = lambda c: (F.when(e_small, F.col(c)).otherwise(F.col(f"{c}_large")).alias(f"{c}_e"), F.when(e_small, F.col(f"{c}_large")).otherwise(F.col(c)).alias(f"{c}_t"))
    near = near.select(*either("sig"), "overlap", *either("n")).dropDuplicates(["sig_e", "sig_t"]).withColumn("exact", F.lit(False))
    same = ce.select(F.col("sig").alias("sig_e"), F.col("n").alias("n_e")).join(ct.select(F.col("sig").alias("sig_t"), F.col("n").alias("n_t")), F.col("sig_e") == F.col("sig_t"))
    sides = [members.where(F.col("side") == x).select("sig", "full").distinct() for x in "et"]
    equal = sides[0].join(sides[1], ["sig", "full"]).select(F.col("sig").alias("sig_e")).distinct().withColumn("exact", F.lit(True))
    same = same.join(equal, "sig_e", "left").select("sig_e", "sig_t", F.col("n_e").alias("overlap"), "n_e", "n_t", F.coalesce("exact", F.lit(False)).alias("exact"))
    links = near.unionByName(same).checkpoint()
    for x in held:
        x.unpersist()
    return members.withColumnRenamed("id", id_), links


def overlap_pairs(df: DataFrame, *, id_: str = "doc_id", slice_: int = 5000, **args) -> DataFrame:
    """Each linked pair of one evaluation and one training record once: ``(id_a, id_b)`` in order of the ids.

    Classes of more than ``slice_`` members are written out slice by slice on either side.
    """
    members, links = overlap_classes(df, id_=id_, **args)
    out, slices = links.select("sig_e", "sig_t"), {}
    for side in "et":
        linked = links.select(F.col(f"sig_{side}").alias("sig")).distinct()
        m = members.where(F.col("side") == side).select("sig", F.col(id_).alias(side)).join(linked, "sig", "left_semi").distinct()
        sizes = m.groupBy("sig").agg(F.ceil(F.count("*") / slice_).cast("int").alias("slices"))
        # the number of slices comes to every member by a join on the class, whose large side AQE may split
        slices[side] = m.join(sizes, "sig").select(F.col("sig").alias(f"sig_{side}"), F.pmod(F.xxhash64(side), "slices").cast("int").alias(f"k_{side}"), side)
        out = out.join(sizes.withColumnRenamed("sig", f"sig_{side}"), f"sig_{side}").withColumn(f"k_{side}", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    for side in "et":
        out = out.join(slices[side], [f"sig_{side}", f"k_{side}"])
    out = out.where("e <> t")
    return out.select(F.least("e", "t").alias(f"{id_}_a"), F.greatest("e", "t").alias(f"{id_}_b")).distinct()


def overlap_report(df: DataFrame, *, id_: str = "doc_id", **args) -> DataFrame:
    """Per evaluation lane and source: records, records with an overlap (exact: the same words and numbers; near: all others), and linked classes of training records."""
    members, links = overlap_classes(df, id_=id_, **args)
    per = links.groupBy(F.col("sig_e").alias("sig")).agg(F.count("*").alias("links"))
    e = members.where("side = 'e'").withColumn("source", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")))
    e = e.groupBy("lane", "source", "sig", "full").agg(F.countDistinct(id_).alias("k"))
    equal = members.where("side = 't'").select("full").distinct().withColumn("exact", F.lit(True))
    joined = e.join(per, "sig", "left").join(equal, "full", "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    linked = F.col("links").isNotNull()
    return joined.groupBy("lane", "source").agg(
        F.sum("k").alias("n_records"), total(linked).alias("n_overlapping"), total(linked & F.col("exact")).alias("n_exact"), total(linked & ~F.col("exact")).alias("n_near"),
        F.coalesce(F.sum(F.col("links") * F.col("k")), F.lit(0)).alias("n_links"),
    )
