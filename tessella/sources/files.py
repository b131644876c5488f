"""File formats besides Parquet: JSON, JSON lines, delimited text, raw token shards, logs, manifests."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.utils import AnalysisException

from tessella.operators.series import running_totals
from tessella.session import scratch  # noqa: F401
from tessella.sources.token_files import SCHEMA, TokenFiles


def read_parquet_glob(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """All files of a folder whose names match; with the file's name in ``file``."""
    return spark.read.option("pathGlobFilter", glob).parquet(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One array of objects per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, lines that can't be read too."""
    text = spark.read.text(path).where(F.trim("value") != "")
    return text.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def read_delimited(spark: SparkSession, path: str, mark: str = "<|endoftext|>", drop_last: bool = True) -> DataFrame:
    """Texts between marks, stripped and without empty ones, with ``file`` and ``n``; the last (cut off) one of a file is dropped.

    The mark is the reader's line separator, so a file is read in splits.
    """
    text = F.regexp_replace("value", "^\\s+|\\s+\\z", "").alias("text")
    t = spark.read.option("lineSep", mark).text(path).select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i")).alias("k"), text)
    if drop_last:  # the last that isn't empty, in the file's last split
        last = t.where("text <> ''").groupBy("path").agg(F.max("k").alias("last"))
        t = t.join(last, "path").where(F.col("k") < F.col("last"))
    return t.where("text <> ''").select(F.element_at(F.split("path", "/"), -1).alias("file"), "k.i", "text").withColumnRenamed("i", "k")


MANIFEST = "shard string, path string, n_tokens long, sha256 string"


def laid_out(df: DataFrame, shard: str, order: str, tokens: str) -> DataFrame:
    """Rows ``s, o, t, start``: documents laid end to end per shard in order of ``order``; ``start`` is a document's place. Null tokens are left out."""
    x = df.where(F.col(tokens).isNotNull()).select(F.col(shard).cast("string").alias("s"), F.col(order).alias("o"), F.col(tokens).alias("t"))
    return running_totals(x, ["s"], ["o"], {"start": F.size("t")}).drop("pos")


def slices(laid: DataFrame, part: int) -> DataFrame:
    """Documents cut at the bounds of files of ``part`` tokens: ``s, part, o, place`` (in the file), ``first`` (in the document), ``n``."""
    n = F.size("t")
    x = laid.select("s", "o", "t", "start", F.explode(F.sequence(F.floor(F.col("start") / part), F.floor((F.col("start") + F.greatest(n - 1, F.lit(0))) / part))).alias("part"))
    lo, hi = F.greatest("start", F.col("part") * part), F.least(F.col("start") + n, (F.col("part") + 1) * part)
    return x.select("s", "part", "o", (lo - F.col("part") * part).alias("place"), (lo - F.col("start")).alias("first"), F.greatest(hi - lo, F.lit(0)).alias("n"), "t")


def file_stem(s: Column, part: Column) -> Column:
    """Name of a file: the shard's for the first part, with the part's number for the others."""
    return F.when(part == 0, s).otherwise(F.format_string("%s.%05d", s, part))


def write_laid_out(laid: DataFrame, folder: str, dtype: str = "<i4", part: int = 1 << 24) -> DataFrame:
    """Flat little-endian token files and a manifest row each: ``shard, path, n_tokens, sha256``.

    A shard is cut into files of ``part`` tokens, so no task holds more than one of them; the first has the shard's name.
    """
    spark = laid.sparkSession
    spark.dataSource.register(TokenFiles)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        flat = [np.asarray(t, dtype=dtype) for t in pdf["t"]]
        return pd.DataFrame({"shard": [pdf["name"].iloc[0]], "data": [np.concatenate(flat).astype(dtype).tobytes() if flat else b""]})

    x = slices(laid, part).select(file_stem(F.col("s"), F.col("part")).alias("name"), "place", F.slice("t", (F.col("first") + 1).cast("int"), F.col("n").cast("int")).alias("t"))
    files = x.groupBy("name").applyInPandas(run, SCHEMA)
    files.write.format("token_files").mode("append").option("width", np.dtype(dtype).itemsize).save(folder)
    return spark.read.schema(MANIFEST).json(f"{folder.rstrip('/')}-manifest")


def write_tokens(df: DataFrame, folder: str, shard: str, order: str, tokens: str, dtype: str = "<i4", part: int = 1 << 24) -> DataFrame:
    """Token files of the documents of ``df``; see :func:`write_laid_out`."""
    return write_laid_out(laid_out(df, shard, order, tokens), folder, dtype, part)


def read_documents(laid: DataFrame, folder: str, dtype: str = "<i4", part: int = 1 << 24) -> DataFrame:
    """``s, o, tokens`` read back from token files by the spans of their documents. A file meets the list of its own spans, so it is read once."""
    kind = laid.schema["o"].dataType.simpleString()
    spans = slices(laid, part).select(file_stem(F.col("s"), F.col("part")).alias("name"), "s", "o", "place", "first", "n").groupBy("name").agg(F.first("s").alias("s"), F.collect_list(F.struct("o", "place", "first", "n")).alias("spans"))
    files = laid.sparkSession.read.format("binaryFile").load(folder).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.bin$", "").alias("name"), "content")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                flat = np.frombuffer(r.content, dtype=dtype)
                yield pd.DataFrame([(r.s, x["o"], x["first"], flat[x["place"] : x["place"] + x["n"]].astype(np.int32)) for x in r.spans], columns=["s", "o", "first", "t"])

    cut = files.join(spans, "name").select("s", "spans", "content").mapInPandas(run, f"s string, o {kind}, first long, t array<int>")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "t"))), lambda x: x["t"]))
    return cut.groupBy("s", "o").agg(whole.alias("tokens"))


def read_tokens(spark: SparkSession, path: str, dtype: str = "<i4") -> DataFrame:
    """Token files as ``file, tokens, sha256``; unsigned 16-bit tokens become ints."""

    @F.pandas_udf("array<int>")
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: np.frombuffer(x, dtype=dtype).astype(np.int32))

    x = spark.read.format("binaryFile").load(path)
    return x.select(F.element_at(F.split("path", "/"), -1).alias("file"), decode("content").alias("tokens"), F.sha2("content", 256).alias("sha256"))


def file_digests(spark: SparkSession, path: str, keep: list[str] | None = None) -> DataFrame:
    """Name, size and SHA-256 of files; ``keep``: partition columns of the folder."""
    x = spark.read.format("binaryFile").load(path)
    return x.select(*(keep or []), F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def verify_shards(manifest: DataFrame, live: DataFrame, tokenizer: str) -> DataFrame:
    """Verdict per shard of the manifest: missing, content mismatch, tokenizer mismatch or ok, in this order.

    The reader doesn't list files of no length, so an empty shard counts as present.
    """
    l = live.select(F.regexp_replace("file", "\\.bin$", "").alias("_shard"), F.col("sha256").alias("_sha"))
    v = F.when(F.col("_shard").isNull() & (F.col("sha256") != F.sha2(F.lit("").cast("binary"), 256)), "missing").when(F.col("sha256") != F.col("_sha"), "content mismatch").when(F.col("tokenizer_hash") != tokenizer, "tokenizer mismatch").otherwise("ok")
    return manifest.join(l, manifest["shard"] == l["_shard"], "left").select("shard", v.alias("verdict"))


def tokenizer_fingerprint(name: str, vocab: int, canary: list[int]) -> str:
    """Digest of a tokenizer's name, size and the ids of a known text."""
    import hashlib

    return hashlib.sha256(f"{name}:{vocab}:{canary}".encode()).hexdigest()


def write_manifests(df: DataFrame, folder: str, indent: bool = True) -> None:
    """A JSON document per row."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": str(indent).lower()}).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(folder)


def read_manifests(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The documents that :func:`write_manifests` wrote, indented or not."""
    whole = spark.read.text(folder, wholetext=True)
    return whole.select(F.explode(F.split("value", "\n(?=\\{)")).alias("v")).select(F.from_json("v", schema).alias("r")).where("r is not null").select("r.*")


def append_ledger(df: DataFrame, folder: str, order: list[str], tries: int = 20) -> None:
    """Appends rows as JSON lines, with dense offsets that go on from the last one.

    A batch is written aside and then gets the next free number by a rename that fails if another writer has taken it; then
    the offsets are assigned anew, so two writers never give the same one.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), conf) if "://" in folder else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    x = running_totals(df, [], order, {}).checkpoint()
    none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    for _ in range(tries):
        try:
            last = read_ledger(spark, folder).agg(F.max("ledger_offset"), F.max("batch")).first()
        except AnalysisException:  # no ledger yet
            last = (None, None)
        base, batch = (-1 if last[0] is None else int(last[0])), (0 if last[1] is None else int(last[1]) + 1)
        aside = f"{folder.rstrip('/')}/_{uuid.uuid4().hex}"
        x.withColumn("ledger_offset", (F.col("pos") + base + 1).cast("long")).drop("pos").write.json(aside)
        try:
            context.rename(path(aside), path(f"{folder.rstrip('/')}/batch={batch:08d}"), none)
            return
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            context.delete(path(aside), True)
    raise RuntimeError(f"the ledger {folder} is written to by others all the time")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger's rows with the number of the ``batch`` that appended them."""
    return spark.read.json(folder)


def write_log(df: DataFrame, folder: str) -> None:
    """``[PASS] name (detail)`` lines from ``name, passed, detail``."""
    line = F.concat(F.when(F.col("passed"), "[PASS] ").otherwise("[FAIL] "), "name", F.when(F.col("detail").isNotNull(), F.concat(F.lit(" ("), "detail", F.lit(")"))).otherwise(F.lit("")))
    df.select(line.alias("value")).write.mode("append").text(folder)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as ``passed, name, detail``."""
    m = lambda i: F.regexp_extract("value", r"^\[(PASS|FAIL)\] (\S+)(?: \((.*)\))?$", i)
    return spark.read.text(path).where(m(1) != "").select((m(1) == "PASS").alias("passed"), m(2).alias("name"), F.nullif(m(3), F.lit("")).alias("detail"))


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """A table of few rows as one Markdown text."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("_r")))), lambda x: x["_r"])
    return df.agg(F.concat_ws("\n", F.lit(head), F.array_join(lines, "\n")).alias("table"))


def replace_block(text: str, name: str, block: str) -> str:
    """The text with what stands between the markers of ``name`` replaced."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    return re.sub(re.escape(begin) + ".*?" + re.escape(end), lambda _: f"{begin}\n{block}\n{end}", text, flags=re.S)


BANKS = {
    "prose": "the river turned slowly past the mill while farmers carried grain over a narrow bridge before evening".split(),
    "code": "def return for while import value index list range print len self total count".split(),
    "agent": "please check the order status and tell me when it will arrive at my office".split(),
}
BANK_PATTERN = {k: f"^(?:{'|'.join(v)})(?: (?:{'|'.join(v)}))*$" for k, v in BANKS.items()}


def block_replaced(text: Column, name: str, block: Column) -> Column:
    """The same of columns; a text without both markers stays as it is."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    new = F.concat(F.substring_index(text, begin, 1), F.lit(begin + "\n"), block, F.lit("\n" + end), F.substring_index(text, end, -1))
    return F.when(text.contains(begin) & text.contains(end), new).otherwise(text)


def synthetic_corpus(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """Documents of three lanes from word banks; words are drawn by hash, so a row is the same on every run and cluster."""
    banks = BANKS
    lane = F.element_at(F.array(*[F.lit(k) for k in banks]), (F.col("id") % 3 + 1).cast("int"))
    x = spark.range(n).withColumn("lane", lane).withColumn("n_words", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(60)) + 20)
    word = lambda bank: F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int")), lambda i: F.element_at(F.array(*[F.lit(w) for w in bank]), (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(len(bank))) + 1).cast("int")))
    text = F.lit(None).cast("array<string>")
    for k, bank in banks.items():
        text = F.when(F.col("lane") == k, word(bank)).otherwise(text)
    return x.select(F.format_string("%s-%06d", "lane", "id").alias("doc_id"), "lane", F.array_join(text, " ").alias("text"))


def with_fallback(first: DataFrame | None, other: DataFrame) -> DataFrame:
    """The first table if it has rows, else the other, with the columns of the second."""
    return first.select(*other.columns) if first is not None and not first.isEmpty() else other


def seed_rows(df: DataFrame, by: str, order: str, text: str, each: int, most: int) -> DataFrame:
    """The first rows per group whose text has more than 20 and under 220 characters, ``most`` in all: a small seed."""
    x = df.where((F.length(text) > 20) & (F.length(text) < 220))
    k = F.row_number().over(W.partitionBy(by).orderBy(order))
    return x.select(by, order, text).withColumn("_k", k).where(F.col("_k") <= each).orderBy(by, order).limit(most).drop("_k")


def parse_conversation(chat: Column) -> Column:
    """Turns of a transcript with ``USER:``, ``ASSISTANT:`` and ``FUNCTION RESPONSE:`` marks.

    Texts are stripped and cut off after 150 characters, results of functions count as the user's, and four turns are kept. Null if there
    are under three or none of the assistant's.
    """
    parts = F.filter(F.split(chat, "(?=(?:USER|ASSISTANT|FUNCTION RESPONSE):)"), lambda p: p.rlike("^(USER|ASSISTANT|FUNCTION RESPONSE):"))
    role = lambda p: F.when(p.startswith("ASSISTANT:"), "assistant").otherwise("user")
    body = lambda p: F.substring(F.trim(F.regexp_replace(F.regexp_replace(p, "^(USER|ASSISTANT|FUNCTION RESPONSE):", ""), "<\\|endoftext\\|>|[\\n\\r]+", " ")), 1, 150)
    turns = F.slice(F.filter(F.transform(parts, lambda p: F.struct(role(p).alias("role"), body(p).alias("text"))), lambda t: t["text"] != ""), 1, 4)
    return F.when((F.size(turns) >= 3) & F.exists(turns, lambda t: t["role"] == "assistant"), turns)


def render_turns(turns: Column) -> Column:
    """``[role] text`` lines."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("["), t["role"], F.lit("] "), t["text"])), "\n")

