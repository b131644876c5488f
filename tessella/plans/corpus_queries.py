"""Audits of a corpus: scans, scalar functions, profiles, rollups, duplicates, licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import text as X
from tessella.operators import profile as P
from tessella.plans.base import Book
from tessella.sources.tables import spread, table

book = Book()
QUERIES, SQL = book.queries, book.sql

TOK = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+'))"
SRC = "coalesce(nullif(lower(trim(source)), ''), 'unknown')"
#: the same rules in the other engine's regular expressions
CONTROLS = "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]|\\x{ad}|[\\x{600}-\\x{605}]|\\x{61c}|\\x{6dd}|\\x{70f}|\\x{180e}|\\x{200b}|[\\x{200e}-\\x{200f}]|[\\x{202a}-\\x{202e}]|[\\x{2060}-\\x{2064}]|[\\x{2066}-\\x{206f}]|\\x{feff}"
CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]|\\x{ad}|[\\x{600}-\\x{605}]|\\x{61c}|\\x{6dd}|\\x{70f}|\\x{180e}|\\x{200b}|[\\x{200e}-\\x{200f}]|[\\x{202a}-\\x{202e}]|[\\x{2060}-\\x{2064}]|[\\x{2066}-\\x{206f}]|\\x{feff}', '', 'g'),"
    " '[\\x{2028}\\x{2029}]', chr(10), 'g'), '(?m)[ \\t\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g'), '^[ \\t\\n\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]+|[ \\t\\n\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]+\\z', '', 'g')"
)
COUNT = lambda pattern, x="text": f"len(regexp_extract_all({x}, '{pattern}'))"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def source(c: str = "source"):
    return X.missing(F.lower(F.trim(F.col(c))), "unknown")


@book("SELECT lang, count(*) AS n_docs, sum(length(text)) AS chars FROM documents GROUP BY lang")
def scan_pruned(spark, d):
    """Two columns of a wide table reach the scan."""
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("chars"))


N_SHARDS = 883  #: Fixed value: shards of the code corpus.


@book("SELECT format('{:05d}', i) AS shard, format('train-{:05d}-of-00883.parquet', i) AS file FROM (SELECT DISTINCT CAST(floor(k * 883 / 10.0) AS BIGINT) AS i FROM range(10) r(k))")
def shard_list(spark, d):
    """Evenly spaced shard numbers, distinct and in order."""
    i = F.floor(F.col("id") * N_SHARDS / 10.0)
    return spark.range(10).select(i.alias("i")).distinct().select(F.format_string("%05d", "i").alias("shard"), F.format_string("train-%05d-of-00883.parquet", "i").alias("file"))


@book(f"""SELECT {SRC} AS source, count(*) AS n_docs, CAST(count(*) FILTER (WHERE {CLEAN} <> coalesce(text, '')) AS BIGINT) AS n_changed, CAST(sum(length({CLEAN})) AS BIGINT) AS clean_chars FROM documents GROUP BY 1""")
def normalize_profile(spark, d):
    """Texts changed by normalisation, per source."""
    raw = F.coalesce("text", F.lit(""))
    return P.evaluated_once(spread(docs(spark, d)), source=source(), raw=raw, clean=X.normalize(raw)).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("clean") != F.col("raw")).alias("n_changed"), F.sum(F.length("clean")).alias("clean_chars")
    )


@book("SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents WHERE text IS NOT NULL")
def nfc_digest(spark, d):
    """Digest of the canonically composed text."""
    return docs(spark, d).where("text is not null").select("doc_id", F.sha2(X.nfc("text"), 256).alias("digest"))


@book(rf"""SELECT lang, round(avg(CASE WHEN {COUNT(chr(92) + 'p{L}')} > 0 THEN {COUNT('[A-Za-z]')} * 1.0 / {COUNT(chr(92) + 'p{L}')} ELSE 1.0 END), 6) AS mean_ratio,
    CAST(count(*) FILTER (WHERE lang = 'en' AND {COUNT(chr(92) + 'p{L}')} > 0 AND {COUNT('[A-Za-z]')} * 1.0 / {COUNT(chr(92) + 'p{L}')} < 0.5) AS BIGINT) AS n_mismatch FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def script_ratio(spark, d):
    """Share of ASCII letters, and English texts in another script."""
    r = X.ascii_script_ratio(F.col("text"))
    return docs(spark, d).where("text is not null").select("lang", r.alias("r")).groupBy("lang").agg(F.round(F.avg("r"), 6).alias("mean_ratio"), F.count_if((F.col("lang") == "en") & (F.col("r") < 0.5)).alias("n_mismatch"))


@book(rf"""SELECT lane, CAST(sum({COUNT(r'(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')}) AS BIGINT) AS emails, CAST(sum({COUNT(r'\b(?:\d{1,3}\.){3}\d{1,3}\b')}) AS BIGINT) AS ipv4s,
    CAST(sum({COUNT(r'(?i)https?://[^ \t\n\v\f\r]+')}) AS BIGINT) AS urls, CAST(sum({COUNT(r'''(?i)\b(api[_-]?key|secret|password|passwd|token)\b\s*[:=]\s*[''"][A-Za-z0-9_\-]{8,}[''"]''')}) AS BIGINT) AS secrets FROM documents WHERE text IS NOT NULL GROUP BY lane""")
def pii_counts(spark, d):
    """Addresses and secrets by pattern, per lane."""
    t = F.col("text")
    return docs(spark, d).where("text is not null").groupBy("lane").agg(*[F.sum(X.pattern_count(t, p)).alias(n) for n, p in (("emails", X.EMAIL), ("ipv4s", X.IPV4), ("urls", X.URL), ("secrets", X.SECRET))])


#: The other engine can't look behind: every other character is doubled, so that neighbours don't share one.
PHONE_SQL = lambda x: rf"len(regexp_extract_all(regexp_replace({x}, '([^0-9])', '\\1\\1', 'g'), '(?:^|[^0-9])(?:\\+?91(?:--|[ \t\n\v\f\r]{{2}})?)?[6-9][0-9]{{9}}(?:[^0-9]|\\z)'))"


@book(f"SELECT lane, CAST(sum(coalesce({PHONE_SQL('text')}, 0)) AS BIGINT) AS phones FROM documents GROUP BY 1")
def phone_counts(spark, d):
    """Telephone numbers."""
    return docs(spark, d).groupBy("lane").agg(F.sum(X.pattern_count(F.col("text"), X.PHONE)).alias("phones"))


@book("SELECT doc_id, coalesce(repo_name, '') || chr(10) || coalesce(license, '') AS joined, concat_ws(chr(10), repo_name, license) AS skipped FROM documents")
def field_join(spark, d):
    """Two ways of joining fields: nulls as empty, and nulls left out."""
    e = F.lit("")
    return docs(spark, d).select("doc_id", F.concat(F.coalesce("repo_name", e), F.lit("\n"), F.coalesce("license", e)).alias("joined"), F.concat_ws("\n", "repo_name", "license").alias("skipped"))


@book(r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '(?s)<\|begin_of_thought\|>(.*?)<\|end_of_thought\|>', 1), chr(10)) AS thoughts, len(regexp_extract_all(text, '(?s)<\|begin_of_thought\|>(.*?)<\|end_of_thought\|>', 1)) AS n_spans FROM documents WHERE text IS NOT NULL""")
def thought_spans(spark, d):
    """Texts between markers, joined."""
    s = X.spans(F.col("text"), "<|begin_of_thought|>", "<|end_of_thought|>")
    return docs(spark, d).where("text is not null").select("doc_id", F.array_join(s, "\n").alias("thoughts"), F.size(s).cast("long").alias("n_spans"))


BANDS = f"CASE WHEN {TOK} >= 2000 THEN '4 long' WHEN {TOK} >= 500 THEN '3 medium' WHEN {TOK} >= 100 THEN '2 short' ELSE '1 tiny' END"


@book(f"SELECT {BANDS} AS band, count(*) AS n_docs, min({TOK}) AS smallest, CAST(sum({TOK}) AS BIGINT) AS n_tokens FROM documents GROUP BY 1")
def length_bands(spark, d):
    """Histogram over half-open bands, with the least of each."""
    n = X.tokens(F.col("text"))
    b = X.band(n, [0, 100, 500, 2000], ["1 tiny", "2 short", "3 medium", "4 long"])
    return docs(spark, d).select(n.alias("n"), b.alias("band")).groupBy("band").agg(F.count("*").alias("n_docs"), F.min("n").cast("long").alias("smallest"), F.sum("n").alias("n_tokens"))


@book(f"""SELECT CASE WHEN {SRC} = 'aya:verified' THEN 'verified' WHEN {SRC} LIKE '%:mixed' THEN 'translated' ELSE 'unverified' END AS tier, coalesce(lang, 'unknown') AS lang, count(*) AS n_docs, CAST(sum({TOK}) AS BIGINT) AS n_tokens FROM documents GROUP BY 1, 2""")
def tier_rollup(spark, d):
    """Tiers by name rules, per language."""
    s = source()
    tier = F.when(s == "aya:verified", "verified").when(s.endswith(":mixed"), "translated").otherwise("unverified")
    return docs(spark, d).groupBy(tier.alias("tier"), F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n_docs"), F.sum(X.tokens(F.col("text"))).alias("n_tokens"))


TIERS = ["verified", "unverified", "translated", "synthetic"]
TIER_SQL = f"CASE WHEN {SRC} = 'aya:verified' THEN 'verified' WHEN {SRC} LIKE '%:mixed' THEN 'translated' ELSE 'unverified' END"


@book(f"""WITH x AS (SELECT coalesce(lang, 'unknown') AS lang, {TIER_SQL} AS tier, {TOK} AS t FROM documents), n AS (SELECT lang, tier, count(*) AS n_docs, sum(t) AS n_tokens FROM x GROUP BY 1, 2 UNION ALL SELECT '*', tier, count(*), sum(t) FROM x GROUP BY 2),
    a AS (SELECT DISTINCT lang, unnest({TIERS}) AS tier FROM n) SELECT a.lang, a.tier, coalesce(n.n_docs, 0) AS n_docs, CAST(coalesce(n.n_tokens, 0) AS BIGINT) AS n_tokens FROM a LEFT JOIN n ON n.lang = a.lang AND n.tier = a.tier""")
def tier_totals(spark, d):
    """Documents and tokens of every tier per language and in all, zeros included."""
    s = source()
    tier = F.when(s == "aya:verified", "verified").when(s.endswith(":mixed"), "translated").otherwise("unverified")
    x = docs(spark, d).select(F.coalesce("lang", F.lit("unknown")).alias("lang"), tier.alias("tier"), X.tokens(F.col("text")).alias("t"))
    sums = [f(F.when(F.col("tier") == k, c)).alias(f"{k}_{n}") for k in TIERS for n, f, c in (("docs", F.count, F.lit(1)), ("tokens", F.sum, F.col("t")))]
    wide = x.rollup("lang").agg(*sums)
    rows = F.array(*[F.struct(F.lit(k).alias("tier"), F.col(f"{k}_docs").alias("n_docs"), F.coalesce(f"{k}_tokens", F.lit(0)).alias("n_tokens")) for k in TIERS])
    return wide.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.explode(rows).alias("r")).select("lang", "r.*").where("lang <> '*' or n_docs is not null")


#: Licences that count as allowed.
ALLOWED = ["mit", "apache-2.0", "bsd-3-clause", "bsd-2-clause", "isc", "cc0-1.0", "unlicense"]
ALLOWED_SQL = ", ".join(f"'{x}'" for x in ALLOWED)


@book(f"""SELECT coalesce(nullif(lower(trim(license)), ''), 'unknown') AS license, coalesce(lang, 'unknown') AS lang, count(*) AS n_docs, CAST(sum({TOK}) AS BIGINT) AS n_tokens FROM documents GROUP BY 1, 2""")
def license_counts(spark, d):
    """Rows and tokens by licence and language; null and empty are one."""
    return docs(spark, d).groupBy(X.missing(F.lower(F.trim("license")), "unknown").alias("license"), F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n_docs"), F.sum(X.tokens(F.col("text"))).alias("n_tokens"))


@book(f"""WITH s AS (SELECT {SRC} AS shard, sum(length(text)) AS total, sum(length(text)) FILTER (WHERE lower(trim(license)) IN ({ALLOWED_SQL})) AS allowed FROM documents GROUP BY 1),
    f AS (SELECT coalesce(allowed, 0) / total AS f, total, coalesce(allowed, 0) AS allowed FROM s WHERE total > 0)
    SELECT count(*) AS n_shards, round(avg(f), 4) AS mean_share, round(coalesce(stddev_samp(f), 0), 4) AS sd_share, round(min(f), 4) AS least, round(max(f), 4) AS most, round(sum(allowed) / sum(total), 4) AS pooled, CAST(floor(avg(total) * 883) AS BIGINT) AS extrapolated FROM f""")
def license_shards(spark, d):
    """Allowed share per shard: mean of ratios against ratio of sums, spread, and totals carried on to all shards."""
    ok = F.lower(F.trim("license")).isin(*ALLOWED)
    s = docs(spark, d).groupBy(source().alias("shard")).agg(F.sum(F.length("text")).alias("total"), F.coalesce(F.sum(F.when(ok, F.length("text"))), F.lit(0)).alias("allowed")).where("total > 0")
    f = F.col("allowed") / F.col("total")
    return s.agg(
        F.count("*").alias("n_shards"), F.round(F.avg(f), 4).alias("mean_share"), F.round(F.coalesce(F.stddev_samp(f), F.lit(0.0)), 4).alias("sd_share"), F.round(F.min(f), 4).alias("least"),
        F.round(F.max(f), 4).alias("most"), F.round(F.sum("allowed") / F.sum("total"), 4).alias("pooled"), F.floor(F.avg("total") * N_SHARDS).alias("extrapolated"),
    )


@book("SELECT doc_id, sha256(coalesce(repo_name, '') || ':' || CAST(doc_id AS VARCHAR)) AS digest, substr(sha256(coalesce(repo_name, '') || ':' || CAST(doc_id AS VARCHAR)), 1, 16) AS rank FROM documents")
def row_digest(spark, d):
    """Digest of a templated key, and its first 64 bits as a rank."""
    k = F.concat(F.coalesce("repo_name", F.lit("")), F.lit(":"), F.col("doc_id").cast("string"))
    return docs(spark, d).select("doc_id", F.sha2(k, 256).alias("digest"), X.rank64(k).alias("rank"))


@book(f"""SELECT lang, count(*) AS n_rows, CAST(sum({TOK}) AS BIGINT) AS total, round(avg({TOK}), 4) AS mean, median({TOK}) AS median, max({TOK}) AS most,
    list_sort(list({TOK}))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95 FROM documents GROUP BY lang""")
def length_profile(spark, d):
    """Mean, median, p95 (by index) and most of the token counts, per language."""
    return P.length_profile(docs(spark, d), X.tokens(F.col("text")).cast("long"), ["lang"])


@book(f"SELECT CAST(count(*) - count(DISTINCT sha256({CLEAN})) AS BIGINT) AS n_duplicates, CAST(count(DISTINCT sha256({CLEAN})) AS BIGINT) AS n_distinct FROM documents")
def exact_duplicates(spark, d):
    """Rows less distinct normalised texts."""
    h = spread(docs(spark, d)).groupBy(F.sha2(X.normalize(F.coalesce("text", F.lit(""))), 256).alias("h")).agg(F.count("*").alias("c"))
    return h.agg(F.sum(F.col("c") - 1).alias("n_duplicates"), F.count("*").alias("n_distinct"))


@book(f"SELECT lang, license, n, rank FROM (SELECT lang, license, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, license ASC NULLS LAST) AS rank FROM documents GROUP BY lang, license) WHERE rank <= 3")
def top_licenses(spark, d):
    """The commonest licences per language."""
    return P.top_k(docs(spark, d), ["lang"], "license", 3)


@book(f"SELECT coalesce(lang, 'unknown') AS lang, lane, count(*) AS n_docs, CAST(sum({TOK}) AS BIGINT) AS n_tokens FROM documents GROUP BY GROUPING SETS ((coalesce(lang, 'unknown'), lane), (coalesce(lang, 'unknown')), ())")
def language_rollup(spark, d):
    """Both levels and the grand total."""
    x = docs(spark, d).select(F.coalesce("lang", F.lit("unknown")).alias("lang"), "lane", X.tokens(F.col("text")).alias("t"))
    return x.rollup("lang", "lane").agg(F.count("*").alias("n_docs"), F.sum("t").alias("n_tokens"))


@book("SELECT lane, lang, count(*) AS n_docs FROM documents GROUP BY CUBE (lane, lang)")
def lane_cube(spark, d):
    return docs(spark, d).cube("lane", "lang").agg(F.count("*").alias("n_docs"))


DISTINCT_SQL = "SELECT lane, count(DISTINCT text) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1"


@book(f"WITH e AS ({DISTINCT_SQL}) SELECT lane, TRUE AS close FROM e UNION ALL SELECT '*', TRUE FROM (SELECT count(*) FROM e) WHERE EXISTS (SELECT 1 FROM e)")
def approx_distinct(spark, d):
    """Sketches of distinct texts per lane and merged over lanes, within 3 % of the exact counts (which are only there for the check)."""
    t = docs(spark, d).where("text is not null").select("lane", "text")
    s = approx_sketches(t)
    exact = t.groupBy("lane").agg(F.countDistinct("text").alias("exact"))
    exact = exact.unionByName(t.agg(F.lit("*").alias("lane"), F.countDistinct("text").alias("exact")))
    return s.join(exact, "lane").select("lane", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact") + 1).alias("close"))


def approx_sketches(t: DataFrame) -> DataFrame:
    """Distinct texts per lane and over all lanes (``*``), from mergeable sketches; nothing is counted exactly."""
    s = t.groupBy("lane").agg(F.hll_sketch_agg("text", 14).alias("sketch"))
    all_ = s.agg(F.hll_union_agg("sketch").alias("sketch"), F.count("*").alias("n")).where("n > 0").select(F.lit("*").alias("lane"), "sketch")
    return s.unionByName(all_).select("lane", F.hll_sketch_estimate("sketch").alias("estimate"))


@book(f"""SELECT CAST(count(*) FILTER (WHERE {TOK} = 0) AS BIGINT) AS n_empty, CAST(count(*) FILTER (WHERE {TOK} > 2048) AS BIGINT) AS n_over, CAST(count(*) FILTER (WHERE {TOK} > 0) AS BIGINT) AS n_kept FROM documents""")
def length_gates(spark, d):
    """Gates that count and don't drop."""
    n = X.tokens(F.col("text"))
    return docs(spark, d).agg(F.count_if(n == 0).alias("n_empty"), F.count_if(n > 2048).alias("n_over"), F.count_if(n > 0).alias("n_kept"))


@book(f"SELECT doc_id, CASE WHEN {TOK} >= 2000 THEN 'withheld' ELSE 'train' END AS split FROM documents")
def threshold_split(spark, d):
    """Long texts are withheld."""
    return docs(spark, d).select("doc_id", F.when(X.tokens(F.col("text")) >= 2000, "withheld").otherwise("train").alias("split"))


LETTERS = COUNT(chr(92) + "p{L}", "clean")
AUDIT = {
    ("manifest", "records"): "count(*)", ("manifest", "raw_tokens"): r"sum(len(regexp_extract_all(raw, '[^ \t\n\r\f]+')))", ("normalize", "changed"): "count(*) FILTER (WHERE clean <> raw)",
    ("normalize", "controls_removed"): f"sum(length(raw) - length(regexp_replace(raw, '{CONTROLS}', '', 'g')))", ("format", "empty"): "count(*) FILTER (WHERE clean = '')",
    ("format", "over_length"): r"count(*) FILTER (WHERE len(regexp_extract_all(clean, '[^ \t\n\r\f]+')) > 2048)",
    ("language", "script_mismatch"): f"count(*) FILTER (WHERE lang = 'en' AND {LETTERS} > 0 AND {COUNT('[A-Za-z]', 'clean')} * 1.0 / {LETTERS} < 0.5)",
    ("pii", "email"): f"sum({COUNT(r'(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', 'clean')})", ("pii", "phone"): f"sum({PHONE_SQL('clean')})", ("pii", "ipv4"): f"sum({COUNT(r'\b(?:\d{1,3}\.){3}\d{1,3}\b', 'clean')})",
    ("pii", "url"): f"sum({COUNT(r'(?i)https?://[^ \t\n\v\f\r]+', 'clean')})", ("dedup", "exact_duplicates"): "count(*) - count(DISTINCT sha256(clean))",
}


@book(f"WITH c AS MATERIALIZED (SELECT {CLEAN} AS clean, coalesce(text, '') AS raw, lang FROM documents) " + " UNION ALL ".join(f"SELECT '{a}' AS stage, '{b}' AS metric, CAST(coalesce({e}, 0) AS BIGINT) AS value FROM c" for (a, b), e in AUDIT.items()))
def audit_stages(spark, d):
    """All stages of the audit as (stage, metric, value)."""
    return P.audit_stages(spread(docs(spark, d)), "text", "lang")


LINES = "regexp_replace(regexp_replace(coalesce(text, ''), chr(13) || chr(10), chr(10), 'g'), chr(13), chr(10), 'g')"
JOINERS = "|[\\x{200c}\\x{200d}]"
REMOVED = lambda x, pattern: f"CAST(sum(length({x}) - length(regexp_replace({x}, '{pattern}', '', 'g'))) AS BIGINT)"


@book(f"SELECT {SRC} AS source, {REMOVED(LINES, CONTROLS + JOINERS)} AS removed_code, {REMOVED(LINES, CONTROLS)} AS removed_indic, {REMOVED('text', CONTROLS)} AS removed_audit FROM documents WHERE text IS NOT NULL GROUP BY 1")
def control_counts(spark, d):
    """Characters that the three rules of normalisation remove as control characters: code (joiners go, line ends first), Indic and audit."""
    lines = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r", "\n")
    x = docs(spark, d).where("text is not null").select(source().alias("source"), "text", lines.alias("lines"))
    return x.groupBy("source").agg(
        F.sum(X.control_count(F.col("lines"), keep_joiners=False)).alias("removed_code"), F.sum(X.control_count(F.col("lines"))).alias("removed_indic"), F.sum(X.control_count(F.col("text"))).alias("removed_audit")
    )


CODE_CLEAN = CLEAN.replace("coalesce(text, '')", LINES).replace(CONTROLS, CONTROLS + JOINERS)
INDIC_CLEAN = CLEAN.replace("coalesce(text, '')", LINES)


@book(f"SELECT doc_id, sha256({CODE_CLEAN}) AS code, sha256({INDIC_CLEAN}) AS indic FROM documents WHERE text IS NOT NULL")
def normalize_variants(spark, d):
    """Digests of the texts under the rules of the code and of the Indic audits."""
    rule = lambda joiners: F.sha2(X.normalize(F.col("text"), keep_joiners=joiners, lines_first=True), 256)
    return spread(docs(spark, d).where("text is not null").select("doc_id", "text")).select("doc_id", rule(False).alias("code"), rule(True).alias("indic"))


@book("""WITH a AS (SELECT DISTINCT sha256(text) AS h FROM code_commitpack_sample WHERE text IS NOT NULL AND lane = 'prose')
    SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT sha256(text)) AS BIGINT) AS n_texts FROM code_commitpack_sample WHERE lane = 'code' AND text IS NOT NULL AND sha256(text) IN (SELECT h FROM a)""")
def cross_source_overlap(spark, d):
    """Rows of one lane whose exact text another lane has (left semi join on digests)."""
    t = table(spark, d, "code_commitpack_sample").where("text is not null").select("lane", F.sha2("text", 256).alias("h"))
    return t.where("lane = 'code'").join(t.where("lane = 'prose'").select("h").distinct(), "h", "left_semi").agg(F.count("*").alias("n_rows"), F.countDistinct("h").alias("n_texts"))


@book("""SELECT CAST((SELECT count(*) FROM (SELECT source FROM documents WHERE lane = 'code' INTERSECT SELECT source FROM documents WHERE lane = 'prose')) AS BIGINT) AS n_both,
    CAST((SELECT count(*) FROM (SELECT source FROM documents WHERE lane = 'code' EXCEPT SELECT source FROM documents WHERE lane = 'prose')) AS BIGINT) AS n_code_only,
    CAST((SELECT count(*) FROM (SELECT source FROM documents WHERE lane IN ('code', 'prose') GROUP BY source)) AS BIGINT) AS n_either""")
def set_operations(spark, d):
    """Sizes of intersection, difference and union of the sources of two lanes."""
    s = docs(spark, d).select("lane", "source")
    a, b = s.where("lane = 'code'").select("source").distinct(), s.where("lane = 'prose'").select("source").distinct()
    n = lambda x, name: x.agg(F.count("*").alias(name))
    return n(a.intersect(b), "n_both").join(n(a.subtract(b), "n_code_only")).join(n(a.union(b).distinct(), "n_either"))


TOKEN_WORDS = r"unnest(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \t\n\r\f]+|\n+'))"
WORDS_SQL = ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS)


@book(rf"""WITH t AS (SELECT {TOKEN_WORDS} AS w FROM documents WHERE text IS NOT NULL)
    SELECT CASE WHEN regexp_full_match(w, '\n+') THEN 'newline/end' WHEN regexp_full_match(regexp_replace(w, '\v', '', 'g'), '[!-/:-@\[-`{{-~]*') THEN 'punctuation' WHEN regexp_matches(w, '[0-9]') THEN 'number'
        WHEN lower(w) IN ({WORDS_SQL}) THEN 'function word' WHEN regexp_matches(w, '^\p{{Lu}}') THEN 'capitalised word' ELSE 'other word' END AS category, count(*) AS n FROM t GROUP BY 1""")
def token_categories(spark, d):
    """Tokens by category."""
    w = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \t\n\r\f]+|\n+"), F.lit(0)))
    return docs(spark, d).select(w.alias("w")).groupBy(X.token_category(F.col("w")).alias("category")).agg(F.count("*").alias("n"))


def _unit(k: int, name: str) -> str:
    u = 1000**k
    near = lambda m: f"((bytes * {m} + {u // 2}) // {u}) / {m}.0::DOUBLE"
    return f"WHEN bytes < {10 * u} THEN printf('%.2f {name}', {near(100)}) WHEN bytes < {100 * u} THEN printf('%.1f {name}', {near(10)}) WHEN bytes < {1000 * u} THEN printf('%.0f {name}', {near(1)})"


@book(f"SELECT doc_id, bytes, CASE {' '.join(_unit(k, n) for k, n in enumerate(['B', 'KB', 'MB', 'GB', 'TB']))} END AS shown FROM (SELECT doc_id, n_chars * (1000 ** k)::BIGINT AS bytes FROM documents, range(4) r(k))")
def byte_format(spark, d):
    """Sizes in decimal units; multiplied by powers of 1000, so that every unit occurs. Null sizes are shown as null."""
    x = docs(spark, d).select("doc_id", F.explode(F.array(*[F.col("n_chars") * 1000**k for k in range(4)])).alias("bytes"))
    return x.select("doc_id", "bytes", X.decimal_bytes(F.col("bytes")).alias("shown"))
