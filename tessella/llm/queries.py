"""The queries of problems 1 and 3 to 6, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm.mixing import CORPUS, MixRule, mix_sources
from tessella.llm.overlap import overlap_pairs, overlap_report
from tessella.llm.packing import pack_documents, utilisation
from tessella.llm.splitting import oversized, piece_checks, split_oversized
from tessella.llm.toxicity import fit_scorer, score_documents, toxicity_rates
from tessella.sources.tables import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap_pairs(table(spark, d, "code_commitpack_sample"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(table(spark, d, "code_commitpack_sample"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "segments"), table(spark, d, "shard_agent"), table(spark, d, "packing_limits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece = 0").select("item_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    items = oversized(table(spark, d, "segments"), table(spark, d, "shard_agent"), table(spark, d, "packing_limits"))
    return piece_checks(_pieces(spark, d), items)


def p4_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(spread(table(spark, d, "documents")), table(spark, d, "packing_limits"))


def p4_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return utilisation(p4_containers(spark, d))


#: The tables want shares of sources only; languages and topics are to stay as the corpus has them.
MIX = MixRule(language_share=CORPUS, topic_share=CORPUS)


def p5_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(spread(table(spark, d, "documents")), table(spark, d, "mixture_targets"), rule=MIX)[0]


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(spread(table(spark, d, "documents")), table(spark, d, "mixture_targets"), rule=MIX)[1]


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return score_documents(spread(docs), fit_scorer(docs, table(spark, d, "review_labels")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_scores(spark, d).where("flagged").select("doc_id").distinct()


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity_rates(p6_scores(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_pieces, p3_checks, p4_containers, p4_utilisation, p5_mixture, p5_shares, p6_found, p6_scores, p6_rates)}

SQL = {
    "p3_checks": """
        WITH items AS (
            SELECT 'segment' AS kind, segment_id AS item_id, lower(trim(lane)) AS lane, token_start, token_end FROM segments
            UNION ALL
            SELECT 'document', doc_id, lower(trim(lane)), token_start, token_end FROM shard_agent
        )
        SELECT DISTINCT kind, item_id, TRUE AS within, TRUE AS covers, TRUE AS overlaps FROM items JOIN packing_limits l ON items.lane = l.lane WHERE token_end - token_start > max_tokens
    """,
    "p3_found": """
        WITH items AS (
            SELECT segment_id AS item_id, lower(trim(lane)) AS lane, token_start, token_end FROM segments
            UNION ALL
            SELECT doc_id, lower(trim(lane)), token_start, token_end FROM shard_agent
        )
        SELECT DISTINCT item_id FROM items JOIN packing_limits l ON items.lane = l.lane WHERE token_end - token_start > max_tokens
    """,
}
