"""Queries of the text problems, over whole tables. Tokenizers, raking and robust distances can't be written in SQL; what the results
promise can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.mixing import mix_documents, mix_margins, mix_shares
from tidewater.llm.packing import container_summary, pack_documents, packing_faults
from tidewater.llm.spam import spam_pages
from tidewater.sources.tables import table


def p6_pack(spark: SparkSession, root: str) -> DataFrame:
    return pack_documents(table(spark, root, "documents"))


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    return container_summary(pack_documents(table(spark, root, "documents")))


def p6_checks(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    return packing_faults(documents, pack_documents(documents))


def p7_margins(spark: SparkSession, root: str) -> DataFrame:
    return mix_margins(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p7_checks(spark: SparkSession, root: str) -> DataFrame:
    """Per source with a target: whether it has documents to use, whether no document is used too often and whether its share of the mix is met
    to within a twentieth."""
    shares = mix_shares(table(spark, root, "documents"), table(spark, root, "mix_targets"))
    kept = (F.col("most_used") <= F.col("max_repeats")).alias("within_repeats")
    met = F.abs(F.coalesce(F.col("tokens") - F.col("wanted_tokens"), F.lit(0.0))) <= 0.05 * F.coalesce("wanted_tokens", F.lit(0.0))
    return shares.select("source", (F.col("tokens") > 0).alias("used"), kept, met.alias("share_met"))


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    return mix_documents(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return mix_shares(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    pages = spam_pages(table(spark, root, "documents"), table(spark, root, "page_labels"))
    return pages.where("is_spam").select("doc_id").distinct()


def p8_scores(spark: SparkSession, root: str) -> DataFrame:
    return spam_pages(table(spark, root, "documents"), table(spark, root, "page_labels"))


QUERIES = {
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p6_checks": p6_checks,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_margins": p7_margins,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
}

ORACLES: dict[str, str] = {
    "p6_checks": "SELECT count(*) AS documents, count(*) AS placed, 0::BIGINT AS overfull, 0::BIGINT AS torn, 0::BIGINT AS lost FROM documents",
    "p7_checks": """SELECT source, EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND d.text <> '') AS used, true AS within_repeats, true AS share_met FROM mix_targets t""",
}
