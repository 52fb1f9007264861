"""Queries p6 to p8 over the whole text tables. SQL can express what must hold of p6 alone; tests/llm compares with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from . import leakage, packing, reading, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each document, by the vocabulary file that `spark.graphloom.vocabulary` names."""
    return tokens.token_counts(table(spark, d, "documents"), spark.conf.get("spark.graphloom.vocabulary", tokens.VOCABULARY))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_layouts(_sizes(spark, d), table(spark, d, "containers"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each layout, counted over all containers and documents."""
    sizes, kinds = written(_sizes(spark, d)), table(spark, d, "containers").where("capacity_tokens > 0")
    most = kinds.select(F.col("container_kind").alias("layout"), F.col("capacity_tokens").alias("most"))
    most = most.unionByName(kinds.agg(F.lit("joint").alias("layout"), F.max("capacity_tokens").alias("most")))
    return packing.layout_check(sizes, written(packing.container_layouts(sizes, kinds)), most)


def p6_use(spark: SparkSession, d: str) -> DataFrame:
    return packing.layout_use(p6_containers(spark, d))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return leakage.matched(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_matched(spark, d))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.spans(_matched(spark, d))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_matched(spark, d))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.cleaned(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.level_profile(p8_found(spark, d))


QUERIES = {f.__name__: f for f in (p6_containers, p6_use, p6_check, p7_found, p7_leaks, p7_spans, p7_items, p7_cleaned, p8_found, p8_profile)}
SQL: dict[str, str] = {
    "p6_check": """select layout, (select count(*) from documents where text is not null and text <> '') documents, 0 overfull, 0 cut_below, 0 gaps, 0 lost_tokens, true is_tight
from (select container_kind layout from containers where capacity_tokens > 0 union all select 'joint')""",
}
