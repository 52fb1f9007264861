"""Reports on the progress of a scan: repeated failures, summaries and sampled progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines printed per failure before the rest is suppressed.
MOST_LINES = 3
# Counters of the printed summary (label, statistic).
SUMMARY = (("Repositories", "repository_count"), ("Projects", "project_count"), ("Endpoints", "endpoint_count"), ("Methods", "method_count"), ("HTTP edges", "http_edge_count"), ("Tables", "table_count"), ("Cross-repo links", "cross_repo_link_count"), ("Ambiguous edges", "ambiguous_edge_count"))


def is_failure(message: Column) -> Column:
    return F.coalesce(F.startswith(message, F.lit("Failed to ")), F.lit(False))


def signature(message: Column) -> Column:
    """What follows the first `: `, or the whole message."""
    at = F.locate(": ", message)
    return F.when(at > 0, F.substring(message, at + 2, F.length(message))).otherwise(message)


def prefix(stage: Column, current: Column, total: Column) -> Column:
    return F.when(current.isNotNull() & total.isNotNull(), F.format_string("[%s %d/%d]", stage, current, total)).otherwise(F.concat(F.lit("["), stage, F.lit("]")))


def printed(progress: DataFrame) -> DataFrame:
    """(seq, line) of (seq, stage, message, current, total): of each failure three lines and one that says the rest is
    suppressed; all other messages. Only the four first rows of a signature are ranked, found by a top-k aggregate."""
    rows = progress.withColumn("sig", F.when(is_failure(F.col("message")), signature(F.col("message"))))
    head = prefix(F.col("stage"), F.col("current"), F.col("total"))
    others = rows.where("sig is null").select("seq", F.concat(head, F.lit(" "), "message").alias("line"))
    # row_number <= k is pushed into each input partition by Catalyst (WindowGroupLimit), so a hot signature stays small.
    ranked = rows.where("sig is not null").withColumn("n", F.row_number().over(W.partitionBy("sig").orderBy("seq"))).where(F.col("n") <= MOST_LINES + 1)
    said = F.when(F.col("n") <= MOST_LINES, F.col("message")).otherwise(F.concat(F.lit("Suppressing additional repeated failures for: "), "sig"))
    return others.unionByName(ranked.select("seq", F.concat(head, F.lit(" "), said).alias("line")))


def failure_summary(progress: DataFrame) -> DataFrame:
    """(sig, suppressed): failures beyond the printed lines, per signature."""
    failed = progress.where(is_failure(F.col("message"))).groupBy(signature(F.col("message")).alias("sig")).agg(F.count("*").alias("n"))
    return failed.where(F.col("n") > MOST_LINES).select("sig", (F.col("n") - MOST_LINES).alias("suppressed"))


def sampled(progress: DataFrame, interval: int) -> DataFrame:
    """The progress rows worth reporting: the first, the last and every `interval`-th."""
    return progress.where((F.col("current") <= 1) | (F.col("current") == F.col("total")) | (F.col("current") % interval == 0))


def summary_lines(stats: DataFrame) -> DataFrame:
    """(place, line) of the printed summary from one row of statistics."""
    return stats.select(F.posexplode(F.array(*(F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in SUMMARY))).alias("place", "line"))
