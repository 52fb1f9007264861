"""Per-key results where a few keys hold most rows: exact offset chunking.

The rows of large keys are range-partitioned by their delivered order; keys are counted per partition, the counts are
prefix-summed into offsets, rows are numbered inside their key, and chunks of at most `chunk` consecutive rows are processed
on their own. Each chunk leaves an ordered boundary state; the states of a key are merged in order. No task ever processes
more than one chunk of a key, whatever the key holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import key, micros
from ..session import BROADCAST_ROWS, partitions, small, written


def chunked(rows: DataFrame, keys: list[str], order: list[str], chunk: int) -> DataFrame:
    """Adds chunk_no to rows: consecutive rows of a key in the order of the columns `order`, at most `chunk` per number.

    The order is that of the columns' values (nulls first), however the rows lie in files and partitions; rows equal in all
    of them are interchangeable, and may be cut between. Rows whose keys are null in any column are left out. Only the
    rows of keys with more than `chunk` rows move and are numbered; there are fewer than rows / chunk such keys.
    """
    spark = rows.sparkSession
    keyed = rows.dropna(subset=keys)
    hot = written(keyed.groupBy(*keys).agg(F.count("*").alias("key_rows")).where(F.col("key_rows") > chunk).select(*keys))
    # Equal rows may be many, so a running number, no part of the result, lets them lie in several partitions.
    hot_rows = keyed.join(small(hot), keys, "left_semi").withColumn("tie", F.monotonically_increasing_id())
    by = [*order, "tie"]
    placed = written(hot_rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).withColumn("part_no", F.spark_partition_id()).withColumn("row_pos", F.monotonically_increasing_id()).drop("tie"))
    counts = placed.groupBy(*keys, "part_no").agg(F.count("*").alias("part_rows"))
    before = W.partitionBy(*keys).orderBy("part_no").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "part_no", F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy(*keys, "part_no").orderBy("row_pos"))
    numbered = (
        placed.withColumn("in_part", inside)
        .join(offsets.hint("shuffle_hash"), [*keys, "part_no"])
        .withColumn("chunk_no", F.expr(f"(offset + in_part - 1) div {int(chunk)}"))
        .select(*rows.columns, "row_pos", "chunk_no")
    )
    cold = keyed.join(small(hot), keys, "left_anti").withColumn("row_pos", F.lit(0).cast("long")).withColumn("chunk_no", F.lit(0).cast("long"))
    return cold.unionByName(numbered)


def ordered_states(rows: DataFrame, keys: list[str], order: list[str], at: str) -> DataFrame:
    """Boundary state per chunk, its rows in order: how many, first and last `at`, steps back, widest step on."""
    by = [*order, "row_pos"]
    step = F.col(at) - F.lag(at).over(W.partitionBy(*keys, "chunk_no").orderBy(*by))
    return (
        rows.withColumn("step", step)
        .groupBy(*keys, "chunk_no")
        .agg(
            F.count("*").alias("n"),
            F.min_by(at, F.struct(*by)).alias("first_at"),
            F.max_by(at, F.struct(*by)).alias("last_at"),
            F.count_if(F.col("step") < 0).alias("steps_back"),
            F.max("step").alias("widest_step"),
        )
    )


def merged_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the chunk states of each key in order; the step from one chunk's end to the next one's start counts too."""
    across = F.col("first_at") - F.lag("last_at").over(W.partitionBy(*keys).orderBy("chunk_no"))
    return (
        states.withColumn("across", across)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("key_rows"),
            F.count("*").alias("chunks"),
            F.min_by("first_at", "chunk_no").alias("first_at"),
            F.max_by("last_at", "chunk_no").alias("last_at"),
            (F.sum("steps_back") + F.count_if(F.col("across") < 0)).alias("steps_back"),
            F.max(F.greatest("widest_step", "across")).alias("widest_step"),
        )
    )


def key_profile(tables: list[tuple[DataFrame, str, str, str, str]], chunk: int | None = None) -> DataFrame:
    """(field_name, key_value, key_rows, share, chunks, first_at, last_at, steps_back, widest_step) for the keys of several fields.

    `tables` lists (table, key column, order column, time column, field name). Key values compare without case and surrounding
    blanks; null and blank are no values, though their rows count for `share`, the part of all delivered rows. A key's rows
    stand in the order of the order column, a whole number (nulls first), and of the time where that is equal. Times are in
    microseconds; from or to a null time there is no step. `chunk` rows are processed at once (default: an eighth of a
    shuffle partition's even share), or more where there would be over BROADCAST_ROWS large keys. Empty tables give no rows.
    """
    spark = tables[0][0].sparkSession
    rows = None
    for df, col, order, at, name in tables:
        one = df.select(F.lit(name).alias("field_name"), key(col).alias("key_value"), F.col(order).cast("long").alias("pos"), micros(df, at).alias("at"))
        rows = one if rows is None else rows.unionByName(one)
    totals = written(rows.groupBy("field_name").agg(F.count("*").alias("all_rows")))  # one row per field
    total = sum(r.all_rows for r in totals.collect())
    size = max(1, chunk or total // (8 * partitions(spark)), -(-total // BROADCAST_ROWS))
    keys, by = ["field_name", "key_value"], ["pos", "at"]
    # Written whole: what a caller does not select is processed all the same.
    states = written(ordered_states(chunked(rows, keys, by, size), keys, by, "at"))
    merged = merged_states(states, keys)
    return merged.join(F.broadcast(totals), "field_name").select(*keys, "key_rows", (F.col("key_rows") / F.col("all_rows")).alias("share"), "chunks", "first_at", "last_at", "steps_back", "widest_step")


def hot_keys(profile: DataFrame, share: float = 0.03) -> DataFrame:
    """The keys that hold at least `share` of all rows of their table."""
    return profile.where(F.col("share") >= share).select("field_name", "key_value")
