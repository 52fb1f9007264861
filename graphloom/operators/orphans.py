"""References to records that do not exist.

References and parent rows go into one table, which is range-partitioned and sorted by key and time; each partition then
merges the two streams in one linear pass. A key with any number of rows may span many partitions: the pass leaves the
rows of a partition's first key open, and the boundary states (one row per partition) close them afterwards. No task
ever holds a key, and no parent list is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import key, micros
from ..session import partitions, written

OPEN_END = 2**62
BEFORE_ALL = NONE = -(2**62)
HEADER, PARENT, REFERENCE = 0, 1, 2
_SCANNED = "pid int, row_kind int, node_id string, at long, ref_id string, end_name string, best_end long, known boolean, alone boolean"
_ARROW = pa.schema([("pid", pa.int32()), ("row_kind", pa.int32()), ("node_id", pa.string()), ("at", pa.int64()), ("ref_id", pa.string()), ("end_name", pa.string()), ("best_end", pa.int64()), ("known", pa.bool_()), ("alone", pa.bool_())])


def intervals(df: DataFrame, id_col: str = "id", start: str = "scanned_at", end: str | None = "removed_at") -> DataFrame:
    """Validity rows (node_id, start_at, end_at) of a parent table. Rows without id or start are left out; a null end is open.

    Rows delivered again collapse before any row moves far: of equal starts the longest validity holds.
    """
    stop = F.coalesce(micros(df, end), F.lit(OPEN_END)) if end else F.lit(OPEN_END)
    rows = df.select(key(id_col).alias("node_id"), micros(df, start).alias("start_at"), stop.cast("long").alias("end_at"))
    return rows.where("node_id is not null and start_at is not null").groupBy("node_id", "start_at").agg(F.max("end_at").alias("end_at"))


def references(edges: DataFrame) -> DataFrame:
    """(ref_id, end_name, node_id, at): one row per distinct edge and non-null end. Edges without id or `scanned_at` are left out.

    An edge delivered again keeps its ends and time; should deliveries differ all the same, the smallest value counts.
    """
    one = (
        edges.select(key("id").alias("ref_id"), key("source_id").alias("source"), key("target_id").alias("target"), micros(edges, "scanned_at").alias("at"))
        .where("ref_id is not null and at is not null")
        .groupBy("ref_id")
        .agg(F.min("source").alias("source"), F.min("target").alias("target"), F.min("at").alias("at"))
    )
    return one.select("ref_id", "at", F.expr("stack(2, 'source', source, 'target', target) as (end_name, node_id)")).where("node_id is not null")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One linear pass over a sorted partition; yields orphans, the rows of the first key, and the boundary state."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    first = last = None
    end, known = NONE, False  # state of the last key so far
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ids = b.column("node_id")
        kind = b.column("row_kind").to_numpy(zero_copy_only=False)
        at = b.column("at").to_numpy(zero_copy_only=False)
        stop = b.column("end_at").to_numpy(zero_copy_only=False)
        change = np.ones(n, bool)
        if n > 1:
            change[1:] = pc.not_equal(ids.slice(1), ids.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        head = ids[0].as_py()
        change[0] = last is not None and head != last
        if first is None:
            first = head
        group = np.cumsum(change)  # 0: still the key that the batch before ended with (or the partition's first)
        by = pd.DataFrame({"end": np.where(kind == PARENT, stop, NONE), "known": (kind == HEADER).astype(np.int8)}).groupby(group, sort=False)
        best, seen = by["end"].cummax().to_numpy(), by["known"].cummax().to_numpy().astype(bool)
        best, seen = best.copy(), seen.copy()
        carried = group == 0
        best[carried] = np.maximum(best[carried], end)
        seen[carried] |= known
        opened = pc.equal(ids, first).to_numpy(zero_copy_only=False)
        keep = np.flatnonzero((kind == REFERENCE) & (opened | (best <= at)))
        last, end, known = ids[n - 1].as_py(), int(best[-1]), bool(seen[-1])
        if len(keep):
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keep), pid, np.int32)), pa.array(np.where(opened[keep], 1, 0).astype(np.int32)), ids.take(take), pa.array(at[keep]), b.column("ref_id").take(take), b.column("end_name").take(take), pa.array(best[keep]), pa.array(seen[keep]), pa.array(np.zeros(len(keep), bool))],
                schema=_ARROW,
            )
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"pid": pid, "row_kind": 2, "node_id": last, "at": 0, "ref_id": None, "end_name": None, "best_end": end, "known": known, "alone": first == last}], schema=_ARROW)


def _carried(states: list) -> list[tuple[int, str, int, bool]]:
    """For each partition the state with which it begins: that of the key in which the one before it ended."""
    out, at, end, known = [], None, NONE, False
    for s in sorted(states, key=lambda s: s.pid):
        if at is not None:
            out.append((s.pid, at, end, known))
        if s.alone and at == s.node_id:
            end, known = max(end, s.best_end), known or s.known
        else:
            at, end, known = s.node_id, s.best_end, s.known
    return out


def orphans(refs: DataFrame, parents: Iterable[DataFrame], parts: int | None = None) -> DataFrame:
    """(ref_id, end_name, node_id, at, reason) of the references whose key has no row valid at `at`.

    `refs` is (ref_id, end_name, node_id, at), `parents` are (node_id, start_at, end_at), times in microseconds.
    reason: `missing` if the key has no row at all, `late` if all its rows start after `at`, else `deleted`.
    A validity holds from its start until before its end; an end at or before the start never holds.
    Empty inputs give an empty result; without parents all references are `missing`.
    """
    spark = refs.sparkSession
    valid = None
    for p in parents:
        p = p.select("node_id", "start_at", "end_at")
        valid = p if valid is None else valid.unionByName(p)
    rows = refs.select("node_id", F.col("at"), F.lit(REFERENCE).alias("row_kind"), F.lit(0).cast("long").alias("end_at"), "ref_id", "end_name")
    if valid is not None:
        none = F.lit(None).cast("string")
        rows = (
            valid.groupBy("node_id").agg(F.lit(BEFORE_ALL).cast("long").alias("at"), F.lit(HEADER).alias("row_kind"), F.lit(NONE).cast("long").alias("end_at"), none.alias("ref_id"), none.alias("end_name"))
            .unionByName(valid.select("node_id", F.col("start_at").alias("at"), F.lit(PARENT).alias("row_kind"), "end_at", none.alias("ref_id"), none.alias("end_name")))
            .unionByName(rows)
        )
    order = ["node_id", "at", "row_kind", "ref_id", "end_name"]
    merged = rows.repartitionByRange(parts or partitions(spark), *order).sortWithinPartitions(*order)
    done = written(merged.mapInArrow(_scan, _SCANNED))
    # One state per partition of the merge, never one per key or row.
    carry = _carried(done.where("row_kind = 2").select("pid", "node_id", "best_end", "known", "alone").collect())
    before = spark.createDataFrame(carry, "pid int, before_id string, before_end long, before_known boolean")
    same = F.col("row_kind").eqNullSafe(1) & F.col("node_id").eqNullSafe(F.col("before_id"))
    closed = (
        done.where("row_kind < 2")
        .join(F.broadcast(before), "pid", "left")
        .withColumn("best_end", F.when(same, F.greatest("best_end", "before_end")).otherwise(F.col("best_end")))
        .withColumn("known", F.when(same, F.col("known") | F.col("before_known")).otherwise(F.col("known")))
        .where("best_end <= at")
    )
    reason = F.when(~F.col("known"), "missing").when(F.col("best_end") == NONE, "late").otherwise("deleted")
    return closed.select("ref_id", "end_name", "node_id", "at", reason.alias("reason"))


def orphan_edges(edges: DataFrame, nodes: DataFrame, *shared: DataFrame) -> DataFrame:
    """Orphan ends of a graph's edges: (edge_id, end_name, node_id, reason, period), period `YYYY-MM` of the edge's `scanned_at`.

    `nodes` is valid from `scanned_at` until `removed_at`, each of `shared` from `scanned_at` on.
    Null ids, ends and times make no reference; repeated rows count once; columns beyond those named are not read.
    """
    found = orphans(references(edges), [intervals(nodes), *(intervals(s, end=None) for s in shared)])
    return found.select(F.col("ref_id").alias("edge_id"), "end_name", "node_id", "reason", F.date_format(F.expr("date_add(date '1970-01-01', cast(floor(at / 86400000000) as int))"), "yyyy-MM").alias("period"))


def orphans_by_period(found: DataFrame) -> DataFrame:
    """Orphan ends counted per end, reason and month."""
    return found.groupBy("end_name", "reason", "period").agg(F.count("*").alias("orphan_ends"), F.countDistinct("node_id").alias("orphan_ids"))
