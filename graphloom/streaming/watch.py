"""Change rows to rebuilds: relevance, batches of fixed delay, and the stream that does both.

A change is (ts, kind, path, old_path). The first change opens a batch, which takes everything that arrives in the next
`delay`; changes after that open the next one. Later changes do not extend a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

#: Milliseconds: the usual and the least delay of a batch.
DELAY_MS, LEAST_DELAY_MS = 1500, 100
#: Reasons named in a digest.
NAMED = 5


def exploded(changes: DataFrame) -> DataFrame:
    """(ts, kind, path, ...): a rename counts for its old and its new path."""
    both = F.when(F.lower("kind") == "renamed", F.array_compact(F.array("old_path", "path"))).otherwise(F.array("path"))
    return changes.withColumn("path", F.explode(both)).drop("old_path")


def relevant(changes: DataFrame, root: str, excluded: list[str], ignore_file: str = ".graphignore") -> DataFrame:
    """Changes that call for a rebuild, with their reason `Kind: relative/path`."""
    pats = F.array(*map(F.lit, excluded)).cast("array<string>")
    kept = exploded(changes).where(P.calls_for_rescan(F.col("path"), F.lit(root), pats, ignore_file))
    return kept.withColumn("reason", P.change_reason(F.col("kind"), F.col("path"), F.lit(root)))


def digest(reasons: Column) -> Column:
    """The first five distinct reasons (without regard to case) of an array in order, and how many more."""
    empty = F.array().cast("array<string>")
    distinct = F.aggregate(reasons, empty, lambda acc, r: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(r)), acc).otherwise(F.array_append(acc, r)))
    more = F.size(distinct) - NAMED
    return F.concat(F.array_join(F.slice(distinct, 1, NAMED), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def batches(events: DataFrame, key: str, delay_us: int, at: str = "at_us", order: str = "event_id") -> DataFrame:
    """(key, batch_no, opened_us, events): batches of fixed delay per key over event times in microseconds.

    Event times are first reduced to one row per key and time, so what a task walks is the distinct times of a key. The walk
    is a fold: each batch opens at the first time not before the end of the one before, which no window can express.
    """
    times = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.count("*").alias("n"))

    def walk(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, end, no, opened, count = None, 0, 0, 0, 0
        for pdf in rows:
            out = []
            for k, t, n in pdf.itertuples(index=False):
                if k != own or t >= end:
                    if own is not None:
                        out.append((own, no, opened, count))
                    no = no + 1 if k == own else 0
                    own, opened, end, count = k, t, t + delay_us, 0
                count += n
            yield pd.DataFrame(out, columns=[key, "batch_no", "opened_us", "events"])
        if own is not None:
            yield pd.DataFrame([(own, no, opened, count)], columns=[key, "batch_no", "opened_us", "events"])

    kind = events.schema[key].dataType.simpleString()
    sorted_ = times.repartition(key).sortWithinPartitions(key, at).select(key, at, "n")
    return sorted_.mapInPandas(walk, f"{key} {kind}, batch_no int, opened_us long, events long")


_STATE = "reasons array<string>, opened_ms long"


def batched_stream(changes: DataFrame, delay_ms: int = DELAY_MS) -> DataFrame:
    """(workspace, reasons): a stream of batches from a stream of relevant changes (workspace, reason).

    The state of a workspace is the open batch; a processing-time timer of the fixed delay closes it, and what arrives
    meanwhile does not move the timer.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    delay = max(delay_ms, LEAST_DELAY_MS)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            reasons, _ = state.get
            state.remove()
            yield pd.DataFrame({"workspace": [key[0]], "reasons": [list(reasons)]})
            return
        reasons, opened = (list(state.get[0]), state.get[1]) if state.exists else ([], state.getCurrentProcessingTimeMs())
        have = {r.lower() for r in reasons}
        for pdf in pdfs:
            for r in pdf["reason"]:
                if r is not None and r.lower() not in have:
                    have.add(r.lower())
                    reasons.append(r)
        state.update((reasons, opened))
        state.setTimeoutDuration(max(1, opened + delay - state.getCurrentProcessingTimeMs()))

    return changes.select("workspace", "reason").groupBy("workspace").applyInPandasWithState(step, "workspace string, reasons array<string>", _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch(batches_: DataFrame, rebuild: Callable[[], object], log: Callable[[str], None] = print, checkpoint: str | None = None):
    """Start the stream: one rebuild first, then one per micro-batch that closes batches, with a digest of its reasons.

    `rebuild` writes its output itself, whole, and replaces what was there. Returns the query; stop() ends it.
    """
    rebuild()

    def act(df: DataFrame, _epoch: int) -> None:
        rows = df.select(digest(F.col("reasons")).alias("line")).collect()  # a row per workspace that is due
        if rows:
            for r in rows:
                log(f"Rescanning because: {r.line}")
            rebuild()

    writer = batches_.writeStream.outputMode("append").foreachBatch(act)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
