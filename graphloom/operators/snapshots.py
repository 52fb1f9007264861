"""What changed between full snapshots.

Rows become (id, snapshot, digest) before anything is shuffled. All snapshots are range-partitioned and sorted by id
together; each snapshot of a partition is cut into chunks where the hash of an id says so, which puts the cuts of two
snapshots at the same ids however many rows lie between. Chunks with equal digests in neighbouring snapshots are dropped,
and only the rows of the other chunks are joined to tell added, removed and changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import folded, key
from ..session import partitions

#: A row starts a chunk if its id's hash is divisible by this: the mean number of rows in a chunk.
CHUNK_ROWS = 32
#: Columns whose values are names, compared without case and surrounding blanks.
NAMES = ("type", "display_name", "repository_name", "project_name", "source_id", "target_id")
#: Columns that say where and when a row was delivered, not what the record is.
DELIVERY = ("doc_pos", "taken_at", "loaded_at")
_OUT = pa.schema([("row_id", pa.string()), ("snap", pa.int32()), ("side", pa.int8()), ("digest", pa.int64())])


def _plain(df: DataFrame, name: str, names: tuple[str, ...]) -> Column:
    """A column as text in which null differs from every value and the entry order of a map does not show."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.MapType):
        c = F.to_json(F.array_sort(F.map_entries(c)), {"ignoreNullFields": "false"})
    elif isinstance(kind, (T.StructType, T.ArrayType, T.VariantType)):
        c = F.to_json(c, {"ignoreNullFields": "false"})
    elif isinstance(kind, T.StringType) and name in names:
        c = folded(c)
    return F.coalesce(c.cast("string"), F.lit("\\u0000"))


def row_digests(df: DataFrame, id_col: str = "id", order_col: str = "snapshot_no", ignored: tuple[str, ...] = DELIVERY, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(row_id, snapshot_no, digest): one row per id and snapshot. Rows without id or snapshot number are left out.

    Rows repeated inside a snapshot collapse before the shuffle; should they differ, the smallest digest counts.
    Every column but the id, the snapshot number and `ignored` counts, extra ones too.
    """
    values = [c for c in df.columns if c not in (id_col, order_col, *ignored)]
    return (
        df.select(key(id_col).alias("row_id"), F.col(order_col).cast("int").alias("snapshot_no"), F.xxhash64(F.lit(0), *(_plain(df, c, names) for c in sorted(values))).alias("digest"))
        .where("row_id is not null and snapshot_no is not null")
        .groupBy("row_id", "snapshot_no")
        .agg(F.min("digest").alias("digest"))
    )


def _differing(snaps: list[int]):
    """A pass over a partition sorted by id: the rows of chunks that no chunk of the neighbouring snapshot equals."""
    place = {s: i for i, s in enumerate(snaps)}

    def compared(rid: pa.Array, sn: np.ndarray, dg: np.ndarray, hs: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = hs % CHUNK_ROWS == 0
        chunks: dict[int, tuple] = {}
        for s in np.unique(sn):
            rows = np.flatnonzero(sn == s)
            number = np.cumsum(cut[rows])  # 0: before the first cut, that is from the partition's start on
            starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            length = np.diff(np.r_[starts, len(rows)])
            # A digest of the chunk: sums over its rows of two mixes of id hash and row digest, which wrap around.
            d, h = dg[rows].view(np.uint64), hs[rows].view(np.uint64)
            mixed = (d ^ (h * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            chunks[place[int(s)]] = (rows, starts, length, np.add.reduceat(mixed, starts), np.add.reduceat(mixed * (d | np.uint64(1)), starts))
        for i, (rows, starts, length, one, two) in chunks.items():
            for side, other in ((0, i + 1), (1, i - 1)):  # side 0: as the earlier of two snapshots, 1: as the later
                if not 0 <= other < len(snaps):
                    continue
                near = chunks.get(other)
                same = set(zip(near[2].tolist(), near[3].tolist(), near[4].tolist())) if near else set()
                differs = np.fromiter((x not in same for x in zip(length.tolist(), one.tolist(), two.tolist())), bool, len(length))
                keep = rows[np.repeat(differs, length)]
                if len(keep):
                    later = snaps[max(i, other)]
                    yield pa.RecordBatch.from_arrays([rid.take(pa.array(keep)), pa.array(np.full(len(keep), later, np.int32)), pa.array(np.full(len(keep), side, np.int8)), pa.array(dg[keep])], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, snap, digest, hashes, held = [], [], [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            ids.append(b.column("row_id"))
            snap.append(b.column("snapshot_no").to_numpy())
            digest.append(b.column("digest").to_numpy())
            hashes.append(b.column("id_hash").to_numpy())
            held += b.num_rows
            if held >= BLOCK_ROWS:
                # Cut at the last id whose hash starts a chunk: all snapshots share that cut, so what lies before is complete.
                rid, h = pa.concat_arrays(ids), np.concatenate(hashes)
                at = np.flatnonzero(h % CHUNK_ROWS == 0)
                if len(at):
                    name = rid[int(at[-1])]
                    k = int(at[-1])
                    while k and rid[k - 1] == name:
                        k -= 1
                    if k:
                        sn, dg = np.concatenate(snap), np.concatenate(digest)
                        yield from compared(rid.slice(0, k), sn[:k], dg[:k], h[:k])
                        ids, snap, digest, hashes, held = [rid.slice(k)], [sn[k:]], [dg[k:]], [h[k:]], len(h) - k
        if ids:
            yield from compared(pa.concat_arrays(ids), np.concatenate(snap), np.concatenate(digest), np.concatenate(hashes))

    return run


#: Rows that a pass holds at once, all snapshots together.
BLOCK_ROWS = 200_000


def changes(digests: DataFrame, parts: int | None = None) -> DataFrame:
    """(row_id, snapshot_no, change_kind) between neighbouring snapshots, from (row_id, snapshot_no, digest).

    snapshot_no is that of the later snapshot; neighbours follow in the order of the numbers that occur, gaps do not matter.
    change_kind is `added`, `removed` or `changed`. The first snapshot reports nothing; fewer than two give no rows.
    """
    spark = digests.sparkSession
    # The numbers of the snapshots: one small row each, not data.
    snaps = [r.snapshot_no for r in digests.select("snapshot_no").distinct().orderBy("snapshot_no").collect()]
    none = F.lit(None).cast("string")
    if len(snaps) < 2:
        return digests.where("false").select("row_id", "snapshot_no", none.alias("change_kind"))
    ordered = digests.withColumn("id_hash", F.xxhash64("row_id")).repartitionByRange(parts or partitions(spark), "row_id").sortWithinPartitions("row_id", "snapshot_no")
    rest = ordered.mapInArrow(_differing(snaps), "row_id string, snap int, side byte, digest long")
    was, now = F.col("was"), F.col("now")
    kind = F.when(was.isNull(), "added").when(now.isNull(), "removed").when(was != now, "changed")
    return (
        rest.groupBy("row_id", F.col("snap").alias("snapshot_no"))
        .agg(F.max(F.when(F.col("side") == 0, F.col("digest"))).alias("was"), F.max(F.when(F.col("side") == 1, F.col("digest"))).alias("now"))
        .select("row_id", "snapshot_no", kind.alias("change_kind"))
        .where("change_kind is not null")
    )


def snapshot_changes(tables: dict[str, DataFrame]) -> DataFrame:
    """(record_kind, id, snapshot_no, change_kind) over several kinds of snapshot tables, `{record_kind: table}`."""
    out = None
    for name, df in tables.items():
        one = changes(row_digests(df)).select(F.lit(name).alias("record_kind"), F.col("row_id").alias("id"), "snapshot_no", "change_kind")
        out = one if out is None else out.unionByName(one)
    return out
