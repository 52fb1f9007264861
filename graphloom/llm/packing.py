"""Items of varying length into containers of several permitted capacities, with little unused space.

Best fit needs only how many items there are of each size, and sizes are whole numbers up to the largest capacity. So the
fit is made on that histogram: bins with equal contents are kept as one group, and an item size goes to the fullest group
that has room, for all its items at once. That is best fit in falling order over all items together, on bounded memory.
Where several capacities are permitted, a second rule opens each bin with the capacity that costs least for what it will
hold, and the cheaper layout counts. The items then get their places by their exact number among the items of their size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: Capacities may be at most this large; it bounds the histogram.
MOST_CAPACITY = 1 << 20


@dataclass
class Layout:
    """Runs place the items of a size: those numbered start .. start + items - 1 go to bins from `bin` on, `each` to a bin."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # size, start, items, bin, each
    bins: list[tuple[int, int, int]] = field(default_factory=list)  # first bin, how many, capacity after downsizing
    cost: int = 0


def best_fit(counts: dict[int, int], capacities: list[int], least: int = 0) -> Layout:
    """Lay `counts` (items by size) into bins. New bins get the permitted capacity, `least` or more, of least cost for
    what can still be put in; in the end every bin gets the smallest permitted capacity that holds its contents."""
    caps = sorted(capacities)
    out = Layout()
    groups: dict[int, list[tuple[int, int, int]]] = {}  # room left: (first bin, how many, capacity)
    rooms: list[int] = []
    bins = 0
    rest = sum(s * n for s, n in counts.items())  # tokens not yet placed

    def put(room: int, group: tuple[int, int, int]) -> None:
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append(group)

    for size in sorted(counts, reverse=True):
        number, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                fitting = [c for c in caps if c >= size and c >= least] or [caps[-1]]
                capacity = min(fitting, key=lambda c: (c / min(c, max(size, rest)), -c))
                each = min(capacity // size, left)
                many = left // each
                put(capacity, (bins, many, capacity))
                bins += many
                at = bisect.bisect_left(rooms, size)
            room = rooms[at]
            first, many, capacity = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = max(1, min(room // size, left // many))
            used = min(many, left // each)
            out.runs.append((size, number, used * each, first, each))
            put(room - size * each, (first, used, capacity))
            if used < many:
                put(room, (first + used, many - used, capacity))
            number, left, rest = number + used * each, left - used * each, rest - size * used * each
    for room, own in groups.items():
        for first, many, capacity in own:
            final = caps[bisect.bisect_left(caps, capacity - room)]
            out.bins.append((first, many, final))
            out.cost += many * final
    out.bins.sort()
    return out


def _filled(capacity: int, first: int, sizes: list[int], left: dict[int, int]) -> list[tuple[int, int]]:
    """What a bin holds that takes an item of size `first`, then always the largest that still fits: (size, how many)."""
    out, room = [], capacity
    at = bisect.bisect_right(sizes, first) - 1
    while at >= 0:
        size = sizes[at]
        n = min(left[size], room // size)
        if n:
            out.append((size, n))
            room -= n * size
        at = min(at, bisect.bisect_right(sizes, room)) - 1
    return out


def by_contents(counts: dict[int, int], capacities: list[int]) -> Layout:
    """Lay `counts` into bins whose capacity is chosen by what the bin will hold: for the largest item left, each permitted
    capacity is filled in trial from all items left, and the one of least cost per token placed is opened, as often as its
    contents are there. Each step uses up an item size, so there are no more steps than sizes."""
    caps, out, bins = sorted(capacities), Layout(), 0
    left = {s: n for s, n in counts.items() if n}
    number = dict.fromkeys(left, 0)
    sizes = sorted(left)
    while sizes:
        size = sizes[-1]
        trials = [(c, _filled(c, size, sizes, left)) for c in caps if c >= size]
        capacity, contents = min(trials, key=lambda x: (x[0] / sum(s * n for s, n in x[1]), -x[0]))
        many = min(left[s] // n for s, n in contents)
        for s, n in contents:
            out.runs.append((s, number[s], n * many, bins, n))
            number[s] += n * many
            left[s] -= n * many
            if not left[s]:
                sizes.pop(bisect.bisect_left(sizes, s))
        used = sum(s * n for s, n in contents)
        final = caps[bisect.bisect_left(caps, used)]
        out.bins.append((bins, many, final))
        out.cost += many * final
        bins += many
    return out


def least_cost(counts: dict[int, int], capacities: list[int]) -> Layout:
    """The cheapest of the layouts: best fit whose new bins have at least each of the permitted capacities, and bins opened by
    their contents."""
    layouts = [best_fit(counts, capacities, least) for least in sorted(capacities)]
    return min([*layouts, by_contents(counts, capacities)], key=lambda x: x.cost)


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, first_token, tokens): whole documents; one above `capacity` is cut into full pieces and a rest."""
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {capacity}")))
    cut = sizes.where("tokens > 0").select("doc_id", F.col("tokens").alias("all"), number.alias("piece_no"))
    first = F.col("piece_no") * capacity
    return cut.select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), first.alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("all") - first).alias("tokens"))


def _numbered(items: DataFrame) -> DataFrame:
    """Adds number: the place of an item among those of its size, from 0. Counts per input partition are prefix-summed,
    so a size that most items have is numbered in many tasks."""
    rows = written(items.withColumn("part_no", F.spark_partition_id()))
    counts = rows.groupBy("tokens", "part_no").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("tokens").orderBy("part_no").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("tokens", "part_no", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("tokens", "part_no").orderBy("doc_id", "piece_no"))
    return rows.withColumn("inside", inside).join(offsets, ["tokens", "part_no"]).withColumn("number", F.col("offset") + F.col("inside") - 1).drop("inside", "offset", "part_no")


def packed(sizes: DataFrame, capacities: list[int], layout: str) -> DataFrame:
    """(layout, container_no, capacity_tokens, doc_id, piece_no, first_token, tokens) for (doc_id, tokens).

    Every token of every document lies in exactly one container, and no container holds more than its capacity, which is
    one of `capacities`. Only documents above the largest of them are cut. Documents without tokens have no row. Rows
    repeated in `sizes` are laid out each.
    """
    caps = sorted({int(c) for c in capacities if c and c > 0})
    if not caps or caps[-1] > MOST_CAPACITY:
        raise ValueError(f"capacities must lie between 1 and {MOST_CAPACITY}: {capacities}")
    items = _numbered(pieces(sizes, caps[-1]))
    # At most one row per size up to the largest capacity.
    counts = {int(r.tokens): r.n for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    plan = least_cost(counts, caps)
    runs = np.array(plan.runs or np.empty((0, 5)), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    bins = np.array(plan.bins or np.empty((0, 3)), np.int64).reshape(-1, 3)
    sent = items.sparkSession.sparkContext.broadcast((runs, bins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, bins = sent.value
        sizes_, starts = np.unique(runs[:, 0], return_index=True)
        ends = np.r_[starts[1:], len(runs)]
        for b in batches:
            if not b.num_rows:
                continue
            size, number = b.column("tokens").to_numpy(), b.column("number").to_numpy()
            row = np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[order])) + 1
            for part in np.split(order, cuts):
                k = np.searchsorted(sizes_, size[part[0]])
                row[part] = starts[k] + np.searchsorted(runs[starts[k] : ends[k], 1], number[part], side="right") - 1
            own = runs[row]
            no = own[:, 3] + (number - own[:, 1]) // own[:, 4]
            capacity = bins[np.searchsorted(bins[:, 0], no, side="right") - 1, 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([layout] * len(no), pa.string()), pa.array(no), pa.array(capacity.astype(np.int32)), b.column("doc_id"), b.column("piece_no"), b.column("first_token"), b.column("tokens")],
                names=["layout", "container_no", "capacity_tokens", "doc_id", "piece_no", "first_token", "tokens"],
            )

    return items.select("doc_id", "piece_no", "first_token", "tokens", "number").mapInArrow(run, "layout string, container_no bigint, capacity_tokens int, doc_id bigint, piece_no int, first_token bigint, tokens bigint")


def container_layouts(sizes: DataFrame, kinds: DataFrame) -> DataFrame:
    """Layouts of all documents: one per container kind, with that capacity alone, and `joint`, which may use all of them.

    `kinds` is (container_kind, capacity_tokens), a list of permitted capacities. Adds container_kind to `packed`.
    """
    rows = [(r.container_kind, r.capacity_tokens) for r in kinds.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().collect()]
    sizes = written(sizes)
    names = kinds.sparkSession.createDataFrame([(c, min(k or "" for k, x in rows if x == c)) for c in sorted({c for _, c in rows})], "capacity_tokens int, container_kind string")
    out = None
    for layout, caps in [*((k, [c]) for k, c in sorted(rows, key=lambda r: r[1])), ("joint", [c for _, c in rows])]:
        if caps:
            one = packed(sizes, caps, layout)
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no permitted capacity")
    return out.join(F.broadcast(names), "capacity_tokens").select("layout", "container_no", "container_kind", "capacity_tokens", "doc_id", "piece_no", "first_token", "tokens")


def layout_check(sizes: DataFrame, laid: DataFrame, most_kept: DataFrame) -> DataFrame:
    """(layout, documents, overfull, cut_below, gaps, lost_tokens, is_tight) per layout, which must be: every document with
    tokens, and no container above its capacity, no document cut that fits the largest capacity of the layout
    (`most_kept`: layout, most), no document whose pieces leave a gap, no token lost, and at most twice the tokens of
    capacity in all besides one container, as any two bins of one kind hold more than one's capacity."""
    bins = laid.groupBy("layout", "container_no", "capacity_tokens").agg(F.sum("tokens").alias("t"))
    by_bin = bins.groupBy("layout").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"), F.sum("t").alias("laid"), F.sum("capacity_tokens").alias("capacity"))
    docs = laid.groupBy("layout", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces"), F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    docs = docs.join(F.broadcast(most_kept), "layout")
    by_doc = docs.groupBy("layout", "most").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("most"))).alias("cut_below"), F.count_if(F.col("end") != F.col("t")).alias("gaps"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    one = by_bin.join(F.broadcast(by_doc), "layout").join(F.broadcast(total))  # a row per layout, and one
    return one.select("layout", "documents", "overfull", "cut_below", "gaps", (F.col("all_tokens") - F.col("laid")).alias("lost_tokens"), (F.col("capacity") <= 2 * F.col("laid") + F.col("most")).alias("is_tight"))


def layout_use(laid: DataFrame) -> DataFrame:
    """Per layout: containers, tokens, capacity and the unused share."""
    own = laid.groupBy("layout", "container_no", "capacity_tokens").agg(F.sum("tokens").alias("tokens"))
    use = own.groupBy("layout").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("capacity_tokens").alias("capacity"))
    return use.withColumn("unused", 1 - F.col("tokens") / F.col("capacity"))
