"""Parent-child links to full hierarchies, in a number of rounds that is logarithmic in the depth.

Upward pass: every node holds a pointer 2^k levels up and the count of its descendants less than 2^k levels down; a round
adds to each node the counts of those that point at it, and doubles the pointers. That gives subtree sizes, depth and
root. Nodes that reach a root leave the loop. Nodes that never do are unprocessed: they lie on a loop or below one.
Downward pass: siblings get consecutive preorder ranges by prefix sums of subtree sizes, and a node's number is the sum of
such offsets from the root down, again by doubling. The ranges (nested sets) answer ancestors and descendants by one sweep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import folded, key
from ..session import BROADCAST_ROWS, counted, discard, few_kinds, partitions, small, written

#: Siblings are summed in this many buckets, so that no task holds all children of one parent.
SIBLING_BUCKETS = 256


def links(edges: DataFrame, types: tuple[str, ...] = ("contains", "defines")) -> DataFrame:
    """(node_id, parent_id): each id at either end of a link, with its parent or null.

    Of several parents of a child the smallest id counts, so the result is a forest with loops. A link with one null or
    blank end adds its other end as a node. Repeated links count once.
    """
    own = edges.where(folded("type").isin(*types)).select(key("source_id").alias("p"), key("target_id").alias("c"))
    ends = own.select(F.inline(F.array(F.struct(F.col("c").alias("node_id"), F.col("p").alias("parent_id")), F.struct(F.col("p").alias("node_id"), F.lit(None).cast("string").alias("parent_id")))))
    return ends.where("node_id is not null").groupBy("node_id").agg(F.min("parent_id").alias("parent_id"))


def _leap(state: DataFrame, closed: list[DataFrame], up: bool) -> tuple[DataFrame, DataFrame]:
    """One doubling of the open rows of `state` (node_id, anc, way, root_id, size); returns them moved, and what was asked for.

    A pointer `anc` jumps twice as far and `way` adds up; a row whose pointer passes a root is closed (anc null, root_id set).
    Rows that were closed before stay where they are, in `closed`, and are only looked up. With `up`, sizes flow to the
    nodes that are pointed at: the second result is (anc, n, more), also for closed nodes.
    """
    open_ = state.where("anc is not null")
    asked = open_.groupBy("anc").agg(F.count("*").alias("n"), F.sum("size").alias("more"))
    known = _all([state, *closed]).select(F.col("node_id").alias("anc"), F.col("anc").alias("anc2"), F.col("way").alias("way2"), F.col("root_id").alias("root2"))
    moved = _spread(open_, known.join(few_kinds(asked.select("anc", "n"), state), "anc"), state)
    if up:
        more = few_kinds(asked.select(F.col("anc").alias("node_id"), "more"), state)
        moved = moved.join(more, "node_id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0)))
    moved = moved.select("node_id", F.col("anc2").alias("anc"), (F.col("way") + F.col("way2")).alias("way"), F.col("root2").alias("root_id"), "size")
    return written(moved, kinds=F.col("anc"), open=F.col("anc")), asked


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _spread(open_: DataFrame, answers: DataFrame, state: DataFrame) -> DataFrame:
    """Open rows of the written `state` with the answer to their pointer; `answers` is a row per `anc` that says by `n` how
    many rows share it. Few answers are broadcast; of many, those that many rows share are, so no task holds all rows
    below one node."""
    first = few_kinds(answers, state)
    if first is not answers:
        return open_.join(first, "anc")
    most = max(10_000, counted(state) // BROADCAST_ROWS)  # so fewer than BROADCAST_ROWS pointers are shared by more rows
    rest = open_.join(F.broadcast(answers.where(F.col("n") > most).select("anc")), "anc", "left_anti")
    return open_.join(F.broadcast(answers.where(F.col("n") > most)), "anc").unionByName(rest.join(answers.where(F.col("n") <= most), "anc"))


def _climbed(tree: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rounds until no further node reaches its root: returns the tree, written; (node_id, root_id, depth, size) of the nodes
    that did; node_id of those that never did; and how many they are."""
    root = F.when(F.col("parent_id").isNull(), F.col("node_id"))
    start = written(tree.select("node_id", F.col("parent_id").alias("anc"), F.col("parent_id").isNotNull().cast("int").cast("long").alias("way"), root.alias("root_id"), F.lit(1).cast("long").alias("size")), kinds=F.col("anc"), open=F.col("anc"))
    state, closed, flows = start, [], []
    left = counted(state, "open")
    while left:
        after, asked = _leap(state, closed, True)
        closed.append(state.where("anc is null"))
        flows.append(asked)
        now, state = counted(after, "open"), after
        if now == left:  # depths have no gaps: were a node deeper, one would have been resolved in this round
            break
        left = now
    # Rows that were open have what flowed to them; what flowed to a node after it was closed, in a later round, is added here.
    done = _all([c.select("node_id", "root_id", F.col("way").alias("depth"), "size", F.lit(n).alias("at")) for n, c in enumerate([*closed, state.where("anc is null")])])
    none = F.lit(None).cast("string").alias("root_id"), F.lit(None).cast("long").alias("depth")
    rows = _all([done, *(f.select(F.col("anc").alias("node_id"), *none, F.col("more").alias("size"), F.lit(n).alias("at")) for n, f in enumerate(flows))])
    is_node = F.col("root_id").isNotNull()
    flown = F.collect_list(F.when(~is_node, F.struct("at", "size")))  # at most a row per round
    one = rows.groupBy("node_id").agg(F.max("root_id").alias("root_id"), F.max("depth").alias("depth"), F.max(F.when(is_node, F.col("size"))).alias("own"), F.max(F.when(is_node, F.col("at"))).alias("at"), flown.alias("flown")).where("root_id is not null")
    later = F.aggregate(F.filter("flown", lambda x: x["at"] >= F.col("at")), F.lit(0).cast("long"), lambda acc, x: acc + x["size"])
    whole = start.select("node_id", F.col("anc").alias("parent_id"))
    return whole, one.select("node_id", "root_id", F.col("depth").cast("int").alias("depth"), (F.col("own") + later).alias("size")), state.where("anc is not null").select("node_id"), left


def _on_loops(unresolved: DataFrame) -> DataFrame:
    """node_id of the nodes on a loop, from (node_id, parent_id). The set reached by jumps from all unresolved nodes shrinks
    to just these."""
    jump = written(unresolved.select("node_id", F.col("parent_id").alias("anc")), kinds=F.col("anc"))
    reached = -1
    while True:
        asked = jump.groupBy("anc").agg(F.count("*").alias("n"))
        now = asked.count()
        if now == reached:
            return asked.select(F.col("anc").alias("node_id"))
        reached = now
        answers = jump.select(F.col("node_id").alias("anc"), F.col("anc").alias("anc2")).join(few_kinds(asked, jump), "anc")
        after = written(_spread(jump, answers, jump).select("node_id", F.col("anc2").alias("anc")), kinds=F.col("anc"))
        discard(jump)
        jump = after


def _preorder(nodes: DataFrame) -> DataFrame:
    """(node_id, pre) of the nodes of trees: the root has 0, siblings follow in the order of a hash of their id."""
    bucket = F.pmod(F.xxhash64("node_id"), F.lit(SIBLING_BUCKETS)).cast("int")
    kids = nodes.where("parent_id is not null").select("node_id", "parent_id", "root_id", "size", bucket.alias("bucket"))
    sums = kids.groupBy("parent_id", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = F.coalesce(F.sum("bucket_size").over(W.partitionBy("parent_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("parent_id", "bucket", earlier.alias("bucket_start"))
    inside = F.coalesce(F.sum("size").over(W.partitionBy("parent_id", "bucket").orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = kids.withColumn("inside", inside).join(starts, ["parent_id", "bucket"]).select("node_id", F.col("parent_id").alias("anc"), (1 + F.col("bucket_start") + F.col("inside")).alias("way"), F.lit(None).cast("string").alias("root_id"), F.lit(0).cast("long").alias("size"))
    roots = nodes.where("parent_id is null").select("node_id", F.lit(None).cast("string").alias("anc"), F.lit(0).cast("long").alias("way"), "root_id", F.lit(0).cast("long").alias("size"))
    state, closed = written(offsets.unionByName(roots), kinds=F.col("anc"), open=F.col("anc")), []
    while counted(state, "open"):
        after, _ = _leap(state, closed, False)
        closed.append(state.where("anc is null"))
        state = after
    return _all([state, *closed]).select("node_id", F.col("way").alias("pre"))


def hierarchy(tree: DataFrame) -> DataFrame:
    """(node_id, parent_id, root_id, depth, loop_state, size, pre, last) from (node_id, parent_id).

    A tree's nodes have numbers `pre` from 0, parents before children, and `last` is the highest number below a node:
    b is below a exactly if both have one root and a.pre < b.pre <= a.last. `size` counts the node itself.
    loop_state is `none`, or `on` a loop or `below` one; these have root_id '', depth -1 and null size, pre and last.
    parent_id must be null or occur as a node_id. An empty table gives an empty result.
    """
    tree, done, lost, left = _climbed(tree)
    nodes = written(tree.join(done, "node_id"))
    trees = nodes.join(_preorder(nodes), "node_id").select("node_id", "parent_id", "root_id", "depth", F.lit("none").alias("loop_state"), "size", "pre", (F.col("pre") + F.col("size") - 1).alias("last"))
    if not left:
        return trees
    lost = written(tree.join(small(lost, rows=left, bytes_=128 * left), "node_id", "left_semi"))
    on = _on_loops(lost).withColumn("is_on", F.lit(True))
    loops = lost.join(on, "node_id", "left").select("node_id", "parent_id", F.lit("").alias("root_id"), F.lit(-1).alias("depth"), F.when(F.col("is_on"), "on").otherwise("below").alias("loop_state"), *(F.lit(None).cast("long").alias(c) for c in ("size", "pre", "last")))
    return trees.unionByName(loops)


def node_paths(tree: DataFrame, separator: str = "/") -> DataFrame:
    """(node_id, path): the ids from the root down to the node, joined; nodes on or below loops have none."""
    state, closed, left = written(tree.select("node_id", F.col("parent_id").alias("anc"), F.col("node_id").alias("path")), kinds=F.col("anc"), open=F.col("anc")), [], -1
    while (now := counted(state, "open")) not in (0, left):
        left, open_ = now, state.where("anc is not null")
        asked = few_kinds(open_.groupBy("anc").agg(F.count("*").alias("n")), state)
        answers = _all([state, *closed]).select(F.col("node_id").alias("anc"), F.col("anc").alias("anc2"), F.col("path").alias("path2")).join(asked, "anc")
        moved = _spread(open_, answers, state).select("node_id", F.col("anc2").alias("anc"), F.concat_ws(separator, "path2", "path").alias("path"))
        closed.append(state.where("anc is null"))
        state = written(moved, kinds=F.col("anc"), open=F.col("anc"))
    return _all([state.where("anc is null"), *closed]).select("node_id", "path")


_SWEPT = "ancestor_id string, node_id string, levels int"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows sorted by (part_no, root_id, pre, header first): a stack holds the ranges that are open."""
    part, root = None, None
    ids: list[str] = []
    lasts: list[int] = []
    depths: list[int] = []
    for b in batches:
        up, down, levels = [], [], []
        for no, at, pre, header, node, last, depth, asked in zip(*(b.column(n).to_pylist() for n in ("part_no", "root_id", "pre", "own", "node_id", "last", "depth", "is_asked"))):
            if no != part or at != root:
                part, root = no, at
                ids, lasts, depths = [], [], []
            if header:  # the node itself, not an open range from before this part
                while lasts and lasts[-1] < pre:
                    ids.pop(), lasts.pop(), depths.pop()
                up += ids
                down += [node] * len(ids)
                levels += [depth - d for d in depths]
            if asked and last > pre:
                ids.append(node), lasts.append(last), depths.append(depth)
            if len(up) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(up, pa.string()), pa.array(down, pa.string()), pa.array(levels, pa.int32())], names=["ancestor_id", "node_id", "levels"])
                up, down, levels = [], [], []
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(up, pa.string()), pa.array(down, pa.string()), pa.array(levels, pa.int32())], names=["ancestor_id", "node_id", "levels"])


def descendants(nodes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(ancestor_id, node_id, levels): all nodes below each node_id of `asked` (default: all), from the nested-set ranges.

    Nodes are range-partitioned and sorted by (root, pre), and each part is swept once with a stack of the ranges that are
    open, which costs its nodes and results and no pair besides. The ranges that are open where a part begins, at most the
    tree's depth for each part, come before its rows. Nodes on or below loops have no range and no row.
    """
    spark = nodes.sparkSession
    own = nodes.where("pre is not null").select("node_id", "root_id", "pre", "last", "depth")
    own = own.withColumn("is_asked", F.lit(True)) if asked is None else own.join(asked.select("node_id").distinct().withColumn("is_asked", F.lit(True)), "node_id", "left").withColumn("is_asked", F.coalesce("is_asked", F.lit(False)))
    order = ["root_id", "pre"]
    placed = written(own.repartitionByRange(4 * partitions(spark), *order).sortWithinPartitions(*order).withColumn("part_no", F.spark_partition_id()))
    begins = written(placed.groupBy("part_no").agg(F.min(F.struct(*order)).alias("b")).select(F.col("part_no").alias("begin_no"), F.col("b.root_id").alias("root_id"), F.col("b.pre").alias("begin_pre")))  # a row per part
    before = placed.where("is_asked and last > pre").join(F.broadcast(begins), "root_id").where("pre < begin_pre and begin_pre <= last")
    # An open range keeps its own number, which is below all of the part's, so it comes first, outer before inner.
    before = before.select("node_id", "root_id", "pre", "last", "depth", "is_asked", F.col("begin_no").alias("part_no"), F.lit(False).alias("own"))
    rows = placed.withColumn("own", F.lit(True)).unionByName(before)
    return rows.repartition(4 * partitions(spark), "part_no").sortWithinPartitions("part_no", *order).mapInArrow(_sweep, _SWEPT)
