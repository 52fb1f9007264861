"""Session helpers: where intermediate tables live, and how large a table may be before it is not broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only when it has at most this many rows and bytes; every caller has another way beyond it.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or one of our own where that is unset (tests).

    A folder of one machine is of use only where all tasks run there, so off local mode an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value) + 16
    if isinstance(kind, T.ArrayType):
        inner = F.octet_length(F.array_join(value, "")) if isinstance(kind.elementType, T.StringType) else F.lit(0)
        return inner + 24 * F.size(value) + 16
    if isinstance(kind, (T.MapType, T.StructType)):
        return F.length(F.to_json(value)) + 32
    return F.lit(8)


def written(df: DataFrame, by: tuple[str, ...] = (), kinds: Column | None = None, **counts: Column) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it back.

    The files outlive any executor, so a lost executor costs a re-read and not a re-run of everything before. Rows and
    bytes are counted on the way, and the values of each of `counts` that are not null; see `counted`. `kinds` is a column
    whose distinct values are estimated (see `few_kinds`). `by` names columns whose values become folders, so that a filter
    on them reads only its part.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    seen = Observation()
    bytes_ = sum((F.coalesce(_width(F.col(f"`{f.name}`"), f.dataType).cast("long"), F.lit(8)) for f in df.schema), F.lit(0).cast("long"))
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(bytes_).alias("bytes"), *([] if kinds is None else [F.approx_count_distinct(kinds).alias("kinds")]), *(F.count(c).alias(n) for n, c in counts.items())).write.partitionBy(*by).parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path).select(*(f"`{c}`" for c in df.columns))
    back._graphloom_path, back._graphloom_counts = path, seen.get
    return back


def counted(df: DataFrame, name: str = "rows") -> int:
    """A count that `written` took of this table."""
    return df._graphloom_counts[name] or 0


def few_kinds(df: DataFrame, of: DataFrame) -> DataFrame:
    """`df`, a row per distinct value of the `kinds` of the written table `of`, with a broadcast hint if those are few.
    Five standard errors are added to the estimate of their number."""
    rows = counted(of, "kinds") * 5 // 4 + 1
    return small(df, rows=rows, bytes_=rows * (2 * counted(of, "bytes") // max(1, counted(of)) + 64))


def discard(df: DataFrame | None) -> None:
    """Delete a table made by `written` once no plan reads it any more (superseded rounds of a loop)."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone, and its scratch folder with it
            return


@contextmanager
def released() -> Iterator[None]:
    """Deletes the intermediate tables written inside; use it around a query whose result is saved or collected there."""
    before = {path for _, path in _written}
    try:
        yield
    finally:
        for spark, path in [x for x in _written if x[1] not in before]:
            _delete(spark, path)
            _written.remove((spark, path))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, of: DataFrame | None = None, rows: int | None = None, bytes_: int = 0) -> DataFrame:
    """`df` with a broadcast hint if its rows and bytes are few enough, else `df` for a shuffled join.

    Its size is that of the written table `of` that it is made from, row for row or less, or `rows` and `bytes_` where the
    caller has counted them. Where nothing is given, a written table's own size is taken, and another table is counted as
    far as needed.
    """
    counts = getattr(df if of is None else of, "_graphloom_counts", None)
    if rows is None and counts is None:
        rows = df.limit(BROADCAST_ROWS + 1).count()
    elif rows is None:
        rows, bytes_ = counts["rows"], counts["bytes"] or 0
    return F.broadcast(df) if rows <= BROADCAST_ROWS and bytes_ <= BROADCAST_BYTES else df


def shared(spark: SparkSession, value):
    """Send a bounded value to the executors once; call the result there to get it. Needs no package on executors, and a
    worker process unpacks it once for all its tasks."""
    from pyspark import cloudpickle

    sent = spark.sparkContext.broadcast([cloudpickle.dumps(value)])

    def get():
        import pickle

        box = sent.value  # the same list in every task of a worker
        if len(box) == 1:
            box[:] = [None, pickle.loads(box[0])]
        return box[1]

    return get
