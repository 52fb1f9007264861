"""Settings files to key/value rows, at any depth of nesting."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(value, key: str = "") -> Iterator[tuple[str, str]]:
    """(key, text) of every scalar: `a:b` for properties, `a[0]` for items. Empty objects and lists vanish; null is empty
    text, booleans are `True` and `False`, other scalars read as written."""
    todo = [(key, value)]
    while todo:  # a stack, so that depth is not bounded by recursion
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += reversed([(f"{at}:{k}" if at.strip() else k, x) for k, x in v.items()])
        elif isinstance(v, list):
            todo += reversed([(f"{at}[{i}]", x) for i, x in enumerate(v)])
        else:
            yield at, "" if v is None else str(v)


class _Number(str):
    """A number as it was written."""


def parse(text: str):
    """JSON with numbers as written; raises ValueError for anything else."""
    return json.loads(text.lstrip("﻿"), parse_int=_Number, parse_float=_Number, parse_constant=_reject)


def _reject(name: str):
    raise ValueError(name)


def flatten_rows(files: DataFrame, keep: list[str], text_col: str = "content") -> DataFrame:
    """(keep..., key, value, failed, place): a row per scalar of each text, in order from 0; a text that is no JSON gives one row with failed = true.

    Null texts give no row. Python is needed because the depth is not bounded; texts pass as Arrow batches.
    """
    fields = {f.name: f.dataType.simpleString() for f in files.select(*keep).schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys, values, failed, places = [], [], [], [], []
            for i, text in enumerate(b.column(text_col).to_pylist()):
                try:
                    rows = [(k, v, False) for k, v in flatten(parse(text))]
                except (ValueError, RecursionError):
                    rows = [(None, None, True)]
                places += range(len(rows))
                for k, v, bad in rows:
                    at.append(i)
                    keys.append(k)
                    values.append(v)
                    failed.append(bad)
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(own) for k in keep), pa.array(keys, pa.string()), pa.array(values, pa.string()), pa.array(failed, pa.bool_()), pa.array(places, pa.int32())], names=[*keep, "key", "value", "failed", "place"])

    schema = ", ".join(f"`{k}` {t}" for k, t in fields.items())
    return files.where(F.col(text_col).isNotNull()).select(*keep, text_col).mapInArrow(run, f"{schema}, key string, value string, failed boolean, place int")
