"""Runs a bytes kernel on each text in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 100_000  # of one output batch


def per_text(df: DataFrame, kernel: Callable, schema: str, keys: tuple[str, ...] = ("doc_id",), inputs: tuple[str, ...] = ("text",)) -> DataFrame:
    """kernel(*inputs) gives tuples for the columns after the keys; rows with a null input give none.

    A map without shuffle: texts are spread as they are read, one text is one task's work.
    """
    full = StructType.fromDDL(", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + schema)
    arrow = to_arrow_schema(full)

    def run(batches):
        held: list = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (*keys, *inputs)), strict=True):
                key, args = row[: len(keys)], row[len(keys) :]
                if any(a is None for a in args):
                    continue
                held.extend((*key, *x) for x in kernel(*args))
                if len(held) >= ROWS:
                    yield batch(held)
                    held = []
        yield batch(held)

    def batch(rows):
        columns = list(zip(*rows, strict=True)) or [[] for _ in arrow.names]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.select(*keys, *inputs).mapInArrow(run, full)
