"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import spread

__all__ = ["SALTS", "columns", "map_rows", "salted", "salted_semi", "spread"]

#: Parts into which the rows of one join key are cut by a hash of their id; adaptive execution splits a part further.
SALTS = 8


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Select input columns under the names an operator works with; further columns are left behind."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in names.items()))


def map_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterable[tuple]]], fields: list[tuple[str, pa.DataType]]
) -> DataFrame:
    """Narrow map of each row to any number of rows, in Arrow batches.

    ``make`` runs once per task and returns the function of one row's values, so
    tables, automata and memories are built once and not per row.
    """
    out_schema = pa.schema([pa.field(n, t) for n, t in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.extend(one(*values))
                if len(out) >= 20_000:
                    yield _batch(out, out_schema)
                    out = []
            if out:
                yield _batch(out, out_schema)

    return df.mapInArrow(work, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def salted(rows: DataFrame, keys: DataFrame, on: list[str], spread_by: str, how: str = "inner") -> DataFrame:
    """Join of many rows with few distinct keys, so that a key that a third of all rows have is no single task.

    Rows are cut into SALTS parts by a hash of ``spread_by`` and keys are repeated for each
    part; no row is lost, and equal rows stay equal.  Keys grow with the data, so they are never broadcast.
    """
    many = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    few = keys.withColumn("_salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    return many.join(few.hint("merge"), [*on, "_salt"], how).drop("_salt")


def salted_semi(rows: DataFrame, keys: DataFrame, on: list[str], spread_by: str) -> DataFrame:
    """Rows whose key is among the keys; see :func:`salted`."""
    return salted(rows, keys, on, spread_by, "left_semi")
