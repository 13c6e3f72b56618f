"""Results as Arrow IPC, Parquet or newline-delimited JSON."""

from __future__ import annotations

import io
from enum import Enum

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ResultFormat(Enum):
    ARROW = 0
    PARQUET = 1
    JSON = 2

    @classmethod
    def from_number(cls, n: int) -> ResultFormat:
        """Numbers that aren't known mean Arrow."""
        return {1: cls.PARQUET, 2: cls.JSON}.get(n, cls.ARROW)


def _json_value(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)
    if isinstance(kind, T.BinaryType):
        return F.base64(col)
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("string")
    return col


def json_rows(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as a JSON object, nulls included, NaN and infinities as null, binary as base64."""
    cols = [_json_value(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def format_result(df: DataFrame, form: ResultFormat = ResultFormat.ARROW) -> bytes:
    """A result's bytes; a result without rows has none, in any format. Results come to the driver."""
    if form is ResultFormat.JSON:
        return "".join(r["value"] + "\n" for r in json_rows(df).toLocalIterator()).encode()
    table = df.toArrow()
    if not table.num_rows:
        return b""
    sink = io.BytesIO()
    if form is ResultFormat.PARQUET:
        pq.write_table(table, sink, compression="snappy")
    else:
        with pa.ipc.new_file(sink, table.schema) as w:
            w.write_table(table)
    return sink.getvalue()


def read_arrow(data: bytes) -> pa.Table:
    """A table of Arrow IPC bytes; an empty table of no bytes."""
    return pa.ipc.open_file(data).read_all() if data else pa.table({})


def write_result(df: DataFrame, path: str, form: ResultFormat = ResultFormat.PARQUET) -> None:
    """Large results are written by the executors. Arrow has no distributed writer here and is written as Parquet."""
    if form is ResultFormat.JSON:
        json_rows(df).write.text(path)
    else:
        df.write.option("compression", "snappy").parquet(path)
