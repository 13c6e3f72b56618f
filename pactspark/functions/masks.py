"""Masks as built-in column expressions. A null stays null under every mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MaskTypeUnsupported
from ..policy import MaskAction

_TYPED = {T.StringType: ("***", ""), T.LongType: (0, 0), T.DoubleType: (0.0, 0.0), T.BooleanType: (False, False)}
_NO_TEXT = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def text_of(col: Column, kind: T.DataType) -> Column:
    """The text that hashes and partial masks work on; doubles in plain notation from 1e-4 to 1e16."""
    text = col.cast("string")
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return text
    plain = F.regexp_replace(text.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(col.cast("double"))
    return F.when(text.contains("E") & (size >= 1e-4) & (size < 1e16), plain).otherwise(text)


def mask(col: Column, kind: T.DataType, action: MaskAction, name: str, null_mode: str = "typed", redacted: str = "***") -> Column:
    """The masked column. With ``null_mode`` "sql_null" the null mask gives SQL nulls instead of typed zeros."""
    if action is MaskAction.NOOP:
        return col
    if action in (MaskAction.REDACT, MaskAction.NULL):
        if action is MaskAction.NULL and null_mode == "sql_null":
            return F.lit(None).cast(kind)
        values = next((v for t, v in _TYPED.items() if type(kind) is t), None)
        if values is None:
            raise MaskTypeUnsupported(name, action.value, kind.simpleString())
        value = values[action is MaskAction.NULL]
        value = redacted if value == "***" else value
        return F.when(col.isNotNull(), F.lit(value).cast(kind))
    if isinstance(kind, _NO_TEXT):
        raise MaskTypeUnsupported(name, action.value, kind.simpleString())
    text = text_of(col, kind)
    if action is MaskAction.PARTIAL:
        return F.concat(F.lit("***"), F.right(text, F.lit(4)))
    return F.sha2(text, 256)
