"""Row-filter predicates: parsed by Spark, then held against a list of allowed nodes."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..errors import UnsupportedPredicate

#: Comparison, logic, IN, LIKE and IS NULL over bare column names and literals.
_NODES = frozenset("EqualTo Not LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual And Or In Like IsNull IsNotNull UnresolvedAttribute Literal".split())


def spelt(text: str) -> str:
    """The operators ``~~`` and ``!~~`` as LIKE and NOT LIKE; quoted text stays as it is."""
    parts = re.split(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)", text)
    return "".join(p if k % 2 else p.replace("!~~", " NOT LIKE ").replace("~~", " LIKE ") for k, p in enumerate(parts))


def scala_seq(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def check_predicate(spark: SparkSession, text: str) -> set[str]:
    """The column names of a predicate within the grammar."""
    try:
        root = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except ParseException as e:
        raise UnsupportedPredicate(f"row filter can't be parsed: {text!r}: {e.getMessage() if hasattr(e, 'getMessage') else e}") from None
    names: set[str] = set()
    todo = [root]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind not in _NODES:
            raise UnsupportedPredicate(f"row filter uses {kind}, which the predicate grammar doesn't have: {text!r}")
        if kind == "UnresolvedAttribute":
            parts = scala_seq(node.nameParts())
            if len(parts) != 1:
                raise UnsupportedPredicate(f"row filter names '{'.'.join(parts)}'; only bare column names are allowed")
            names.add(parts[0])
        todo += scala_seq(node.children())
    return names


def filter_rows(df: DataFrame, text: str | None) -> DataFrame:
    """Rows for which the predicate is true; without one, all rows. Unknown columns and other than boolean types fail here."""
    if not text or not text.strip():
        return df
    text = spelt(text)
    check_predicate(df.sparkSession, text)
    try:
        return df.filter(text)
    except AnalysisException as e:
        raise UnsupportedPredicate(f"row filter doesn't fit the data: {text!r}: {e}") from None
