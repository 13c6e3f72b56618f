"""Functions that queries may spell otherwise than Spark does.

Only the names that a query uses are made known, in the session of that query. A
name that Spark has itself always means Spark's function.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

#: Another name: Spark's function with the same arguments.
ALIASES = {
    "approx_distinct": "approx_count_distinct",
    "approx_median": "median",
    "approx_percentile_cont": "percentile_approx",
    "array_concat": "concat",
    "array_element": "try_element_at",
    "array_has": "array_contains",
    "array_has_any": "arrays_overlap",
    "array_length": "array_size",
    "array_reverse": "reverse",
    "array_to_string": "array_join",
    "arrow_typeof": "typeof",
    "ends_with": "endswith",
    "generate_series": "sequence",
    "make_array": "array",
    "make_map": "map_from_arrays",
    "starts_with": "startswith",
    "strpos": "instr",
    "substr_index": "substring_index",
    "to_timestamp_micros": "timestamp_micros",
    "to_timestamp_millis": "timestamp_millis",
    "to_timestamp_seconds": "timestamp_seconds",
    "to_unixtime": "unix_timestamp",
    "unnest": "explode",
}

_GCD = "aggregate(sequence(1, 100), named_struct('a', abs(a), 'b', abs(b)), (s, _k) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
_WIDTH = f"timestampdiff(MICROSECOND, {_EPOCH}, {_EPOCH} + stride)"

#: Functions that Spark has no equal of: their signature and body.
DEFINED = {
    "date_bin": (f"stride INTERVAL DAY TO SECOND, at TIMESTAMP_NTZ, origin TIMESTAMP_NTZ DEFAULT {_EPOCH}", "TIMESTAMP_NTZ", f"timestampadd(MICROSECOND, CAST(floor(timestampdiff(MICROSECOND, origin, at) / {_WIDTH}) AS BIGINT) * {_WIDTH}, origin)"),
    "gcd": ("a BIGINT, b BIGINT", "BIGINT", _GCD),
    "iszero": ("x DOUBLE", "BOOLEAN", "x = 0"),
    "lcm": ("a BIGINT, b BIGINT", "BIGINT", f"if(a = 0 OR b = 0, 0, abs(a div {_GCD} * b))"),
    "regexp_match": ("s STRING, pattern STRING", "ARRAY<STRING>", "if(s RLIKE pattern, array(regexp_extract(s, pattern, 0)), NULL)"),
    "sha224": ("x STRING", "STRING", "sha2(x, 224)"),
    "sha256": ("x STRING", "STRING", "sha2(x, 256)"),
    "sha384": ("x STRING", "STRING", "sha2(x, 384)"),
    "sha512": ("x STRING", "STRING", "sha2(x, 512)"),
    "string_to_array": ("s STRING, mark STRING", "ARRAY<STRING>", "split(s, concat('\\\\Q', mark, '\\\\E'))"),
    "to_hex": ("n BIGINT", "STRING", "lower(hex(n))"),
}


def install(session: SparkSession, functions: Iterable[str]) -> None:
    """Make those of the functions known in the session that it doesn't have."""
    registry = session._jsparkSession.sessionState().functionRegistry()
    identifier = session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    for name in sorted(set(functions) & (ALIASES.keys() | DEFINED.keys())):
        if registry.functionExists(identifier(name)):
            continue
        if name in ALIASES:
            known = identifier(ALIASES[name])
            registry.registerFunction(identifier(name), registry.lookupFunction(known).get(), registry.lookupFunctionBuilder(known).get())
        elif name in DEFINED:
            arguments, kind, body = DEFINED[name]
            session.sql(f"CREATE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
