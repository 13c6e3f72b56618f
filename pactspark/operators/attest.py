"""Attestation: what a query returned and what was enforced on the way."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from typing import Protocol

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MissingContractReference
from ..policy import BundleHandle, ResolvedPolicy
from .govern import GovernedFrame

ENGINE_VERSION = "0.1.0"


@dataclass(frozen=True)
class Envelope:
    query_sha: str
    contract_id: str
    contract_version: str
    result_hash: str
    rules_applied: tuple[str, ...]
    epsilon_consumed: float | None
    delta_consumed: float | None
    timestamp_utc: str
    engine_version: str
    signature: str

    def unsigned_json(self) -> str:
        doc = asdict(self)
        del doc["signature"]
        return json.dumps(doc, sort_keys=True, separators=(",", ":"))


class Signer(Protocol):
    def sign(self, envelope_json: str, engine_version: str, tenant_id: str) -> str: ...


def _hashable(col: Column, kind: T.DataType) -> Column:
    """Maps have no order and no hash: their entries do. Variants go by their text. Hashes skip nulls, so inner values say whether they are null."""

    def inner(x: Column, of: T.DataType) -> Column:
        return F.struct(x.isNull().alias("null"), _hashable(x, of).alias("v"))

    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(col), lambda e: F.struct(_hashable(e["key"], kind.keyType).alias("k"), inner(e["value"], kind.valueType).alias("v"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: inner(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(inner(col.getField(f.name), f.dataType).alias(f"f{k}") for k, f in enumerate(kind))))
    return col.cast("string") if isinstance(kind, T.VariantType) else col


def result_hash(df: DataFrame) -> str:
    """xxh64 of the columns' names and types, the number of rows, and two sums of row hashes; without rows that of nothing.

    One aggregate over the rows, wherever they are; it doesn't depend on their order, also where columns are
    nested or share a name.
    """
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    cols = [_hashable(F.col(f.name), f.dataType) for f in plain.schema]
    rows = plain.select(*(F.when(c.isNull(), F.lit(k)).otherwise(F.lit(-1)).alias(f"n{k}") for k, c in enumerate(cols)), *(c.alias(f"v{k}") for k, c in enumerate(cols)))
    one, two = F.xxhash64(*rows.columns), F.xxhash64(F.lit("second"), *reversed(rows.columns))
    whole = rows.select(*(h.cast("decimal(38,0)").alias(n) for n, h in (("a", one), ("b", two)))).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not whole["n"]:
        return f"{xxhash.xxh64_intdigest(b''):016x}"
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return f"{xxhash.xxh64_intdigest(f'{kinds}; {whole["n"]} {int(whole["a"]) % 2**64} {int(whole["b"]) % 2**64}'.encode()):016x}"


def attest(sql: str, result: DataFrame | GovernedFrame, policy: ResolvedPolicy | BundleHandle, frame: GovernedFrame | None = None, signer: Signer | None = None, rows: bool = True) -> tuple[pa.Table | None, Envelope]:
    """Run the query once and describe its result. ``frame``: the governed frame that the result comes from.

    With ``rows`` the result comes to the driver and the envelope covers what came; without, only its hash does, for
    results of any size.
    """
    if isinstance(policy, BundleHandle):
        policy = ResolvedPolicy.from_handle(policy)
    if not policy.contract_id or not policy.contract_version:
        raise MissingContractReference("an attestation needs contract_id and contract_version")
    if isinstance(result, GovernedFrame):
        frame, result = result, result.df
    table = result.toArrow() if rows else None
    covered = result if table is None else result.sparkSession.createDataFrame(table.rename_columns([f"c{k}" for k in range(table.num_columns)]), T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(result.schema)])).toDF(*result.columns)
    query_sha, found = hashlib.sha256(sql.encode()).hexdigest(), result_hash(covered)
    envelope = Envelope(query_sha, policy.contract_id, policy.contract_version, found, frame.rules if frame else (), frame.epsilon if frame else None, None, datetime.now(UTC).isoformat(), ENGINE_VERSION, "")
    signature = signer.sign(envelope.unsigned_json(), ENGINE_VERSION, policy.tenant_id) if signer else hashlib.sha256((query_sha + found).encode()).hexdigest()
    return table, Envelope(**{**asdict(envelope), "rules_applied": envelope.rules_applied, "signature": signature})
