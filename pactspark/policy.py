"""The policy model: what a contract grants to one caller."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from enum import Enum

from .errors import InvalidNoiseParameters, MalformedBundle, UnknownMaskAction


class MaskAction(Enum):
    REDACT = "redact"
    HASH_SHA256 = "hash_sha256"
    TOKENIZE = "tokenize"
    PARTIAL = "partial"
    NULL = "null"
    NOOP = "noop"

    @classmethod
    def parse(cls, text: str, column: str | None = None) -> MaskAction:
        token = {"hash": "hash_sha256", "none": "noop"}.get(str(text).lower(), str(text).lower())
        try:
            return cls(token)
        except ValueError:
            raise UnknownMaskAction(str(text), column) from None


@dataclass(frozen=True)
class DpParam:
    sensitivity: float
    epsilon: float

    def checked(self, column: str) -> DpParam:
        for name in ("sensitivity", "epsilon"):
            x = getattr(self, name)
            if isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 < x < float("inf"):
                raise InvalidNoiseParameters(f"{name} of column '{column}' must be finite and positive, not {x!r}")
        return self


@dataclass(frozen=True)
class Allow:
    pass


@dataclass(frozen=True)
class Deny:
    reason: str


@dataclass(frozen=True)
class BundleHandle:
    """A policy document as bytes, with the contract and tenant it stands for."""

    raw: bytes
    contract_id: str
    tenant_id: str
    handle_id: str = field(default_factory=lambda: str(uuid.uuid4()))


@dataclass(frozen=True)
class ResolvedPolicy:
    contract_id: str
    contract_version: str
    tenant_id: str
    decision: Allow | Deny = Allow()
    column_masks: dict[str, MaskAction] = field(default_factory=dict)
    row_filter: str | None = None
    dp_columns: dict[str, DpParam] = field(default_factory=dict)

    def to_bytes(self) -> bytes:
        """The bundle document; masks that change nothing are left out."""
        return json.dumps(
            {
                "contract_id": self.contract_id,
                "contract_version": self.contract_version,
                "column_masking": {c: m.value for c, m in self.column_masks.items() if m is not MaskAction.NOOP},
                "row_filter": self.row_filter,
                "dp_columns": {c: {"sensitivity": p.sensitivity, "epsilon": p.epsilon} for c, p in self.dp_columns.items()},
            },
            sort_keys=True,
        ).encode()

    def to_handle(self) -> BundleHandle:
        return BundleHandle(self.to_bytes(), self.contract_id, self.tenant_id)

    @classmethod
    def from_handle(cls, handle: BundleHandle) -> ResolvedPolicy:
        """Read a bundle; empty bytes mean no masks, no filter and no noise."""
        doc = load_document(handle.raw) if handle.raw else {}
        masks = {c: MaskAction.parse(m, c) for c, m in (doc.get("column_masking") or {}).items()}
        noise = {}
        for c, p in (doc.get("dp_columns") or {}).items():
            if not isinstance(p, dict) or {"sensitivity", "epsilon"} - p.keys():
                raise MalformedBundle(f"dp_columns of '{c}' needs sensitivity and epsilon")
            noise[c] = DpParam(p["sensitivity"], p["epsilon"])
        return cls(doc.get("contract_id") or handle.contract_id, str(doc.get("contract_version") or ""), handle.tenant_id, Allow(), masks, doc.get("row_filter") or None, noise)


def load_document(raw: bytes) -> dict:
    try:
        doc = json.loads(raw)
    except ValueError as e:
        raise MalformedBundle(f"bundle is no JSON: {e}") from None
    if not isinstance(doc, dict):
        raise MalformedBundle("bundle is no JSON object")
    return doc
