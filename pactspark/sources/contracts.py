"""Contract sources: a dataset and a caller give a policy."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..errors import ContractError, ContractNotFound
from ..policy import Allow, Deny, DpParam, MaskAction, ResolvedPolicy


@dataclass(frozen=True)
class Caller:
    id: str
    purpose: str
    tenant: str
    tier: str = "bronze"
    classification: str = "internal"


class ContractSource(Protocol):
    def resolve(self, dataset: str, caller: Caller) -> ResolvedPolicy: ...


class BindingResolver(Protocol):
    """Gives the ungoverned data of a dataset, in the given session."""

    def bind(self, dataset: str, session: SparkSession) -> DataFrame: ...


@dataclass(frozen=True)
class Contract:
    contract_id: str
    version: str
    dataset: str
    parquet: str
    owner_tenant: str
    purposes: tuple[str, ...] = ()
    masks: dict[str, MaskAction] | None = None
    row_filter: str | None = None
    dp_columns: dict[str, DpParam] | None = None

    @classmethod
    def parse(cls, text: str | bytes | dict) -> Contract:
        """Unknown keys are ignored; mask names and noise parameters are checked here already."""
        try:
            doc = text if isinstance(text, dict) else json.loads(text)
            noise = {c: DpParam(float(p["sensitivity"]), float(p["epsilon"])).checked(c) for c, p in (doc.get("dp_columns") or {}).items()}
            masks = {c["name"]: MaskAction.parse(c["mask"], c["name"]) for c in doc.get("columns") or [] if c.get("mask") is not None}
            return cls(str(doc["contract_id"]), str(doc["version"]), str(doc["dataset"]), str(doc["binding"]["parquet"]), str(doc["owner_tenant"]), tuple(doc.get("purposes") or ()), masks, doc.get("row_filter") or None, noise)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise ContractError(f"contract can't be read: {type(e).__name__}: {e}") from None

    def policy_for(self, caller: Caller) -> ResolvedPolicy:
        """The purpose binds everybody; the owner sees everything else, others what the contract leaves."""
        who = (self.contract_id, self.version, self.owner_tenant)
        if self.purposes and caller.purpose not in self.purposes:
            return ResolvedPolicy(*who, Deny(f"purpose '{caller.purpose}' not permitted (allowed: {', '.join(self.purposes)})"))
        if caller.tenant == self.owner_tenant:
            return ResolvedPolicy(*who)
        return ResolvedPolicy(*who, Allow(), dict(self.masks or {}), self.row_filter, dict(self.dp_columns or {}))


class JsonContracts:
    """Contracts from JSON documents; of two for one dataset the later one holds. Also binds their Parquet files."""

    def __init__(self, documents: list[str | bytes | dict]):
        self.by_dataset = {c.dataset: c for c in map(Contract.parse, documents)}

    @classmethod
    def from_dir(cls, folder: str | Path) -> JsonContracts:
        """Every ``*.json`` of the folder itself, in the order of their names."""
        try:
            return cls([p.read_bytes() for p in sorted(Path(folder).iterdir()) if p.suffix == ".json" and p.is_file()])
        except OSError as e:
            raise ContractError(f"contracts can't be read: {e}") from None

    def _find(self, dataset: str) -> Contract:
        if dataset not in self.by_dataset:
            raise ContractNotFound(dataset)
        return self.by_dataset[dataset]

    def resolve(self, dataset: str, caller: Caller) -> ResolvedPolicy:
        return self._find(dataset).policy_for(caller)

    def bind(self, dataset: str, session: SparkSession) -> DataFrame:
        return session.read.parquet(self._find(dataset).parquet)
