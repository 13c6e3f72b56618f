"""The four-rule pipeline: contract check, row filter, masks, aggregate noise, with an audit trail.

Unlike the scan stack, a denial here gives an empty result instead of an error,
masks give text literals and SQL nulls, and noise goes on aggregates.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BudgetExhausted, ContractNotApproved, MalformedBundle, PactError
from ..functions.noise import PrivacyBudget, laplace
from ..operators.govern import quoted
from ..operators.predicate import filter_rows
from ..policy import BundleHandle, MaskAction, load_document

RULE_ORDER = ("contract_check", "row_filter", "masking", "dp_noise")
REDACTED = "<REDACTED>"
TIERS = ("bronze", "silver", "gold")


class AuditKind(Enum):
    CONTRACT_DENIED = "contract_check_denied"
    PURPOSE_MISMATCH = "purpose_mismatch"
    TIER_MISMATCH = "tier_mismatch"
    CLASSIFICATION_MISMATCH = "classification_mismatch"
    CONTRACT_APPROVED = "contract_check_approved"
    BUDGET_EXHAUSTED = "privacy_budget_exhausted"


@dataclass(frozen=True)
class AuditRecord:
    kind: AuditKind
    table_name: str
    tenant_id: str
    contract_id: str | None
    detail: str
    event_id: str = field(default_factory=lambda: str(uuid.uuid4()))


@dataclass(frozen=True)
class Principal:
    id: str = ""
    declared_purpose: str = ""
    tier: str = ""
    classification: str = ""


def mismatch(doc: dict, who: Principal) -> tuple[AuditKind, str] | None:
    """The first of purpose, tier and classification that doesn't fit. A tier that isn't known fits."""
    purposes = doc.get("allowed_purposes") or []
    if purposes and who.declared_purpose not in purposes:
        return AuditKind.PURPOSE_MISMATCH, f"purpose '{who.declared_purpose}' is not among {', '.join(purposes)}"
    tier = doc.get("required_tier")
    if tier in TIERS and who.tier in TIERS and TIERS.index(who.tier) < TIERS.index(tier):
        return AuditKind.TIER_MISMATCH, f"tier '{who.tier}' is below '{tier}'"
    classification = doc.get("required_classification")
    if classification is not None and who.classification != classification:
        return AuditKind.CLASSIFICATION_MISMATCH, f"classification '{who.classification}' is not '{classification}'"
    return None


@dataclass
class Pipeline:
    """The rules under one bundle and principal; ``audit`` collects records.

    An approval holds for the frame that was checked and for what the rules make of it, not for other
    frames under the same table's name.
    """

    bundle: BundleHandle
    principal: Principal
    budget: PrivacyBudget = field(default_factory=PrivacyBudget)
    audit: list[AuditRecord] = field(default_factory=list)
    _approved: list[tuple[str, DataFrame]] = field(default_factory=list)

    @property
    def rules(self) -> tuple[str, ...]:
        return RULE_ORDER

    @property
    def approved(self) -> set[str]:
        """Names of tables with an approved frame."""
        return {name for name, _ in self._approved}

    def _passes(self, df: DataFrame, table: str) -> bool:
        """Whether the frame was approved; another frame under an approved name is refused."""
        if any(f is df and name == table for name, f in self._approved):
            return True
        if table in self.approved:
            raise ContractNotApproved(f"another frame than this one was approved as '{table}'")
        return False

    def _made(self, df: DataFrame, table: str) -> DataFrame:
        self._approved.append((table, df))
        return df

    def _note(self, kind: AuditKind, table: str, detail: str, contract: str | None = None) -> None:
        self.audit.append(AuditRecord(kind, table, self.bundle.tenant_id, contract or self.bundle.contract_id or None, detail))

    def _doc(self) -> dict:
        return load_document(self.bundle.raw)

    def contract_check(self, df: DataFrame, table: str) -> DataFrame:
        """The frame, or an empty one of the same schema."""
        try:
            doc = self._doc() if self.bundle.raw else None
        except MalformedBundle as e:
            doc = None
            self._note(AuditKind.CONTRACT_DENIED, table, str(e))
        else:
            if doc is None:
                self._note(AuditKind.CONTRACT_DENIED, table, "no contract bundle")
        if doc is not None:
            found = mismatch(doc, self.principal)
            if found is None:
                self._note(AuditKind.CONTRACT_APPROVED, table, "approved")
                return self._made(df, table)
            self._note(found[0], table, found[1])
        self._approved = [x for x in self._approved if x[0] != table]
        return df.filter(F.lit(False))

    def row_filter(self, df: DataFrame, table: str) -> DataFrame:
        """A filter of the principal's own replaces the general one; null means none. Tables that weren't approved stay as they are."""
        if not self._passes(df, table):
            return df
        doc = self._doc()
        own = doc.get("per_principal_row_filters") or {}
        return self._made(filter_rows(df, own[self.principal.id] if self.principal.id in own else doc.get("row_filter")), table)

    def masking(self, df: DataFrame, table: str) -> DataFrame:
        if not self._passes(df, table):
            return df
        actions = {c: MaskAction.parse(p["mask"], c) for c, p in (self._doc().get("column_policies") or {}).items() if isinstance(p, dict) and p.get("mask") is not None}
        return self._made(df.select(*(self._mask(quoted(c), actions.get(c, MaskAction.NOOP)).alias(c) for c in df.columns)), table)

    @staticmethod
    def _mask(col, action: MaskAction):
        if action is MaskAction.REDACT:
            return F.lit(REDACTED)
        if action in (MaskAction.HASH_SHA256, MaskAction.TOKENIZE):
            return F.sha2(col.cast("string"), 256)
        if action is MaskAction.PARTIAL:
            return F.concat(F.lit("***"), F.right(col.cast("string"), F.lit(4)))
        return F.lit(None).cast("string") if action is MaskAction.NULL else col

    def dp_noise(self, df: DataFrame, table: str, keys: list[str], results: dict[str, tuple[str, str]]) -> DataFrame:
        """Aggregate with noise of scale 1 / epsilon on results of noised columns; each such column pays once."""
        if not self._passes(df, table):
            raise ContractNotApproved(f"table '{table}' was not approved")
        params = self._noise_params()
        if bad := [k for k in keys if k in params]:
            raise PactError(f"grouping by noised columns shows their values: {', '.join(bad)}")
        used = sorted({c for _, c in results.values()} & params.keys())
        try:
            self.budget.consume(self.bundle.tenant_id, {c: params[c] for c in used})
        except BudgetExhausted as e:
            self._note(AuditKind.BUDGET_EXHAUSTED, table, str(e))
            raise
        functions = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
        plain = df.groupBy(*map(quoted, keys)).agg(*(functions[fn](F.lit(1) if c == "*" else quoted(c)).alias(a) for a, (fn, c) in results.items()))
        return plain.select(*map(quoted, keys), *((quoted(a) + laplace(1 / params[c])).alias(a) if c in params else quoted(a) for a, (_, c) in results.items()))

    def _noise_params(self) -> dict[str, float]:
        params = {}
        for c, p in (self._doc().get("dp_columns") or {}).items():
            if not isinstance(p, dict) or {"epsilon_per_query", "noise_mechanism"} - p.keys():
                raise MalformedBundle(f"dp_columns of '{c}' needs epsilon_per_query and noise_mechanism")
            params[c] = float(p["epsilon_per_query"])
        return params

    def apply(self, df: DataFrame, table: str, keys: list[str] | None = None, results: dict[str, tuple[str, str]] | None = None) -> DataFrame:
        """All four rules: check, filter, mask, and noise on the aggregate that ``keys`` and ``results`` (see dp_noise) ask for.

        Without an aggregate the rows themselves come back; they may not have columns that the bundle has noise for. A
        denied table gives an empty frame.
        """
        out = self.contract_check(df, table)
        if not self._passes(out, table):
            return out
        out = self.masking(self.row_filter(out, table), table)
        if results is not None:
            return self.dp_noise(out, table, keys or [], results)
        if bad := sorted(self._noise_params().keys() & set(df.columns)):
            raise PactError(f"columns with noise come in aggregates only: {', '.join(bad)}")
        return out


def build_pipeline(bundle: BundleHandle, principal: Principal, initial_budgets: dict[tuple[str, str], float] | None = None) -> Pipeline:
    """Budgets, where given, are enforced."""
    return Pipeline(bundle, principal, PrivacyBudget(initial_budgets))
