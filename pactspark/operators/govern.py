"""The governed scan: approve, filter rows, mask columns, add noise."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractDenied, ContractNotApproved, NoiseTypeUnsupported, PactError, UnknownColumn
from ..functions.masks import mask
from ..functions.noise import PrivacyBudget, laplace, noised
from ..policy import BundleHandle, Deny, MaskAction, ResolvedPolicy
from .predicate import filter_rows

_PROOF = object()


@dataclass(frozen=True)
class Event:
    """What an operator enforced."""

    operator: str
    detail: str


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _replaced(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """The frame with some of its columns replaced, in their places; names are exact, also where others differ by case only."""
    if not cols:
        return df
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.withColumns(cols)
    return df.select(*(cols[c].alias(c) if c in cols else quoted(c) for c in df.columns))


@dataclass(frozen=True)
class GovernedFrame:
    """A frame that a contract approved, and the operators that may follow.

    Only :func:`approve` makes one. The operators are plain projections and
    filters, so predicates on clear columns and column pruning still reach the
    scan, while predicates on masked or noised columns see what the caller sees.
    """

    df: DataFrame
    policy: ResolvedPolicy
    proof: object = None
    rules: tuple[str, ...] = ()
    events: tuple[Event, ...] = ()
    epsilon: float | None = None
    noise_of: dict[str, object] = field(default_factory=dict)

    def __post_init__(self):
        if self.proof is not _PROOF:
            raise ContractNotApproved("only approve() makes governed frames")

    def _with(self, operator: str, detail: str, **changes) -> GovernedFrame:
        return replace(self, rules=(*self.rules, operator), events=(*self.events, Event(operator, detail)), **changes)

    def row_filter(self, predicate: str | None = None) -> GovernedFrame:
        """Keep the rows of the policy's (or the given) predicate; without one, all."""
        text = predicate if predicate is not None else self.policy.row_filter
        return self._with("RowFilter", text or "none", df=filter_rows(self.df, text))

    def mask(self, null_mode: str = "typed", redacted: str = "***", strict_columns: bool = False) -> GovernedFrame:
        """Mask the policy's columns, named exactly; every mask's type is checked, also of columns that no query selects."""
        masks = self.policy.column_masks
        known = {f.name for f in self.df.schema}
        if strict_columns and (gone := [c for c in masks if c not in known]):
            raise UnknownColumn(f"masked columns that the data doesn't have: {', '.join(gone)}")
        cols = {f.name: mask(quoted(f.name), f.dataType, masks[f.name], f.name, null_mode, redacted) for f in self.df.schema if masks.get(f.name, MaskAction.NOOP) is not MaskAction.NOOP}
        done = sorted(c for c in masks if c in known)
        return self._with("Masking", ", ".join(done) or "none", df=_replaced(self.df, cols))

    def noise(self, budget: PrivacyBudget | None = None, strict_columns: bool = False) -> GovernedFrame:
        """Add noise to every value of the policy's columns, with new seeds.

        The budget is taken here, once for each column, all or nothing, before
        anything runs. Streams are refused: each micro-batch would have to pay.
        """
        params = self.policy.dp_columns
        if not params:
            return self
        if self.df.isStreaming:
            raise PactError("noise on a stream is not supported")
        kinds = {f.name: f.dataType for f in self.df.schema}
        for c, p in params.items():
            p.checked(c)
            if c in kinds and not isinstance(kinds[c], (T.DoubleType, T.LongType)):
                raise NoiseTypeUnsupported(c, kinds[c].simpleString())
        if strict_columns and (gone := [c for c in params if c not in kinds]):
            raise UnknownColumn(f"noised columns that the data doesn't have: {', '.join(gone)}")
        costs = {c: p.epsilon for c, p in params.items() if c in kinds}
        spent = (budget or PrivacyBudget()).consume(self.policy.tenant_id, costs)
        cols = {c: noised(quoted(c), k, params[c], c) for c, k in kinds.items() if c in params}
        return self._with("LaplaceNoise", ", ".join(sorted(costs)) or "none", df=_replaced(self.df, cols), epsilon=(self.epsilon or 0.0) + spent)

    def group_by(self, *keys: str) -> NoisyAggregate:
        """Aggregates with noise on those results that come from the policy's noised columns."""
        return NoisyAggregate(self, keys)

    @property
    def schema(self) -> T.StructType:
        return self.df.schema


class NoisyAggregate:
    """Aggregation of clear values, noised once per result instead of once per value."""

    _FUNCTIONS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}

    def __init__(self, frame: GovernedFrame, keys: tuple[str, ...]):
        if "LaplaceNoise" in frame.rules:
            raise PactError("these rows are noised already")
        self.frame, self.keys = frame, keys

    def agg(self, budget: PrivacyBudget | None = None, **results: tuple[str, str]) -> GovernedFrame:
        """``alias=(function, column)``. Noise comes before any sort or limit can follow; each noised column pays once."""
        frame, params = self.frame, self.frame.policy.dp_columns
        if bad := [k for k in self.keys if k in params]:
            raise PactError(f"grouping by noised columns shows their values: {', '.join(bad)}")
        used = {c for _, c in results.values() if c in params}
        for c in used:
            params[c].checked(c)
        spent = (budget or PrivacyBudget()).consume(frame.policy.tenant_id, {c: params[c].epsilon for c in sorted(used)})
        plain = frame.df.groupBy(*(quoted(k) for k in self.keys)).agg(*(self._FUNCTIONS[fn](F.lit(1) if c == "*" else quoted(c)).alias(a) for a, (fn, c) in results.items()))
        cols = [quoted(k) for k in self.keys]
        for a, (_, c) in results.items():
            kind = plain.schema[a].dataType
            if c not in used:
                cols.append(quoted(a))
            elif isinstance(kind, (T.DoubleType, T.LongType)):
                cols.append(noised(quoted(a), kind, params[c], a).alias(a))
            else:
                raise NoiseTypeUnsupported(a, kind.simpleString())
        return frame._with("AggregateNoise", ", ".join(sorted(used)) or "none", df=plain.select(*cols), epsilon=(frame.epsilon or 0.0) + spent if used else frame.epsilon)


def approve(df: DataFrame, policy: ResolvedPolicy | BundleHandle, dataset: str = "data") -> GovernedFrame:
    """Start governing ``df`` under a policy; denied, malformed or nameless contracts fail here."""
    if isinstance(policy, BundleHandle):
        policy = ResolvedPolicy.from_handle(policy)
    if not policy.contract_id:
        raise ContractNotApproved("the contract has no id")
    if isinstance(policy.decision, Deny):
        raise ContractDenied(dataset, policy.decision.reason)
    return GovernedFrame(df, policy, _PROOF, ("ContractApproved",), (Event("ContractApproved", policy.contract_id),))


def govern(df: DataFrame, policy: ResolvedPolicy | BundleHandle, budget: PrivacyBudget | None = None, dataset: str = "data", null_mode: str = "typed", strict_columns: bool = False) -> GovernedFrame:
    """The whole stack, in its order: approval, row filter, masks, noise."""
    return approve(df, policy, dataset).row_filter().mask(null_mode, strict_columns=strict_columns).noise(budget, strict_columns)


def governed_schema(df: DataFrame, policy: ResolvedPolicy | BundleHandle) -> T.StructType:
    """Names and types that a governed scan of ``df`` has; no budget is spent."""
    return approve(df, policy).mask().schema


def is_approved(frame: object) -> bool:
    return isinstance(frame, GovernedFrame) and frame.proof is _PROOF


def event_id() -> str:
    return str(uuid.uuid4())


__all__ = ["Event", "GovernedFrame", "NoisyAggregate", "approve", "govern", "governed_schema", "is_approved", "laplace", "quoted"]
