"""Governed SQL: a query names datasets, each is resolved for the caller and read governed."""

from __future__ import annotations

import re
import threading
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import BindingFailed, ContractDenied, PactError, ResolutionFailed
from .functions.noise import PrivacyBudget
from .operators.govern import GovernedFrame, approve, govern
from .plans.dialect import install
from .plans.guard import names_in, reject_unsafe
from .plans.noised import noise_results
from .policy import Deny, ResolvedPolicy
from .sources.contracts import BindingResolver, Caller, ContractSource, JsonContracts

_CONF = {"spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.runSQLOnFiles": "false"}


def new_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of another, but without its views."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and session.conf.isModifiable(key):
            session.conf.set(key, value)
    return session


def query_session(spark: SparkSession) -> SparkSession:
    """A session for governed queries: only what they name is put into it."""
    session = new_session(spark)
    for key, value in _CONF.items():
        session.conf.set(key, value)
    return session


@dataclass(frozen=True)
class Prepared:
    """A query that was resolved for a caller, before anything is read."""

    policy: bytes  # of all datasets in it
    noised: bool
    frame: Callable[[], DataFrame]


class Engine:
    """Contract-resolving SQL engine."""

    def __init__(self, spark: SparkSession, source: ContractSource, binding: BindingResolver, budget: PrivacyBudget | None = None, null_mode: str = "typed", strict_columns: bool = False):
        self.spark, self.source, self.binding, self.budget = spark, source, binding, budget
        self.null_mode, self.strict_columns = null_mode, strict_columns
        self._lock = threading.RLock()
        self._held: tuple[int, SparkSession] | None = None

    def __init_subclass__(cls, **kw):
        raise TypeError("the engine can't be extended")

    def _session(self) -> SparkSession:
        """The session of this engine's queries; a new one when the settings of the application's have changed."""
        settings = self.spark._jsparkSession.sessionState().conf().getAllConfs().hashCode()
        if self._held is None or self._held[0] != settings:
            self._held = settings, query_session(self.spark)
        return self._held[1]

    @classmethod
    def from_json_contracts(cls, spark: SparkSession, documents: list, **options) -> Engine:
        found = JsonContracts(documents)
        return cls(spark, found, found, **options)

    @classmethod
    def from_json_contracts_dir(cls, spark: SparkSession, folder: str | Path, **options) -> Engine:
        found = JsonContracts.from_dir(folder)
        return cls(spark, found, found, **options)

    def query(self, sql: str, caller: Caller) -> DataFrame:
        """The result of one query, as a lazy DataFrame. Denied and unknown datasets fail here, before anything is read."""
        return self.plan(sql, caller)[0]

    def plan(self, sql: str, caller: Caller) -> tuple[DataFrame, dict[str, GovernedFrame]]:
        """The result, and the governed frame of each dataset in it."""
        with self._lock:
            session, policies, times = self._resolved(sql, caller)
            return self._planned(session, sql, policies, times)

    def _planned(self, session: SparkSession, sql: str, policies: dict[str, ResolvedPolicy], times: Counter) -> tuple[DataFrame, dict[str, GovernedFrame]]:
        for name, policy in policies.items():
            if policy.dp_columns and times[name] > 1:
                raise PactError(f"dataset '{name}' has noise and occurs {times[name]} times; each reference would need noise of its own")
        frames = {n: govern(self._bound(n, session), p, self.budget, n, self.null_mode, self.strict_columns) for n, p in policies.items()}
        return self._run(session, sql, frames), frames

    def prepare(self, sql: str, caller: Caller) -> Prepared:
        """Resolve a query for a caller: denials fail here, and budgets are taken when its frame is asked for."""
        with self._lock:
            _, policies, _ = self._resolved(sql, caller)
        known = "\n".join(f"{n} {p.tenant_id} {p.to_bytes().decode()}" for n, p in sorted(policies.items()))
        return Prepared(known.encode(), any(p.dp_columns for p in policies.values()), lambda: self.query(sql, caller))

    def explain(self, sql: str, caller: Caller, mode: str = "formatted") -> str:
        """How a query would run, without the seeds of noise. No budget is taken."""
        with self._lock:
            session, policies, _ = self._resolved(sql, caller)
            frames = {n: govern(self._bound(n, session), p, None, n, self.null_mode, self.strict_columns) for n, p in policies.items()}
            df = self._run(session, sql, frames)
        text = self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
        return re.sub(r"\brand(n?)\(-?\d+\)", r"rand\1(?)", text)

    def query_noised(self, sql: str, caller: Caller, order_by: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
        """One aggregate query with noise on its results instead of on the rows.

        The query must be an aggregation at its top. Results that come from
        noised columns get noise of the sum of their scales, each noised column
        pays once, and grouping by a noised column is refused. Ordering and
        limiting are given apart, as they must not see the exact results.
        """
        with self._lock:
            session, policies, _ = self._resolved(sql, caller)
            frames = {n: approve(self._bound(n, session), p, n).row_filter().mask(self.null_mode, strict_columns=self.strict_columns) for n, p in policies.items()}
            exact = self._run(session, sql, frames)
        out = noise_results(exact, [p for p in policies.values() if p.dp_columns], self.budget)
        out = out.orderBy(*order_by) if order_by else out
        return out if limit is None else out.limit(limit)

    def _resolved(self, sql: str, caller: Caller) -> tuple[SparkSession, dict[str, ResolvedPolicy], Counter]:
        reject_unsafe(sql)
        session = self._session()
        names, functions = names_in(session, sql)
        install(session, functions)
        times, policies = Counter(names), {}
        if len({n.lower() for n in times}) < len(times):  # views differ by more than case
            raise PactError("datasets of one query whose names differ by case only are not supported")
        for name in times:
            try:
                policies[name] = self.source.resolve(name, caller)
            except PactError as e:
                raise ResolutionFailed(name, e) from e
            if isinstance(policies[name].decision, Deny):
                raise ContractDenied(name, policies[name].decision.reason)
        return session, policies, times

    def _bound(self, name: str, session: SparkSession) -> DataFrame:
        try:
            return self.binding.bind(name, session)
        except Exception as e:
            raise BindingFailed(name, e) from e

    @staticmethod
    def _run(session: SparkSession, sql: str, frames: dict[str, GovernedFrame]) -> DataFrame:
        """The plan is resolved at once, so the views go again."""
        views = {n: "`" + n.replace("`", "``") + "`" for n in frames}
        try:
            for name, frame in frames.items():
                frame.df.createOrReplaceTempView(views[name])
            return session.sql(sql.strip().rstrip(";"))
        finally:
            for name in frames:
                session._jsparkSession.sessionState().catalog().dropTempView(name)
