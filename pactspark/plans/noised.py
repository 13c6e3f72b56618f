"""Noise on the results of an aggregate query, found by the lineage of its analyzed plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NoiseTypeUnsupported, PactError
from ..functions.noise import PrivacyBudget, laplace
from ..operators.govern import quoted
from ..operators.predicate import scala_seq
from ..policy import DpParam, ResolvedPolicy


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _attributes(expression) -> set[int]:
    """Ids of all attributes below an expression, those of its subqueries' plans included."""
    out, todo = set(), [expression]
    while todo:
        e = todo.pop()
        if _kind(e) == "AttributeReference":
            out.add(e.exprId().id())
        if hasattr(e, "plan") and _kind(e) in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
            for a in scala_seq(e.plan().output()):
                out.add(a.exprId().id())
        todo += scala_seq(e.children())
    return out


def _lineage(plan, names: set[str], roots: dict[int, set[str]], made: dict[int, set[int]], decide: set[int]) -> None:
    """roots: attributes of tables that are named like noised columns; made: which attributes an alias is made of;
    decide: attributes that decide over rows or their order, in filters, joins, groups, windows and so on."""
    todo = [plan]
    while todo:
        node = todo.pop()
        children = scala_seq(node.children())
        if not children:
            for a in scala_seq(node.output()):
                if a.name() in names:
                    roots.setdefault(a.exprId().id(), set()).add(a.name())
        if _kind(node) == "Union":  # outputs come from all branches by position
            for k, a in enumerate(scala_seq(node.output())):
                made.setdefault(a.exprId().id(), set()).update(scala_seq(c.output())[k].exprId().id() for c in children if scala_seq(c.output())[k].exprId().id() != a.exprId().id())
        elif _kind(node) in ("Intersect", "Except"):
            raise PactError(f"noise on results of {_kind(node).lower()} is not supported")
        for e in scala_seq(node.expressions()):
            _aliases(e, made)
            if children and _kind(node) not in ("Project", "Aggregate", "Union", "SubqueryAlias", "View"):
                decide |= _attributes(e)
        if _kind(node) == "Aggregate":
            for g in scala_seq(node.groupingExpressions()):
                decide |= _attributes(g)
        todo += children + scala_seq(node.subqueries())


def _aliases(expression, made: dict[int, set[int]]) -> None:
    todo = [expression]
    while todo:
        e = todo.pop()
        if _kind(e) == "Alias":
            made.setdefault(e.exprId().id(), set()).update(_attributes(e.child()))
        todo += scala_seq(e.children())


def _sources(ids: set[int], roots: dict[int, set[str]], made: dict[int, set[int]]) -> set[str]:
    out, seen, todo = set(), set(), list(ids)
    while todo:
        k = todo.pop()
        if k not in seen:
            seen.add(k)
            out |= roots.get(k, set())
            todo += made.get(k, ())
    return out


def noise_results(df: DataFrame, policies: list[ResolvedPolicy], budget: PrivacyBudget | None = None) -> DataFrame:
    """``df``, an aggregation, with noise on the columns that come from noised ones. Columns are followed by name and id; in doubt they count as noised."""
    params: dict[str, DpParam] = {}
    tenants: dict[str, str] = {}
    for p in policies:
        for c, x in p.dp_columns.items():
            if c in params:
                raise PactError(f"two datasets of the query have a noised column '{c}'")
            params[c], tenants[c] = x.checked(c), p.tenant_id
    plan = df._jdf.queryExecution().analyzed()
    while _kind(plan) in ("WithCTE", "SubqueryAlias"):
        if _kind(plan) == "WithCTE":
            raise PactError("noise on results needs a query without common table expressions")
        plan = plan.child()
    if _kind(plan) != "Aggregate":
        raise PactError(f"noise on results needs an aggregation at the top of the query, not {_kind(plan)}")
    roots: dict[int, set[str]] = {}
    made: dict[int, set[int]] = {}
    decide: set[int] = set()
    for part in (plan.child(), *scala_seq(plan.subqueries())):
        _lineage(part, set(params), roots, made, decide)
    if bad := _sources(decide, roots, made):
        raise PactError(f"conditions, inner groups and windows would show the exact values of noised columns: {', '.join(sorted(bad))}")
    for g in scala_seq(plan.groupingExpressions()):
        if bad := _sources(_attributes(g), roots, made):
            raise PactError(f"grouping by noised columns shows their values: {', '.join(sorted(bad))}")
    cols, paid = [], set()
    for field, e in zip(df.schema, scala_seq(plan.aggregateExpressions())):
        used = _sources(_attributes(e), roots, made)
        if not used:
            cols.append(quoted(field.name))
            continue
        paid |= used
        noisy = quoted(field.name).cast("double")
        for c in sorted(used):
            noisy = noisy + laplace(params[c].sensitivity / params[c].epsilon)
        if isinstance(field.dataType, T.DoubleType):
            cols.append(noisy.alias(field.name))
        elif isinstance(field.dataType, T.LongType):
            cols.append(F.round(noisy).cast("long").alias(field.name))
        else:
            raise NoiseTypeUnsupported(field.name, field.dataType.simpleString())
    if len(set(df.columns)) < len(df.columns):
        raise PactError("results need names of their own")
    budget = budget or PrivacyBudget()
    for tenant in sorted({tenants[c] for c in paid}):
        budget.consume(tenant, {c: params[c].epsilon for c in sorted(paid) if tenants[c] == tenant})
    return df.select(*cols)
