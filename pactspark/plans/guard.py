"""Statements are checked before they are planned.

Two checks: a list of verbs that no statement may begin with, and a walk over the
parsed plan that only lets plain queries over single-part relation names pass.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..errors import NotAQuery, UnsafeStatement
from ..operators.predicate import scala_seq

#: Verbs that load code, attach databases or write files.
VERBS = frozenset(("INSTALL", "LOAD", "ATTACH", "COPY", "EXTENSION"))

#: Plan nodes that a query may consist of.
NODES = frozenset(
    """Project Filter Aggregate Join LateralJoin UnresolvedRelation SubqueryAlias Sort GlobalLimit LocalLimit Offset LimitAll Distinct
    Deduplicate Union Intersect Except UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedInlineTable LocalRelation OneRowRelation
    Generate UnresolvedTableValuedFunction UnresolvedTVFAliases Window WithWindowDefinition UnresolvedHint Pivot UnresolvedPivot Unpivot Sample Expand GroupingSets
    RepartitionByExpression Repartition Tail ParameterizedQuery UnionLoop UnionLoopRef Range ResolvedHint""".split()
)
#: Functions that reach outside the rows of a query: arbitrary code, files, sessions.
FUNCTIONS = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length raise_error assert_true current_catalog current_database current_schema current_user session_user user version spark_partition_id".split())
TABLE_FUNCTIONS = frozenset("range explode explode_outer inline inline_outer posexplode posexplode_outer stack json_tuple variant_explode variant_explode_outer".split())


def statements(sql: str) -> list[str]:
    """The statements of a text, without comments; a comment counts as a blank.

    Block comments nest. Quoted text, with doubled quotes in it, is taken whole:
    neither comment marks nor semicolons count there.
    """
    out, now, k, n = [], [], 0, len(sql)
    while k < n:
        c, two = sql[k], sql[k : k + 2]
        if c in "'\"`":
            end = k + 1
            while end < n:
                if sql[end] == c:
                    if sql[end + 1 : end + 2] != c:
                        break
                    end += 1
                end += 1
            now.append(sql[k : end + 1])
            k = end + 1
        elif two == "--":
            end = sql.find("\n", k)
            k = n if end < 0 else end
            now.append(" ")
        elif two == "/*":
            depth, k = 1, k + 2
            while k < n and depth:
                two = sql[k : k + 2]
                depth += (two == "/*") - (two == "*/")
                k += 2 if two in ("/*", "*/") else 1
            now.append(" ")
        elif c == ";":
            out.append("".join(now).strip())
            now, k = [], k + 1
        else:
            now.append(c)
            k += 1
    out.append("".join(now).strip())
    return [s for s in out if s]


def reject_unsafe(sql: str) -> None:
    """Raise if any statement begins with one of VERBS."""
    for s in statements(sql):
        word = ""
        for c in s.lstrip("("):
            if not (c.isalnum() or c == "_"):
                break
            word += c
        if word.upper() in VERBS:
            raise UnsafeStatement(word.upper())


@contextmanager
def active(spark: SparkSession):
    """The parser goes by the settings of the thread's active session."""
    sessions = spark._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)
    try:
        yield
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
        else:
            sessions.clearActiveSession()


def relations(spark: SparkSession, sql: str) -> list[str]:
    """Names of all relations that the one query in ``sql`` reads, one entry for each reference, in no special order."""
    return names_in(spark, sql)[0]


def names_in(spark: SparkSession, sql: str) -> tuple[list[str], set[str]]:
    """The relations of a query (see relations), and the functions it calls, in lower case."""
    found = statements(sql)
    if len(found) != 1:
        raise NotAQuery(f"one query is expected, not {len(found)}")
    with active(spark):
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    out: list[str] = []
    functions: set[str] = set()
    _walk(plan, frozenset(), out, functions)
    return out, functions


def _walk(plan, ctes: frozenset[str], out: list[str], functions: set[str]) -> None:
    kind = plan.getClass().getSimpleName()
    if kind not in NODES:
        raise NotAQuery(f"{kind} is no part of a plain query")
    if kind == "UnresolvedRelation":
        parts = scala_seq(plan.multipartIdentifier())
        if len(parts) != 1:
            raise NotAQuery(f"relation '{'.'.join(parts)}' has several parts; datasets are named by one quoted name")
        if parts[0].lower() not in ctes:
            out.append(parts[0])
        return
    if kind == "UnresolvedTableValuedFunction":
        _allowed([p.lower() for p in scala_seq(plan.name())], TABLE_FUNCTIONS, True)
    if kind == "UnresolvedWith":
        # A name stands for a common table expression only in later ones and in the body.
        recursive = plan.allowRecursion()
        for t in scala_seq(plan.cteRelations()):
            name = t.productElement(0).lower()
            _walk(t.productElement(1), ctes | {name} if recursive else ctes, out, functions)
            ctes = ctes | {name}
        _walk(plan.child(), ctes, out, functions)
        return
    for e in scala_seq(plan.expressions()):
        _expression(e, functions)
    for p in scala_seq(plan.subqueries()):
        _walk(p, ctes, out, functions)
    for p in scala_seq(plan.children()):
        _walk(p, ctes, out, functions)


def _expression(root, functions: set[str]) -> None:
    todo = [root]
    while todo:
        e = todo.pop()
        if e.getClass().getSimpleName() == "UnresolvedFunction":
            name = [p.lower() for p in scala_seq(e.nameParts())]
            _allowed(name, FUNCTIONS, False)
            functions.add(name[0])
        todo += scala_seq(e.children())


def _allowed(parts: list[str], names: frozenset[str], inside: bool) -> None:
    if len(parts) > 1 or (parts[0] in names) is not inside:
        raise NotAQuery(f"function '{'.'.join(parts)}' may not be used")
