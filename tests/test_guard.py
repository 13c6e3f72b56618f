import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pactspark.engine import query_session
from pactspark.errors import NotAQuery, UnsafeStatement
from pactspark.plans.guard import VERBS, names_in, reject_unsafe, relations, statements

QUOTES = ("'", '"', "`")
words = st.text("abcxyz_09 ,.()=é", max_size=12)
#: What may stand between tokens without being one: blanks and comments, some of them nested.
nested = st.recursive(st.text("ab;'\" copy", max_size=6), lambda x: x.map(lambda t: f"/*{t}*/"), max_leaves=3)
gaps = st.one_of(st.just(" "), st.just("\n\t"), nested.map(lambda t: f"/* {t} */"), words.map(lambda t: f"-- {t}\n"))
quoted = st.tuples(st.sampled_from(QUOTES), st.one_of(words, st.sampled_from(sorted(VERBS)).map(lambda v: f"; {v} x -- /*"))).map(lambda q: q[0] + q[1].replace(q[0], q[0] * 2) + q[0])
#: Statements that begin with a harmless word and hold quoted text, comments and verbs elsewhere.
harmless = st.tuples(st.sampled_from(("SELECT", "VALUES", "TABLE", "copying", "loads", "CREATE")), st.lists(st.one_of(gaps, quoted, st.sampled_from(("k", "7", "LOAD", "copy"))), max_size=5)).map(lambda x: " ".join((x[0], *x[1])))
spelt = st.sampled_from(sorted(VERBS)).flatmap(lambda v: st.tuples(st.just(v), st.lists(st.booleans(), min_size=len(v), max_size=len(v)).map(lambda up: "".join(c.upper() if u else c.lower() for c, u in zip(v, up)))))


@settings(max_examples=300, deadline=None)
@given(st.lists(harmless, max_size=3), st.lists(gaps, max_size=3), spelt, st.one_of(gaps, st.just("('")), st.lists(harmless, max_size=2))
def test_verbs_are_found_at_the_start_of_any_statement(before, lead, verb, after, rest):
    name, written = verb
    with pytest.raises(UnsafeStatement, match=f"statement contains disallowed verb '{name}'"):
        reject_unsafe(";".join([*(x + " " for x in before), "".join(lead) + written + after + " 'f'", *rest]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(gaps, harmless, gaps), min_size=1, max_size=4))
def test_verbs_elsewhere_are_no_verbs(parts):
    sql = " ; ".join("".join(p) for p in parts)
    reject_unsafe(sql)
    assert len(statements(sql)) == len(parts)


@pytest.mark.parametrize("sql", ["copy", "(load x)", ";\n;attach x", "/**/extension/**/y", "--\ninstall x", "SELECT '''' ; copy x", 'SELECT "a""b";load y', "SELECT `;`;copy x"])
def test_edges_that_are_rejected(sql):
    with pytest.raises(UnsafeStatement):
        reject_unsafe(sql)


@pytest.mark.parametrize("sql", ["", ";;", "-- copy x", "/* copy x", "/* a /* b */ copy */ SELECT 1", "SELECT 'copy", "loading", "copy_of", "SELECT '\n; -- '", "/*;*/SELECT 1/*;copy*/"])
def test_edges_that_pass(sql):
    reject_unsafe(sql)


def test_statements():
    assert statements("a/**/b; ; -- x\n c") == ["a b", "c"]


@pytest.mark.parametrize(
    "sql",
    ["SET a=b", "ADD JAR x", "INSERT INTO x SELECT 1", "INSERT OVERWRITE DIRECTORY '/x' SELECT 1", "DROP TABLE x", "CREATE TABLE x AS SELECT 1", "EXPLAIN SELECT 1", "CACHE TABLE x", "SELECT java_method('a', 'b')", "SELECT 1 WHERE reflect('a', 'b') = '1'", "SELECT * FROM parquet.`/x`", "SELECT * FROM a.b", "SELECT (SELECT input_file_name())", "SELECT 1; SELECT 2", "", "DESCRIBE t", "SELECT * FROM read_files('x')"],
)
def test_only_plain_queries(spark, sql):
    with pytest.raises(NotAQuery):
        relations(query_session(spark), sql)


def test_relations_are_scoped(spark):
    s = query_session(spark)
    assert relations(s, 'WITH a AS (SELECT * FROM a), b AS (SELECT * FROM a) SELECT * FROM b JOIN "x/y" ON 1 = 1 WHERE 1 IN (SELECT k FROM c) AND EXISTS (SELECT 1 FROM d)').sort() is None
    assert sorted(relations(s, 'WITH a AS (SELECT * FROM a), b AS (SELECT * FROM a) SELECT (SELECT max(q) FROM e) FROM b JOIN "x/y" ON 1 = 1 WHERE 1 IN (SELECT k FROM c)')) == ["a", "c", "e", "x/y"]
    assert relations(s, "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r") == []
    assert sorted(relations(s, "SELECT * FROM t, t u, LATERAL (SELECT * FROM v)")) == ["t", "t", "v"]


def test_functions_are_named(spark):
    assert names_in(query_session(spark), "SELECT Strpos(a, upper(b)) FROM t WHERE EXISTS (SELECT gcd(1, 2) FROM u)")[1] == {"strpos", "upper", "gcd"}
