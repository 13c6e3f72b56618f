import hashlib
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from pactspark.engine import Engine
from pactspark.errors import BindingFailed, BudgetExhausted, ContractDenied, ContractError, InvalidNoiseParameters, PactError, ResolutionFailed, UnknownColumn, UnknownMaskAction, UnsafeStatement
from pactspark.functions.noise import PrivacyBudget
from pactspark.sources.bindings import FirstOf, FrameBinding, ParquetBinding
from pactspark.sources.contracts import Caller, JsonContracts

ROWS = [(11, "nora.k@mail.test", "EU", 12.5), (12, "omar@post.test", "ME", 250.25), (13, "pia@mail.test", "EU", 40.0), (14, "quinn@web.test", "AF", 3.75), (15, "rosa@post.test", "ME", 77.0), (16, "sam@web.test", None, 1.0)]
OUTSIDER, OWNER = Caller("user:bob", "analytics", "globex"), Caller("user:alice", "analytics", "acme")


@pytest.fixture(scope="module")
def parquet(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders") / "orders.parquet")
    spark.createDataFrame(ROWS, "order_id long, email string, region string, amount double").write.parquet(path)
    return path


def contract(parquet, **more):
    return {"contract_id": "c", "version": "1", "dataset": "sales/orders/v1", "binding": {"parquet": parquet}, "owner_tenant": "acme", "purposes": ["analytics"], "columns": [{"name": "email", "mask": "hash_sha256", "type": "string"}, {"name": "region"}], "row_filter": "region = 'EU'", "comment": "ignored"} | more


def test_outsider_and_owner(spark, parquet):
    e = Engine.from_json_contracts(spark, [json.dumps(contract(parquet))])
    q = 'SELECT order_id, email, region FROM "sales/orders/v1" ORDER BY order_id'
    rows = e.query(q, OUTSIDER).collect()
    assert [r.order_id for r in rows] == [11, 13]
    assert [r.email for r in rows] == [hashlib.sha256(x.encode()).hexdigest() for x in ("nora.k@mail.test", "pia@mail.test")]
    assert [tuple(r) for r in e.query(q, OWNER).collect()] == [x[:3] for x in ROWS]
    assert e.query('SELECT count(*) AS n FROM "sales/orders/v1"', OUTSIDER).first().n == 2
    assert e.query("SELECT order_id FROM \"sales/orders/v1\" WHERE email = 'nora.k@mail.test'", OUTSIDER).count() == 0


def test_pushdown_and_pruning(spark, parquet):
    e = Engine.from_json_contracts(spark, [contract(parquet)])
    plan = e.query('SELECT order_id FROM "sales/orders/v1" WHERE amount > 50', OUTSIDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(region,EU)" in plan and "GreaterThan(amount,50.0)" in plan and "email" not in plan


def test_refusals(spark, parquet):
    e = Engine.from_json_contracts(spark, [contract(parquet)])
    with pytest.raises(ContractDenied, match="denied access to 'sales/orders/v1': purpose 'marketing'"):
        e.query('SELECT 1 FROM "sales/orders/v1"', Caller("x", "marketing", "acme"))
    with pytest.raises(ResolutionFailed, match="contract resolution failed for 'nope': no contract for dataset 'nope'"):
        e.query("SELECT * FROM nope", OUTSIDER)
    with pytest.raises(UnsafeStatement):
        e.query("COPY a FROM 'b'", OUTSIDER)
    gone = Engine.from_json_contracts(spark, [contract("/no/such/file.parquet")])
    with pytest.raises(BindingFailed, match="binding failed for 'sales/orders/v1'"):
        gone.query('SELECT * FROM "sales/orders/v1"', OUTSIDER)


def test_views_of_the_parent_are_not_reachable(spark, parquet):
    spark.range(3).createOrReplaceTempView("secret")
    with pytest.raises(ResolutionFailed):
        Engine.from_json_contracts(spark, [contract(parquet)]).query("SELECT * FROM secret", OUTSIDER)


def test_contract_documents(tmp_path, parquet):
    for bad in ("{", {}, contract(parquet, columns=[{"name": "email", "mask": 3}])):
        with pytest.raises(ContractError):
            JsonContracts([bad])
    with pytest.raises(UnknownMaskAction, match="rainbow"):
        JsonContracts([contract(parquet, columns=[{"name": "email", "mask": "rainbow"}])])
    with pytest.raises(InvalidNoiseParameters):
        JsonContracts([contract(parquet, dp_columns={"amount": {"sensitivity": 1, "epsilon": 0}})])
    (tmp_path / "b.json").write_text(json.dumps(contract(parquet, version="2")))
    (tmp_path / "a.json").write_text(json.dumps(contract(parquet, version="1")))
    (tmp_path / "x.txt").write_text("no contract")
    assert JsonContracts.from_dir(tmp_path).by_dataset["sales/orders/v1"].version == "2"
    with pytest.raises(ContractError):
        JsonContracts.from_dir(tmp_path / "gone")


def test_frames_and_paths_as_bindings(spark, parquet):
    frame = spark.createDataFrame(ROWS, "order_id long, email string, region string, amount double")
    source = JsonContracts([contract("unused"), contract("unused", dataset="other")])
    e = Engine(spark, source, FirstOf(ParquetBinding({"other": parquet}), FrameBinding({"sales/orders/v1": frame})))
    assert e.query('SELECT a.order_id FROM "sales/orders/v1" a JOIN other b USING (order_id)', OUTSIDER).count() == 2
    with pytest.raises(BindingFailed):
        Engine(spark, source, FrameBinding({})).query("SELECT * FROM other", OUTSIDER)


def test_strict_columns(spark, parquet):
    doc = contract(parquet, columns=[{"name": "Email", "mask": "hash"}])
    assert Engine.from_json_contracts(spark, [doc]).query('SELECT email FROM "sales/orders/v1"', OUTSIDER).first().email.endswith(".test")
    with pytest.raises(UnknownColumn, match="Email"):
        Engine.from_json_contracts(spark, [doc], strict_columns=True).query('SELECT email FROM "sales/orders/v1"', OUTSIDER)


def test_noise_needs_a_reference_of_its_own(spark, parquet):
    e = Engine.from_json_contracts(spark, [contract(parquet, dp_columns={"amount": {"sensitivity": 1, "epsilon": 1}})])
    assert e.query('SELECT amount FROM "sales/orders/v1"', OUTSIDER).first().amount not in (12.5, 40.0)
    with pytest.raises(PactError, match="occurs 2 times"):
        e.query('SELECT * FROM "sales/orders/v1" a, "sales/orders/v1" b', OUTSIDER)


def test_noise_on_results(spark, parquet):
    dp = {"amount": {"sensitivity": 1, "epsilon": 1e12}}
    budget = PrivacyBudget({("acme", "amount"): 3e12})
    e = Engine.from_json_contracts(spark, [contract(parquet, dp_columns=dp, row_filter=None)], budget=budget)
    q = 'SELECT region, round(sum(x), 3) AS s, count(*) AS n, max(order_id) AS m FROM (SELECT region, order_id, amount * 2 AS x FROM "sales/orders/v1") t GROUP BY region'
    rows = [(r.region, round(r.s, 2), r.n, r.m) for r in e.query_noised(q, OUTSIDER, order_by=("region",)).collect()]
    assert rows == [(None, 2.0, 1, 16), ("AF", 7.5, 1, 14), ("EU", 105.0, 2, 13), ("ME", 654.5, 2, 15)] and budget.spent("acme", "amount") == 1e12
    assert e.query_noised(q, OUTSIDER, order_by=("s",), limit=2).collect()[1].region == "AF"
    loud = Engine.from_json_contracts(spark, [contract(parquet, dp_columns={"amount": {"sensitivity": 1000, "epsilon": 0.1}})])
    first = loud.query_noised('SELECT avg(amount) AS a, count(*) AS n FROM "sales/orders/v1" a JOIN (SELECT 1 AS one) b ON one = 1', OUTSIDER).first()
    assert abs(first.a - 26.25) > 1e-6 and first.n == 2
    one, two = (loud.query_noised('SELECT sum(amount) AS a FROM "sales/orders/v1"', OUTSIDER).first().a for _ in range(2))
    assert one != two
    refused = ['SELECT amount FROM "sales/orders/v1"', 'SELECT round(amount) AS g, count(*) AS n FROM "sales/orders/v1" GROUP BY round(amount)', 'SELECT sum(amount) AS s FROM "sales/orders/v1" ORDER BY s', 'SELECT max(CAST(amount AS STRING)) AS s FROM "sales/orders/v1"', 'WITH c AS (SELECT amount FROM "sales/orders/v1") SELECT sum(amount) AS s FROM c', 'SELECT sum(x) AS s FROM (SELECT amount AS x FROM "sales/orders/v1" INTERSECT SELECT 1D) t', 'SELECT count(*) AS n FROM "sales/orders/v1" WHERE amount > 90', 'SELECT sum(r) AS s FROM (SELECT row_number() OVER (ORDER BY amount) AS r FROM "sales/orders/v1") t', 'SELECT count(*) AS n FROM (SELECT amount AS a FROM "sales/orders/v1" GROUP BY amount) t', 'SELECT count(*) AS n FROM "sales/orders/v1" WHERE order_id > (SELECT max(amount) FROM "sales/orders/v1")']
    for q in refused:
        with pytest.raises(PactError):
            loud.query_noised(q, OUTSIDER)
    union = loud.query_noised('SELECT sum(x) AS s FROM (SELECT 1D AS x UNION ALL SELECT amount FROM "sales/orders/v1") t', OUTSIDER).first()
    assert abs(union.s - 53.5) > 1e-6
    sub = loud.query_noised('SELECT count(*) + (SELECT sum(amount) FROM "sales/orders/v1") AS s FROM (SELECT 1) t', OUTSIDER).first()
    assert abs(sub.s - 53.5) > 1e-6
    with pytest.raises(BudgetExhausted):
        for _ in range(3):
            e.query_noised('SELECT sum(amount) AS s FROM "sales/orders/v1"', OUTSIDER)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(alphabet="abcé@'\\ ", min_size=5, max_size=12), st.sampled_from(["EU", "US", None])), max_size=8))
def test_no_raw_value_gets_out(spark, rows):
    frame = spark.createDataFrame(rows, T.StructType([T.StructField("email", T.StringType()), T.StructField("region", T.StringType())]))
    source = JsonContracts([contract("unused")])
    found = Engine(spark, source, FrameBinding({"sales/orders/v1": frame})).query('SELECT * FROM "sales/orders/v1"', OUTSIDER).collect()
    assert sorted(r.email for r in found) == sorted(hashlib.sha256(e.encode()).hexdigest() for e, r in rows if r == "EU")


def test_plans_without_seeds(spark, parquet):
    budget = PrivacyBudget({("acme", "amount"): 1.0})
    e = Engine.from_json_contracts(spark, [contract(parquet, dp_columns={"amount": {"sensitivity": 1, "epsilon": 1}})], budget=budget)
    for mode in ("simple", "extended", "formatted"):
        text = e.explain('SELECT amount FROM "sales/orders/v1"', OUTSIDER, mode)
        assert "rand(?)" in text and "region" in text and not re.search(r"rand\(-?\d", text)
    assert budget.spent("acme", "amount") == 0
    with pytest.raises(ContractDenied):
        e.explain('SELECT 1 FROM "sales/orders/v1"', Caller("x", "marketing", "acme"))


def test_one_session_serves_many_queries(spark, parquet):
    e = Engine.from_json_contracts(spark, [contract(parquet), contract(parquet, dataset="b")])
    one, two = (e.query(f'SELECT order_id FROM "{n}" t', c) for n, c in (("sales/orders/v1", OUTSIDER), ("b", OWNER)))
    assert one.sparkSession is two.sparkSession and (one.count(), two.count()) == (2, 6)
    assert one.sparkSession.catalog.listTables() == []
    with pytest.raises(PactError, match="differ by case"):
        Engine.from_json_contracts(spark, [contract(parquet), contract(parquet, dataset="Sales/orders/v1")]).query('SELECT 1 FROM "sales/orders/v1" a, "Sales/orders/v1" b', OWNER)
    before = e.query('SELECT 1 FROM b', OWNER).sparkSession
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        after = e.query("SELECT 1 FROM b", OWNER).sparkSession
        assert after is not before and after.conf.get("spark.sql.shuffle.partitions") == "3"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_other_spellings(spark, parquet):
    e = Engine.from_json_contracts(spark, [contract(parquet)])

    def value(text):
        return e.query(f'SELECT {text} AS x FROM "sales/orders/v1" t LIMIT 1', OWNER).first().x

    assert [value(t) for t in ("gcd(54, -24)", "gcd(0, 0)", "lcm(4, 6)", "lcm(0, 5)", "to_hex(255)", "iszero(0)", "strpos('abc', 'c')", "array_element(make_array(1, 2), 3)", "array_to_string(string_to_array('a.b.c', '.'), '-')", "regexp_match('a1b2', '[0-9]')", "starts_with('ab', 'a')", "sha256('a')")] == [6, 0, 12, 0, "ff", True, 3, None, "a-b-c", ["1"], True, hashlib.sha256(b"a").hexdigest()]
    assert str(value("date_bin(INTERVAL '15' MINUTE, TIMESTAMP_NTZ'2024-05-01 10:44:59')")) == "2024-05-01 10:30:00"
    assert str(value("date_bin(INTERVAL '1' DAY, TIMESTAMP_NTZ'1969-12-31 10:00:00', TIMESTAMP_NTZ'2000-01-01 06:00:00')")) == "1969-12-31 06:00:00"
    assert e.query('SELECT approx_distinct(region) AS n, approx_median(amount) AS m FROM "sales/orders/v1"', OWNER).first().n == 3
