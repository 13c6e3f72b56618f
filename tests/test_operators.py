import hashlib
import json
import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from pactspark.errors import BudgetExhausted, ContractDenied, ContractNotApproved, InvalidNoiseParameters, MalformedBundle, MaskTypeUnsupported, MissingContractReference, NoiseTypeUnsupported, PactError, UnknownMaskAction, UnsupportedPredicate
from pactspark.functions.noise import PrivacyBudget
from pactspark.operators.attest import attest, result_hash
from pactspark.operators.govern import GovernedFrame, approve, govern, governed_schema, is_approved
from pactspark.policy import Allow, BundleHandle, Deny, DpParam, MaskAction, ResolvedPolicy


def policy(masks=None, row_filter=None, dp=None, decision=Allow()):
    return ResolvedPolicy("c", "1", "acme", decision, {c: MaskAction.parse(m) for c, m in (masks or {}).items()}, row_filter, dp or {})


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def masked(spark, rows, schema, **masks):
    return [tuple(r) for r in govern(spark.createDataFrame(rows, schema), policy(masks)).df.collect()]


#: The text form that each type is hashed in.
@pytest.mark.parametrize(
    "kind,value,text",
    [("double", 2547000.0, "2547000.0"), ("double", 1e7, "10000000.0"), ("double", 1e-4, "0.0001"), ("bigint", 8801015555, "8801015555"), ("date", date(1970, 1, 1), "1970-01-01"), ("boolean", True, "true"), ("string", "a@b", "a@b"), ("int", 7, "7")],
)
def test_hash_by_type(spark, kind, value, text):
    for action in ("hash_sha256", "tokenize", "HASH"):
        assert masked(spark, [(value,), (None,)], f"x {kind}", x=action) == [(sha(text),), (None,)]


def test_other_masks(spark):
    assert masked(spark, [("alice",), (None,)], "x string", x="redact") == [("***",), (None,)]
    assert masked(spark, [("alice",), (None,)], "x string", x="null") == [("",), (None,)]
    assert masked(spark, [(5,), (None,)], "x long", x="redact") == [(0,), (None,)]
    assert masked(spark, [(5.5,)], "x double", x="null") == [(0.0,)]
    assert masked(spark, [(True,)], "x boolean", x="redact") == [(False,)]
    assert masked(spark, [(4111111111111234,), (12,)], "x long", x="partial") == [("***1234",), ("***12",)]
    assert masked(spark, [("añ😀b",), ("xyzañ😀b",)], "x string", x="partial") == [("***añ😀b",), ("***añ😀b",)]
    assert masked(spark, [("q",)], "x string", x="none") == [("q",)]
    assert masked(spark, [("q", 1)], "x string, `a.b` long", **{"a.b": "hash"}) == [("q", sha("1"))]


@pytest.mark.parametrize("kind,action", [("int", "redact"), ("date", "null"), ("array<int>", "hash_sha256"), ("array<float>", "redact"), ("timestamp", "redact"), ("decimal(5,2)", "null"), ("struct<a:int>", "partial")])
def test_masks_that_do_not_apply(spark, kind, action):
    with pytest.raises(MaskTypeUnsupported):
        govern(spark.createDataFrame([], f"x {kind}, y int"), policy({"x": action})).df.select("y")


def test_governed_schema(spark):
    s = governed_schema(spark.createDataFrame([], "a long, b string"), policy({"a": "hash"}))
    assert [f.dataType.simpleString() for f in s] == ["string", "string"]


def test_other_spellings_of_like(spark):
    df = spark.createDataFrame([("ab",), ("b~~c",), (None,)], "x string")

    def kept(text):
        return sorted(r.x for r in approve(df, policy(row_filter=text)).row_filter().df.collect())

    assert kept("x ~~ 'a%'") == ["ab"] and kept("x !~~ 'a%'") == ["b~~c"] and kept("x = 'b~~c'") == ["b~~c"]


def test_row_filters(spark):
    df = spark.createDataFrame([(1, "us", None), (2, "eu", 1.5), (3, None, 2.5)], "id long, region string, v double")

    def ids(text):
        return [r.id for r in govern(df, policy(row_filter=text)).df.orderBy("id").collect()]

    assert ids(None) == ids("") == [1, 2, 3]
    assert ids("region = 'us'") == [1]
    assert ids("region != 'us'") == [2]  # null is not true
    assert ids("NOT (id = 1 OR id = 2)") == [3]
    assert ids("id IN (1, 3) AND region IS NULL") == [3]
    assert ids("region LIKE 'e%' OR v >= 2.5") == [2, 3]
    assert ids("region NOT LIKE 'e%'") == [1]
    for bad in ("id +", "abs(id) = 1", "id BETWEEN 1 AND 2", "t.id = 1", "id = (SELECT 1)", "CAST(id AS INT) = 1", "region ILIKE 'x'", "id <=> 1", "nope = 1", "id", "java_method('a', 'b') = 'c'"):
        with pytest.raises(UnsupportedPredicate):
            govern(df, policy(row_filter=bad))


def test_approval(spark):
    df = spark.range(2)
    with pytest.raises(ContractNotApproved):
        GovernedFrame(df, policy())
    with pytest.raises(ContractNotApproved):
        approve(df, ResolvedPolicy("", "1", "t"))
    with pytest.raises(ContractDenied, match="no way"):
        approve(df, policy(decision=Deny("no way")), "d")
    frame = approve(df, policy()).row_filter().mask()
    assert is_approved(frame) and not is_approved(df) and frame.rules == ("ContractApproved", "RowFilter", "Masking")
    assert [e.operator for e in frame.events] == list(frame.rules)


def test_bundles(spark):
    p = policy({"a": "hash", "b": "noop"}, "a = 'x'", {"n": DpParam(1.0, 2.0)})
    doc = json.loads(p.to_bytes())
    assert doc["column_masking"] == {"a": "hash_sha256"}
    back = ResolvedPolicy.from_handle(p.to_handle())
    assert back.row_filter == "a = 'x'" and back.dp_columns == p.dp_columns and back.contract_version == "1"
    assert p.to_handle().handle_id != p.to_handle().handle_id
    assert govern(spark.range(1), BundleHandle(b"", "c", "t")).df.count() == 1
    with pytest.raises(MalformedBundle):
        govern(spark.range(1), BundleHandle(b"{ no json", "c", "t"))
    with pytest.raises(UnknownMaskAction):
        govern(spark.range(1), BundleHandle(b'{"column_masking": {"id": "rainbow"}}', "c", "t"))


def test_noise_has_the_right_spread(spark):
    df = spark.range(0, 20000, numPartitions=4).select(F.lit(1000.0).alias("x"), F.lit(50).cast("long").alias("k"))
    frame = govern(df, policy(dp={"x": DpParam(2.0, 0.2), "k": DpParam(1.0, 1.0)}))
    m, a, v, k = frame.df.agg(F.avg("x"), F.avg(F.abs(F.col("x") - 1000)), F.var_samp("x"), F.avg("k")).first()
    assert abs(m - 1000) < 0.7 and abs(a - 10) < 0.6 and abs(v - 200) < 30 and abs(k - 50) < 0.1
    assert math.isclose(frame.epsilon, 1.2)
    assert dict(frame.df.dtypes) == {"x": "double", "k": "bigint"}


def test_noise_is_fresh_and_checked(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, s string")
    one, two = (govern(df, policy(dp={"x": DpParam(1, 1)})).df.first().x for _ in range(2))
    assert one != two
    for e in (0.0, -0.5, float("nan"), float("inf")):
        with pytest.raises(InvalidNoiseParameters):
            govern(df, policy(dp={"x": DpParam(1.0, e)}))
    with pytest.raises(NoiseTypeUnsupported):
        govern(df, policy(dp={"s": DpParam(1.0, 1.0)}))


def test_budget(spark):
    b = PrivacyBudget({("acme", "x"): 1.0})
    b.consume("acme", {"x": 0.5})
    b.consume("acme", {"x": 0.5})
    with pytest.raises(BudgetExhausted):
        b.consume("acme", {"x": 0.1})
    assert b.remaining("acme", "x") == 0.0 and b.remaining("acme", "y") == 0.0 and b.spent("acme", "x") == 1.0
    assert PrivacyBudget().remaining("t", "c") == float("inf")
    b = PrivacyBudget({("acme", "x"): 1.0, ("acme", "k"): 0.1})
    with pytest.raises(BudgetExhausted):
        b.consume("acme", {"x": 0.5, "k": 0.2})
    assert b.remaining("acme", "x") == 1.0  # all or nothing
    with pytest.raises(BudgetExhausted):
        govern(spark.createDataFrame([(1.0,)], "x double"), policy(dp={"x": DpParam(1.0, 2.0)}), b)


def test_aggregate_noise(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "g string, x double")
    p = policy(dp={"x": DpParam(1.0, 1e12)})
    frame = approve(df, p).group_by("g").agg(s=("sum", "x"), n=("count", "*"), m=("avg", "x"))
    assert [(r.g, round(r.s, 3), r.n, round(r.m, 3)) for r in frame.df.orderBy("g").collect()] == [("a", 3.0, 2, 1.5), ("b", 5.0, 1, 5.0)]
    assert frame.epsilon == 1e12 and frame.rules[-1] == "AggregateNoise"
    with pytest.raises(PactError):
        approve(df, p).group_by("x").agg(n=("count", "*"))
    with pytest.raises(PactError):
        approve(df, p).noise().group_by("g")


def test_attestation(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, email string")
    p = policy({"email": "hash"}, "id > 0", {"id": DpParam(1.0, 1e12)})
    table, e = attest("SELECT 1", govern(df, p), p)
    assert table.num_rows == 2 and e.rules_applied == ("ContractApproved", "RowFilter", "Masking", "LaplaceNoise") and e.epsilon_consumed == 1e12
    assert e.query_sha == sha("SELECT 1") and len(e.result_hash) == 16 and e.signature == sha(e.query_sha + e.result_hash)
    assert "signature" not in json.loads(e.unsigned_json())
    assert attest("q", df, p)[1].result_hash == attest("q", df.orderBy(F.desc("id")), p)[1].result_hash != e.result_hash
    assert result_hash(df.limit(0)) == "ef46db3751d8e999"  # fixed value: xxh64 of nothing
    none, far = attest("q", df, p, rows=False)
    assert none is None and far.result_hash == attest("q", df, p)[1].result_hash == result_hash(df)


def test_result_hashes(spark):
    rows = spark.sql("SELECT id, array(id, 1) AS a, named_struct('x', id % 2, 'y', NULL) AS s, map('k', id, 'l', 2) AS m, 'v' AS v, id % 3 AS v FROM range(20)")
    same = spark.sql("SELECT id, array(id, 1) AS a, named_struct('x', id % 2, 'y', NULL) AS s, map('l', 2, 'k', id) AS m, 'v' AS v, id % 3 AS v FROM range(20)").orderBy(F.desc("id")).repartition(7)
    known = result_hash(rows)
    assert known == result_hash(same) and len(known) == 16
    others = [rows.limit(19), rows.union(rows.limit(1)), rows.toDF("id", "a", "s", "m", "v", "w"), rows.selectExpr("id + 1 AS id", "a", "s", "m").toDF("id", "a", "s", "m"), spark.sql("SELECT CAST(NULL AS INT) AS a, 1 AS b"), spark.sql("SELECT 1 AS a, CAST(NULL AS INT) AS b"), spark.sql("SELECT array(NULL, 1) AS a"), spark.sql("SELECT array(1, NULL) AS a")]
    assert len({known, *map(result_hash, others)}) == 1 + len(others)


def test_attestation_needs_a_version(spark):
    df = spark.range(1)
    with pytest.raises(MissingContractReference):
        attest("q", df, ResolvedPolicy("c", "", "t"))
