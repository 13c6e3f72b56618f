import json

import pytest

from pactspark.errors import BudgetExhausted, ContractNotApproved, MalformedBundle, PactError, UnknownMaskAction, UnsupportedPredicate
from pactspark.plans.rules import RULE_ORDER, AuditKind, Principal, build_pipeline
from pactspark.policy import BundleHandle

ALICE = Principal("user:alice", "analytics", "silver", "internal")


def bundle(**more):
    return BundleHandle(json.dumps({"allowed_purposes": ["analytics"], "required_tier": "silver", "required_classification": "internal", **more}).encode(), "c", "acme")


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("nora.k@mail.test", "north", 5200), ("omar@post.test", "south", 4700), ("pia@mail.test", "south", 6100)], "email string, region string, salary long")


@pytest.mark.parametrize(
    "who,kind",
    [(Principal("a", "marketing", "silver", "internal"), AuditKind.PURPOSE_MISMATCH), (Principal("a", "analytics", "bronze", "internal"), AuditKind.TIER_MISMATCH), (Principal("a", "analytics", "gold", "restricted"), AuditKind.CLASSIFICATION_MISMATCH)],
)
def test_denials_are_empty(people, who, kind):
    p = build_pipeline(bundle(), who)
    out = p.apply(people, "people")
    assert out.count() == 0 and out.schema == people.schema and [a.kind for a in p.audit] == [kind]
    assert "LocalTableScan <empty>" in out._jdf.queryExecution().executedPlan().toString()


def test_unknown_tiers_pass(people):
    assert build_pipeline(bundle(required_tier="platinum"), ALICE).apply(people, "p").count() == 3
    assert build_pipeline(bundle(allowed_purposes=[]), Principal("a", "any", "odd", "internal")).apply(people, "p").count() == 3


@pytest.mark.parametrize("raw", [b"", b"{ no json"])
def test_missing_and_malformed_bundles(people, raw):
    p = build_pipeline(BundleHandle(raw, "c", "t"), ALICE)
    assert p.apply(people, "p").count() == 0 and [a.kind for a in p.audit] == [AuditKind.CONTRACT_DENIED]


def test_filters(people):
    def regions(**more):
        return sorted(r.region for r in build_pipeline(bundle(**more), ALICE).apply(people, "p").collect())

    assert regions() == ["north", "south", "south"] and regions(row_filter="region = 'north'") == ["north"]
    own = {"user:alice": "salary > 5000", "service:ops": None}
    assert regions(row_filter="region = 'north'", per_principal_row_filters=own) == ["north", "south"]
    assert regions(row_filter="region = 'north'", per_principal_row_filters={"user:alice": None}) == ["north", "south", "south"]
    with pytest.raises(UnsupportedPredicate):
        regions(row_filter="length(region) = 2")
    p = build_pipeline(bundle(row_filter="region = 'north'"), ALICE)
    assert p.row_filter(people, "never approved").count() == 3


def test_an_approval_holds_for_its_frame(people):
    p = build_pipeline(bundle(row_filter="region = 'north'"), ALICE)
    assert p.apply(people, "p").count() == 1 and p.approved == {"p"}
    other = people.where("salary > 0")
    for rule in (p.row_filter, p.masking):
        with pytest.raises(ContractNotApproved, match="another frame"):
            rule(other, "p")
    with pytest.raises(ContractNotApproved):
        p.dp_noise(other, "p", [], {"n": ("count", "*")})
    denied = build_pipeline(bundle(), Principal("a", "marketing", "silver", "internal"))
    denied.apply(people, "p")
    assert denied.approved == set()


def test_masks(people):
    out = build_pipeline(bundle(column_policies={"email": {"sensitivity": "pii", "mask": "redact"}, "salary": {"mask": "null"}, "region": {"mask": "partial"}}), ALICE).apply(people, "p")
    assert [tuple(r) for r in out.collect()] == [("<REDACTED>", "***orth", None), ("<REDACTED>", "***outh", None), ("<REDACTED>", "***outh", None)]
    with pytest.raises(UnknownMaskAction):
        build_pipeline(bundle(column_policies={"email": {"mask": "rainbow"}}), ALICE).apply(people, "p")


def test_aggregate_noise_and_budget(people):
    dp = {"salary": {"epsilon_per_query": 0.6, "noise_mechanism": "laplace"}}
    p = build_pipeline(bundle(dp_columns=dp, row_filter="region = 'south'"), ALICE, {("acme", "salary"): 1.0})
    out = p.apply(people, "p", [], {"m": ("avg", "salary"), "s": ("sum", "salary"), "n": ("count", "*")}).first()
    assert out.n == 2 and out.m != 5400.0 and abs(out.m - 5400) < 500
    with pytest.raises(BudgetExhausted):
        p.apply(people, "p", [], {"m": ("avg", "salary")})
    assert p.audit[-1].kind is AuditKind.BUDGET_EXHAUSTED and p.rules == RULE_ORDER
    with pytest.raises(ContractNotApproved):
        p.dp_noise(people, "other", [], {"m": ("avg", "salary")})
    with pytest.raises(PactError, match="grouping by noised columns"):
        p.apply(people, "p", ["salary"], {"n": ("count", "*")})
    for rows in (people, people.select("salary")):
        with pytest.raises(PactError, match="in aggregates only: salary"):
            build_pipeline(bundle(dp_columns=dp), ALICE).apply(rows, "rows")
    assert build_pipeline(bundle(dp_columns=dp), ALICE).apply(people.drop("salary"), "rest").count() == 3
    assert build_pipeline(bundle(dp_columns=dp), Principal("a", "marketing", "silver", "internal")).apply(people, "p").count() == 0
    bad = build_pipeline(bundle(dp_columns={"salary": {"epsilon": 1}}), ALICE)
    with pytest.raises(MalformedBundle):
        bad.apply(people, "p", [], {"m": ("avg", "salary")})
