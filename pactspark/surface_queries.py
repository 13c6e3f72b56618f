"""Queries over the engine's other surfaces: guards, bundles, rules, formats, serving, and Spark's functions by group.

Where a result is a verdict and no data, the SQL twin states the rows that are
expected, written by hand.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bundle_engine import BundleEngine, EngineConfig
from .engine import Engine, new_session, query_session
from .errors import BudgetExhausted, PactError
from .functions.noise import PrivacyBudget, laplace
from .operators.attest import attest, result_hash
from .operators.govern import approve, govern, governed_schema, is_approved
from .plans.guard import reject_unsafe, relations
from .plans.rules import Principal, build_pipeline
from .policy import Allow, BundleHandle, Deny, DpParam, MaskAction, ResolvedPolicy
from .serving.cache import CacheKey, QueryCache
from .serving.formats import ResultFormat, format_result, read_arrow
from .serving.pool import PoolConfig, WorkerPool
from .sources.blob_service import LocalBlobService
from .sources.blob_store import BlobClient, BlobTable, SocketSigner
from .sources.contracts import Caller, JsonContracts
from .sources.signed_bundle import SignedBundle
from .streaming import govern_stream

OUTSIDER, OWNER = Caller("user:bob", "analytics", "globex"), Caller("user:alice", "analytics", "acme")
ALICE = Principal("user:alice", "analytics", "silver", "internal")


def _contract(sf_dir: str, name: str, **more) -> dict:
    return {"contract_id": f"{name}-c", "version": "2", "dataset": f"sales/{name}/v1", "binding": {"parquet": f"{sf_dir}/{name}.parquet"}, "owner_tenant": "acme", "purposes": ["analytics"], **more}


def _said(action: Callable[[], object]) -> str:
    """What an action answers, or the error it raises."""
    try:
        return str(action())
    except PactError as e:
        return str(e)


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x)


def _rows(columns: str, *rows: tuple) -> str:
    listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {listed}) AS t({columns})"


# statements

GUARDED = ["SELECT 1", "copy t to 'f'", "/* a /* b */ */ Load 'x'", "SELECT ';copy x'", "SELECT 1; -- x\n attach 'f'", "SELECT 'it''s'; install e", "extension", "SELECT \"load\" FROM t"]


def q65_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, _said(lambda s=s: reject_unsafe(s))) for k, s in enumerate(GUARDED)], "step int, said string")


def _verb(v: str) -> str:
    return f"unsafe DDL rejected: statement contains disallowed verb '{v}'"


REFUSED = ["INSERT INTO t SELECT 1", "CREATE TABLE t AS SELECT 1", "CREATE VIEW v AS SELECT 1", "SET a = b", "EXPLAIN SELECT 1", "SELECT java_method('a', 'b')", "SELECT * FROM a.b", "SELECT 1; SELECT 2", "SELECT k FROM t", "WITH t AS (SELECT 1 AS k) SELECT k FROM t", "SELECT * FROM t JOIN u USING (k)"]


def q66_query_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = query_session(spark)

    def read(sql: str) -> str:
        try:
            return ",".join(sorted(relations(session, sql)))
        except PactError:
            return "refused"

    return spark.createDataFrame([(k, read(s)) for k, s in enumerate(REFUSED)], "step int, reads string")


def q67_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine.from_json_contracts(spark, [_contract(sf_dir, "nation")])
    ask = 'SELECT 1 FROM "sales/nation/v1"'
    said = [
        ("denied", _said(lambda: e.query(ask, Caller("x", "marketing", "globex")))),
        ("unknown", _said(lambda: e.query("SELECT 1 FROM nowhere", OUTSIDER))),
        ("unsafe", _said(lambda: e.query("ATTACH 'x'", OUTSIDER))),
        ("owner is bound by purpose", _said(lambda: e.query(ask, Caller("x", "marketing", "acme")))),
        ("no bundle", _said(lambda: BundleEngine(spark, EngineConfig("acme", "e", "/s", "/t")).query("SELECT 1"))),
    ]
    return spark.createDataFrame(said, "what string, said string")


def q86_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan shows: the pushed filter and the pruned columns, but no seeds."""
    e = Engine.from_json_contracts(spark, [_contract(sf_dir, "lineitem", row_filter="l_returnflag = 'R'", dp_columns={"l_quantity": {"sensitivity": 1.0, "epsilon": 1.0}})])
    text = e.explain('SELECT l_orderkey, l_quantity FROM "sales/lineitem/v1"', OUTSIDER)
    found = [("filter reaches the scan", "EqualTo(l_returnflag,R)" in text), ("unused column is read", "l_extendedprice" in text), ("seed is shown", re.search(r"rand\(-?\d", text) is not None)]
    return spark.createDataFrame(found, "what string, holds boolean")


# engines and tables


def q68_bundle_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = BundleEngine(spark, EngineConfig("acme", "e", "/s", "/t"))
    e.register_parquet("customers", f"{sf_dir}/customer.parquet")
    e.register_rows("areas", [(k, f"area {k % 3}") for k in range(25)], "nation int, area string")
    e.inject_bundle(BundleHandle(b"b", "c", "acme"))
    return e.query("SELECT area, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customers JOIN areas ON nation = c_nationkey GROUP BY area")


def q69_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    def extended(base) -> bool:
        try:
            type("Mine", (base,), {})
        except TypeError:
            return False
        return True

    bad = [{"tenant_id": ""}, {"engine_id": " "}, {"storage_socket": ""}, {"signer_socket": ""}, {"max_result_rows": 0}]
    settings = {"tenant_id": "a", "engine_id": "b", "storage_socket": "c", "signer_socket": "d"}
    said = [_said(lambda x=x: EngineConfig(**(settings | x))) for x in bad]
    return spark.createDataFrame([("Engine is extended", str(extended(Engine)).lower()), ("BundleEngine is extended", str(extended(BundleEngine)).lower()), *((f"setting {k}", s) for k, s in enumerate(said))], "what string, said string")


def q70_blob_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet table served in byte ranges, and ranges of its bytes, by a service on the machine of driver and executors."""
    body = bytes(spark.read.format("binaryFile").load(f"{sf_dir}/nation.parquet").first()["content"])
    path = os.path.join(tempfile.mkdtemp(), "s")  # a socket of this machine, where the service runs
    with LocalBlobService(path, {"nation": body}):
        session = new_session(spark)
        session.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        session.dataSource.register(BlobTable)
        rows = session.read.format("pact_blob_table").options(socket=path, asset="nation", token="token", columns="n_nationkey,n_name").load().where("n_nationkey < 20").collect()
        client = BlobClient(path, "acme", "token")
        parts = [client.get_range("nation", 0, 4) == body[:4], client.get_range("nation", -4) == body[-4:], client.get_range("nation", 4) == body[4:]]
        said = [_said(lambda: client.read("nation", len(body), 1)), _said(lambda: BlobClient(path, "acme", "other").stat("nation")), SocketSigner(path).sign("{}", "1", "acme")]
    return spark.createDataFrame([*((r.n_nationkey, r.n_name) for r in rows), *((100 + k, str(p).lower()) for k, p in enumerate(parts)), *((200 + k, s) for k, s in enumerate(said))], "k int, said string")


# formats and serving


def q71_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A governed result as Arrow, Parquet and JSON, each read back."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    e = Engine.from_json_contracts(spark, [_contract(sf_dir, "supplier", columns=[{"name": "s_name", "mask": "partial"}])])
    df = e.query('SELECT s_suppkey, s_name FROM "sales/supplier/v1"', OUTSIDER)
    arrow, parquet = read_arrow(format_result(df)), pq.read_table(pa.BufferReader(format_result(df, ResultFormat.PARQUET)))
    lines = [json.loads(x) for x in format_result(df, ResultFormat.JSON).decode().splitlines()]
    rows = [(form, k, n) for form, t in (("arrow", arrow), ("parquet", parquet)) for k, n in zip(t.column("s_suppkey").to_pylist(), t.column("s_name").to_pylist())]
    nothing = [(f"empty {f.name.lower()}", len(format_result(df.limit(0), f)), "") for f in ResultFormat]
    numbers = [(f"number {n}", n, ResultFormat.from_number(n).name) for n in (0, 1, 2, 7)]
    return spark.createDataFrame([*rows, *(("json", x["s_suppkey"], x["s_name"]) for x in lines), *nothing, *numbers], "form string, k long, name string")


def q77_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    now, t = [0.0], pa.table({"a": [1, 2]})
    cache = QueryCache(max_entries=2, ttl=10, clock=lambda: now[0])
    one, two, three = (CacheKey.of("acme", f"q{k}") for k in range(3))
    other = [CacheKey.of("acme", "q0", purpose="p"), CacheKey.of("acme", "q0", principal="u"), CacheKey.of("acme", "q0", policy=b"x"), CacheKey.of("globex", "q0")]
    steps = []

    def step(what: str, held: object) -> None:
        steps.append((what, held is not None))

    cache.put(one, t)
    step("kept", cache.get(one))
    for k, key in enumerate(other):
        step(f"other key {k}", cache.get(key))
    cache.put(two, t)
    cache.get(one)
    cache.put(three, t)
    step("used least recently", cache.get(two))
    step("used since", cache.get(one))
    now[0] = 10.5
    step("too old", cache.get(one))
    cache.put(one, t)
    cache.invalidate_tenant("globex")
    step("another tenant's were dropped", cache.get(one))
    cache.invalidate_tenant("acme")
    step("the tenant's were dropped", cache.get(one))
    small = QueryCache(max_bytes=1)
    small.put(one, t)
    step("too large", small.get(one))
    return spark.createDataFrame(steps, "step string, held boolean")


def q78_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tenants' queries by one pool, with what the cache answered, and a bundle that is swapped."""
    e = Engine.from_json_contracts(spark, [_contract(sf_dir, "customer", row_filter="c_mktsegment = 'BUILDING'")])
    plain = BundleEngine(spark, EngineConfig("initech", "e", "/s", "/t"))
    plain.register_parquet("customer", f"{sf_dir}/customer.parquet")
    pool = WorkerPool(lambda tenant: plain if tenant == "initech" else e, PoolConfig(workers=2, queue_depth=8, drain_s=30))
    ask, rows = 'SELECT count(*) AS n FROM "sales/customer/v1"', []
    for who in (OUTSIDER, OWNER, OUTSIDER):
        rows.append((f"{who.tenant} {len(rows)}", pool.submit(who.tenant, ask, who).result(120).column("n")[0].as_py()))
    rows.append(("hits", pool.cache.stats()["hits"]))
    rows.append(("without a bundle", -len(_said(lambda: pool.submit("initech", "SELECT 1 AS n").result(120)).split(":")[0])))
    pool.refresh_bundle("initech", BundleHandle(b"1", "c", "initech"))
    rows.append(("with a bundle", pool.submit("initech", "SELECT count(*) AS n FROM customer").result(120).column("n")[0].as_py()))
    before = pool.cache.stats()["entries"]
    pool.refresh_bundle("initech", BundleHandle(b"2", "c", "initech"))
    rows.append(("entries that a new bundle drops", before - pool.cache.stats()["entries"]))
    rows.append(("drained", int(pool.shutdown())))
    return spark.createDataFrame(rows, "what string, n long")


# contracts, policies, bundles


def q72_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = JsonContracts([_contract(sf_dir, "nation", columns=[{"name": "n_name", "mask": "HASH"}, {"name": "n_regionkey", "mask": "none"}], row_filter="n_regionkey = 1", dp_columns={"n_nationkey": {"sensitivity": 1, "epsilon": 2}})])
    rows = []
    for who in (OUTSIDER, OWNER, Caller("x", "marketing", "acme")):
        p = source.resolve("sales/nation/v1", who)
        kind = "allow" if isinstance(p.decision, Allow) else "deny"
        rows.append((who.tenant, who.purpose, kind, ",".join(f"{c}={m.value}" for c, m in sorted(p.column_masks.items())), p.row_filter, len(p.dp_columns), len(json.loads(p.to_bytes())["column_masking"])))
    return spark.createDataFrame(rows, "tenant string, purpose string, decision string, masks string, row_filter string, noised int, masks_in_bundle int")


def q73_mask_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = ["redact", "HASH_SHA256", "Hash", "tokenize", "Partial", "null", "none", "NOOP", "rainbow", ""]
    return spark.createDataFrame([(t, _said(lambda t=t: MaskAction.parse(t).value)) for t in tokens], "token string, said string")


def q74_bundle_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy through its bundle's bytes and back governs as before; broken bytes do not govern at all."""
    p = ResolvedPolicy("c", "1", "acme", Allow(), {"n_name": MaskAction.PARTIAL, "n_regionkey": MaskAction.NOOP}, "n_regionkey < 3")
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = govern(df, ResolvedPolicy.from_handle(p.to_handle())).df.selectExpr("n_nationkey AS k", "n_name AS said")
    bad = [(b"{", "malformed"), (b"[]", "no object"), (b'{"column_masking": {"a": "rainbow"}}', "unknown mask"), (b'{"dp_columns": {"a": {"epsilon": 1}}}', "no sensitivity")]
    said = [(-k, f"{name}: {'governed' if _said(lambda b=b: ResolvedPolicy.from_handle(BundleHandle(b, 'c', 't')).contract_id) == 'c' else 'refused'}") for k, (b, name) in enumerate(bad, 1)]
    return rows.unionByName(spark.createDataFrame(said, "k int, said string"))


SIGNED = {
    "bundle": {
        "manifest": {"contract_id": "trial", "contract_version": 7, "compiled_at_unix_ms": 1700000000000},
        "wasm_modules": [{"name": "w", "bytes": [0, 97, 255]}],
        "rego_bundles": [{"name": "purpose", "source": 'allow { input.declared_purpose == "analytics" } allow { input.declared_purpose == "audit" }'}],
        "sql_templates": [{"name": "owner-read", "template": "SELECT * FROM t"}, {"name": "non-owner-read", "template": 'SELECT sha256_hex(a), mask_redact("b"), mask_tokenize(d) FROM t WHERE region = 1'}],
        "resolution_map": {"entries": [{"dataset_id": "acme/t", "operation": "read", "check_ref": "x"}]},
    },
    "signature_hex": "00",
    "metadata": {"bundle_hash_hex": "", "signed_at_unix_ms": 1700000000001, "key_generation": 3},
}


def q75_signed_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, signing payload, and what the bundle says: owner, purposes, masks and filter for others."""
    doc = json.loads(json.dumps(SIGNED))
    b = SignedBundle.parse(json.dumps(doc))
    doc["metadata"]["bundle_hash_hex"] = b.digest().hex()
    b = SignedBundle.parse(json.dumps(doc))
    p = b.policy_for(OUTSIDER)
    rows = [
        ("digest", b.digest().hex()), ("payload", b.signing_payload().hex()), ("owner", b.owner), ("purposes", ",".join(b.purposes())), ("masks", ",".join(f"{c}={m.value}" for c, m in sorted(p.column_masks.items()))), ("filter", p.row_filter),
        ("version", p.contract_version), ("owner's masks", str(len(b.policy_for(OWNER).column_masks))), ("other purpose", str(isinstance(b.policy_for(Caller("x", "sales", "acme")).decision, Deny)).lower()), ("digest holds", _said(b.check_digest)),
    ]
    doc["bundle"]["sql_templates"][1]["template"] += " "
    return spark.createDataFrame([*rows, ("after a change", _said(SignedBundle(doc).check_digest))], "what string, said string")


def _field(x: str) -> str:
    """A text or blob with its length before it, as DuckDB writes it."""
    return f"unhex(printf('%08x', octet_length({x}))) || {x}"


def _signed_twin() -> str:
    b = SIGNED["bundle"]

    def text(x: str) -> str:
        return f"encode('{x.replace(chr(39), chr(39) * 2)}')"

    def little(n: int, size: int) -> str:
        return f"unhex('{n.to_bytes(size, 'little').hex()}')"

    def count(n: int) -> str:
        return f"unhex('{n:08x}')"

    non_owner, owner = b["sql_templates"][1], b["sql_templates"][0]
    fields = [text("trial"), little(7, 8), little(1700000000000, 8), count(1), text("w"), "unhex('0061ff')", count(1), text("purpose"), text(b["rego_bundles"][0]["source"]), count(2), text(non_owner["name"]), text(non_owner["template"]), text(owner["name"]), text(owner["template"]), count(1), text("acme/t"), text("read"), text("x")]
    digest = f"sha256({' || '.join(map(_field, fields))})"
    payload = " || ".join(map(_field, [text("t03:bundle-signing-payload:v1"), "unhex(h)", little(3, 4), little(1700000000001, 8), "unhex(h)"]))
    known = _rows("what, said", ("owner", "acme"), ("purposes", "analytics,audit"), ("masks", "a=hash_sha256,b=redact,d=tokenize"), ("filter", "region = 1"), ("version", "7"), ("owner's masks", "0"), ("other purpose", "true"), ("digest holds", "None"), ("after a change", "the bundle's content doesn't have the recorded digest"))
    return f"WITH d AS (SELECT {digest} AS h) SELECT 'digest' AS what, h AS said FROM d UNION ALL SELECT 'payload', sha256({payload}) FROM d UNION ALL {known}"


# governance operators


def q79_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, rows = PrivacyBudget({("acme", "a"): 1.0, ("acme", "b"): 0.25}), []
    for costs in ({"a": 0.5}, {"a": 0.25, "b": 0.25}, {"a": 0.25, "b": 0.25}, {"c": 0.5}, {"a": 0.25}, {"a": 0.25}):
        try:
            b.consume("acme", costs)
            said = "taken"
        except BudgetExhausted as e:
            said = str(e)
        rows.append((len(rows), said, b.remaining("acme", "a"), b.remaining("acme", "b"), b.spent("acme", "a")))
    return spark.createDataFrame(rows, "step int, said string, left_a double, left_b double, spent_a double")


def _bundle(**more) -> BundleHandle:
    return BundleHandle(json.dumps({"allowed_purposes": ["analytics"], "required_tier": "silver", "required_classification": "internal", **more}).encode(), "rules", "acme")


def q80_four_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four rules on one table; the noise is too small to be seen after rounding."""
    bundle = _bundle(row_filter="l_returnflag = 'R' AND NOT l_quantity IS NULL", column_policies={"l_linestatus": {"mask": "partial"}}, dp_columns={"l_extendedprice": {"epsilon_per_query": 1e12, "noise_mechanism": "laplace"}})
    out = build_pipeline(bundle, ALICE).apply(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "lineitem", ["l_linestatus"], {"total": ("sum", "l_extendedprice"), "most": ("max", "l_extendedprice"), "n": ("count", "*")})
    return out.select("l_linestatus", F.round("total", 1).alias("total"), F.round("most", 2).alias("most"), "n")


def q80b_rules_refuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    dp = {"n_regionkey": {"epsilon_per_query": 0.75, "noise_mechanism": "laplace"}}
    p = build_pipeline(_bundle(dp_columns=dp), ALICE, {("acme", "n_regionkey"): 1.0})
    ask = {"s": ("sum", "n_regionkey")}
    rows = [
        ("rows with noise", _said(lambda: p.apply(df, "nation"))), ("group by noise", _said(lambda: p.apply(df, "nation", ["n_regionkey"], ask))), ("first", str(p.apply(df, "nation", [], ask).count())), ("second", _said(lambda: p.apply(df, "nation", [], ask))),
        ("another frame", _said(lambda: p.row_filter(df.limit(3), "nation"))), ("not approved", _said(lambda: p.dp_noise(df, "other", [], ask))), ("order", ",".join(p.rules)), ("approved", ",".join(sorted(p.approved))), ("last audit", p.audit[-1].kind.value),
    ]
    return spark.createDataFrame(rows, "what string, said string")


def q81_noise_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, mean distance and variance of 60,000 samples of scale 10, within six standard errors."""
    z = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(laplace(10.0, (11, 12)).alias("z"))
    m = z.agg(F.count("z").alias("n"), F.avg("z").alias("mean"), F.avg(F.abs("z")).alias("far"), F.var_pop("z").alias("var"))
    error = 6 / F.sqrt("n")
    return m.select((F.abs("mean") < 14.2 * error).alias("mean_is_zero"), (F.abs(F.col("far") - 10) < 10 * error).alias("distance_is_scale"), (F.abs(F.col("var") - 200) < 448 * error).alias("variance_is_twice_its_square"))


def q82_attestation_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    p = ResolvedPolicy("c", "9", "acme", Allow(), {"s_name": MaskAction.TOKENIZE}, "s_suppkey >= 0", {"s_acctbal": DpParam(1.0, 0.5)})
    frame = govern(df, p)
    table, one = attest("SELECT 1", approve(df, p).row_filter().mask(), p)
    _, two = attest("SELECT 1", approve(df.orderBy(F.desc("s_name")).repartition(5), p).row_filter().mask(), p, rows=False)
    noisy = attest("SELECT 1", frame, p, rows=False)[1]
    import hashlib

    checks = [
        ("rows came", table.num_rows == df.count()), ("order does not matter", one.result_hash == two.result_hash), ("noise matters", noisy.result_hash != one.result_hash), ("one row less matters", result_hash(df.limit(3)) != result_hash(df.limit(2))), ("nothing", result_hash(df.limit(0)) == "ef46db3751d8e999"),
        ("signature covers query and result", one.signature == hashlib.sha256((one.query_sha + one.result_hash).encode()).hexdigest()), ("epsilon", noisy.epsilon_consumed == 0.5), ("no epsilon", one.epsilon_consumed is None and one.delta_consumed is None), ("the envelope leaves its signature out", "signature" not in json.loads(one.unsigned_json())),
        ("rules", noisy.rules_applied == ("ContractApproved", "RowFilter", "Masking", "LaplaceNoise")), ("version needed", "needs contract_id and contract_version" in _said(lambda: attest("q", df, ResolvedPolicy("c", "", "t")))),
    ]
    return spark.createDataFrame(checks, "what string, holds boolean")


def q83_governed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered and masked stream, written as Parquet until its source is read."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp()
    folder = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    kind = spark.read.parquet(f"{sf_dir}/customer.parquet").schema
    p = ResolvedPolicy("c", "1", "acme", Allow(), {"c_name": MaskAction.HASH_SHA256, "c_acctbal": MaskAction.NULL}, "c_mktsegment = 'MACHINERY'")
    stream = govern_stream(spark.readStream.schema(kind).option("pathGlobFilter", "customer.parquet").parquet(sf_dir), p).df
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def q87_governed_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    p = ResolvedPolicy("c", "1", "acme", Allow(), {c: MaskAction.HASH_SHA256 for c in df.columns[:3]} | {"l_returnflag": MaskAction.REDACT})
    refused = [_said(lambda c=c, m=m: govern(df, ResolvedPolicy("c", "1", "acme", Allow(), {c: m}))) for c, m in (("l_shipdate", MaskAction.REDACT), ("l_linenumber", MaskAction.NULL))]
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in governed_schema(df, p)] + [(f"refused {k}", x) for k, x in enumerate(refused)], "name string, kind string")


def q88_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/region.parquet")
    p = ResolvedPolicy("c", "1", "acme")
    frame = approve(df, p)
    from .operators.govern import GovernedFrame

    rows = [
        ("approved", str(is_approved(frame)).lower()), ("after masks", str(is_approved(frame.row_filter().mask())).lower()), ("plain frame", str(is_approved(df)).lower()), ("made by hand", _said(lambda: GovernedFrame(df, p))),
        ("no contract id", _said(lambda: approve(df, ResolvedPolicy("", "1", "acme")))), ("denied", _said(lambda: approve(df, ResolvedPolicy("c", "1", "acme", Deny("no")), "d"))), ("events", ",".join(e.operator for e in frame.row_filter("r_regionkey > 1").mask().events)),
        ("filter beyond the grammar", str("predicate grammar" in _said(lambda: frame.row_filter("length(r_name) > 3"))).lower()), ("unknown column", str("doesn't fit" in _said(lambda: frame.row_filter("nope = 1"))).lower()),
    ]
    return spark.createDataFrame(rows, "what string, said string")


FRAMES = [q65_guard, q66_query_only, q67_errors, q68_bundle_engine, q69_sealed, q70_blob_table, q71_formats, q72_resolution, q73_mask_tokens, q74_bundle_bytes, q75_signed_bundle, q77_cache, q78_pool, q79_budget, q80_four_rules, q80b_rules_refuse, q81_noise_moments, q82_attestation_hash, q83_governed_stream, q86_explain, q87_governed_schema, q88_approval]

_BAD_SETTINGS = [f"{n} is empty" for n in ("tenant_id", "engine_id", "storage_socket", "signer_socket")]
TWINS: dict[str, str] = {
    "q65_guard": _rows("step, said", *enumerate(["None", _verb("COPY"), _verb("LOAD"), "None", _verb("ATTACH"), _verb("INSTALL"), _verb("EXTENSION"), "None"])),
    "q66_query_only": _rows("step, reads", *enumerate(["refused"] * 8 + ["t", "", "t,u"])),
    "q67_errors": _rows(
        "what, said",
        ("denied", "contract denied access to 'sales/nation/v1': purpose 'marketing' not permitted (allowed: analytics)"),
        ("unknown", "contract resolution failed for 'nowhere': no contract for dataset 'nowhere'"),
        ("unsafe", _verb("ATTACH")),
        ("owner is bound by purpose", "contract denied access to 'sales/nation/v1': purpose 'marketing' not permitted (allowed: analytics)"),
        ("no bundle", "no contract bundle: inject one before the first query"),
    ),
    "q68_bundle_engine": "SELECT 'area ' || (c_nationkey % 3) AS area, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_nationkey < 25 GROUP BY 1",
    "q69_sealed": _rows("what, said", ("Engine is extended", "false"), ("BundleEngine is extended", "false"), *((f"setting {k}", s) for k, s in enumerate([*_BAD_SETTINGS, "max_result_rows must be above zero"]))),
    "q70_blob_table": "SELECT n_nationkey AS k, n_name AS said FROM nation WHERE n_nationkey < 20 UNION ALL " + _rows("k, said", (100, "true"), (101, "true"), (102, "true"), (200, "RANGE_ERROR: outside the blob"), (201, "ACCESS_DENIED: no access")) + " UNION ALL SELECT 202, sha256('{}')",
    "q71_formats": "SELECT form, s_suppkey AS k, '***' || right(s_name, 4) AS name FROM supplier, (VALUES ('arrow'), ('parquet'), ('json')) AS f(form) UNION ALL "
    + _rows("form, k, name", ("empty arrow", 0, ""), ("empty parquet", 0, ""), ("empty json", 0, ""), ("number 0", 0, "ARROW"), ("number 1", 1, "PARQUET"), ("number 2", 2, "JSON"), ("number 7", 7, "ARROW")),
    "q72_resolution": _rows("tenant, purpose, decision, masks, row_filter, noised, masks_in_bundle", ("globex", "analytics", "allow", "n_name=hash_sha256,n_regionkey=noop", "n_regionkey = 1", 1, 1), ("acme", "analytics", "allow", "", None, 0, 0), ("acme", "marketing", "deny", "", None, 0, 0)),
    "q73_mask_tokens": _rows("token, said", ("redact", "redact"), ("HASH_SHA256", "hash_sha256"), ("Hash", "hash_sha256"), ("tokenize", "tokenize"), ("Partial", "partial"), ("null", "null"), ("none", "noop"), ("NOOP", "noop"), ("rainbow", "unknown mask action 'rainbow'"), ("", "unknown mask action ''")),
    "q74_bundle_bytes": "SELECT n_nationkey AS k, '***' || right(n_name, 4) AS said FROM nation WHERE n_regionkey < 3 UNION ALL " + _rows("k, said", (-1, "malformed: refused"), (-2, "no object: refused"), (-3, "unknown mask: refused"), (-4, "no sensitivity: refused")),
    "q75_signed_bundle": _signed_twin(),
    "q77_cache": _rows("step, held", ("kept", True), *((f"other key {k}", False) for k in range(4)), ("used least recently", False), ("used since", True), ("too old", False), ("another tenant''s were dropped".replace("''", "'"), True), ("the tenant's were dropped", False), ("too large", False)),
    "q78_pool": "SELECT 'globex ' || k AS what, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS n FROM (VALUES (0), (2)) AS v(k) UNION ALL SELECT 'acme 1', count(*) FROM customer UNION ALL SELECT 'with a bundle', count(*) FROM customer UNION ALL " + _rows("what, n", ("hits", 1), ("without a bundle", -18), ("entries that a new bundle drops", 1), ("drained", 1)),
    "q79_budget": _rows(
        "step, said, left_a, left_b, spent_a",
        (0, "taken", 0.5, 0.25, 0.5),
        (1, "taken", 0.25, 0.0, 0.75),
        (2, "privacy budget exhausted for column 'b' of tenant 'acme': 0.25 wanted, 0.0 left", 0.25, 0.0, 0.75),
        (3, "privacy budget exhausted for column 'c' of tenant 'acme': 0.5 wanted, 0.0 left", 0.25, 0.0, 0.75),
        (4, "taken", 0.0, 0.0, 1.0),
        (5, "privacy budget exhausted for column 'a' of tenant 'acme': 0.25 wanted, 0.0 left", 0.0, 0.0, 1.0),
    ),
    "q80_four_rules": "SELECT '***' || l_linestatus AS l_linestatus, round(sum(l_extendedprice), 1) AS total, round(max(l_extendedprice), 2) AS most, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity IS NOT NULL GROUP BY 1",
    "q80b_rules_refuse": _rows(
        "what, said",
        ("rows with noise", "columns with noise come in aggregates only: n_regionkey"),
        ("group by noise", "grouping by noised columns shows their values: n_regionkey"),
        ("first", "1"),
        ("second", "privacy budget exhausted for column 'n_regionkey' of tenant 'acme': 0.75 wanted, 0.25 left"),
        ("another frame", "another frame than this one was approved as 'nation'"),
        ("not approved", "table 'other' was not approved"),
        ("order", "contract_check,row_filter,masking,dp_noise"),
        ("approved", "nation"),
        ("last audit", "privacy_budget_exhausted"),
    ),
    "q81_noise_moments": "SELECT true AS mean_is_zero, true AS distance_is_scale, true AS variance_is_twice_its_square",
    "q82_attestation_hash": _rows("what, holds", *((w, True) for w in ("rows came", "order does not matter", "noise matters", "one row less matters", "nothing", "signature covers query and result", "epsilon", "no epsilon", "the envelope leaves its signature out", "rules", "version needed"))),
    "q83_governed_stream": "SELECT c_custkey, sha256(c_name) AS c_name, CASE WHEN c_acctbal IS NULL THEN NULL ELSE 0.0::DOUBLE END AS c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "q86_explain": _rows("what, holds", ("filter reaches the scan", True), ("unused column is read", False), ("seed is shown", False)),
    "q87_governed_schema": _rows("name, kind", ("l_orderkey", "string"), ("l_linenumber", "string"), ("l_quantity", "string"), ("l_returnflag", "string"), ("l_shipdate", "timestamp_ntz"), ("refused 0", "mask 'redact' does not apply to column 'l_shipdate' of type timestamp_ntz"), ("refused 1", "mask 'null' does not apply to column 'l_linenumber' of type int")),
    "q88_approval": _rows(
        "what, said",
        ("approved", "true"),
        ("after masks", "true"),
        ("plain frame", "false"),
        ("made by hand", "only approve() makes governed frames"),
        ("no contract id", "the contract has no id"),
        ("denied", "contract denied access to 'd': no"),
        ("events", "ContractApproved,RowFilter,Masking"),
        ("filter beyond the grammar", "true"),
        ("unknown column", "true"),
    ),
}

# Spark's functions, by group, over governed views

SQL: dict[str, tuple[str, str]] = {
    "q89_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, from_json(props, 'k INT').k + 1 AS next, to_json(named_struct('t', event_type, 'k', 1)) AS j FROM \"sales/events/v1\" t",
        """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS INT) + 1 AS next, '{"t":"' || event_type || '","k":1}' AS j FROM events""",
    ),
    "q90_regex": (
        r"""SELECT p_partkey, regexp_count(p_name, '[aeiou]') AS vowels, regexp_like(p_name, '^[a-m]') AS early, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) AS second, array_join(regexp_extract_all(p_name, '([a-z]+)', 1), '+') AS parts, regexp_match(p_name, 'r[a-z]')[0] AS r FROM "sales/part/v1" t""",
        r"""SELECT p_partkey, len(regexp_extract_all(p_name, '[aeiou]'))::INT AS vowels, regexp_matches(p_name, '^[a-m]') AS early, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) AS second, array_to_string(regexp_extract_all(p_name, '([a-z]+)'), '+') AS parts, nullif(regexp_extract(p_name, 'r[a-z]'), '') AS r FROM part""",
    ),
    "q91_dates": (
        "SELECT event_id, date_bin(INTERVAL '15' MINUTE, ts) AS quarter, date_bin(INTERVAL '1' DAY, ts, TIMESTAMP_NTZ '2000-01-01 06:00:00') AS day6, make_date(2024, 2, 29) AS leap, date_format(ts, 'yyyy/MM') AS ym, datediff(DATE '2024-03-01', CAST(ts AS DATE)) AS until, last_day(CAST(ts AS DATE)) AS last, date_add(CAST(ts AS DATE), 30) AS later, date_part('hour', ts) AS h, to_date('2024-05-06') AS d FROM \"sales/events/v1\" t",
        "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS quarter, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2000-01-01 06:00:00') AS day6, make_date(2024, 2, 29) AS leap, strftime(ts, '%Y/%m') AS ym, datediff('day', ts::DATE, DATE '2024-03-01')::INT AS until, last_day(ts::DATE) AS last, (ts::DATE + 30)::DATE AS later, date_part('hour', ts)::INT AS h, DATE '2024-05-06' AS d FROM events",
    ),
    "q92_arrays": (
        "SELECT p_partkey, array_has(make_array(p_size, 7), 7) AS has, array_length(array_append(make_array(p_size), 1)) AS n, array_to_string(array_sort(array_concat(make_array(p_size), make_array(3, 20))), ',') AS sorted, array_to_string(array_reverse(generate_series(1, 1 + p_size % 4)), ',') AS back, array_element(make_array(p_size, 2), 2) AS second, array_to_string(array_except(make_array(1, 2, 3), make_array(p_size % 4)), ',') AS rest, array_to_string(array_intersect(make_array(1, 2, 3), make_array(p_size % 4)), ',') AS both, cardinality(array_union(make_array(p_size), make_array(5))) AS u, array_has_any(make_array(1, p_size), make_array(2, 3, 4)) AS anyof, array_to_string(array_remove(make_array(1, p_size % 3, 1), 1), ',') AS gone, array_to_string(array_repeat(p_size, 2), ',') AS twice, array_to_string(flatten(make_array(make_array(p_size), make_array(1))), ',') AS flat, array_min(make_array(p_size, 9)) AS least, array_to_string(string_to_array(p_name, ' '), '_') AS words FROM \"sales/part/v1\" t",
        "SELECT p_partkey, list_contains([p_size, 7], 7) AS has, len(list_append([p_size], 1))::INT AS n, array_to_string(list_sort([p_size] || [3, 20]), ',') AS sorted, array_to_string(list_reverse(generate_series(1, 1 + p_size % 4)), ',') AS back, [p_size, 2][2] AS second, array_to_string(list_filter([1, 2, 3], lambda x: x <> p_size % 4), ',') AS rest, array_to_string(list_filter([1, 2, 3], lambda x: x = p_size % 4), ',') AS both, CASE WHEN p_size = 5 THEN 1 ELSE 2 END AS u, list_has_any([1, p_size], [2, 3, 4]) AS anyof, array_to_string(list_filter([1, p_size % 3, 1], lambda x: x <> 1), ',') AS gone, p_size || ',' || p_size AS twice, p_size || ',1' AS flat, least(p_size, 9) AS least, replace(p_name, ' ', '_') AS words FROM part",
    ),
    "q93_maps": (
        "SELECT p_partkey, element_at(m, p_name) AS size, cardinality(m) AS n, array_to_string(array_sort(map_keys(m)), ',') AS ks, array_max(map_values(m)) AS most, s.a AS a, s.b AS b FROM (SELECT p_partkey, p_name, make_map(make_array(p_name, p_type), make_array(p_size, 100)) AS m, named_struct('a', p_size, 'b', upper(p_type)) AS s FROM \"sales/part/v1\" t) x",
        "SELECT p_partkey, p_size AS size, 2 AS n, least(p_name, p_type) || ',' || greatest(p_name, p_type) AS ks, greatest(p_size, 100) AS most, p_size AS a, upper(p_type) AS b FROM part",
    ),
    "q94_strings": (
        "SELECT p_partkey, bit_length(p_name) AS bits, octet_length(p_name) AS bytes, initcap(p_type) AS cap, strpos(p_name, ' ') AS blank, starts_with(p_name, 'r') AS r, ends_with(p_name, 't') AS t, substr_index(p_name, ' ', 1) AS head, to_hex(p_size) AS hex, chr(65 + p_size % 26) AS c, rpad(p_type, 9, '*') AS rp, levenshtein(p_name, 'red bolt') AS far, overlay(p_name PLACING '##' FROM 2 FOR 3) AS o, contains(p_name, 'ol') AS ol, btrim('  x ') AS b, position('g' IN p_name) AS g, find_in_set('b', concat('a,', 'b')) AS f, char_length(p_name) AS n FROM \"sales/part/v1\" t",
        "SELECT p_partkey, bit_length(p_name)::INT AS bits, strlen(p_name)::INT AS bytes, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS cap, strpos(p_name, ' ')::INT AS blank, starts_with(p_name, 'r') AS r, ends_with(p_name, 't') AS t, split_part(p_name, ' ', 1) AS head, lower(printf('%x', p_size)) AS hex, chr(65 + p_size % 26) AS c, rpad(p_type, 9, '*') AS rp, levenshtein(p_name, 'red bolt')::INT AS far, left(p_name, 1) || '##' || substr(p_name, 5) AS o, contains(p_name, 'ol') AS ol, 'x' AS b, position('g' IN p_name)::INT AS g, 2 AS f, length(p_name)::INT AS n FROM part",
    ),
    "q95_math": (
        "SELECT p_partkey, gcd(p_size, 12) AS g, lcm(p_size, 4) AS l, round(cbrt(p_retailprice), 6) AS cb, round(exp(p_size / 50.0D), 6) AS e, round(log2(p_retailprice), 6) AS l2, round(log10(p_retailprice), 6) AS l10, factorial(p_size % 9) AS f, round(degrees(p_size), 6) AS dg, round(radians(p_size), 6) AS rd, round(pi() * p_size, 6) AS p, signum(p_size - 25.0D) AS s, round(p_retailprice, -1) AS tens, iszero(p_size % 5) AS five, isnan(CAST('NaN' AS DOUBLE)) AS nan, nanvl(CAST('NaN' AS DOUBLE), 2.0D) AS nv, round(tanh(p_size / 10.0D), 6) AS th, round(acos(1.0D / (1 + p_size)), 6) AS ac FROM \"sales/part/v1\" t",
        "SELECT p_partkey, gcd(p_size, 12)::BIGINT AS g, lcm(p_size, 4)::BIGINT AS l, round(cbrt(p_retailprice), 6) AS cb, round(exp(p_size / 50.0), 6) AS e, round(log2(p_retailprice), 6) AS l2, round(log10(p_retailprice), 6) AS l10, factorial(p_size % 9)::BIGINT AS f, round(degrees(p_size), 6) AS dg, round(radians(p_size), 6) AS rd, round(pi() * p_size, 6) AS p, sign(p_size - 25)::DOUBLE AS s, round(p_retailprice, -1) AS tens, p_size % 5 = 0 AS five, true AS nan, 2.0::DOUBLE AS nv, round(tanh(p_size / 10.0), 6) AS th, round(acos(1.0 / (1 + p_size)), 6) AS ac FROM part",
    ),
    "q96_hashes": ('SELECT c_custkey, sha256(c_name) AS s, md5(c_name) AS m, sha1(c_name) AS o, base64(encode(c_name, \'UTF-8\')) AS b FROM "sales/customer/v1" t', "SELECT c_custkey, sha256(c_name) AS s, md5(c_name) AS m, sha1(c_name) AS o, base64(encode(c_name)) AS b FROM customer"),
    "q97_aggregates": (
        "SELECT l_linestatus, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(covar_samp(l_quantity, l_extendedprice), 3) AS cs, round(regr_intercept(l_extendedprice, l_quantity), 3) AS ri, regr_count(l_extendedprice, l_quantity) AS rc, bool_or(l_quantity > 49) AS big, count_if(l_discount > 0.05) AS disc, round(approx_median(l_quantity), 3) AS med, approx_percentile_cont(l_linenumber, 0.5) AS mid, approx_distinct(l_linenumber) AS kinds, array_to_string(array_sort(collect_set(l_returnflag)), ',') AS flags, max_by(l_orderkey, struct(l_extendedprice, l_orderkey)) AS dearest, round(skewness(l_quantity) * 0, 3) AS zero FROM \"sales/lineitem/v1\" t GROUP BY l_linestatus",
        "SELECT l_linestatus, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(covar_samp(l_quantity, l_extendedprice), 3) AS cs, round(regr_intercept(l_extendedprice, l_quantity), 3) AS ri, regr_count(l_extendedprice, l_quantity)::BIGINT AS rc, bool_or(l_quantity > 49) AS big, count(*) FILTER (WHERE l_discount > 0.05) AS disc, round(median(l_quantity), 3) AS med, quantile_disc(l_linenumber, 0.5) AS mid, count(DISTINCT l_linenumber) AS kinds, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS dearest, 0.0::DOUBLE AS zero FROM lineitem GROUP BY l_linestatus",
    ),
    "q98_windows": (
        'SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r, nth_value(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nth, lead(c_custkey, 2, -1L) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ahead, last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM "sales/customer/v1" t',
        "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)::INT AS r, nth_value(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nth, lead(c_custkey, 2, -1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ahead, last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM customer",
    ),
    "q99_set_operations": (
        'SELECT c_nationkey AS k, \'all\' AS op FROM "sales/customer/v1" a EXCEPT ALL SELECT n_nationkey, \'all\' FROM "sales/nation/v1" b UNION ALL (SELECT c_nationkey, \'both\' FROM "sales/customer/v1" c INTERSECT ALL SELECT n_nationkey, \'both\' FROM "sales/nation/v1" d WHERE n_regionkey < 3)',
        "SELECT c_nationkey AS k, 'all' AS op FROM customer EXCEPT ALL SELECT n_nationkey, 'all' FROM nation UNION ALL (SELECT c_nationkey, 'both' FROM customer INTERSECT ALL SELECT n_nationkey, 'both' FROM nation WHERE n_regionkey < 3)",
    ),
    "q100_nulls_first": (
        'SELECT n_name, b FROM (SELECT n_name, nullif(n_regionkey, 2) AS b FROM "sales/nation/v1" t) x ORDER BY b NULLS FIRST, n_name DESC LIMIT 9',
        "SELECT n_name, b FROM (SELECT n_name, nullif(n_regionkey, 2) AS b FROM nation) ORDER BY b NULLS FIRST, n_name DESC LIMIT 9",
    ),
    "q101_typing": (
        "SELECT p_partkey, try_cast(p_name AS INT) AS none, CAST(p_retailprice AS INT) AS i, CAST(p_size AS STRING) || '!' AS s, arrow_typeof(p_size) AS kind, p_retailprice::DECIMAL(12, 1) AS d FROM \"sales/part/v1\" t",
        "SELECT p_partkey, NULL::INT AS none, trunc(p_retailprice)::INT AS i, p_size || '!' AS s, 'int' AS kind, round(p_retailprice::DECIMAL(18, 4), 1)::DECIMAL(12, 1) AS d FROM part",
    ),
    "q102_pivot": (
        "SELECT * FROM (SELECT l_linestatus, l_returnflag, l_quantity FROM \"sales/lineitem/v1\" t) PIVOT (sum(l_quantity) FOR l_returnflag IN ('A' AS a, 'N' AS n, 'R' AS r))",
        "SELECT l_linestatus, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS n, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY l_linestatus",
    ),
    "q103_unnest": ("SELECT p_partkey, unnest(split(p_name, ' ')) AS word FROM \"sales/part/v1\" t", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part"),
    "q104_range_join": (
        'SELECT a.event_id, count(b.event_id) AS n FROM "sales/events/v1" a LEFT JOIN "sales/events/v1" b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL \'1\' HOUR GROUP BY a.event_id',
        "SELECT a.event_id, count(b.event_id) AS n FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR GROUP BY a.event_id",
    ),
    "q105_as_of": (
        # Orders are at whole hours, so the last error of each hour is enough: it is told to the first whole hour from it on and the next five,
        # and each order meets one row. Hours are counted from 2024-01-01; an order's lie between -699 and 699.
        "WITH h AS (SELECT datediff(CAST(ts AS DATE), DATE '2024-01-01') * 24L + hour(ts) + CAST(minute(ts) > 0 OR extract(SECOND FROM ts) > 0 AS INT) AS first, max_by(event_id, struct(ts, event_id)) FILTER (WHERE event_id IS NOT NULL) AS last FROM \"sales/events/v1\" t WHERE event_type = 'error' AND ts IS NOT NULL GROUP BY 1), e AS (SELECT n, max_by(last, first) FILTER (WHERE last IS NOT NULL) AS last_error FROM (SELECT first, last, explode(sequence(first, first + 5)) AS n FROM h) x WHERE n BETWEEN -699 AND 699 GROUP BY n) SELECT /*+ BROADCAST(e) */ o_orderkey, last_error FROM (SELECT DISTINCT o_orderkey FROM \"sales/orders/v1\" t) o JOIN e ON e.n = o.o_orderkey % 700",
        "SELECT o_orderkey, arg_max(e.event_id, (e.ts, e.event_id)) AS last_error FROM (SELECT o_orderkey, TIMESTAMP '2024-01-01 00:00:00' + to_hours(o_orderkey % 700) AS at FROM orders) o JOIN (SELECT event_id, ts FROM events WHERE event_type = 'error') e ON e.ts <= o.at AND e.ts > o.at - INTERVAL 6 HOUR GROUP BY o_orderkey",
    ),
}
_TABLES = ("customer", "orders", "lineitem", "events", "part", "nation")


def _sql_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine.from_json_contracts(spark, [_contract(sf_dir, t) for t in _TABLES]).query(sql, OUTSIDER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in FRAMES} | {name: _sql_query(sql) for name, (sql, _) in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return TWINS | {name: twin for name, (_, twin) in SQL.items()}
