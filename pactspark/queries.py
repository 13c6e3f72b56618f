"""Queries of the governance engine for the driver entry module, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import surface_queries
from .engine import Engine
from .functions.noise import PrivacyBudget
from .operators.attest import attest, result_hash
from .operators.govern import approve, govern
from .plans.rules import Pipeline, Principal, build_pipeline
from .policy import Allow, BundleHandle, DpParam, MaskAction, ResolvedPolicy
from .serving.formats import json_rows
from .sources.contracts import Caller

OWNER, OUTSIDER = Caller("user:alice", "analytics", "acme"), Caller("user:bob", "analytics", "globex")


def contract(sf_dir: str, name: str, masks: dict[str, str] | None = None, row_filter: str | None = None, dp: dict | None = None) -> dict:
    return {
        "contract_id": f"{name}-contract", "version": "1.0.0", "dataset": f"sales/{name}/v1", "binding": {"parquet": f"{sf_dir}/{name}.parquet"}, "owner_tenant": "acme", "purposes": ["analytics"],
        "columns": [{"name": c, "mask": m} for c, m in (masks or {}).items()], "row_filter": row_filter, "dp_columns": dp or {},
    }


CUSTOMER_MASKS, CUSTOMER_FILTER = {"c_name": "hash_sha256", "c_acctbal": "redact"}, "c_mktsegment = 'BUILDING'"
ORDERS_FILTER = "o_orderstatus IN ('F', 'O')"


def default_contracts(sf_dir: str) -> list[dict]:
    return [
        contract(sf_dir, "customer", CUSTOMER_MASKS, CUSTOMER_FILTER),
        contract(sf_dir, "orders", {"o_orderpriority": "partial"}, ORDERS_FILTER),
        contract(sf_dir, "lineitem", {}, "l_returnflag <> 'N' OR l_quantity >= 10"),
        contract(sf_dir, "events", {"user_id": "hash_sha256"}, "event_type IS NOT NULL"),
        contract(sf_dir, "part", {"p_brand": "tokenize"}),
        contract(sf_dir, "nation"),
        contract(sf_dir, "supplier", {"s_name": "partial"}),
    ]


#: The governed views as the outsider sees them, for the SQL twins.
_VIEWS = {
    "customer": f"(SELECT c_custkey, sha256(c_name) AS c_name, c_nationkey, CASE WHEN c_acctbal IS NULL THEN NULL ELSE 0.0::DOUBLE END AS c_acctbal, c_mktsegment FROM customer WHERE {CUSTOMER_FILTER})",
    "orders": f"(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, '***' || right(o_orderpriority, 4) AS o_orderpriority FROM orders WHERE {ORDERS_FILTER})",
    "lineitem": "(SELECT * FROM lineitem WHERE l_returnflag <> 'N' OR l_quantity >= 10)",
    "events": "(SELECT event_id, ts, sha256(CAST(user_id AS VARCHAR)) AS user_id, event_type, value, props FROM events WHERE event_type IS NOT NULL)",
    "part": "(SELECT p_partkey, p_name, sha256(p_brand) AS p_brand, p_type, p_size, p_retailprice FROM part)",
    "nation": "(SELECT * FROM nation)",
    "supplier": "(SELECT s_suppkey, '***' || right(s_name, 4) AS s_name, s_nationkey, s_acctbal FROM supplier)",
}


#: Where DuckDB spells a query of SQL differently.
_SPELT = {
    "q47_unnest": "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM \"sales/part/v1\" t",
    "q55_array_functions": "SELECT p_partkey, array_to_string([p_brand, p_type], '|') AS j, list_contains([1, 5, p_size], 5) AS h, list_max([p_size, 7]) AS m, CAST(list_position([9, p_size], p_size) AS BIGINT) AS at, p_size AS e, len(list_distinct([p_size, 3, 3]))::INT AS d, array_to_string(list_slice(generate_series(p_size, p_size + 4), 2, 4), ',') AS sl FROM \"sales/part/v1\" t",
    "q56_map_struct_functions": 'SELECT p_partkey, p_size AS v, p_brand AS k, p_size % 5 AS x FROM "sales/part/v1" t',
    "q57_conditionals": 'SELECT p_partkey, coalesce(nullif(p_size, 3), 0) AS a, CASE WHEN nullif(p_size, 3) IS NOT NULL THEN 1 ELSE 2 END AS b, coalesce(nullif(p_size, 4), -4) AS c FROM "sales/part/v1" t',
    "q58_approx": 'SELECT l_returnflag, count(DISTINCT l_linenumber) AS n, quantile_disc(l_linenumber, 0.5) AS m FROM "sales/lineitem/v1" t GROUP BY l_returnflag',
    "q61_string_agg": 'SELECT n_regionkey, string_agg(n_name, \',\' ORDER BY n_name) AS names FROM "sales/nation/v1" t GROUP BY n_regionkey',
}


def _twin(sql: str) -> str:
    for name, view in _VIEWS.items():
        sql = sql.replace(f'"sales/{name}/v1"', f"{view}")
    return sql


#: Queries over the default contracts; DuckDB runs the same text over subqueries in place of the datasets.
SQL: dict[str, str] = {
    "q01_outsider_mask_filter": 'SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM "sales/customer/v1" t',
    "q03_filter_col_not_selected": 'SELECT c_custkey FROM "sales/customer/v1" t',
    "q12_predicate_on_masked": """SELECT c_custkey FROM "sales/customer/v1" t WHERE c_name LIKE 'a%'""",
    "q18_governed_join": 'SELECT c.c_name, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total FROM "sales/customer/v1" c JOIN "sales/orders/v1" o ON c.c_custkey = o.o_custkey GROUP BY c.c_name',
    "q19_group_by_masked": 'SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM "sales/events/v1" t GROUP BY user_id',
    "q20_window": 'SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), -1) AS before FROM "sales/orders/v1" t',
    "q21_topk": 'SELECT o_orderkey, o_totalprice FROM "sales/orders/v1" t ORDER BY o_totalprice DESC, o_orderkey LIMIT 20',
    "q22_union": 'SELECT c_nationkey AS k FROM "sales/customer/v1" t UNION SELECT n_nationkey FROM "sales/nation/v1" u',
    "q22b_union_all": 'SELECT c_nationkey AS k FROM "sales/customer/v1" t UNION ALL SELECT n_nationkey FROM "sales/nation/v1" u',
    "q23_except": 'SELECT n_nationkey AS k FROM "sales/nation/v1" t EXCEPT SELECT s_nationkey FROM "sales/supplier/v1" u',
    "q23b_intersect": 'SELECT o_custkey AS k FROM "sales/orders/v1" t INTERSECT SELECT c_custkey FROM "sales/customer/v1" u',
    "q24_semi": 'SELECT c_custkey, c_name FROM "sales/customer/v1" c WHERE EXISTS (SELECT 1 FROM "sales/orders/v1" o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)',
    "q24b_anti": 'SELECT c_custkey FROM "sales/customer/v1" c WHERE NOT EXISTS (SELECT 1 FROM "sales/orders/v1" o WHERE o.o_custkey = c.c_custkey)',
    "q24c_in_subquery": 'SELECT o_orderkey FROM "sales/orders/v1" o WHERE o_custkey IN (SELECT c_custkey FROM "sales/customer/v1" c)',
    "q25_rollup": 'SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS BIGINT) AS g FROM "sales/orders/v1" t GROUP BY ROLLUP (o_orderstatus, o_orderpriority)',
    "q25b_cube": 'SELECT l_returnflag, l_linestatus, count(*) AS n FROM "sales/lineitem/v1" t GROUP BY CUBE (l_returnflag, l_linestatus)',
    "q25c_grouping_sets": 'SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM "sales/lineitem/v1" t GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())',
    "q33_left_join": 'SELECT n.n_name, count(c.c_custkey) AS n FROM "sales/nation/v1" n LEFT JOIN "sales/customer/v1" c ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name',
    "q34_full_theta_join": 'SELECT coalesce(n.n_nationkey, -1) AS a, coalesce(c.c_custkey, -1) AS b FROM "sales/nation/v1" n FULL JOIN "sales/customer/v1" c ON n.n_nationkey = c.c_nationkey AND n.n_regionkey < 3',
    "q35_cross_join": 'SELECT count(*) AS n FROM "sales/nation/v1" a CROSS JOIN "sales/nation/v1" b',
    "q36_range_join": 'SELECT a.o_orderkey AS k, count(*) AS n FROM "sales/orders/v1" a JOIN "sales/orders/v1" b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY a.o_orderkey',
    "q37_cte_scalar_subquery": 'WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS s FROM "sales/orders/v1" t GROUP BY o_custkey) SELECT o_custkey FROM spend WHERE s > (SELECT avg(s) FROM spend)',
    "q38_recursive_cte": "WITH RECURSIVE r(n) AS (SELECT 0 UNION ALL SELECT n + 7 FROM r WHERE n < 60) SELECT n, n_name FROM r LEFT JOIN \"sales/nation/v1\" t ON n = n_nationkey",
    "q39_distinct": 'SELECT DISTINCT p_brand, p_size FROM "sales/part/v1" t',
    "q40_aggregates": 'SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(avg(l_quantity), 6) AS a, min(l_discount) AS lo, max(l_tax) AS hi, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(median(l_quantity), 6) AS med, bool_and(l_quantity > 0) AS b, sum(l_quantity) FILTER (WHERE l_linestatus = \'O\') AS open_q FROM "sales/lineitem/v1" t GROUP BY l_returnflag',
    "q41_window_frames": 'SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS q, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 6) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 6) AS cd, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS BIGINT) AS dr FROM "sales/orders/v1" t',
    "q42_string_functions": "SELECT p_partkey, upper(p_name) AS u, CAST(length(p_name) AS BIGINT) AS n, substr(p_name, 2, 5) AS s, replace(p_type, ' ', '_') AS r, concat_ws('-', p_name, p_type) AS w, left(p_name, 3) AS l, lpad(p_name, 30, '.') AS lp, reverse(p_name) AS rv, translate(p_name, 'abc', 'xyz') AS t, split_part(p_type, ' ', 1) AS sp, ascii(p_name) AS a, repeat(p_name, 2) AS rp FROM \"sales/part/v1\" t",
    "q43_math_functions": "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 6) AS s, CAST(floor(p_retailprice) AS DOUBLE) AS f, CAST(ceil(p_retailprice) AS DOUBLE) AS c, round(ln(p_retailprice), 6) AS l, round(power(p_size, 2), 6) AS p, greatest(p_size, 10) AS g, least(p_size, 10) AS ls, coalesce(nullif(p_size, 1), -1) AS nf, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS k, CAST(sign(p_size - 25) AS INT) AS sg, p_size % 7 AS m, round(sin(p_size), 6) AS sn, round(atan2(p_size, 3), 6) AS at FROM \"sales/part/v1\" t",
    "q44_date_functions": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR(10)) AS mo, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS dt, CAST(extract(quarter FROM o_orderdate) AS BIGINT) AS q FROM \"sales/orders/v1\" t",
    "q45_regex_functions": "SELECT p_partkey, regexp_replace(p_name, '[0-9]', 'N') AS r FROM \"sales/part/v1\" t WHERE p_type LIKE '%E%'",
    "q46_hash_functions": 'SELECT p_partkey, md5(p_name) AS m, lower(hex(p_size)) AS h FROM "sales/part/v1" t',
    "q48_order_limit_offset": 'SELECT o_orderkey FROM "sales/orders/v1" t ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 5',
    "q49_distinct_on": 'SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM "sales/orders/v1" t) x WHERE rn = 1',
    "q50_having": 'SELECT o_custkey, count(*) AS n FROM "sales/orders/v1" t GROUP BY o_custkey HAVING count(*) > 10',
    "q47_unnest": "SELECT p_partkey, explode(split(p_type, ' ')) AS word FROM \"sales/part/v1\" t",
    "q55_array_functions": "SELECT p_partkey, array_join(array(p_brand, p_type), '|') AS j, array_contains(array(1, 5, p_size), 5) AS h, array_max(array(p_size, 7)) AS m, CAST(array_position(array(9, p_size), p_size) AS BIGINT) AS at, array(3, p_size)[1] AS e, size(array_distinct(array(p_size, 3, 3))) AS d, array_join(slice(sequence(p_size, p_size + 4), 2, 3), ',') AS sl FROM \"sales/part/v1\" t",
    "q56_map_struct_functions": "SELECT p_partkey, element_at(map('a', p_size, 'b', 2), 'a') AS v, element_at(map(p_partkey, p_brand, -1L, p_type), p_partkey) AS k, named_struct('x', p_size % 5).x AS x FROM \"sales/part/v1\" t",
    "q57_conditionals": "SELECT p_partkey, nvl(nullif(p_size, 3), 0) AS a, nvl2(nullif(p_size, 3), 1, 2) AS b, ifnull(nullif(p_size, 4), -4) AS c FROM \"sales/part/v1\" t",
    "q58_approx": 'SELECT l_returnflag, approx_count_distinct(l_linenumber) AS n, percentile_approx(l_linenumber, 0.5, 100000) AS m FROM "sales/lineitem/v1" t GROUP BY l_returnflag',
    "q59_lateral": 'SELECT n.n_nationkey, s.n FROM "sales/nation/v1" n, LATERAL (SELECT count(*) AS n FROM "sales/customer/v1" c WHERE c.c_nationkey = n.n_nationkey) s',
    "q60_natural_using": 'SELECT a.c_custkey, b.c_name FROM "sales/customer/v1" a JOIN "sales/customer/v1" b USING (c_custkey)',
    "q61_string_agg": 'SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), \',\') AS names FROM "sales/nation/v1" t GROUP BY n_regionkey',
    "q62_regr_bits": 'SELECT l_returnflag, round(covar_pop(l_quantity, l_extendedprice), 3) AS cp, round(regr_slope(l_extendedprice, l_quantity), 6) AS sl, bit_or(l_linenumber) AS bo, bit_and(l_linenumber) AS ba, bit_xor(l_linenumber) AS bx, max(l_orderkey) AS mx FROM "sales/lineitem/v1" t GROUP BY l_returnflag',
    "q63_time_bins": "SELECT event_type, count(*) AS n, CAST(min(date_trunc('hour', ts)) AS VARCHAR(30)) AS first_hour FROM \"sales/events/v1\" t GROUP BY event_type",
    "q64_cast_typeof": 'SELECT p_partkey, CAST(p_size AS DOUBLE) / 4 AS d, CAST(p_partkey AS VARCHAR(20)) AS s, p_size::BIGINT AS b FROM "sales/part/v1" t',
    "q51_values_join": "SELECT v.name, n.n_name FROM (VALUES (1, 'a'), (2, 'b'), (99, 'c')) AS v(k, name) LEFT JOIN \"sales/nation/v1\" n ON n.n_nationkey = v.k",
}


def _sql_query(sql: str, caller: Caller = OUTSIDER) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine.from_json_contracts(spark, default_contracts(sf_dir)).query(sql, caller)


def _one(name: str, sql: str, masks: dict[str, str] | None = None, row_filter: str | None = None, caller: Caller = OUTSIDER, **options):
    """One contract of its own, one query over it."""
    return lambda spark, sf_dir: Engine.from_json_contracts(spark, [contract(sf_dir, name, masks, row_filter)], **options).query(sql, caller)


#: name: (table, governed SQL, masks, row filter, twin).
CASES: dict[str, tuple[str, str, dict[str, str] | None, str | None, str]] = {
    "q04_numeric_hash": ("customer", 'SELECT c_custkey, c_name FROM "sales/customer/v1"', {"c_custkey": "hash_sha256"}, None, "SELECT sha256(CAST(c_custkey AS VARCHAR)) AS c_custkey, c_name FROM customer"),
    "q04b_double_hash": ("lineitem", 'SELECT l_orderkey, l_linenumber, l_extendedprice FROM "sales/lineitem/v1"', {"l_extendedprice": "hash_sha256"}, None, "SELECT l_orderkey, l_linenumber, sha256(CAST(l_extendedprice AS VARCHAR)) AS l_extendedprice FROM lineitem"),
    "q05_partial": ("customer", 'SELECT c_custkey, c_name FROM "sales/customer/v1"', {"c_name": "partial"}, None, "SELECT c_custkey, '***' || right(c_name, 4) AS c_name FROM customer"),
    "q05b_partial_numeric": ("orders", 'SELECT o_orderkey, o_custkey FROM "sales/orders/v1"', {"o_custkey": "partial"}, None, "SELECT o_orderkey, '***' || right(CAST(o_custkey AS VARCHAR), 4) AS o_custkey FROM orders"),
    "q06_redact_string": ("customer", 'SELECT c_custkey, c_name FROM "sales/customer/v1"', {"c_name": "redact"}, None, "SELECT c_custkey, CASE WHEN c_name IS NULL THEN NULL ELSE '***' END AS c_name FROM customer"),
    "q07_redact_numeric": ("customer", 'SELECT c_custkey, c_acctbal FROM "sales/customer/v1"', {"c_acctbal": "redact", "c_custkey": "redact"}, None, "SELECT 0::BIGINT AS c_custkey, 0.0::DOUBLE AS c_acctbal FROM customer"),
    "q08_null_mask": ("customer", 'SELECT c_custkey, c_name, c_acctbal FROM "sales/customer/v1"', {"c_name": "null", "c_acctbal": "null"}, None, "SELECT c_custkey, CASE WHEN c_name IS NULL THEN NULL ELSE '' END AS c_name, CASE WHEN c_acctbal IS NULL THEN NULL ELSE 0.0::DOUBLE END AS c_acctbal FROM customer"),
    "q09_tokenize": ("customer", 'SELECT c_custkey, c_name FROM "sales/customer/v1"', {"c_name": "tokenize"}, None, "SELECT c_custkey, sha256(c_name) AS c_name FROM customer"),
    "q10_noop": ("customer", 'SELECT * FROM "sales/customer/v1"', {"c_name": "noop"}, None, "SELECT * FROM customer"),
    "q11_timestamp_hash": ("events", 'SELECT event_id, ts FROM "sales/events/v1"', {"ts": "hash_sha256"}, None, "SELECT event_id, sha256(CAST(ts AS VARCHAR)) AS ts FROM events"),
    "q13_filter_and_or": ("orders", 'SELECT o_orderkey FROM "sales/orders/v1"', None, "(o_orderstatus = 'F' AND o_totalprice > 100000.0) OR o_custkey <= 10", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000.0) OR o_custkey <= 10"),
    "q14_filter_in": ("orders", 'SELECT o_orderkey FROM "sales/orders/v1"', None, "o_orderpriority IN ('1-URGENT', '2-HIGH')", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "q15_filter_not_in": ("orders", 'SELECT o_orderkey FROM "sales/orders/v1"', None, "o_orderstatus NOT IN ('F', 'P')", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P')"),
    "q16_filter_like": ("part", 'SELECT p_partkey FROM "sales/part/v1"', None, "p_type LIKE '%E%' AND NOT p_name LIKE 'a%'", "SELECT p_partkey FROM part WHERE p_type LIKE '%E%' AND NOT p_name LIKE 'a%'"),
    "q17_filter_null": ("events", 'SELECT event_id FROM "sales/events/v1"', None, "props IS NOT NULL AND NOT value IS NULL AND value <> 0", "SELECT event_id FROM events WHERE props IS NOT NULL AND value IS NOT NULL AND value <> 0"),
    "q52_mask_and_filter_same_column": ("customer", 'SELECT c_custkey, c_mktsegment FROM "sales/customer/v1"', {"c_mktsegment": "redact"}, CUSTOMER_FILTER, f"SELECT c_custkey, '***' AS c_mktsegment FROM customer WHERE {CUSTOMER_FILTER}"),
    "q53_nested_passthrough": ("embeddings", 'SELECT vec_id, embedding[0] AS first, size(embedding) AS n, label FROM "sales/embeddings/v1"', {"label": "hash_sha256"}, None, "SELECT vec_id, embedding[1] AS first, len(embedding)::INT AS n, sha256(CAST(label AS VARCHAR)) AS label FROM embeddings"),
}


def _bundle(masks: dict | None = None, row_filter: str | None = None, **more) -> BundleHandle:
    import json

    return BundleHandle(json.dumps({"contract_id": "rules", "contract_version": "1", "allowed_purposes": ["analytics"], "required_tier": "silver", "required_classification": "internal", "row_filter": row_filter, "column_policies": {c: {"sensitivity": "pii", "mask": m} for c, m in (masks or {}).items()}, **more}).encode(), "rules", "acme")


ALICE = Principal("user:alice", "analytics", "silver", "internal")


def _piped(bundle: BundleHandle, who: Principal = ALICE, name: str = "customer"):
    return lambda spark, sf_dir: build_pipeline(bundle, who).apply(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name)


def q31_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit kinds of five principals, in order."""
    df, kinds = spark.read.parquet(f"{sf_dir}/customer.parquet"), []
    for who in (ALICE, Principal("user:alice", "marketing", "silver", "internal"), Principal("user:alice", "analytics", "bronze", "internal"), Principal("user:alice", "analytics", "silver", "restricted")):
        p = build_pipeline(_bundle(), who)
        p.apply(df, "customer")
        kinds += [a.kind.value for a in p.audit]
    p = Pipeline(BundleHandle(b"", "", "acme"), ALICE)
    p.apply(df, "customer")
    kinds += [a.kind.value for a in p.audit]
    return spark.createDataFrame(list(enumerate(kinds)), "step int, kind string")


def q26_denied_rule_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each of four principals gets of one table; denials give an empty frame of the table's own schema."""
    df, out = spark.read.parquet(f"{sf_dir}/customer.parquet"), None
    for who in (ALICE, Principal("user:bob", "marketing", "silver", "internal"), Principal("user:bob", "analytics", "bronze", "internal"), Principal("user:bob", "analytics", "gold", "public")):
        got = build_pipeline(_bundle(), who).apply(df, "customer")
        one = got.groupBy().agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys")).select(F.lit(f"{who.declared_purpose} {who.tier} {who.classification}").alias("who"), "n", "keys", F.lit(got.schema == df.schema).alias("same_schema"))
        out = one if out is None else out.unionByName(one)
    return out


def q32_attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = ResolvedPolicy("customer-contract", "1.0.0", "acme", Allow(), {"c_name": MaskAction.HASH_SHA256}, CUSTOMER_FILTER)
    frame = govern(spark.read.parquet(f"{sf_dir}/customer.parquet"), policy)
    table, e = attest("SELECT 1", frame, policy)
    known = frame.df.orderBy(F.desc("c_custkey"))
    return spark.createDataFrame([(e.query_sha, e.contract_id, e.contract_version, ",".join(e.rules_applied), table.num_rows, sum(table.column("c_custkey").to_pylist()), e.result_hash == result_hash(known), e.epsilon_consumed)], "query_sha string, contract_id string, contract_version string, rules string, n long, keys long, hash_of_rows boolean, epsilon double")


def _noise(epsilon: float):
    return ResolvedPolicy("li", "1", "acme", Allow(), {}, "l_returnflag = 'R'", {"l_extendedprice": DpParam(1.0, epsilon), "l_orderkey": DpParam(1.0, 1e12)})


def q29_dp_identity_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = govern(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _noise(1e12), PrivacyBudget())
    return frame.df.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("l_extendedprice"))


def q30_dp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return govern(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _noise(0.1)).df.select("l_linenumber", "l_extendedprice")


def q30b_dp_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = approve(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _noise(1e12)).row_filter()
    return frame.group_by("l_linestatus").agg(total=("sum", "l_extendedprice"), n=("count", "*")).df.withColumn("total", F.round("total", 1))


def q28_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_rows(_sql_query('SELECT c_custkey, c_name, c_acctbal FROM "sales/customer/v1" t')(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _sql_query(sql) for name, sql in SQL.items()}
    out["q02_owner_raw"] = _sql_query('SELECT * FROM "sales/customer/v1"', OWNER)
    out |= {name: _one(table, sql, masks, flt) for name, (table, sql, masks, flt, _) in CASES.items()}
    out["q08b_null_mask_sql"] = _one("customer", 'SELECT c_custkey, c_name FROM "sales/customer/v1"', {"c_name": "null"}, null_mode="sql_null")
    out["q27_per_principal_filter"] = _piped(_bundle(row_filter="c_custkey > 0", per_principal_row_filters={"user:alice": "c_mktsegment = 'MACHINERY'", "service:ops": None}))
    out["q27b_per_principal_none"] = _piped(_bundle(row_filter="c_custkey < 0", per_principal_row_filters={"user:alice": None}))
    out["q54_rule_masks"] = _piped(_bundle({"c_name": "partial", "c_acctbal": "null", "c_mktsegment": "redact", "c_custkey": "hash_sha256"}, "c_nationkey IS NOT NULL"))
    return out | {f.__name__: f for f in (q26_denied_rule_empty, q28_ndjson, q29_dp_identity_limit, q30_dp_rows, q30b_dp_aggregate, q31_audit, q32_attestation)} | surface_queries.queries()


def oracle_sql() -> dict[str, str]:
    out = {name: _twin(_SPELT.get(name, sql)) for name, sql in SQL.items()}
    out["q02_owner_raw"] = "SELECT * FROM customer"
    out |= {name: case[4] for name, case in CASES.items()}
    out["q08b_null_mask_sql"] = "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name FROM customer"
    out["q26_denied_rule_empty"] = "SELECT 'analytics silver internal' AS who, count(*) AS n, sum(c_custkey)::BIGINT AS keys, true AS same_schema FROM customer UNION ALL SELECT who, 0, NULL, true FROM (VALUES ('marketing silver internal'), ('analytics bronze internal'), ('analytics gold public')) AS t(who)"
    out["q28_ndjson"] = f"""SELECT '{{"c_custkey":' || c_custkey || ',"c_name":"' || sha256(c_name) || '","c_acctbal":' || CASE WHEN c_acctbal IS NULL THEN 'null' ELSE '0.0' END || '}}' AS value FROM customer WHERE {CUSTOMER_FILTER}"""
    out["q27_per_principal_filter"] = "SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY'"
    out["q27b_per_principal_none"] = "SELECT * FROM customer"
    out["q54_rule_masks"] = "SELECT sha256(CAST(c_custkey AS VARCHAR)) AS c_custkey, '***' || right(c_name, 4) AS c_name, c_nationkey, CAST(NULL AS VARCHAR) AS c_acctbal, '<REDACTED>' AS c_mktsegment FROM customer WHERE c_nationkey IS NOT NULL"
    out["q29_dp_identity_limit"] = "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS l_extendedprice FROM lineitem WHERE l_returnflag = 'R'"
    out["q30b_dp_aggregate"] = "SELECT l_linestatus, round(sum(l_extendedprice), 1) AS total, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_linestatus"
    out["q31_audit"] = "SELECT * FROM (VALUES (0, 'contract_check_approved'), (1, 'purpose_mismatch'), (2, 'tier_mismatch'), (3, 'classification_mismatch'), (4, 'contract_check_denied')) AS t(step, kind)"
    out["q32_attestation"] = f"SELECT sha256('SELECT 1') AS query_sha, 'customer-contract' AS contract_id, '1.0.0' AS contract_version, 'ContractApproved,RowFilter,Masking' AS rules, count(*) AS n, sum(c_custkey)::BIGINT AS keys, true AS hash_of_rows, NULL::DOUBLE AS epsilon FROM customer WHERE {CUSTOMER_FILTER}"
    return out | surface_queries.oracle_sql()
