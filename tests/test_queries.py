import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pactspark import queries as governed
from pactspark.operators.predicate import scala_seq

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = governed.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(table: pa.Table, names):
    return sorted(tuple("NULL" if v is None else str(v) for v in r) for r in zip(*(table.column(c).to_pylist() for c in names)))


@pytest.mark.parametrize("name", sorted(governed.queries()))
def test_against_the_twin(spark, db, sf, name):
    found = governed.queries()[name](spark, sf).toArrow()
    if name not in ORACLE:
        assert found.num_rows >= 0
        return
    wanted = db.execute(ORACLE[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(wanted.column_names)
    assert rows(found, sorted(found.column_names)) == rows(wanted, sorted(found.column_names))


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def as_of_tables(folder, orders, errors):
    """errors: hours after 2024 began, or times, and event_ids."""
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=t) if isinstance(t, (int, float)) else t for t, _ in errors]
    pq.write_table(pa.table({"o_orderkey": pa.array(orders, pa.int64())}), f"{folder}/orders.parquet")
    pq.write_table(pa.table({"event_id": pa.array([i for _, i in errors], pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "event_type": ["error"] * len(at)}), f"{folder}/events.parquet")


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_as_of_odd_rows(spark, tmp_path, zone):
    """Null ids and times, equal times, times on and beside whole hours, before 2024 and far away; keys that repeat, are null or negative."""
    us = 1 / 3_600_000_000  # a microsecond in hours
    errors = [(5, 1), (5, 2), (5 + us, 3), (11, None), (11 - us, 4), (20, None), (30, 5), (30.5, None), (40, 6), (40, None), (-3.25, 7), (-3, 8), (-690 - us, 9), (-699, 10), (-705 + us, 11), (-705, 12), (699, 13), (699 + us, 14)]
    errors += [(None, 15), (dt.datetime(1, 1, 1), 16), (dt.datetime(9999, 12, 31, 23, 59, 59, 999999), 17), (101 - us, 18), (101 + us, 19), (100 + 59.5 / 3600, 20)]
    as_of_tables(tmp_path, [*range(-720, 1500), *range(60), None, None, 2**63 - 1, -(2**63), 700 - 2**63], errors)
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    wanted = con.execute(ORACLE["q105_as_of"]).to_arrow_table()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = governed.queries()["q105_as_of"](spark, str(tmp_path)).toArrow()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert wanted.num_rows > 100
    assert rows(found, ["o_orderkey", "last_error"]) == rows(wanted, ["o_orderkey", "last_error"])


def rows_made(plan) -> list[int]:
    """The rows that each node of an executed plan put out."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return rows_made(plan.executedPlan())
    below = [plan.plan()] if kind.endswith("QueryStageExec") else scala_seq(plan.children())
    out = plan.metrics().get("numOutputRows")
    return ([int(out.get().value())] if out.isDefined() else []) + [n for p in below for n in rows_made(p)]


def test_as_of_makes_no_pairs(spark, tmp_path):
    """2,000 orders at one hour and 1,000 errors just before it."""
    as_of_tables(tmp_path, [700 * k + 9 for k in range(2000)], [(8 + (k + 1) / 1001, k) for k in range(1000)])
    df = governed.queries()["q105_as_of"](spark, str(tmp_path))
    assert [r.last_error for r in df.collect()] == [999] * 2000
    assert max(rows_made(df._jdf.queryExecution().executedPlan())) == 2000
