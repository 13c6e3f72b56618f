import json
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pactspark.bundle_engine import BundleEngine, EngineConfig
from pactspark.errors import ConfigError, MissingBundle, PactError, PoolShutdown, QueueFull, ResultTooLarge, UnsafeStatement
from pactspark.policy import BundleHandle, DpParam, MaskAction, ResolvedPolicy
from pactspark.serving.cache import CacheKey, QueryCache
from pactspark.serving.formats import ResultFormat, format_result, json_rows, read_arrow, write_result
from pactspark.serving.pool import PoolConfig, WorkerPool
from pactspark.streaming import govern_stream

CONFIG = EngineConfig("acme", "e1", "/s", "/t")
BUNDLE = BundleHandle(b"any bytes", "c", "acme")


def engine(spark, **more):
    e = BundleEngine(spark, EngineConfig("acme", "e1", "/s", "/t", **more))
    e.register_rows("people", [(1, "alice"), (2, "bob"), (3, "carol")], "id long, name string")
    return e


def test_config():
    for bad in ({"tenant_id": ""}, {"engine_id": " "}, {"storage_socket": ""}, {"signer_socket": ""}, {"max_result_rows": 0}):
        with pytest.raises(ConfigError):
            EngineConfig(**({"tenant_id": "a", "engine_id": "b", "storage_socket": "c", "signer_socket": "d"} | bad))
    with pytest.raises(TypeError):
        type("Mine", (BundleEngine,), {})


def test_bundle_engine(spark, tmp_path):
    e = engine(spark)
    with pytest.raises(MissingBundle):
        e.query("COPY a FROM 'b'")
    e.inject_bundle(BUNDLE)
    with pytest.raises(UnsafeStatement):
        e.query("COPY a FROM 'b'")
    assert [r.name for r in e.query("SELECT name FROM people WHERE id > 1 ORDER BY id").collect()] == ["bob", "carol"]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(10, "a"), (20, "b")], "x long, label string").write.parquet(path)
    e.register_parquet("t", path)
    assert e.query("SELECT sum(x) AS s FROM t").first().s == 30
    small = engine(spark, max_result_rows=2)
    small.inject_bundle(BUNDLE)
    assert small.query("SELECT * FROM people").count() == 3 and small.fetch("SELECT * FROM people WHERE id < 3").num_rows == 2
    with pytest.raises(ResultTooLarge, match="more than 2 rows"):
        small.fetch("SELECT * FROM people")


def test_formats(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, double('NaN') AS c, X'00ff' AS d, DATE'2024-01-02' AS e, CAST(1.50 AS DECIMAL(5,2)) AS f, array(1, 2) AS g")
    row = json.loads(format_result(df, ResultFormat.JSON))
    assert row == {"a": 1, "b": None, "c": None, "d": "AP8=", "e": "2024-01-02", "f": 1.5, "g": [1, 2]}
    assert read_arrow(format_result(df)).num_rows == 1
    assert pq.read_table(pa.BufferReader(format_result(df, ResultFormat.PARQUET))).column("a").to_pylist() == [1]
    for f in ResultFormat:
        assert format_result(df.limit(0), f) == b""
    assert read_arrow(b"").num_rows == 0 and [ResultFormat.from_number(n) for n in (0, 1, 2, 9)] == [ResultFormat.ARROW, ResultFormat.PARQUET, ResultFormat.JSON, ResultFormat.ARROW]
    write_result(df, str(tmp_path / "j"), ResultFormat.JSON)
    assert spark.read.text(str(tmp_path / "j")).first().value == json_rows(df).first().value
    write_result(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_cache():
    now = [0.0]
    c = QueryCache(max_entries=2, ttl=10, clock=lambda: now[0])
    t = pa.table({"a": [1, 2]})
    k = [CacheKey.of("acme", f"q{n}") for n in range(3)]
    for x in k[:2]:
        c.put(x, t)
    assert c.get(k[0]) is t
    c.put(k[2], t)  # k[1] was used least recently
    assert c.get(k[1]) is None and c.get(k[0]) is t and c.stats()["evicted"] == 1
    c.put(k[0], t)
    assert c.stats()["bytes"] == 2 * t.nbytes
    now[0] = 11
    assert c.get(k[0]) is None
    c.put(CacheKey.of("globex", "q"), t)
    assert c.invalidate_tenant("acme") == 1 and c.stats()["entries"] == 1
    c.invalidate_all()
    assert c.stats()["bytes"] == 0
    assert CacheKey.of("a", "q", purpose="x") != CacheKey.of("a", "q", purpose="y") != CacheKey.of("a", "q", policy=b"p")
    small = QueryCache(max_bytes=t.nbytes - 1)
    small.put(k[0], t)
    assert small.get(k[0]) is None


def test_pool(spark):
    e = engine(spark)
    pool = WorkerPool(lambda tenant: e, PoolConfig(workers=2, queue_depth=4, drain_s=20))
    with pytest.raises(MissingBundle):
        pool.submit("acme", "SELECT 1 AS a").result(30)
    pool.refresh_bundle("acme", BUNDLE)
    assert pool.submit("acme", "SELECT count(*) AS n FROM people").result(30).column("n").to_pylist() == [3]
    pool.submit("acme", "SELECT count(*) AS n FROM people").result(30)
    assert pool.cache.stats()["hits"] == 1
    pool.refresh_bundle("acme", BundleHandle(b"2", "c", "acme"))
    assert pool.cache.stats()["entries"] == 0
    assert pool.shutdown()
    with pytest.raises(PoolShutdown):
        pool.submit("acme", "SELECT 1")


def test_pool_of_governed_engines(spark):
    from pactspark.engine import Engine
    from pactspark.sources.bindings import FrameBinding
    from pactspark.sources.contracts import Caller, JsonContracts

    def contract(name, **more):
        return {"contract_id": name, "version": "1", "dataset": name, "binding": {"parquet": "unused"}, "owner_tenant": "acme", "purposes": ["analytics", "audit"], "columns": [{"name": "name", "mask": "redact"}], **more}

    frame = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    source = JsonContracts([contract("a"), contract("noisy", dp_columns={"id": {"sensitivity": 1, "epsilon": 1}})])
    e = Engine(spark, source, FrameBinding({"a": frame, "noisy": frame}))
    pool = WorkerPool(lambda tenant: e, PoolConfig(workers=2, queue_depth=9, drain_s=20))
    q = "SELECT name FROM a ORDER BY id"

    def names(caller):
        return pool.submit(caller.tenant, q, caller).result(60).column("name").to_pylist()

    one, other, owner = Caller("u1", "analytics", "globex"), Caller("u2", "audit", "globex"), Caller("u1", "analytics", "acme")
    assert names(one) == ["***", "***"] and names(owner) == ["x", "y"] and names(other) == ["***", "***"] and pool.cache.stats()["hits"] == 0
    assert names(one) == ["***", "***"] and pool.cache.stats()["hits"] == 1
    source.by_dataset |= JsonContracts([contract("a", row_filter="id = 2")]).by_dataset
    assert names(one) == ["***"] and pool.cache.stats()["hits"] == 1
    held = pool.cache.stats()["entries"]
    assert pool.submit("globex", "SELECT id FROM noisy", one).result(60).num_rows == 2 and pool.cache.stats()["entries"] == held
    for bad in (None, owner):
        with pytest.raises(PactError, match="caller of the tenant"):
            pool.submit("globex", q, bad).result(60)
    with pytest.raises(PactError, match="purpose 'sales'"):
        pool.submit("globex", q, Caller("u1", "sales", "globex")).result(60)
    with pytest.raises(PactError, match="come from its source"):
        pool.refresh_bundle("globex", BUNDLE)
    assert pool.shutdown()


def test_full_queues():
    hold, begun = threading.Event(), threading.Event()

    class Slow:
        bundle = None

        def query(self, sql):
            raise AssertionError

    def engine_for(tenant):
        begun.set()
        hold.wait(20)
        return Slow()

    pool = WorkerPool(engine_for, PoolConfig(workers=1, queue_depth=1, drain_s=0.1))
    pool.submit("a", "q")
    begun.wait(20)
    last = pool.submit("a", "q")
    with pytest.raises(QueueFull):
        pool.submit("a", "q")
    assert not pool.shutdown()
    hold.set()
    with pytest.raises(PoolShutdown):
        last.result(5)


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, user string, kind string").write.parquet(src)
    stream = spark.readStream.schema("id long, user string, kind string").parquet(src)
    p = ResolvedPolicy("c", "1", "t", column_masks={"user": MaskAction.REDACT}, row_filter="kind = 'x'")
    q = govern_stream(stream, p).df.writeStream.format("memory").queryName("governed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("governed").collect()] == [(1, "***", "x")]
    with pytest.raises(PactError):
        govern_stream(stream, ResolvedPolicy("c", "1", "t", dp_columns={"id": DpParam(1.0, 1.0)}))
    with pytest.raises(PactError):
        govern_stream(spark.range(1), p)
