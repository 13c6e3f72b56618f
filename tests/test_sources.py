import io
import json
import threading

import pytest

from pactspark.errors import BlobAccessDenied, BlobError, BlobRangeError, ContractError, SigningRefused, VerifyError
from pactspark.policy import Deny, MaskAction
from pactspark.sources.blob_service import LocalBlobService
from pactspark.sources.blob_store import BlobClient, BlobFile, BlobSource, BlobStore, BlobTable, SocketSigner
from pactspark.sources.contracts import Caller
from pactspark.sources.signed_bundle import BundleService, SignedBundle

OUTSIDER = Caller("u", "analytics", "other")


def document(**more):
    b = {
        "manifest": {"contract_id": "c", "contract_version": 3, "compiled_at_unix_ms": 1},
        "wasm_modules": [{"name": "b", "bytes": [1, 2]}, {"name": "a", "bytes": []}],
        "rego_bundles": [{"name": "purpose-gate", "source": 'allow { input.declared_purpose == "analytics" } allow { input.declared_purpose == "audit" }'}],
        "sql_templates": [{"name": "owner-read", "template": "SELECT * FROM {table}"}, {"name": "non-owner-read", "template": 'SELECT id, sha256_hex(email) AS email, mask_redact("name") AS name\nFROM {table}\nWHERE region = \'EU\''}],
        "resolution_map": {"entries": [{"dataset_id": "acme/users", "operation": "read", "check_ref": "x"}]},
    } | more
    doc = {"bundle": b, "signature_hex": "00", "metadata": {"bundle_hash_hex": "", "signed_at_unix_ms": 5, "key_generation": 1}}
    doc["metadata"]["bundle_hash_hex"] = SignedBundle(doc).digest().hex()
    return doc


def test_policy_of_a_bundle():
    s = SignedBundle.parse(json.dumps(document()))
    p = s.policy_for(OUTSIDER)
    assert p.column_masks == {"email": MaskAction.HASH_SHA256, "name": MaskAction.REDACT} and p.row_filter == "region = 'EU'" and p.tenant_id == "acme" and p.contract_version == "3"
    assert s.policy_for(Caller("u", "audit", "acme")).column_masks == {}
    assert isinstance(s.policy_for(Caller("u", "marketing", "acme")).decision, Deny)


def test_bundles_fail_closed():
    only_owner = document(sql_templates=[{"name": "owner-read", "template": "SELECT * FROM {table}"}])
    assert isinstance(SignedBundle(only_owner).policy_for(OUTSIDER).decision, Deny)
    assert SignedBundle(document(sql_templates=[{"name": "read", "template": "SELECT * FROM {table} WHERE 1 = 1"}])).policy_for(OUTSIDER).row_filter is None
    for bad in ("{", "{}", json.dumps({"bundle": {}})):
        with pytest.raises(VerifyError):
            SignedBundle.parse(bad)


def test_digest():
    doc = document()
    SignedBundle(doc).check_digest()
    doc["bundle"]["wasm_modules"].reverse()
    SignedBundle(doc).check_digest()  # lists go by name
    doc["bundle"]["sql_templates"][0]["template"] += " "
    with pytest.raises(VerifyError):
        SignedBundle(doc).check_digest()


def test_signature(spark):
    jvm = spark._jvm
    make = jvm.java.security.KeyPairGenerator.getInstance("EC")
    make.initialize(jvm.java.security.spec.ECGenParameterSpec("secp256r1"))
    pair = make.generateKeyPair()
    doc = document()
    signer = jvm.java.security.Signature.getInstance("SHA256withECDSA")
    signer.initSign(pair.getPrivate())
    signer.update(bytearray(SignedBundle(doc).signing_payload()))
    doc["signature_hex"] = bytes(signer.sign()).hex()
    spec = jvm.java.lang.Class.forName("java.security.spec.X509EncodedKeySpec")
    key = bytes(jvm.java.security.KeyFactory.getInstance("EC").getKeySpec(pair.getPublic(), spec).getEncoded())
    SignedBundle(doc).verify(spark, key)
    doc["metadata"]["key_generation"] = 2
    with pytest.raises(VerifyError):
        SignedBundle(doc).verify(spark, key)
    doc["signature_hex"] = "zz"
    with pytest.raises(VerifyError):
        SignedBundle(doc).verify(spark, key)


def test_bundle_service(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            good = self.path == "/v1/contracts/c/bundle" and self.headers["Authorization"] == "Bearer x"
            self.send_response(200 if good else 500)
            self.end_headers()
            self.wfile.write(json.dumps(document()).encode() if good else b"")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    with pytest.raises(ContractError):
        BundleService(url, spark)
    service = BundleService(url, spark, auth=("Authorization", "Bearer x"), allow_unverified=True)
    assert service.resolve("c", OUTSIDER).row_filter == "region = 'EU'"
    with pytest.raises(ContractError, match="500"):
        service.resolve("d", OUTSIDER)
    server.shutdown()


@pytest.fixture
def service(tmp_path):
    """A byte-range and signing service over one blob."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    path, plain = str(tmp_path / "s"), bytes(range(256)) * 40
    pq.write_table(pa.table({"id": list(range(100)), "name": [f"n{k}" for k in range(100)]}), tmp_path / "t.parquet", row_group_size=10)
    blobs = {"a": plain, "t": (tmp_path / "t.parquet").read_bytes()}
    with LocalBlobService(path, blobs):
        yield path, plain


def test_blob_client(service):
    path, blob = service
    c = BlobClient(path, "acme", "token")
    assert c.read("a", 5, 10) == blob[5:15] and c.get_range("a", 3, 9) == blob[3:9] and c.get_range("a", 10000) == blob[10000:] and c.get_range("a", -7) == blob[-7:]
    with pytest.raises(BlobRangeError):
        c.read("a", len(blob), 1)
    with pytest.raises(BlobAccessDenied):
        BlobClient(path, "acme", "other").stat("a")
    with pytest.raises(BlobError):
        BlobClient(path + "x").stat("a")


def test_blob_source(spark, service):
    path, blob = service
    spark.dataSource.register(BlobSource)
    df = spark.read.format("pact_blob").options(socket=path, asset="a", token="token", slice="3000").load()
    assert b"".join(bytes(r.data) for r in df.orderBy("offset").collect()) == blob


def test_blob_table(spark, service):
    from pactspark.bundle_engine import BundleEngine, EngineConfig
    from pactspark.policy import BundleHandle

    spark.dataSource.register(BlobTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"socket": service[0], "asset": "t", "token": "token"}
    df = spark.read.format("pact_blob_table").options(**options).load()
    assert df.dtypes == [("id", "bigint"), ("name", "string")] and df.count() == 100
    few = df.where("id >= 35 AND id < 42")
    assert sorted(r.id for r in few.collect()) == list(range(35, 42)) and few.rdd.getNumPartitions() == 2
    assert df.select("name").limit(3).count() == 3
    names = spark.read.format("pact_blob_table").options(**options, columns="name").load()
    assert names.columns == ["name"] and names.count() == 100 and names.first().name == "n0"
    e = BundleEngine(spark, EngineConfig("acme", "e", "/s", "/t"))
    e.register_source("t", "pact_blob_table", **options)
    e.inject_bundle(BundleHandle(b"b", "c", "acme"))
    assert e.query("SELECT max(id) AS m FROM t").first().m == 99


def test_blob_file(service):
    f = BlobFile(BlobClient(service[0], "acme", "token"), "a")
    assert f.read(3) == service[1][:3] and f.seek(-2, 2) == len(service[1]) - 2 and f.read() == service[1][-2:] and f.read(5) == b""
    with pytest.raises((io.UnsupportedOperation, NotImplementedError)):
        f.write(b"x")


def test_blob_store(service):
    path, blob = service
    store = BlobStore(BlobClient(path, "acme", "token"))
    assert store.head("a") == len(blob) and store.get("a") == blob and store.get_range("a", -4) == blob[-4:] and store.list() == []
    for refused in (lambda: store.put("a", b""), lambda: store.delete("a"), lambda: store.head("gone")):
        with pytest.raises(BlobError):
            refused()


def test_signer(service):
    s = SocketSigner(service[0])
    assert len(s.sign("{}", "1", "acme")) == 64 and s.key_id == "k1"
    with pytest.raises(SigningRefused, match="unknown tenant"):
        s.sign("{}", "1", "globex")
