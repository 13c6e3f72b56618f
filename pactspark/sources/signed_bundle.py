"""Signed contract bundles: reading, verifying, and mapping to a policy."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import urllib.error
import urllib.request
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..errors import ContractError, ContractNotFound, VerifyError
from ..policy import Allow, Deny, MaskAction, ResolvedPolicy
from .contracts import Caller

#: Fixed values of the bundle format: the signed payload's domain, and functions in templates that stand for masks.
DOMAIN = b"t03:bundle-signing-payload:v1"
MASK_FUNCTIONS = {"sha256_hex": MaskAction.HASH_SHA256, "mask_hash_sha256": MaskAction.HASH_SHA256, "mask_redact": MaskAction.REDACT, "mask_tokenize": MaskAction.TOKENIZE}


def _prefixed(fields: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(struct.pack(">I", len(f)) + f for f in fields)).digest()


@dataclass(frozen=True)
class SignedBundle:
    doc: dict

    @classmethod
    def parse(cls, raw: bytes | str) -> SignedBundle:
        try:
            doc = json.loads(raw)
            bundle, meta = doc["bundle"], doc["metadata"]
            for part, keys in (("wasm_modules", ("name", "bytes")), ("rego_bundles", ("name", "source")), ("sql_templates", ("name", "template"))):
                for x in bundle[part]:
                    [x[k] for k in keys]
            [(e["dataset_id"], e["operation"], e["check_ref"]) for e in bundle["resolution_map"]["entries"]]
            m = bundle["manifest"]
            [m["contract_id"], m["contract_version"], m["compiled_at_unix_ms"], doc["signature_hex"], meta["bundle_hash_hex"], meta["signed_at_unix_ms"], meta["key_generation"]]
        except (ValueError, KeyError, TypeError) as e:
            raise VerifyError(f"signed bundle can't be read: {type(e).__name__}: {e}") from None
        return cls(doc)

    @property
    def bundle(self) -> dict:
        return self.doc["bundle"]

    def digest(self) -> bytes:
        """SHA-256 over all length-prefixed fields; lists go by name, with their length before them."""
        b, m = self.bundle, self.bundle["manifest"]
        fields = [m["contract_id"].encode(), struct.pack("<Q", m["contract_version"]), struct.pack("<Q", m["compiled_at_unix_ms"])]
        for part, body in (("wasm_modules", "bytes"), ("rego_bundles", "source"), ("sql_templates", "template")):
            rows = sorted(b[part], key=lambda x: x["name"].encode())
            fields.append(struct.pack(">I", len(rows)))
            for x in rows:
                fields += [x["name"].encode(), bytes(x[body]) if body == "bytes" else x[body].encode()]
        rows = sorted(b["resolution_map"]["entries"], key=lambda e: (e["dataset_id"].encode(), e["operation"].encode()))
        fields.append(struct.pack(">I", len(rows)))
        for e in rows:
            fields += [e[k].encode() for k in ("dataset_id", "operation", "check_ref")]
        return _prefixed(fields)

    def signing_payload(self) -> bytes:
        meta = self.doc["metadata"]
        return _prefixed([DOMAIN, self.digest(), struct.pack("<I", meta["key_generation"]), struct.pack("<Q", meta["signed_at_unix_ms"]), bytes.fromhex(meta["bundle_hash_hex"])])

    def check_digest(self) -> None:
        try:
            recorded = bytes.fromhex(self.doc["metadata"]["bundle_hash_hex"])
        except ValueError:
            raise VerifyError("the recorded digest is no hex text") from None
        if recorded != self.digest():
            raise VerifyError("the bundle's content doesn't have the recorded digest")

    def verify(self, spark: SparkSession, public_key_der: bytes) -> None:
        """Check the digest, and the ECDSA P-256 signature with the JVM's provider (key: DER SubjectPublicKeyInfo)."""
        self.check_digest()
        jvm = spark._jvm
        try:
            signature = bytes.fromhex(self.doc["signature_hex"])
            key = jvm.java.security.KeyFactory.getInstance("EC").generatePublic(jvm.java.security.spec.X509EncodedKeySpec(bytearray(public_key_der)))
            check = jvm.java.security.Signature.getInstance("SHA256withECDSA")
            check.initVerify(key)
            check.update(bytearray(self.signing_payload()))
            good = check.verify(bytearray(signature))
        except Exception as e:
            raise VerifyError(f"the signature can't be checked: {e}") from None
        if not good:
            raise VerifyError("the signature is wrong")

    @property
    def owner(self) -> str:
        entries = self.bundle["resolution_map"]["entries"]
        return entries[0]["dataset_id"].split("/")[0] if entries else ""

    def purposes(self) -> list[str]:
        """Quoted texts after ``declared_purpose`` in the first policy module named for purposes."""
        module = next((r["source"] for r in self.bundle["rego_bundles"] if "purpose" in r["name"]), "")
        return re.findall(r'declared_purpose[^"]*"([^"]*)"', module, re.S)

    def template(self) -> str | None:
        """The template for readers other than the owner; one that is only named for the owner is never taken."""
        rows = self.bundle["sql_templates"]
        for fits in (lambda n: "non-owner" in n, lambda n: "read" in n and "owner" not in n):
            for t in rows:
                if fits(t["name"]):
                    return t["template"]
        return None

    def policy_for(self, caller: Caller) -> ResolvedPolicy:
        """Purpose first, then the owner's full access, then masks and filter of the template. Without a template nothing is readable."""
        m = self.bundle["manifest"]
        who = (m["contract_id"], str(m["contract_version"]), self.owner)
        allowed = self.purposes()
        if allowed and caller.purpose not in allowed:
            return ResolvedPolicy(*who, Deny(f"purpose '{caller.purpose}' not permitted (allowed: {', '.join(allowed)})"))
        if self.owner and caller.tenant == self.owner:
            return ResolvedPolicy(*who)
        sql = self.template()
        if sql is None:
            return ResolvedPolicy(*who, Deny("the bundle has no template for other tenants"))
        masks = {}
        for name, column in re.findall(r"(\w+)\(\s*\"?([^()\"]+?)\"?\s*\)", sql):
            if name in MASK_FUNCTIONS:
                masks[column] = MASK_FUNCTIONS[name]
        found = re.search(r"\bWHERE\b(.*)", sql, re.S | re.I)
        clause = found[1].strip().rstrip(";").strip() if found else ""
        return ResolvedPolicy(*who, Allow(), masks, None if re.sub(r"\s", "", clause) in ("", "1=1") else clause)


class BundleService:
    """Fetches bundles over HTTP. A key is required unless ``allow_unverified`` says otherwise."""

    def __init__(self, base_url: str, spark: SparkSession, public_key_der: bytes | None = None, auth: tuple[str, str] | None = None, allow_unverified: bool = False, timeout_s: float = 30.0):
        if public_key_der is None and not allow_unverified:
            raise ContractError("a public key is needed to verify bundles")
        self.base_url, self.spark, self.key, self.auth, self.timeout_s = base_url.rstrip("/"), spark, public_key_der, auth, timeout_s

    def fetch(self, contract_id: str) -> SignedBundle:
        request = urllib.request.Request(f"{self.base_url}/v1/contracts/{contract_id}/bundle", headers=dict([self.auth]) if self.auth else {})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as reply:
                found = SignedBundle.parse(reply.read())
        except urllib.error.HTTPError as e:
            raise ContractNotFound(contract_id) if e.code == 404 else ContractError(f"the bundle service answered {e.code}") from None
        except OSError as e:
            raise ContractError(f"the bundle service can't be reached: {e}") from None
        found.verify(self.spark, self.key) if self.key is not None else found.check_digest()
        return found

    def resolve(self, dataset: str, caller: Caller) -> ResolvedPolicy:
        return self.fetch(dataset).policy_for(caller)
