"""Homomorphic multiset hash of documents.

A document is the multiset of its paragraphs. Each paragraph is hashed to a wide
vector and the vectors are summed modulo a power of two, so that the order of
paragraphs doesn't matter and a paragraph can be added or taken away by adding or
subtracting its vector. A vector has two parts:

* EXACT lanes of 64 bits expanded from the paragraph's digest, summed mod 2**64:
  equal multisets, and for all practical purposes only those, have equal lanes;
* SKETCH lanes of 32 bits, mod 2**32: the distinct shingles of WORDS words of each
  paragraph (of all its words, if it has fewer), each added to a lane with a sign, both
  taken from its hash. Products of these lanes estimate how many shingles two texts share.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, released, save, small_batches

EXACT = 16
SKETCH = 4096
WORDS = 3
CACHE_WORDS = 200_000


class Hasher:
    """Vectors of paragraphs and of texts, with a bounded cache of word hashes."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def paragraph(self, text: str) -> np.ndarray:
        return self.of([text])

    def text(self, text: str) -> np.ndarray:
        return self.of(paragraphs(text))

    def of(self, parts: list[str]) -> np.ndarray:
        """The sum of the vectors of all parts, with the shingles of all of them counted at once."""
        vector = empty()
        if not parts:
            return vector
        for p in parts:
            vector[:EXACT] += np.frombuffer(hashlib.shake_256(p.encode("utf-8", "surrogatepass")).digest(8 * EXACT), "<u8")
        split = [p.split() for p in parts]
        words = list(chain.from_iterable(split))
        if not words:
            return vector
        known = self.words
        numbers = list(map(known.get, words))
        if None in numbers:
            if len(known) > CACHE_WORDS:
                known.clear()
            for k, w in enumerate(words):
                if numbers[k] is None:
                    numbers[k] = known.get(w)
                    if numbers[k] is None:
                        numbers[k] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)
                        if len(w) < 64:
                            known[w] = numbers[k]
        hashes = np.array(numbers, np.uint64)
        lens = np.fromiter(map(len, split), np.int64, len(split))
        part = np.repeat(np.arange(len(parts)), lens)
        # A shingle is the hash of its words in order; words beyond the paragraph count as none.
        at = np.arange(len(words))
        left = np.repeat(np.cumsum(lens), lens) - at  # words from here to the paragraph's end
        h = np.zeros(len(words), np.uint64)
        for n in range(WORDS):
            inside = n < left
            h = (h ^ np.where(inside, hashes[np.where(inside, at + n, 0)], np.uint64(n + 1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        starts = (left >= WORDS) | (left == lens[part])
        h, part = h[starts] * np.uint64(0xBF58476D1CE4E5B9), part[starts]
        if len(parts) == 1:
            h = np.unique(h)
        else:
            order = np.lexsort((h, part))
            h, part = h[order], part[order]
            h = h[np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])]]
        lane = ((h >> np.uint64(40)) & np.uint64(2 * SKETCH - 1)).astype(np.int64)  # lane and sign
        lanes = np.bincount(lane, minlength=2 * SKETCH)
        vector[EXACT:] = (lanes[:SKETCH] - lanes[SKETCH:]).view(np.uint64)
        return _wrap(vector)


def paragraphs(text: str) -> list[str]:
    """Lines; each line end is a paragraph's own, so that texts are joined of their paragraphs without loss."""
    return text.split("\n") if text else []


def _wrap(vector: np.ndarray) -> np.ndarray:
    vector[EXACT:] &= np.uint64(0xFFFFFFFF)
    return vector


def empty() -> np.ndarray:
    return np.zeros(EXACT + SKETCH, np.uint64)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _wrap(a + b)


def remove(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _wrap(a - b)


def total(vectors: Iterable[np.ndarray]) -> np.ndarray:
    out = empty()
    for v in vectors:
        out += v
    return _wrap(out)


def pack(vector: np.ndarray) -> bytes:
    """A fingerprint as bytes: lanes of 64 bits, then lanes of 32 bits."""
    return vector[:EXACT].astype("<u8").tobytes() + vector[EXACT:].astype("<u4").tobytes()


def unpack(body: bytes) -> np.ndarray:
    return np.r_[np.frombuffer(body[: 8 * EXACT], "<u8"), np.frombuffer(body[8 * EXACT :], "<u4").astype(np.uint64)]


def digest(vector: np.ndarray) -> str:
    """A short name of a fingerprint: equal for equal vectors."""
    return hashlib.blake2b(pack(vector), digest_size=32).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles, 0 to 1: twice the shared ones over those of both; 1 for equal fingerprints.

    A shingle of several paragraphs weighs by the product of its numbers of paragraphs. The
    estimate's standard deviation is at most about SKETCH ** -0.5 = 0.016.
    """
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EXACT:].astype(np.uint32).view(np.int32).astype(np.float64) for v in (a, b))
    norms = float(x @ x + y @ y)
    return min(max(2 * float(x @ y) / norms, 0.0), 1.0) if norms else 0.0


def edited(hasher: Hasher, text: str, vector: np.ndarray, following: str) -> tuple[str, np.ndarray]:
    """The text with its last half replaced, and its fingerprint by taking away and adding paragraphs."""
    half = len(text) // 2
    new = text[: len(text) - half] + following[:half] if half else text
    old_parts, new_parts = paragraphs(text), paragraphs(new)
    same = 0
    for a, b in zip(old_parts, new_parts):
        if a != b:
            break
        same += 1
    gone = hasher.of(old_parts[same:])
    come = hasher.of(new_parts[same:])
    return new, add(remove(vector, gone), come)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    held = None  # bucket, doc_id, text, vector, number of such rows
    out: list[tuple] = []

    def row(doc_id, text, vector, following, next_vector) -> tuple:
        new, changed = edited(hasher, text, vector, following)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), sha, digest(vector), digest(changed), likeness(vector, changed), likeness(vector, next_vector)

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _OUT)], schema=_OUT)

    for batch in batches:
        for bucket, guest, doc_id, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            vector = hasher.text(text)
            if held is not None and held[0] == bucket:
                out.append(row(*held[1:], text, vector))
            held = None if guest else (bucket, doc_id, text, vector)
            same = row(doc_id, text, vector, text, vector) if copies > 1 and not guest else None
            for _ in range(copies - 1 if same else 0):  # all but the last of equal rows are followed by their like
                out.append(same)
                if len(out) >= 500:
                    yield full()
                    out = []
            if len(out) >= 500:
                yield full()
                out = []
    if out:
        yield full()


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            found = [hasher.text(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(digest, found), pa.string()), pa.array(map(pack, found), pa.binary())], ["doc_id", "fingerprint", "vector"])


def fingerprint_vectors(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, vector`` of each row's whole text; null texts are empty, repeated rows stay, other columns are ignored.

    ``vector`` is the packed fingerprint; with add, remove and Hasher.paragraph it follows a text's paragraphs
    without reading the others.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(_vectors), "doc_id long, fingerprint string, vector binary")


def _bounds(found: list[int]) -> list[tuple[int, int]]:
    """Bounds of ranges of (doc_id, hash) from quantiles of doc_id: an id that fills several ranges is split by its hashes."""
    out = []
    for at in sorted(set(found)):
        n = found.count(at)
        out += [(at, -(2**63) + k * (2**64 // (n + 1))) for k in range(1, n + 1)] if n > 1 else [(at, 2**63 - 1)]
    return out


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and its likeness to that and to the next document.

    The last ``n_chars // 2`` code points are replaced by the first as many of the
    next document by ascending doc_id, which after the last is the first. Null
    texts are empty; a null id comes first; rows of one id go by their text's hash;
    a lone document is its own next; an empty table gives no rows. Texts are dealt
    once, to ranges of doc_id; the first document of a range is also sent to the
    range before it, so that no range waits for another. Rows equal in id and text are
    dealt as one row, and a repeated id fills as many ranges as its rows ask for.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("tie", F.xxhash64("text")).withColumn("copies", F.lit(1).cast("long"))
    equal = save(rows.groupBy("at", "tie").agg(F.count("*").alias("n")).where("n > 1"), "equal")
    if not equal.isEmpty():  # rows equal in id and text are dealt as one
        met = rows.drop("copies").join(equal.hint("merge"), ["at", "tie"], "left")
        one = met.where("n IS NOT NULL").groupBy("at", "tie").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.count("*").alias("copies"))
        rows = save(met.where("n IS NULL").select("doc_id", "text", "at", "tie", F.lit(1).cast("long").alias("copies")).unionByName(one.select("doc_id", "text", "at", "tie", "copies")), "rows")
    n = 4 * partitions(spark)
    # n bounds of ranges: a bounded summary, whatever the size of the table.
    ranks = ", ".join(f"{k / n!r}D" for k in range(1, n))
    found = rows.agg(F.expr(f"percentile_approx(at, array({ranks}), {10 * n})").alias("b")).first()["b"] if n > 1 else None
    bounds = _bounds(found or [])
    rows = rows.withColumn("bucket", _bisect(bounds))
    # The first document of each range: at most n rows.
    firsts = {r["bucket"]: (r["first"]["at"], r["first"]["tie"]) for r in rows.groupBy("bucket").agg(F.min(F.struct("at", "tie")).alias("first")).collect()}
    order = sorted(firsts)
    before = {b: order[k - 1] for k, b in enumerate(order)}
    if not order:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    schema = "bucket int, at long, tie long, goes_to int"
    guests = F.broadcast(spark.createDataFrame([(b, *firsts[b], before[b]) for b in order], schema))
    sent = rows.join(guests, ["bucket", "at", "tie"], "left")
    # A repeated first row makes several guests; those after the first close nothing.
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("goes_to").cast("int").alias("bucket"), F.lit(True).alias("guest"))
    dealt = sent.withColumn("as", F.explode(F.when(F.col("goes_to").isNull(), F.array(own)).otherwise(F.array(own, guest)))).select("as.bucket", "as.guest", "at", "tie", "doc_id", "text", "copies")
    placed = dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", "at", "tie")
    return placed.select("bucket", "guest", "doc_id", "text", "copies").mapInArrow(released(_pairs), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _bisect(bounds: list[tuple[int, int]]):
    """How many bounds lie below (at, tie)."""

    def listed(k: int) -> str:
        return f"CAST(split('{','.join(str(b[k]) for b in bounds)}', ',') AS ARRAY<BIGINT>)" if bounds else "CAST(array() AS ARRAY<BIGINT>)"

    mid = "(s.lo + s.hi) div 2"
    below = f"({listed(0)}[{mid}] < at OR {listed(0)}[{mid}] = at AND {listed(1)}[{mid}] < tie)"
    half = f"if({below}, struct(int({mid} + 1) AS lo, s.hi AS hi), struct(s.lo AS lo, int({mid}) AS hi))"
    return F.expr(f"aggregate(sequence(0, {len(bounds).bit_length()}), struct(0 AS lo, {len(bounds)} AS hi), (s, _k) -> if(s.lo < s.hi, {half}, s)).lo")
