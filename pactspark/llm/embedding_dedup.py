"""Near-duplicate embeddings: random-hyperplane hashing, exact cosine, components.

Equal vectors meet once. Each distinct vector gets a sign hash in several tables;
vectors of one bucket are compared by exact cosines in double precision, in blocks.
A pair counts in the first table only in which its hashes agree, so counts of
partners add up. A bucket emits counts and a spanning forest of its links, never
its pairs; a bucket above its share of rows is split into groups whose pairs are
tasks of their own.

Vectors are shuffled once a table, so tables are few and buckets large: within a
bucket products of single precision pick the pairs that are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, released, save, small_batches
from .components import components
from .simhash import _Forest

MIN_COSINE = 0.9
RECALL = 0.99  # of pairs at the least cosine; closer pairs are found more often
BUCKET = 1024  # vectors that a bucket should hold on average
LEAST_JOB = 4096
MOST_JOB = 100_000  # vectors of a bucket that a task holds
FEW = 10_000  # hot buckets whose table is broadcast
SINGLE = 1e-4  # more than single precision can be off for unit vectors
BLOCK = 1024
CHUNK = 20_000


def tables_for(n: int, cosine: float = MIN_COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a hash and number of tables for ``n`` vectors."""
    bits = min(max(math.ceil(math.log2(max(n, 2) / BUCKET)), 2), 24)
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _planes(bits: int, tables: int, seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, bits * tables))


def _codes(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """The hash of each vector in each table."""
    return ((x @ planes > 0).reshape(len(x), -1, bits) @ (1 << np.arange(bits))).astype("<i4")


def _signed(bits: int, tables: int, seed: int, kind: str):
    """Hashes of each vector, and the vector itself as bytes of its own kind (``<f4`` or ``<f8``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, m, vectors = batch.column(0), batch.column(1), batch.column(2)
            lens = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lens) - lens
            for dim in np.unique(lens):
                at = np.flatnonzero(lens == dim)
                raw = flat[starts[at][:, None] + np.arange(dim)]
                if dim not in planes:
                    planes[dim] = _planes(bits, tables, seed, int(dim))
                codes = _codes(_unit(raw), planes[dim], bits)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), m.take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array(list(codes)), pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary())], ["id", "m", "dim", "codes", "vector"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


_FOUND = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])


def _compared(cosine: float, kind: str, bits: int, tables: int, seed: int):
    """Rows come sorted by table, bucket and part; out come counts (n) and links (other)."""

    def near(x: np.ndarray, y: np.ndarray, small: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = np.nonzero(small @ other.T >= cosine - SINGLE)
        if 8 * len(u) > len(x) * len(y):
            return np.nonzero(x @ y.T >= cosine)
        hold = [np.einsum("ij,ij->i", x[u[k : k + 50_000]], y[v[k : k + 50_000]]) >= cosine for k in range(0, len(u), 50_000)]
        hold = np.concatenate(hold) if hold else np.zeros(0, bool)
        return u[hold], v[hold]

    def job(table: int, side: np.ndarray, m, x, planes) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        lone = not len(b)
        counts, forest, codes = np.zeros(len(m), np.int64), _Forest(len(m)), None
        small, b = x.astype(np.float32), a if lone else b
        for i in range(0, len(a), BLOCK):
            p = a[i : i + BLOCK]
            for j in range(i if lone else 0, len(b), BLOCK):
                q = b[j : j + BLOCK]
                u, v = near(x[p], x[q], small[p], small[q])
                if lone and i == j:
                    u, v = u[u < v], v[u < v]
                u, v = p[u], q[v]
                if table and len(u):
                    if codes is None:
                        codes = _codes(x, planes[:, : bits * table], bits)
                    new = np.ones(len(u), bool)
                    for t in range(table):
                        new &= codes[u, t] != codes[v, t]
                    u, v = u[new], v[new]
                np.add.at(counts, u, m[v])
                np.add.at(counts, v, m[u])
                forest.add(u, v)
        return counts, forest.root

    planes: dict[int, np.ndarray] = {}

    def work(cols: list) -> pa.RecordBatch:
        key, dim, part, side, table, ids, m, vectors = cols
        edge = np.flatnonzero((key[1:] != key[:-1]) | (dim[1:] != dim[:-1]) | (table[1:] != table[:-1]) | (part[1:] != part[:-1])) + 1
        out: list[tuple] = []
        for lo, hi in zip(np.r_[0, edge], np.r_[edge, len(key)]):
            if hi - lo < 2:
                continue
            s = side[lo:hi]
            if part[lo] >= 0 and part[lo] >> 16 != part[lo] & 65535 and (s.all() or not s.any()):
                continue  # the other group of the pair has no rows
            x = _unit(np.frombuffer(b"".join(vectors[lo:hi]), kind).reshape(hi - lo, -1))
            if int(dim[lo]) not in planes:
                planes[int(dim[lo])] = _planes(bits, tables, seed, int(dim[lo]))
            counts, root = job(int(table[lo]), s, m[lo:hi], x, planes[int(dim[lo])])
            own = ids[lo:hi]
            at = np.flatnonzero(counts)
            out.append((own[at], np.full(len(at), -1), counts[at]))
            at = np.flatnonzero(root != np.arange(hi - lo))
            out.append((own[at], own[root[at]], np.zeros(len(at), np.int64)))
        cat = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ([], [], []))]
        return pa.RecordBatch.from_arrays([pa.array(cat[0], pa.int64()), pa.array(cat[1], pa.int64(), mask=cat[2] > 0), pa.array(cat[2], pa.int64())], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)])
            size += batch.num_rows
            if size >= CHUNK:
                cols = [np.concatenate(c) for c in zip(*held)]
                same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[4] == cols[4][-1]) & (cols[2] == cols[2][-1])
                cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                held, size = [[c[cut:] for c in cols]], len(same) - cut
                if cut:
                    yield work([c[:cut] for c in cols])
        if size:
            yield work([np.concatenate(c) for c in zip(*held)])

    return run


def near_vectors(vectors: DataFrame, cosine: float = MIN_COSINE, recall: float = RECALL, seed: int = 7) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vec_id, embedding``.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing. Vectors of different lengths never link. Repeated rows
    stay and link with each other; rows with a null vec_id are linked, and name
    a component only where no other id does; other columns are ignored; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.withColumn("v", F.when(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)), F.col("v")))
    rows = rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")))
    valid = rows.where("v is not null")
    groups = save(valid.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("v").alias("v")).withColumn("id", F.xxhash64("h1", "h2")), "vectors")
    n = groups.count()
    bits, tables = tables_for(n, cosine, recall)
    hashed = save(groups.select("id", "m", "v").mapInArrow(released(_signed(bits, tables, seed, kind)), "id long, m long, dim int, codes array<int>, vector binary"), "hashes")
    placed = hashed.select("id", "m", "dim", "vector", F.posexplode("codes").alias("table", "bucket"))
    n_parts = partitions(spark)
    least = min(max(LEAST_JOB, n * tables // (2 * n_parts)), MOST_JOB)
    tally = hashed.select("dim", F.posexplode("codes").alias("table", "bucket")).groupBy("dim", "table", "bucket").count()
    hot = save(tally.where(F.col("count") > least).select("dim", "table", "bucket", F.ceil(F.col("count") / least).cast("int").alias("g")), "hot")
    n_hot = hot.count()
    if n_hot:
        placed = placed.join(F.broadcast(hot) if n_hot <= FEW else hot.hint("merge"), ["dim", "table", "bucket"], "left")
        g = F.coalesce("g", F.lit(1))
        placed = placed.withColumn("i", F.pmod(F.xxhash64("id", F.lit("group")), g).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), g - 1)))
    else:
        placed = placed.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    part = F.least("i", "j") * 65536 + F.greatest("i", "j")
    jobs = placed.select(F.col("bucket").cast("long").alias("key"), "dim", part.alias("part"), (F.col("i") > F.col("j")).cast("int").alias("side"), "table", "id", "m", "vector")
    order = ["table", "key", "dim", "part"]
    found = save(jobs.repartition(*order).sortWithinPartitions(*order).mapInArrow(released(_compared(cosine, kind, bits, tables, seed)), "id long, other long, n long"), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = groups.drop("v").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(counts, "id", "left")
    # A table of its own, so that the partition of a large component can be split in the join.
    firsts = save(known.groupBy("root").agg(F.min("least").alias("component_id")), "firsts")
    known = known.join(firsts, "root").select("h1", "h2", "component_id", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    # A row without a valid vector meets no group and needs no place of its own among the keys.
    own = rows.select("vec_id", "h1", "h2")
    out = own.where("h1 is not null").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = own.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
