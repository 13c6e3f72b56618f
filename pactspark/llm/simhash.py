"""SimHash near-duplicates by a binary trie self-join.

A fingerprint is one or two words of 64 bits, each of BLOCKS blocks. For each block
the word is rotated to begin with it, and the rotated words form a binary trie. The
trie is joined with itself: pairs of nodes are walked down together, differing bits
add up, and a pair is dropped when they exceed the budget: ``errors`` down to the
end of the block, the budget of all bits beyond. A link is found if one of its
blocks has no more than ``errors`` differing bits, in nodes of any size. The top
levels of the walk are a Spark shuffle by node pair, no deeper than the number of
rows asks for; the rest of the walk is done on sorted arrays, many node pairs at a
time. A job emits a spanning forest of the links it found, never all pairs of a group.

Equal fingerprints meet once, as one fingerprint. A node that holds more than its
share of all rows is split into groups of rows, whose pairs are jobs of their own,
so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, released, save, small_batches
from .components import components

BLOCKS = 5  # blocks of a word of 64 bits
DEPTH = 12  # bits of a block
NODE = 16_384  # rows of a node that the shuffle makes, on average, where blocks may have errors
LEAST_JOB = NODE
CHUNK = 100_000  # rows that a task walks at a time, if no job is larger
LEAF = 16_384  # node pairs with no more row pairs than this are compared row by row
TINY = 256  # of these, those with no more row pairs than this are compared together
SIDE = 1024  # rows of either side that are compared at once
BATCH = 200_000  # links that are handed on together
FRONT = 100_000  # node pairs that are walked at a time
GROUP_BYTES = 8_000_000  # sets of shingles that a task holds of either side
STEP = 512  # texts of either side whose shared shingles are counted at once
COLUMNS = 4096  # shingles that are counted at once


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle; words are runs of other than ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(whole, seed)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; zero without any."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def _second(hashes: np.ndarray) -> np.ndarray:
    """Another hash of each shingle, by mixing the first."""
    h = hashes ^ np.uint64(0xA5A3564E27C2B1F9)
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(m)
    return h ^ (h >> np.uint64(32))


def _hashed(width: int, words: int, once: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f0, f1 = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                h = np.unique(shingle_hashes(text, width)) if once else shingle_hashes(text, width)
                f0.append(fingerprint(h))
                f1.append(fingerprint(_second(h)) if words == 2 else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f0, f1))], [*batch.schema.names[:-1], "f0", "f1"])

    return run


def fingerprints(docs: DataFrame, width: int = 5, words: int = 1, once: bool = False) -> DataFrame:
    """``key, f0, f1`` of each row of ``key, text``; f1 is 0 for fingerprints of one word. With ``once`` repeated shingles count once."""
    small_batches(docs.sparkSession)
    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", F.col("text").cast("string").alias("text")).mapInArrow(released(_hashed(width, words, once)), f"key {kind}, f0 long, f1 long")


class _Forest:
    """Union-find over array indices, fed with arrays of edges."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


class _Pairs(_Forest):
    """A forest that keeps the pair that joined two trees, the closest ones of each batch first."""

    def __init__(self, n: int, f0: np.ndarray, f1: np.ndarray):
        super().__init__(n)
        self.f0, self.f1 = f0, f1
        self.used: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
        if not len(a):
            return
        far = np.bitwise_count(self.f0[a] ^ self.f0[b]).astype(np.int64) + np.bitwise_count(self.f1[a] ^ self.f1[b])
        order = np.argsort(far, kind="stable")
        a, b = a[order], b[order]
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x)) is not None:
                up[x] = y = up.get(y, y)
                x = y
            return x

        for u, v, x, y in zip(a.tolist(), b.tolist(), root[a].tolist(), root[b].tolist()):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                self.used.append((u, v))
        jump = np.arange(len(root))
        jump[list(up)] = list(up.values())
        while not np.array_equal(jump, up_ := jump[jump]):
            jump = up_
        self.root = jump[root]


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each sorted range, where the bit at ``depth`` turns to one."""
    shift = (63 - depth).astype(np.uint64)
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        one = (values[np.where(open_, mid, 0)] >> shift) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


class _Batched:
    """Hands on links in batches."""

    def __init__(self, found):
        self.found, self.held, self.size = found, [], 0

    def __call__(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append((a, b))
            self.size += len(a)
            if self.size >= BATCH:
                self.flush()

    def flush(self) -> None:
        if self.held:
            self.found(*(np.concatenate(c) for c in zip(*self.held)))
        self.held, self.size = [], 0


def walk(values: np.ndarray, other: np.ndarray, pairs: np.ndarray, errors: int, total: int, found) -> None:
    """Walk node pairs down.

    ``pairs``: rows of lo, hi, lo, hi, depth, differing bits, over the sorted words
    ``values``; ``other`` is the other word of each row (zero without one). ``found``
    takes index arrays of links: no more than ``errors`` bits differ among the first
    DEPTH ones of the word, and no more than ``total`` in both words.
    """
    found = _Batched(found)
    stack = [pairs]
    while stack:
        p = stack.pop()
        if len(p) > FRONT:
            stack += [p[: len(p) // 2], p[len(p) // 2 :]]
            continue
        n1, n2 = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
        live = (n1 > 0) & (n2 > 0) & (p[:, 5] <= np.where(p[:, 4] <= DEPTH, errors, total))
        p, n1, n2 = p[live], n1[live], n2[live]
        leaf = (n1 * n2 <= LEAF) | (p[:, 4] >= 64)
        tiny = n1[leaf] * n2[leaf] <= TINY
        _compare_tiny(values, other, p[leaf][tiny], errors, total, found)
        for q in p[leaf][~tiny].tolist():
            _compare(values, other, q, errors, total, found)
        p = p[~leaf]
        if not len(p):
            continue
        m1 = _split(values, p[:, 0], p[:, 1], p[:, 4])
        m2 = _split(values, p[:, 2], p[:, 3], p[:, 4])
        same = p[:, 0] == p[:, 2]
        d, e = p[:, 4] + 1, p[:, 5]
        stack.append(
            np.concatenate(
                [
                    np.column_stack([p[:, 0], m1, p[:, 2], m2, d, e]), np.column_stack([m1, p[:, 1], m2, p[:, 3], d, e]),
                    np.column_stack([p[:, 0], m1, m2, p[:, 3], d, e + 1]), np.column_stack([m1, p[:, 1], p[:, 2], m2, d, e + 1])[~same],
                ]
            )
        )
    found.flush()


_REST = np.uint64(64 - DEPTH)


def _compare(values, other, pair: list[int], errors: int, total: int, found) -> None:
    """All rows of one node against all of another, or each two of one."""
    lo1, hi1, lo2, hi2 = pair[:4]
    for i in range(lo1, hi1, SIDE):
        for j in range(lo2, hi2, SIDE):
            x = values[i : min(i + SIDE, hi1), None] ^ values[j : min(j + SIDE, hi2)]
            a, b = np.nonzero(np.bitwise_count(x) <= total)
            if len(a):
                x = x[a, b]
                a, b = a + i, b + j
                near = (np.bitwise_count(x >> _REST) <= errors) & (np.bitwise_count(x).astype(np.int64) + np.bitwise_count(other[a] ^ other[b]) <= total)
                if lo1 == lo2:
                    near &= a < b
                found(a[near], b[near])


def _compare_tiny(values, other, p, errors: int, total: int, found) -> None:
    sizes, w = (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2]), p[:, 3] - p[:, 2]
    for at in range(0, len(p), 4096):
        q, s, v = p[at : at + 4096], sizes[at : at + 4096], w[at : at + 4096]
        of = np.repeat(np.arange(len(q)), s)
        k = np.arange(len(of)) - np.repeat(np.cumsum(s) - s, s)
        a, b = q[of, 0] + k // v[of], q[of, 2] + k % v[of]
        x = values[a] ^ values[b]
        near = (np.bitwise_count(x >> _REST) <= errors) & (np.bitwise_count(x) <= total) & ((a < b) | (q[of, 0] != q[of, 2]))
        a, b, x = a[near], b[near], x[near]
        near = np.bitwise_count(x).astype(np.int64) + np.bitwise_count(other[a] ^ other[b]) <= total
        found(a[near], b[near])


def _firsts(ids: np.ndarray) -> np.ndarray:
    """Where each of the ids stands first."""
    _, at, place = np.unique(ids, return_index=True, return_inverse=True)
    return at[place]


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _joined(errors: int, total: int, top: int, direct: bool):
    """Jobs come sorted by key; each is one row range, or two by side.

    Jobs were walked down ``top`` bits. Out come stars of the components found; with
    ``direct`` the pairs that joined them, the closest ones of each batch first.
    """

    def work(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, side, f0, f1, vid, part = cols
        u0, u1 = f0.view(np.uint64), f1.view(np.uint64)
        block = (key >> 48).astype(np.int64) & 15
        word, other = np.where(block >= BLOCKS, u1, u0), np.where(block >= BLOCKS, u0, u1)
        turn = ((block % BLOCKS) * (64 // BLOCKS)).astype(np.uint64)
        values = np.where(turn == 0, word, (word << turn) | (word >> ((np.uint64(64) - turn) % np.uint64(64))))
        job = np.r_[0, np.cumsum((key[1:] != key[:-1]) | (part[1:] != part[:-1]))]
        order = np.lexsort((values, side, job))
        job, side, values, other, u0, u1, vid, key = (c[order] for c in (job, side, values, other, u0, u1, vid, key))
        starts = np.r_[0, np.flatnonzero(job[1:] != job[:-1]) + 1, len(job)]
        lo, hi = starts[:-1], starts[1:]
        ones = np.r_[0, np.cumsum(side == 1)]
        mid = hi - (ones[hi] - ones[lo])
        two = mid < hi
        lone = np.flatnonzero(~two)
        pairs = np.empty((len(lo), 6), np.int64)
        pairs[:, 0], pairs[:, 1], pairs[:, 2], pairs[:, 3], pairs[:, 4] = lo, mid, mid, hi, top
        pairs[lone, 2], pairs[lone, 3] = lo[lone], hi[lone]
        x, y = (key[lo] >> 24) & 0xFFFFFF, key[lo] & 0xFFFFFF
        pairs[:, 5] = np.bitwise_count(x ^ y)
        pairs = pairs[two | (x == y)]  # only one side of a pair of nodes came: nothing to join
        forest = _Pairs(len(vid), u0, u1) if direct else _Forest(len(vid))
        # A fingerprint comes once to each job, and so may stand at several places of a chunk.
        forest.root[:] = _firsts(vid)
        walk(values, other, pairs, errors, total, forest.add)
        if direct:
            links = np.array(forest.used, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(vid[links[:, 0]]), pa.array(vid[links[:, 1]])], schema=_EDGE)
        member = np.flatnonzero(vid != vid[forest.root])
        links = np.unique(np.column_stack([vid[forest.root[member]], vid[member]]), axis=0) if len(member) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], schema=_EDGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= CHUNK:
                cols = [np.concatenate(c) for c in zip(*held)]
                same = (cols[0] == cols[0][-1]) & (cols[5] == cols[5][-1])
                cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                held, size = [[c[cut:] for c in cols]], len(same) - cut
                if cut:
                    yield work([c[:cut] for c in cols])
        if size:
            yield work([np.concatenate(c) for c in zip(*held)])

    return run


def _masks(bits: int, errors: int) -> list[int]:
    return [sum(1 << k for k in at) for n in range(min(bits, errors) + 1) for at in combinations(range(bits), n)]


def links(fps: DataFrame, budget: int, words: int = 1, errors: int | None = None, direct: bool = False) -> DataFrame:
    """Spanning forests, as ``a, b``, of the pairs of distinct ``id, f0, f1`` within ``budget`` differing bits.

    A pair is found if one of its blocks has no more than ``errors`` differing bits; if that is not given, it
    is so large that every pair has such a block. With ``direct`` each row is such a pair itself, otherwise it may
    stand for a way over others.
    """
    spark = fps.sparkSession
    small_batches(spark)
    # More errors in each block would be over the budget.
    errors = budget // (BLOCKS * words) if errors is None else errors
    size = 64 // BLOCKS
    n_parts, n = partitions(spark), fps.count()
    # Masks multiply the rows that are shuffled, and there are more of them the deeper the shuffle goes.
    top = DEPTH if not errors else min(DEPTH, max(0, math.ceil(math.log2(max(n, 1) / NODE))))
    masks = _masks(top, errors)
    # Nodes above a task's share are split; there are at most BLOCKS * words * 2**DEPTH nodes.
    least = max(LEAST_JOB, min(CHUNK, n * words * BLOCKS * len(masks) // (2 * n_parts)))

    def prefix(block: int, turn: int):
        w = "f1" if block >= BLOCKS else "f0"
        value = f"(shiftleft({w}, {turn}) | shiftrightunsigned({w}, {64 - turn}))" if turn else w
        return F.expr(f"shiftrightunsigned({value}, {64 - top})") if top else F.lit(0).cast("long")

    blocks = F.array(*(F.struct(F.lit(b).alias("block"), prefix(b, (b % BLOCKS) * size).alias("x")) for b in range(BLOCKS * words)))
    placed = fps.select(F.col("id"), "f0", "f1", F.explode(blocks).alias("at")).select("id", "f0", "f1", "at.block", "at.x")
    hot = placed.groupBy("block", "x").count().where(F.col("count") > least).select("block", "x", F.ceil(F.col("count") / least).cast("int").alias("g"))
    hot_rows = [(r["block"], r["x"], r["g"]) for r in hot.collect()]
    paired = placed.withColumn("mask", F.explode(F.array(*map(F.lit, masks)))).withColumn("y", F.col("x").bitwiseXOR(F.col("mask").cast("long")))
    if hot_rows:
        groups = F.broadcast(spark.createDataFrame(hot_rows, "block int, x long, g int"))
        paired = paired.join(groups.withColumnRenamed("g", "gx"), ["block", "x"], "left").join(groups.select("block", F.col("x").alias("y"), F.col("g").alias("gy")), ["block", "y"], "left")
        gx, gy = F.coalesce("gx", F.lit(1)), F.coalesce("gy", F.lit(1))
        paired = paired.withColumn("i", F.pmod(F.xxhash64("id", F.lit("group")), gx).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), gy - 1)))
    else:
        paired = paired.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    swap = (F.col("x") > F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("i") > F.col("j")))
    key = F.expr("shiftleft(cast(block as long), 48) | shiftleft(least(x, y), 24) | greatest(x, y)")
    lo, hi = F.when(swap, F.col("j")).otherwise(F.col("i")), F.when(swap, F.col("i")).otherwise(F.col("j"))
    jobs = paired.select(key.alias("key"), swap.cast("int").alias("side"), "f0", "f1", "id", (lo.cast("long") * 65536 + hi).alias("part"))
    dealt = jobs.repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(released(_joined(errors, budget, top, direct)), "a long, b long")


def _shingled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    return run


def _held(least: float):
    """Of rows ``a, b`` and both sets of hashes, those that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = shared >= least * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _matched(least: float):
    """Rows ``id, f0, f1, comp, s, whole, part, side`` come sorted by whole and part; out come pairs of similar
    texts that join components, as a forest. Components are those known before."""

    def shared(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
        """How many shingles each of the sets shares with each of the others."""
        out = np.zeros((len(p), len(q)), np.float32)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (p, q)]
        of = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (p, q)]
        both = np.intersect1d(*flat)
        at = [np.searchsorted(both, x) for x in flat]
        for k, x in enumerate(flat):
            hit = np.flatnonzero(both[np.minimum(at[k], len(both) - 1)] == x) if len(both) else np.zeros(0, np.int64)
            order = hit[np.argsort(at[k][hit], kind="stable")]
            at[k], of[k] = at[k][order], of[k][order]
        for lo in range(0, len(both), COLUMNS):
            dense = []
            for k, x in enumerate((p, q)):
                i, j = np.searchsorted(at[k], [lo, lo + COLUMNS])
                m = np.zeros((len(x), min(COLUMNS, len(both) - lo)), np.float32)
                m[of[k][i:j], at[k][i:j] - lo] = 1
                dense.append(m)
            out += dense[0] @ dense[1].T
        return out

    def job(rows: list[tuple]) -> pa.RecordBatch:
        ids, f0, f1, comp, side = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2, 3, 7))
        f0, f1, sets = f0.view(np.uint64), f1.view(np.uint64), [r[4] for r in rows]
        sizes = np.array([len(x) for x in sets])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b, lone = (b, False) if len(b) else (a, True)
        forest = _Pairs(len(ids), f0, f1)
        forest.root[:] = _firsts(comp)
        for i in range(0, len(a), STEP):
            for j in range(i if lone else 0, len(b), STEP):
                p, q = a[i : i + STEP], b[j : j + STEP]
                open_ = forest.root[p][:, None] != forest.root[q]
                # Sets whose sizes differ too much can't be similar.
                open_ &= (sizes[p][:, None] >= least * sizes[q]) & (least * sizes[p][:, None] <= sizes[q])
                p, q = p[open_.any(1)], q[open_.any(0)]
                if not len(p):
                    continue
                n = shared([sets[k] for k in p], [sets[k] for k in q])
                near = (n >= least * (sizes[p][:, None] + sizes[q] - n)) & (forest.root[p][:, None] != forest.root[q])
                u, v = np.nonzero(near)
                forest.add(p[u], q[v])
        links = ids[np.array(forest.used, np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], schema=_EDGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            sets = batch.column(4)
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6, 7)))):
                if held and held[-1][5:7] != row[4:6]:
                    yield job(held)
                    held = []
                held.append((*row[:4], sets[k].values.to_numpy(), *row[4:]))
        if held:
            yield job(held)

    return run


def verified(distinct: DataFrame, docs: DataFrame, width: int, words: int, budget: int, errors: int | None, least: float) -> DataFrame:
    """Links between texts with a Jaccard similarity of ``least`` or more over their sets of shingles.

    The pairs that join the candidates' trees are held against the texts first. A refused one may hide others
    between the same trees; so where a tree of candidates falls apart into several components, all pairs between
    these are held against the texts, in blocks: no similar pair that candidates join is lost.
    """
    fps = distinct.select("id", "f0", "f1")
    edges = save(links(fps, budget, words, errors, True).distinct(), "edges")
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    wanted = save(distinct.join(ends, "id").select("id", F.col("least").alias("key")), "wanted")
    texts = docs.select("key", F.col("text").cast("string").alias("text")).join(wanted.hint("merge"), "key").groupBy("id").agg(F.min("text").alias("text"))
    small_batches(edges.sparkSession)
    sets = save(texts.mapInArrow(released(_shingled(width)), "id long, s array<long>"), "sets")
    both = edges.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    good = save(both.select("a", "b", "sa", "sb").mapInArrow(released(_held(least)), "a long, b long"), "links")
    trees, found = components(edges), components(good)
    members = trees.select("id", F.col("root").alias("whole")).join(found, "id", "left").select("id", "whole", F.coalesce("root", "id").alias("comp")).join(sets, "id")
    members = save(members, "members")
    apart = members.groupBy("whole").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(8 * F.size("s") + 64).alias("bytes"))
    # Of two texts the one link is known to be none. A table of its own, so that a large tree's partition can be split in the join.
    apart = save(apart.where("n > 2 AND lo <> hi").select("whole", F.ceil(F.col("bytes") / GROUP_BYTES).cast("int").alias("g")), "apart")
    if apart.isEmpty():
        return good
    rows = members.join(apart, "whole").withColumn("i", F.pmod(F.xxhash64("id", F.lit("group")), F.col("g")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).join(fps, "id")
    part = F.least("i", "j").cast("long") * 2**31 + F.greatest("i", "j")
    rows = rows.select("id", "f0", "f1", "comp", "s", "whole", part.alias("part"), (F.col("i") > F.col("j")).cast("int").alias("side"))
    more = rows.repartition("whole", "part").sortWithinPartitions("whole", "part").mapInArrow(released(_matched(least)), "a long, b long")
    return save(good.union(more), "links")


def near_duplicates(docs: DataFrame, width: int = 5, words: int = 2, budget: int = 19, errors: int | None = None, least: float | None = None) -> DataFrame:
    """``key, f0, f1, first``: ``first`` is the least key of the row's component.

    ``docs`` has ``key`` of a type with an order and ``text``. The defaults take five words and a
    similarity of 0.8: of 128 bits, 19.4 differ then on average. ``errors`` see links. With ``least``
    fingerprints go by the sets of shingles, and candidates are held against those sets themselves until all
    that join components are (see verified); only texts of one fingerprint are taken for near-duplicates without that.
    A null text is an empty one, and texts without words have the fingerprint zero, linked like
    any other. Rows with a null key are linked but never first while others are.
    Repeated rows stay; an empty table gives none.
    """
    marked = save(fingerprints(docs, width, words, least is not None), "simhash")
    distinct = marked.groupBy("f0", "f1").agg(F.min("key").alias("least"))
    distinct = save(distinct.withColumn("id", F.col("f0") if words == 1 else F.xxhash64("f0", "f1")), "distinct")
    if least is None:
        edges = links(distinct.select("id", "f0", "f1"), budget, words, errors)
    else:
        edges = verified(distinct, docs, width, words, budget, errors, least)
    roots = components(edges)
    rooted = distinct.join(roots, "id", "left").select("f0", "f1", "least", F.coalesce("root", "id").alias("root"))
    # A table of its own, so that the partition of a large component can be split in the join.
    firsts = save(rooted.groupBy("root").agg(F.min("least").alias("first")), "firsts")
    named = rooted.join(firsts, "root").select("f0", "f1", "first")
    return marked.join(named, ["f0", "f1"]).select("key", "f0", "f1", "first")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (``doc_id, text`` and others) with one of each component, the least doc_id.

    Rows of one doc_id go by their text's hash, a null doc_id comes last, and of
    equal rows one stays.
    """
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("at"), F.xxhash64("text").alias("tie"))
    found = near_duplicates(docs.select(key.alias("key"), "text"), **options)
    kept = save(found.where("key = first").groupBy(F.col("key").alias("kept_key")).agg(F.count("*").alias("copies")), "kept")
    # The columns of docs stand in a struct, where no name can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("kept_key"))
    left = rows.join(kept.drop("copies").hint("merge"), "kept_key", "left_semi")
    if not kept.where("copies > 1").isEmpty():
        left = left.dropDuplicates(["kept_key"])
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
