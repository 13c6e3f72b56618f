"""SentencePiece encoding and decoding (BPE with byte fallback) by suffix-array matching.

Texts are cut into chunks that no piece spans. The distinct chunks of a batch that
were not seen before are concatenated and indexed by a suffix array, each piece's
occurrences are found in it by binary search, and the occurrences are the edges of
a lattice over the text. Edges sorted by their end are relaxed: an edge extends the
one valid encoding of the prefix before it if its piece stays apart from that
prefix's last piece, that is, if merging the two pieces' characters gives the same
two pieces again. That makes the relaxed path the one which merging by score takes.
"""

from __future__ import annotations

import heapq
import re
import string
import sys
import types
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches

SPACE = "▁"
STEP = 1000  # texts that are encoded together
MOST_CHUNKS = 120_000
MOST_PAIRS = 300_000
_LETTER = re.compile(r"[^\W\d_]")
_APART = "\U0010ffff"
_WIDTH = 1 << 22  # more than the pieces and code points together


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` code points, by prefix doubling.

    The first keys hold as many characters as fit in 63 bits.
    """
    small = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    bits = int(small.max()).bit_length()
    k = max(1, min(63 // bits, depth))
    key = np.zeros_like(small)
    padded = np.r_[small, np.zeros(k, np.int64)]
    for j in range(k):
        key = (key << bits) | padded[j : j + len(small)]
    while True:
        order = np.argsort(key, kind="stable")
        if k >= depth:
            return order
        in_order = key[order]
        rank = np.empty_like(key)
        rank[order] = np.cumsum(np.r_[1, in_order[1:] != in_order[:-1]])
        key = rank * (len(rank) + 2)
        key[: max(len(rank) - k, 0)] += rank[k:]
        k *= 2


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece (a row of code points) the range of the suffix array that begins with it."""
    lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order), np.int64)
    padded = np.r_[codes, np.zeros(pieces.shape[1] + 1, codes.dtype)]

    def bound(at: np.ndarray, c: int, right: bool) -> np.ndarray:
        a, b = lo[at].copy(), hi[at].copy()
        want = pieces[at, c]
        while (open_ := a < b).any():
            mid = (a + b) // 2
            got = padded[order[np.where(open_, mid, 0)] + c]
            less = open_ & ((got <= want) if right else (got < want))
            a = np.where(less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        return a

    for c in range(pieces.shape[1]):
        at = np.flatnonzero((lens > c) & (lo < hi))
        if not len(at):
            break
        left, right = bound(at, c, False), bound(at, c, True)
        lo[at], hi[at] = left, right
    return lo, hi


class PieceModel:
    """Vocabulary and normalisation of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that leave texts as they are")
        self.prefix = norm.add_dummy_prefix
        self.text = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.id = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.byte = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_of = {k: v for v, k in self.byte.items()}
        self.silent = {k for k, t in enumerate(kinds) if t == 3}
        self.unknown = next(k for k, t in enumerate(kinds) if t == 2)
        if 4 in kinds or 5 in kinds:
            raise ValueError("user-defined and unused pieces are not handled")
        # Text can be cut between two characters that stand together in no piece: no merge spans them.
        together = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.chunked = not any(x[0] != SPACE and x[1] == SPACE for x in together)
        after = {x[1] for x in together if _LETTER.fullmatch(x[0])}
        before = {x[0] for x in together if _LETTER.fullmatch(x[1])}
        gap = "".join(c for c in "\n\r\t" if not any(c in p for p in self.id))
        marks = [c for c in string.punctuation if c not in after]
        ends = re.escape("".join(c for c in marks if c not in before))
        mark, letter, words = re.escape("".join(marks)), _LETTER.pattern, ""
        if ends:
            words = rf"{SPACE}*{letter}++(?=[{SPACE}{gap}{mark}]|\Z)|{SPACE}*[{mark}]++(?:(?=[{SPACE}{gap}]|\Z)|(?<=[{ends}])(?={letter}))|"
        self.cut = re.compile(f"{words}{SPACE}*[^{SPACE}{gap}]+|{SPACE}+" + (f"|[{gap}]+" if gap else ""))
        self.names = list(self.id)
        self.lens = np.array([len(p) for p in self.names])
        self.depth = int(self.lens.max())
        self.codes = np.zeros((len(self.names), self.depth), np.int64)
        for k, p in enumerate(self.names):
            self.codes[k, : len(p)] = [ord(c) for c in p]
        self.chunks: dict[str, bytes] = {}  # ids of four bytes; of two generations, so that frequent chunks stay known
        self.older: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}
        self.stable = np.full(len(self.names), -1, np.int8)
        self.ids = np.array(list(self.id.values()))
        self.bytes = [b"" if k in self.silent else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for k, p in enumerate(self.text)]
        self.bytes[self.unknown] = " ⁇ ".encode()
        for k, v in self.byte_of.items():
            self.bytes[k] = bytes((v,))
        counts = {}
        for p, s in self.score.items():
            counts[s] = counts.get(s, 0) + 1
        #: Pieces whose score others share: merging them goes by place as well, so their chunks are merged directly.
        self.tied = np.array([counts[s] > 1 and len(p) > 1 for p, s in self.score.items()])

    def merge(self, text: str) -> list[str]:
        """Merge neighbours by score, leftmost first among equals."""
        parts: list[str | None] = list(text)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(-self.score[p], k, k + 1, p) for k in range(n - 1) if (p := parts[k] + parts[k + 1]) in self.score]
        heapq.heapify(queue)
        while queue:
            _, a, b, p = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != p:
                continue
            parts[a], parts[b] = p, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            for x, y in ((left[a], a), (a, right[a])):
                if x >= 0 and y >= 0 and (q := parts[x] + parts[y]) in self.score:
                    heapq.heappush(queue, (-self.score[q], x, y, q))
        return [p for p in parts if p is not None]

    def spelt(self, k: int) -> str:
        """A piece's text; numbers beyond the pieces are single characters."""
        return self.names[k] if k < len(self.names) else chr(k - len(self.names))

    def _apart(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the two pieces of each pair (first * _WIDTH + second) stay apart in a merge."""
        known, out = self.apart, []
        if len(known) > MOST_PAIRS:
            known.clear()
        for k in pairs.tolist():
            v = known.get(k)
            if v is None:
                x, y = self.spelt(k // _WIDTH), self.spelt(k % _WIDTH)
                v = known[k] = self.merge(x + y) == [x, y]
            out.append(v)
        return np.array(out, bool)

    def _stable(self, pieces: np.ndarray) -> np.ndarray:
        for k in pieces.tolist():
            if self.stable[k] < 0:
                self.stable[k] = self.merge(self.names[k]) == [self.names[k]]
        return self.stable[pieces] > 0

    def ids_of(self, parts: Iterable[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            k = self.id.get(p)
            if k is not None:
                out.append(k)
            elif self.byte:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def learn(self, chunks: list[str]) -> None:
        """Encode distinct chunks together."""
        text = _APART.join(chunks)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        order = suffix_array(codes, self.depth)
        lo, hi = occurrences(codes, order, self.codes, self.lens)
        found = np.flatnonzero(lo < hi)
        many = hi[found] - lo[found]
        piece = np.repeat(found, many)
        at = order[np.repeat(lo[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        ends = at + self.lens[piece]
        kinds = np.unique(piece)
        usable = np.zeros(len(self.names), bool)
        usable[kinds] = self._stable(kinds)
        ok = usable[piece]
        # A character that is no piece is an edge as well; chunks with tied pieces are merged directly.
        sizes = np.array([len(c) for c in chunks])
        starts = np.cumsum(sizes + 1) - sizes - 1
        owner = np.repeat(np.arange(len(chunks)), sizes + 1)[:-1]
        inside = np.ones(len(codes), bool)
        inside[(starts + sizes)[:-1]] = False
        single = np.zeros(len(codes), bool)
        single[at[self.lens[piece] == 1]] = True
        bare = np.flatnonzero(inside & ~single)
        tied = np.zeros(len(chunks), bool)
        tied[owner[at[self.tied[piece]]]] = True
        at, ends, piece = np.r_[at[ok], bare], np.r_[ends[ok], bare + 1], np.r_[piece[ok], codes[bare] + len(self.names)]
        step = ends - starts[owner[at]]
        order = np.argsort(step, kind="stable")
        at, ends, piece, step = at[order], ends[order], piece[order], step[order]
        cuts = np.searchsorted(step, np.arange(1, int(sizes.max()) + 2))
        last = np.full(len(codes) + 1, -1, np.int64)  # the last piece of the prefix that ends before a position
        last[starts] = -2
        for lo_, hi_ in zip(cuts[:-1], cuts[1:]):
            a, p = at[lo_:hi_], piece[lo_:hi_]
            before = last[a]
            fits = before == -2
            open_ = np.flatnonzero(before >= 0)
            if len(open_):
                pairs, back = np.unique(before[open_] * _WIDTH + p[open_], return_inverse=True)
                fits[open_] = self._apart(pairs)[back]
            last[ends[lo_:hi_][fits]] = p[fits]
        # All chunks are walked back at once, a piece of each in a step.
        lens = np.r_[self.lens, 1]
        n_names = len(self.names)
        now, of, steps = starts + sizes, np.arange(len(chunks)), []
        while len(of):
            p = last[now]
            on = p >= 0
            of, now, p = of[on], now[on], p[on]
            steps.append((of, p))
            now = now - lens[np.minimum(p, n_names)]
        of, p = np.concatenate([x[0] for x in steps]), np.concatenate([x[1] for x in steps])
        order = np.argsort(of, kind="stable")[::-1]  # pieces forward, chunks backward
        of, p = of[order], p[order]
        # Chunks with tied pieces, without a path, or with characters that are no pieces go one by one.
        odd = tied.copy()
        odd[of[p >= n_names]] = True
        lost = np.ones(len(chunks), bool)
        lost[of[np.r_[True, of[1:] != of[:-1]]]] = False
        reached = np.bincount(of, lens[np.minimum(p, n_names)], minlength=len(chunks)).astype(np.int64)
        odd |= lost | (reached != sizes)
        ids = self.ids[np.minimum(p, n_names - 1)].astype("<i4").tobytes()
        stop = np.cumsum(np.bincount(of, minlength=len(chunks))[::-1])[::-1]
        begin = np.r_[stop[1:], 0]
        for chunk, i, j, hand in zip(chunks, begin.tolist(), stop.tolist(), odd.tolist()):
            self.chunks[chunk] = np.array(self.ids_of(self.merge(chunk)), "<i4").tobytes() if hand else ids[4 * i : 4 * j]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<i4").tolist() for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        cut = []
        for t in texts:
            body = (SPACE if self.prefix else "") + t.replace(" ", SPACE) if t else ""
            cut.append(self.cut.findall(body) if self.chunked else [body] if body else [])
        if len(self.chunks) > MOST_CHUNKS:
            self.older, self.chunks = self.chunks, {}
        known, older = self.chunks, self.older
        new = []
        for c in set(chain.from_iterable(cut)).difference(known):
            ids = older.get(c)
            if ids is None:
                new.append(c)
            else:
                known[c] = ids
        step, size = [], 0
        for c in new:
            step.append(c)
            size += len(c)
            if size > 500_000:
                self.learn(step)
                step, size = [], 0
        if step:
            self.learn(step)
        return [b"".join(map(known.__getitem__, chunks)) for chunks in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """Pieces of bytes that make no character give U+FFFD."""
        body = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return body[1:] if self.prefix and body.startswith(" ") else body


def _model(path: str) -> PieceModel:
    """One model for each worker process, which serves many tasks."""
    held = sys.modules.setdefault("_pactspark_models", types.ModuleType("_pactspark_models")).__dict__
    if path not in held:
        held[path] = PieceModel(path)
    return held[path]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in (b.slice(k, STEP) for b in batches for k in range(0, b.num_rows, STEP)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bodies = model.encode_bytes(texts)
            n = np.array([len(x) // 4 for x in bodies], np.int64)
            values = np.frombuffer(b"".join(bodies), "<i4")
            ends = np.r_[0, np.cumsum(n)].astype(np.int32)
            flat, at = values.tolist(), ends.tolist()
            same = [model.decode(flat[i:j]) == t.replace(SPACE, " ") for i, j, t in zip(at, at[1:], texts)]
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(n), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip`` of every row's whole text, without begin and end tokens.

    ``round_trip`` says that decoding gives the text again (with the model's own
    space mark read as a space, as the library reads it). Null and empty texts
    have no ids; repeated rows stay; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(_encoded(path)), "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if i is None else model.decode(i) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def decode_documents(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""
    small_batches(rows.sparkSession)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(released(_decoded(path)), "doc_id long, text string")
