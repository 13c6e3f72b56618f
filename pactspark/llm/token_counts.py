"""Token counts without ids: pieces are counted once per distinct pre-token.

Documents are read in blocks. A block turns into posting lists (pre-token ->
documents of the block with their frequencies), dealt out by a hash of the
pre-token, so that a pre-token of the whole corpus meets its piece count in one
place, is counted there once, and the count is joined to the frequencies. A
pre-token that every document holds costs one posting list a block, never one
row a document. What goes back to a block is one sum per document.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, released, small_batches

BLOCK_DOCS = 4096  # an index within a block fits in two bytes
BLOCK_CHARS = 16_000_000  # a longer single document still makes one block
CACHE_WORDS = 300_000
MOST_PIECES = 1_000_000  # pre-tokens whose counts a task holds; a bucket with more counts the rarer ones again
HEADER = -1

_POSTING = np.dtype([("doc", "<u2"), ("n", "u1")])
_SHUFFLED = "bucket int, slot int, block string, words binary, postings binary"
_SUMS = "slot int, block string, words binary, postings binary"


def _load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


#: Code points beyond this pattern need the tokenizer's own normaliser; for the rest white space and case are plain.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u0250-\U0010ffff]")


#: What a tokenizer must count here as its library does, or is refused.
_PROBES = ("it's  a b\tc\n\n d 12 x,y", " lead", "trail ", "a b", "Ünï ΣΑΣ 漢字 🎉\xa0é", "x" * 40, "don't WON'T we're", "a - b_c (d) 3.14 e-mail", "", " ", "A  B   C", "é e\u0301 \u1e9e")


class PreTokens:
    """Splits texts into words, and words into pre-tokens, as the tokenizer does.

    Where the splitter never puts white space into a pre-token, words are split
    off first and each distinct word is pre-tokenised once; otherwise whole texts are.
    Special strings stand apart before normalisation, as the library does it. Texts below U+0250 are
    composed already; if the normaliser is the chain NFC, white space to blanks,
    lower case, then ``lower().split()`` gives the same words. A tokenizer whose
    counts over probes differ from its library's raises a ValueError, as do added
    tokens that take in blanks, stand for whole words or are normalised.
    """

    def __init__(self, tok):
        self.tok = tok
        added = tok.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("added tokens with lstrip, rstrip, single_word or normalized are not handled")
        specials = [t.content for t in added]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        rule = json.loads(tok.to_str())["normalizer"] or {}
        self.plain = rule.get("normalizers") == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        probes = [*_PROBES, *(x for s in specials for x in (s, f"a{s}b", f"a {s} b  {s.upper()}{s}"))]
        pieces = piece_counter(tok)
        for self.by_word in (True, False):
            self.reset()
            if all(sum(n * self.pieces_of(w, pieces) for w, n in Counter(self.words(x)).items()) == len(tok.encode(x, add_special_tokens=False).ids) for x in probes) and (not self.by_word or all(map(self._cuts, probes))):
                break
        else:
            raise ValueError("this tokenizer's counts are not sums over its pre-tokens")
        self.reset()

    def _normal(self, text: str) -> str:
        return self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text

    def _split(self, text: str) -> list[str]:
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)] if self.tok.pre_tokenizer else [text] if text else []

    def _cuts(self, text: str) -> bool:
        """Whether a text has the same pre-tokens word by word."""
        return [p for w in self._normal(text).split(" ") if w for p in self._split(w)] == self._split(self._normal(text))

    def pieces_of(self, word: str, pieces) -> int:
        k = self.id_of(word)
        spelt = list(self.token_id)
        return sum(pieces(spelt[t]) for t in self.flat[self.start[k] : self.start[k + 1]])

    def reset(self) -> None:
        self.word_id: dict[str, int] = {}
        self.token_id: dict[str, int] = {}
        self.flat: list[int] = []
        self.start: list[int] = [0]

    def words(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._words(text)
        out = [" " + x for x in self.special.findall(text)]  # no word begins with a blank
        for part in self.special.split(text):
            out += self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if not self.by_word:
            return ["P" + p for p in self._split(self._normal(text))]
        if self.plain and not _ODD.search(text):
            return text.lower().split()
        return [w for w in self._normal(text).split(" ") if w]

    def id_of(self, word: str) -> int:
        """The word's number; its pre-tokens' numbers lie in flat[start[number]:start[number + 1]]."""
        k = self.word_id.get(word)
        if k is None:
            k = self.word_id[word] = len(self.word_id)
            for p in ["S" + word[1:]] if word[0] == " " else ["P" + p for p in self._split(word)] if self.by_word else [word]:
                self.flat.append(self.token_id.setdefault(p, len(self.token_id)))
            self.start.append(len(self.flat))
        return k


def piece_counter(tok):
    """How many pieces a pre-token has, by its name: S and a special string, or P and a part of a text."""
    known: dict[str, int] = {}
    older: dict[str, int] = {}

    def count(name: str) -> int:
        nonlocal known, older
        n = known.get(name)
        if n is None:
            if len(known) >= MOST_PIECES // 2:
                known, older = {}, known
            n = older.get(name)
            if n is None:
                n = 1 if name[0] == "S" else len(tok.model.tokenize(name[1:]))
            known[name] = n
        return n

    return count


def _blocks(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens(_load(path))
        schema = pa.schema([("bucket", pa.int32()), ("slot", pa.int32()), ("block", pa.string()), ("words", pa.binary()), ("postings", pa.binary())])
        ids: list = []
        sizes: list[int] = []
        held: list[list[int]] = []  # word numbers of each document
        times: list[list[int]] = []
        chars = 0

        def flush():
            nonlocal ids, sizes, held, times, chars
            head = pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "n_bytes"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as w:
                w.write_batch(head)
            body = sink.getvalue().to_pybytes()
            start, flat = np.array(pre.start), np.array(pre.flat, np.int64)
            doc = np.repeat(np.arange(len(held)), [len(h) for h in held])
            word = np.fromiter(chain.from_iterable(held), np.int64, len(doc))
            n = np.fromiter(chain.from_iterable(times), np.int64, len(doc))
            lens = start[word + 1] - start[word]
            at = np.repeat(start[word] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            key = flat[at] * BLOCK_DOCS + np.repeat(doc, lens)
            n = np.repeat(n, lens)
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            n = np.add.reduceat(n, first) if len(first) else n
            key = key[first]
            parts = (n + 254) // 255  # a larger frequency takes several entries of one byte
            entries = np.empty(int(parts.sum()), _POSTING)
            entries["doc"] = np.repeat(key % BLOCK_DOCS, parts)
            entries["n"] = 255
            entries["n"][np.cumsum(parts) - 1] = n - 255 * (parts - 1)
            token = np.repeat(key // BLOCK_DOCS, parts)
            runs = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
            ends = np.r_[runs[1:], len(token)] if len(runs) else runs
            raw = entries.tobytes()
            spelt = list(pre.token_id)
            # The name is a digest of the block's content: an attempt that reads other rows makes other blocks.
            seal = hashlib.blake2b(body, digest_size=16)
            seal.update(raw)
            seal.update("\0".join(f"{len(spelt[t])} {spelt[t]}" for t in token[runs].tolist()).encode("utf-8", "surrogatepass"))
            name = seal.hexdigest()
            per: list[list] = [[] for _ in range(buckets)]
            size = _POSTING.itemsize
            for t, a, b in zip(token[runs].tolist(), runs.tolist(), ends.tolist()):
                w = spelt[t].encode("utf-8", "surrogatepass")
                per[zlib.crc32(w) % buckets].append((w, b - a, raw[a * size : b * size]))
            rows = [(zlib.crc32(name.encode()) % buckets, HEADER, name, None, body)]
            for b, found in enumerate(per):
                if found:
                    lens = np.array([x[1] for x in found], "<u4").tobytes()
                    rows.append((b, len(found), name, zlib.compress(np.array([len(x[0]) for x in found], "<u4").tobytes() + b"".join(x[0] for x in found), 1), zlib.compress(lens + b"".join(x[2] for x in found), 1)))
            ids, sizes, held, times, chars = [], [], [], [], 0
            if len(pre.word_id) > CACHE_WORDS:
                pre.reset()
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[k : k + 64]), schema)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                if ids and (len(ids) >= BLOCK_DOCS or chars + len(text) > BLOCK_CHARS):
                    yield from flush()
                ids.append(doc_id)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                chars += len(text)
                found = Counter(pre.words(text))
                numbers = list(map(pre.word_id.get, found))
                if None in numbers:
                    numbers = list(map(pre.id_of, found))
                held.append(numbers)
                times.append(list(found.values()))
        if ids:
            yield from flush()

    return run


def _counted(path: str):
    """For each block and bucket: tokens per document of the block. A bucket's pre-tokens are counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_counter(_load(path))
        for batch in batches:
            out = []
            for slot, block, words, postings in zip(*(batch.column(k).to_pylist() for k in ("slot", "block", "words", "postings"))):
                if slot == HEADER:
                    out.append((HEADER, block, None, postings))
                    continue
                raw = zlib.decompress(postings)
                lens = np.frombuffer(raw[: 4 * slot], "<u4")
                entries = np.frombuffer(raw[4 * slot :], _POSTING)
                counts = np.empty(slot, np.int64)
                spelt = zlib.decompress(words)
                ends = (4 * slot + np.cumsum(np.frombuffer(spelt[: 4 * slot], "<u4"))).tolist()
                for k, (i, j) in enumerate(zip([4 * slot, *ends], ends)):
                    counts[k] = pieces(spelt[i:j].decode("utf-8", "surrogatepass"))
                sums = np.bincount(entries["doc"], weights=np.repeat(counts, lens) * entries["n"].astype(np.float64))
                at = np.flatnonzero(sums)
                out.append((0, block, at.astype("<u2").tobytes(), sums[at].astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.binary(), pa.binary()))] if out else [pa.array([], t) for t in (pa.int32(), pa.string(), pa.binary(), pa.binary())], ["slot", "block", "words", "postings"])

    return run


def _gathered(group: pa.Table) -> pa.Table:
    head, totals = None, np.zeros(BLOCK_DOCS, np.int64)
    copies = 0
    for slot, at, body in zip(group.column("slot").to_pylist(), group.column("words").to_pylist(), group.column("postings").to_pylist()):
        if slot == HEADER:
            copies += 1
            head = pa.ipc.open_stream(body).read_all()
        else:
            totals[np.frombuffer(at, "<u2")] += np.frombuffer(body, "<i8")
    tokens = pa.array(totals[: head.num_rows] // copies)
    one = pa.table({"doc_id": head["doc_id"], "n_bytes": head["n_bytes"], "n_tokens": tokens})
    return pa.concat_tables([one] * copies)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, as ``tokenizers`` counts them without begin and end tokens.

    A tokenizer that can't be counted by pre-tokens raises a ValueError here (see PreTokens).

    One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``. Null and
    empty texts have no bytes and no tokens; a null id stays null; repeated rows
    stay repeated; an empty table gives none; other columns are ignored. The
    input should be a scan or a table: block contents must not change when a
    task is repeated.
    """
    spark = docs.sparkSession
    PreTokens(_load(path))
    small_batches(spark)
    buckets = max(1, partitions(spark))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.mapInArrow(released(_blocks(path, buckets)), _SHUFFLED).repartition(buckets, "bucket")
    sums = dealt.mapInArrow(released(_counted(path)), _SUMS)
    out = sums.groupBy("block").applyInArrow(_gathered, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
