"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens that are new to a worker lie, byte by byte, in one linked list in
which no pair reaches over the end of a pre-token.  Every adjacent pair
that the vocabulary knows waits in the bucket of its merge rank; a bitmap of
two levels marks the buckets in use, so find-first-set twice gives the
lowest rank.  A bucket's positions are merged together, leftmost first where
two of them overlap.  Merging changes the ranks of the neighbouring pairs;
their old entries stay in the buckets and are skipped when met, because the
list then holds another rank for that position.  The work is near-linear in
the length of a pre-token, however long it is.

Contract: null and empty texts give no ids; ids decode to exactly the
bytes of the text; special strings are ordinary text.  Repeated rows and
texts give equal results; other columns of the input are not read.
"""

from __future__ import annotations

import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from matchops.llm.common import map_texts, texts
from matchops.llm.tokens import ChunkCache, ranks_of_tiktoken

SPAN = 256  # ranks per leaf bitmap
NONE = -1
JOINT = 1 << 21  # bytes of short pre-tokens that share one queue
SLICE = {"max_rows": 2048, "max_bytes": 8 << 20}  # of texts whose new pre-tokens share queues: the more, the fewer ranks are popped


class Pairs:
    """Ranks of all pairs of vocabulary ids that make up another one."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.rank = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Ids that may join a neighbour at a rank below their own; where one would, its pre-token merges one place at a time.
        self.early = {x for k, r in found.items() for x in (k >> 32, k & 0xFFFFFFFF) if r < x}

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)


    def below(self, rank: int, other: np.ndarray, on_right: bool) -> np.ndarray:
        """Whether the id ``rank`` joins ``other`` at a rank below its own."""
        own = np.full(len(other), rank, np.int64)
        joined = self(own, other) if on_right else self(other, own)
        return (joined != NONE) & (joined < rank)


class RankQueue:
    """Buckets of positions by rank, under a bitmap of two levels."""

    def __init__(self):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.leaves: dict[int, int] = {}
        self.top = 0

    def push(self, at: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        order = order[np.searchsorted(rank[order], 0):]  # without NONE
        if not len(order):
            return
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for r, lo, hi in zip(rank[starts].tolist(), starts, [*starts[1:], len(rank)], strict=True):
            if r in self.buckets:
                self.buckets[r].append(at[lo:hi])
            else:
                self.buckets[r] = [at[lo:hi]]
                word = r // SPAN
                self.leaves[word] = self.leaves.get(word, 0) | 1 << r % SPAN
                self.top |= 1 << word

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank and all its entries."""
        word = (self.top & -self.top).bit_length() - 1
        leaf = self.leaves[word]
        bit = leaf & -leaf
        self.leaves[word] = leaf ^ bit
        if leaf == bit:
            self.top ^= 1 << word
        rank = word * SPAN + bit.bit_length() - 1
        found = self.buckets.pop(rank)
        return rank, found[0] if len(found) == 1 else np.concatenate(found)


def merge(pieces: list[bytes], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all the pre-tokens, none of them empty; how many each has)."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    ids = pairs.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    n, stops = len(ids), np.cumsum(lengths)
    owner = np.repeat(np.arange(len(pieces)), lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[stops - 1] = NONE
    before[stops - lengths] = NONE
    alive = np.ones(n, bool)
    waits = np.full(n, NONE)
    at = np.flatnonzero(after != NONE)
    waits[at] = pairs(ids[at], ids[after[at]])
    queue = RankQueue()
    queue.push(at, waits[at])
    while queue.top:
        rank, at = queue.pop()
        at = at[waits[at] == rank]  # the others are stale
        if len(at) > 1:
            at = np.unique(at)
            if rank in pairs.early:
                right, left = after[after[at]], before[at]
                lower = (right != NONE) & (pairs.below(rank, ids[right], True) | (ids[right] == ids[at]))
                lower |= (left != NONE) & (pairs.below(rank, ids[left], False) | (ids[left] == ids[after[at]]))
                first = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
                now = first | ~np.isin(owner[at], owner[at[lower]])
                queue.push(at[~now], waits[at[~now]])
                at = at[now]
            overlaps = np.r_[False, after[at[:-1]] == at[1:]]
            if overlaps.any():
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(overlaps, 0, place))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        then = after[gone]
        ids[at] = rank
        after[at] = then
        alive[gone] = False
        waits[gone] = waits[at] = NONE
        inner = then != NONE
        before[then[inner]] = at[inner]
        left = before[at]
        left = left[left != NONE]
        at = np.concatenate([at[inner], left])
        waits[at] = pairs(ids[at], ids[after[at]])
        queue.push(at, waits[at])
    return ids[alive], np.bincount(owner[alive], minlength=len(pieces))


class Splitter:
    """Pre-tokens of a text by the pattern, as the Rust libraries cut them.

    This Python's ``regex`` may know letters and digits that those do not
    know yet; characters of that kind are taken out of the classes."""

    def __init__(self, pattern: str):
        self.pattern, self.plain, self.exact = pattern, regex.compile(pattern), None
        self.common: set[str] = set()  # characters met that every version knows alike

    def _exact(self):
        import tiktoken

        alphabet = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        single = {bytes([b]): b for b in range(256)}
        newer = set()
        for cls in (r"\p{L}", r"\p{N}"):
            core = tiktoken.Encoding("class", pat_str=cls, mergeable_ranks=single, special_tokens={})
            newer |= set(regex.findall(cls, alphabet)) - set(bytes(core.encode_ordinary(alphabet)).decode())
        if not newer:
            return self.plain
        pts = sorted(map(ord, newer))
        starts = [p for p in pts if p - 1 not in newer and chr(p - 1) not in newer]
        ends = [p for p in pts if chr(p + 1) not in newer]
        span = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))
        adjusted = (self.pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{span}]|[^\s\p{{L}}\p{{N}}])")
                    .replace(r"?\p{L}+", rf"?(?:(?![{span}])\p{{L}})+").replace(r"?\p{N}+", rf"?(?:(?![{span}])\p{{N}})+"))
        return regex.compile(adjusted)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.common.issuperset(text):
            return self.plain.findall(text)
        if not any(c > "⿿" or unicodedata.category(c) == "Cn" for c in text):
            self.common.update(text)
            return self.plain.findall(text)
        if self.exact is None:
            self.exact = self._exact()
        return self.exact.findall(text)


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = ranks_of_tiktoken(path)
        self.split = Splitter(pattern)
        self.pairs = Pairs(self.ranks)
        self.words: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for word, i in self.ranks.items():
            self.words[i] = word
        self.whole = {word: struct.pack("<I", i) for word, i in self.ranks.items()}
        self.cache = ChunkCache(self._encode)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        cut = [[p.encode() for p in self.split(c)] for c in chunks]
        new = [p for p in set().union(*cut) if p not in self.whole] if cut else []
        known: dict[bytes, bytes] = {}
        lo = size = 0
        for hi, piece in enumerate(new, 1):
            size += len(piece)
            if size > JOINT or hi == len(new):
                ids, counts = merge(new[lo:hi], self.pairs)
                flat, stops = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                known.update(zip(new[lo:hi], map(flat.__getitem__, map(slice, [0, *stops], stops)), strict=True))
                lo, size = hi, 0
        whole = self.whole
        return [(known.get(ps[0]) or whole[ps[0]]) if len(ps) == 1 else b"".join([known.get(p) or whole[p] for p in ps]) for ps in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4").astype(np.int32) for x in self.cache.ids(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.words.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process and vocabulary."""
    return Codec(path, pattern)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every document; ``path``: a rank file."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "ids": _lists(codec(path, pattern).encode(part.column("text").to_pylist()))}

    return map_texts(texts(docs), run, schema, "doc_id long, ids array<int>", **SLICE)


_DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("bytes", pa.binary())])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes binary) of every document: its ids, and what these
    ids alone stand for; ``decode(encode(docs))`` in one pass."""
    def run(part: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        rows = c.encode(part.column("text").to_pylist())
        return {"doc_id": part.column("doc_id"), "ids": _lists(rows), "bytes": list(map(c.decode, rows))}

    return map_texts(texts(docs), run, _DECODED, "doc_id long, ids array<int>, bytes binary", **SLICE)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes binary): what the ids stand for, null ids: none."""
    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [b"" if not x.is_valid else c.decode(x.values.to_numpy()) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(rows, pa.binary())],
                                                 schema=_DECODED)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")
