"""Document fingerprints by a randomised edit embedding.

A text is cut into blocks of code points.  Over each block goes a random
walk that all texts share: step j emits a hash of the character under the
pointer, and a random bit of (j, character) says whether the pointer moves
on.  Walks over two strings that differ by an edit soon run in step again,
so a small edit distance becomes a small Hamming distance between the
emitted strings.  The fingerprint keeps the emissions at sampled steps:
steps are kept by a hash of their number, at a rate of 1/2^level that
leaves 128 to 256 of them, so fingerprints of texts of different length
share their steps.  Bands of sampled positions find near fingerprints,
and the share of agreeing positions verifies them.

Contract: null and empty texts have an empty fingerprint; two empty ones
are alike (1), an empty and a filled one are not (0); equal texts have
equal fingerprints; equal ids are ordered by text; a null id comes first;
a single row is its own next one; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchops.llm.common import shuffle_width, slices, texts
from matchops.session import materialize

CHARS, STEPS = 1024, 2304  # of a block, and of the walk over it
SAMPLES = 256
BATCH_CHARS = 2 << 20
BANDS, BAND_SIZE = 8, 8
_U32 = np.uint32


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(_U32)
    x ^= x >> _U32(16)
    x = x * _U32(0x7FEB352D)
    x ^= x >> _U32(15)
    x = x * _U32(0x846CA68B)
    return x ^ x >> _U32(16)


@lru_cache(maxsize=64)
def _steps(level: int, up_to: int) -> np.ndarray:
    p = np.arange(up_to)
    return p[_mix(p) >> _U32(32 - level) == 0] if level else p


def _sampled(level: int, n: int) -> np.ndarray:
    """Kept step numbers below n."""
    up_to = 1 << max(12, (n - 1).bit_length()) if n else 0
    found = _steps(level, up_to)
    return found[:np.searchsorted(found, n)]


class Print:
    """A fingerprint: level, number of steps, emissions at the kept steps."""

    def __init__(self, level: int, steps: int, emitted: np.ndarray):
        self.level, self.steps, self.emitted = level, steps, emitted

    def __str__(self) -> str:
        return f"{self.level:02x}{self.steps:08x}" + self.emitted.astype(np.uint8).tobytes().translate(_HEX).decode()

    def at_level(self, level: int) -> np.ndarray:
        if level == self.level:
            return self.emitted
        return self.emitted[_mix(_sampled(self.level, self.steps)) >> _U32(32 - level) == 0]

    def likeness(self, other: Print) -> float:
        level = max(self.level, other.level)
        a, b = self.at_level(level), other.at_level(level)
        if not len(a) or not len(b):
            return float(self.steps == other.steps)
        n = min(len(a), len(b))
        share = np.count_nonzero(a[:n] == b[:n]) / max(len(a), len(b))
        return max(0.0, (share - 1 / 16) * 16 / 15)  # one in 16 agrees by chance

    def bands(self) -> list[int]:
        """Keys of the bands at this level and the one below it."""
        out = []
        for level in (self.level, self.level - 1):
            where = _sampled(level + 1, self.steps) if level >= 0 else np.zeros(0, int)
            if len(where) < BAND_SIZE:
                continue
            shown = self.at_level(level + 1) if level + 1 > self.level else self.emitted
            for b in range(BANDS):
                at = np.argpartition(_mix(where * BANDS + b + 1), BAND_SIZE - 1)[:BAND_SIZE]
                at = at[np.argsort(where[at])]
                key = bytes([level, b]) + where[at].astype("<u4").tobytes() + shown[at].tobytes()
                out.append(int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True))
        return out


_HEX = bytes(b"0123456789abcdef"[i & 15] for i in range(256))


def prints(strings: list[str]) -> list[Print]:
    """Fingerprints of some strings; all their blocks walk together."""
    codes = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), _U32) for s in strings]
    blocks = [-(-len(c) // CHARS) for c in codes]
    lanes = sum(blocks)
    x = np.zeros((lanes, CHARS + 1), _U32)
    lane = 0
    for c, n in zip(codes, blocks, strict=True):
        flat = np.zeros(n * CHARS, _U32)
        flat[:len(c)] = c
        x[lane:lane + n, :CHARS] = flat.reshape(n, CHARS)
        lane += n
    rng = np.random.default_rng(8)
    add, mul = rng.integers(0, 1 << 32, STEPS, dtype=_U32), rng.integers(0, 1 << 32, STEPS, dtype=_U32) | _U32(1)
    flat, at = x.ravel(), np.arange(lanes, dtype=np.int64) * (CHARS + 1)
    stop = at + CHARS
    emitted = np.empty((STEPS, lanes), np.uint8)
    for j in range(STEPS):
        h = (flat[at] + add[j]) * mul[j]
        emitted[j] = h >> _U32(24) & _U32(15)
        at += h >> _U32(31)
        np.minimum(at, stop, out=at)
    by_lane = np.ascontiguousarray(emitted.T).reshape(-1)
    out, lane = [], 0
    for c, n in zip(codes, blocks, strict=True):
        steps = (n - 1) * STEPS + -(-STEPS * (len(c) - (n - 1) * CHARS) // CHARS) if n else 0
        level = max(0, (max(steps, 1) - 1).bit_length() - SAMPLES.bit_length() + 1)
        out.append(Print(level, steps, by_lane[lane * STEPS:][_sampled(level, steps)]))
        lane += n
    return out


ROWS = 16_384  # of a range of ids, about


def _ordered(docs: DataFrame) -> DataFrame:
    """Rows in ranges of ids, each sorted by id and text."""
    rows = texts(docs)
    ranges = max(shuffle_width(docs.sparkSession), -(-rows.count() // ROWS))
    return rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("bands", pa.list_(pa.int64()))]
_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, bands array<long>")
_EDGE = [("range", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("last_id", pa.int64())]


def _finish(rows: list[tuple[int | None, str, str]]) -> list[pa.Array]:
    """Columns of _FIELDS for (doc_id, text, next text)."""
    edited = [t[:len(t) - len(t) // 2] + after[:len(t) // 2] for _, t, after in rows]
    found = list(dict.fromkeys([s for _, t, after in rows for s in (t, after)] + edited))
    of = dict(zip(found, prints(found), strict=True))
    out = [(d, len(t), hashlib.sha256(e.encode()).hexdigest(), str(of[t]), str(of[e]), of[t].likeness(of[e]), of[t].likeness(of[after]), of[t].bands())
           for (d, t, after), e in zip(rows, edited, strict=True)]
    return [pa.array(c, f[1]) for c, f in zip(zip(*out, strict=True), _FIELDS, strict=True)]


def _in_parts(rows: Iterator[tuple[int | None, str, str]]) -> Iterator[list[pa.Array]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) + CHARS
        if size > BATCH_CHARS:
            yield _finish(held)
            held, size = [], 0
    if held:
        yield _finish(held)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of
    its code points replaced by as many from the start of the next text.

    A task finishes all rows of its range but the last, whose next text is
    in another range.  It leaves its first and its last text as a row of
    their own in the written table: one such row a range, joined to the
    range behind it for the rows that were left."""
    schema = pa.schema(_FIELDS + _EDGE)

    def run(batches):
        edge: list = [None, None, None]  # first text, last text, last id

        def followed():
            for batch in batches:
                for part in slices([batch]):
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                        if edge[0] is None:
                            edge[0] = text
                        else:
                            yield edge[2], edge[1], text
                        edge[1:] = text, doc_id

        for columns in _in_parts(followed()):
            blank = [pa.nulls(len(columns[0]), f[1]) for f in _EDGE]
            yield pa.RecordBatch.from_arrays(columns + blank, schema=schema)
        if edge[0] is not None:
            own = zip([TaskContext.get().partitionId(), *edge], _EDGE, strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f[1]) for f in _FIELDS), *(pa.array([v], f[1]) for v, f in own)], schema=schema)

    ddl = f"{_DDL}, range long, first string, last string, last_id long"
    done = materialize(_ordered(docs).mapInArrow(run, ddl), "fingerprinted")
    edges = done.where("range is not null").select("range", "first", "last", "last_id")
    every = Window.orderBy("range")  # over a number a range, no texts
    least = F.min("range").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    behind = edges.select("range").select("range", F.coalesce(F.lead("range").over(every), least).alias("next"))
    left = edges.drop("first").join(behind, "range").join(edges.select(F.col("range").alias("next"), "first"), "next")

    def rest(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield tuple(batch.column(c)[i].as_py() for c in ("last_id", "last", "first"))
        for columns in _in_parts(rows()):
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(_FIELDS))

    return done.where("range is null").select(*(f[0] for f in _FIELDS)).union(left.select("last_id", "last", "first").mapInArrow(rest, _DDL))


def parse(text: str) -> Print:
    return Print(int(text[:2], 16), int(text[2:10], 16), np.array([int(c, 16) for c in text[10:]], np.uint8))


def near_pairs(printed: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of all distinct fingerprints that share a band and
    reach ``least``; copies stand behind one id.  Only ids are paired in the
    bands; the fingerprints come in once per pair."""
    one = materialize(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "prints")
    banded = one.select(F.col("doc_id").alias("a"), F.explode("bands").alias("band"))
    pairs = banded.join(banded.select(F.col("a").alias("b"), "band"), "band").where("a < b").select("a", "b").distinct()
    of = one.select("doc_id", "fingerprint")
    pairs = pairs.join(of.toDF("a", "fa"), "a").join(of.toDF("b", "fb"), "b")

    def verify(batches):
        known = lru_cache(maxsize=20_000)(parse)
        for batch in batches:
            like = [known(x).likeness(known(y)) for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(like, pa.float64())], ["a", "b", "likeness"])

    return pairs.select("a", "b", "fa", "fb").mapInArrow(verify, "a long, b long, likeness double").where(F.col("likeness") >= least)
