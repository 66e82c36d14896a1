"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers.  A block of rows keeps, for every
component, one bitmap per bit (a slice).  A query's scores for a block come
from adding the slices under the bits of its own components with carry-save
bitmap arithmetic; a negative component adds the complement instead.  The
score slices are then read from the most significant one downward, keeping
the rows that can still be among the best k; the rows that tie at the
boundary are resolved by their exact integer scores and ids.

Queries come in blocks that meet every block of the index once, so no task
holds all rows or all queries, and only k rows of each meeting go on.

Contract: vectors that are null or hold null or non-finite components take
no part; shorter vectors count as padded with zeros; components saturate at
2^26 in size; repeated rows are separate rows; a null id takes no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchops.session import materialize

BLOCK, QUERIES = 8192, 64
LARGEST = 1 << 26


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<int>): floor(scale * x) of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(c * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return (rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")))


def _matrix(vectors: list, width: int | None = None) -> np.ndarray:
    width = max(map(len, vectors), default=0) if width is None else width
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[:len(v)] = v
    return out


def _sum(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Bitmaps of the sum, least significant first; columns[w] are addends of weight 2^w."""
    out = []
    w = 0
    while w < len(columns):
        stack = np.stack(columns[w]) if columns[w] else None
        while stack is not None and len(stack) > 1:
            n = len(stack) // 3 * 3
            if n:
                a, b, c = stack[:n:3], stack[1:n:3], stack[2:n:3]
                half = a ^ b
                one, carry = half ^ c, (a & b) | (half & c)
                stack = np.concatenate([one, stack[n:]])
            else:
                a, b = stack
                stack, carry = (a ^ b)[None], (a & b)[None]
            if w + 1 == len(columns):
                columns.append([])
            columns[w + 1] += list(carry)
        out.append(stack[0] if stack is not None else None)
        w += 1
    return out


class Block:
    """One block of the index: ids in ascending order, integers, slices."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.low = self.values.min(axis=0) if len(ids) else np.zeros(values.shape[1], np.int64)
        self.words = -(-len(ids) // 64)
        shifted = self.values - self.low
        self.bits = [int(m).bit_length() for m in shifted.max(axis=0)] if len(ids) else []
        self.slices = [[self._bitmap(shifted[:, d] >> b & 1) for b in range(n)] for d, n in enumerate(self.bits)]
        self.full = self._bitmap(np.ones(len(ids), np.int64))

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        packed = np.packbits(flags.astype(bool), bitorder="little")
        return np.pad(packed, (0, 8 * self.words - len(packed))).view(np.uint64)

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, exact scores) of all rows that can be among the best k."""
        columns: list[list[np.ndarray]] = []
        for d, q in enumerate(query[:len(self.bits)].tolist()):
            for p in range(abs(q).bit_length()):
                if abs(q) >> p & 1:
                    for b, s in enumerate(self.slices[d]):
                        while len(columns) <= p + b:
                            columns.append([])
                        columns[p + b].append(s if q > 0 else ~s)
        maybe, sure = self.full.copy(), np.zeros_like(self.full)
        own = np.flatnonzero(self.ids == query_id)
        for row in own:
            maybe[row // 64] &= ~np.uint64(1 << int(row) % 64)
        need = k
        for s in reversed(_sum(columns)):
            if s is None:
                continue
            ones = maybe & s
            n = int(np.bitwise_count(ones).sum())
            if n >= need:
                maybe = ones
            else:
                sure |= ones
                need -= n
                maybe &= ~s
        rows = np.flatnonzero(np.unpackbits((sure | maybe).view(np.uint8), bitorder="little"))
        width = min(len(query), self.values.shape[1])
        scores = self.values[rows, :width] @ query[:width]
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[best], scores[best]


def build_index(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of the index as a written table, and their number; a row holds
    the ids and integers of a block (slices are cut again when it is read:
    they take as much room)."""
    blocks = max(1, -(-vectors.count() // BLOCK))
    dealt = vectors.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf["v"].tolist())
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["vec_id"].to_numpy().tobytes()],
                             "width": [m.shape[1]], "ints": [m.astype("<i4").tobytes()]})

    return materialize(dealt.groupBy("block").applyInPandas(pack, "block int, ids binary, width int, ints binary"), "index"), blocks


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query, its
    own id excluded; both tables are (vec_id, v)."""
    index, blocks = build_index(vectors)
    parts = max(1, -(-queries.count() // QUERIES))
    asked = (queries.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
             .groupBy("part").agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def search(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                ids = np.frombuffer(one["ids"], np.int64)
                block = Block(ids, np.frombuffer(one["ints"], "<i4").reshape(len(ids), one["width"]).astype(np.int64))
                out: list[list] = [[], [], []]
                for q in one["q"]:
                    rows, scores = block.top(np.array(q["v"], np.int64), q["vec_id"], k)
                    out[0] += [q["vec_id"]] * len(rows)
                    out[1] += block.ids[rows].tolist()
                    out[2] += scores.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    found = asked.join(index, "block").select("q", "ids", "width", "ints").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
