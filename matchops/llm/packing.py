"""Best-fit-decreasing packing of documents into fixed windows.

A document's ids (and an end id) are cut into full windows and one
remainder.  Remainders are dealt evenly into groups of bounded size; each
group places them longest first, every one into the tightest open window
that still holds it.  A segment tree over remaining capacities finds that
window in logarithmic time.

Contract: a null text is an empty document of one id; repeated rows are
packed once each; an empty table gives an empty result; other columns are
not read.  Ties between equal lengths go by (doc_id, start).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchops.llm.common import map_texts, texts
from matchops.llm.tokens import json_tokenizer
from matchops.session import materialize

WINDOW = 2048
GROUP = 2048  # pieces that one task packs together, on average
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class OpenWindows:
    """Open windows by remaining capacity; the tree's inner nodes count the
    windows below them, so the least capacity >= need is found by descent."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, capacity: int, change: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, capacity: int, name: int) -> None:
        self.at[capacity].append(name)
        self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, name) of a window taken out, or None."""
        node = need + self.size
        while not self.count[node]:
            while node & 1:  # a right child: go up until there is a sibling to the right
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit(lengths: Iterable[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) of each length, which come longest first."""
    open_windows, made, out = OpenWindows(window), 0, []
    for n in lengths:
        found = open_windows.tightest(n)
        if found is None:
            found = window, made
            made += 1
        capacity, name = found
        out.append((name, window - capacity))
        if capacity > n:
            open_windows.put(capacity - n, name)
    return out


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Full windows and the remainder of every document, optionally with ids."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    last = np.array([end_id], "<u4").tobytes()

    def run(part: pa.RecordBatch) -> dict:
        cols: dict[str, list] = {f.name: [] for f in schema}
        for doc_id, ids in zip(part.column("doc_id").to_pylist(), json_tokenizer(path).ids(part.column("text").to_pylist()), strict=True):
            ids += last
            n = len(ids) // 4
            for start in range(0, n, window):
                cut = ids[4 * start:4 * (start + window)]
                for name, value in zip(cols, (doc_id, start, len(cut) // 4, zlib.crc32(cut), n), strict=False):
                    cols[name].append(value)
                if with_ids:
                    cols["ids"].append(np.frombuffer(cut, "<i4"))
        return cols

    return map_texts(texts(docs), run, schema, PIECES + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces with their place: sequence_id and offset.

    sequence_id is the group number times 2^32 plus the window's number in
    its group, so that no step needs all windows in one place."""
    cut = materialize(pieces(docs, path, window, end_id, with_ids), "pieces")
    groups = max(1, -(-cut.count() // GROUP))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        spots = best_fit(pdf["length"].tolist(), window)
        base = int(pdf["_group"].iloc[0]) << 32
        return pdf.drop(columns="_group").assign(sequence_id=[base + w for w, _ in spots], offset=[o for _, o in spots])

    return dealt.groupBy("_group").applyInPandas(
        place, PIECES + ", ids array<int>" * with_ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts of documents' pieces) from ``pack(with_ids=True)``;
    a group here is at most one window of ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
                    F.transform("p", lambda x: x["offset"]).alias("starts"),
                    F.transform("p", lambda x: x["doc_id"]).alias("doc_ids")))
