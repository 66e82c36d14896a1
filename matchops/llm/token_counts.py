"""Token counts without token ids.

Each task cuts its documents into pre-tokens and keeps, for every distinct
pre-token of a block of documents, in which of them it occurs and how often
(its postings).  Pre-tokens that are vocabulary entries count one piece at
once.  The others are dealt out by their hash, so that all blocks' postings
of one pre-token meet in one task: there its pieces are counted once, and
the sums for each document go back to the document's block.

A frequent pre-token has one row of postings for each block, not for each
document; ids are never made.  Special strings are one piece each.

Contract: null and empty texts have 0 tokens and 0 bytes; repeated rows are
counted alike; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from matchops.llm.bpe import Splitter
from matchops.llm.common import shuffle_width, slices, texts
from matchops.llm.tokens import chunks, ranks_of_json

BLOCK_ROWS, BLOCK_BYTES = 3072, 12 << 20  # of texts; places in a block are 16-bit numbers


class Cutter:
    """Pre-tokens of texts; those in the vocabulary need no further count."""

    def __init__(self, path: str):
        from public_tokenizers import PATTERN

        ranks, self.special = ranks_of_json(path)
        self.single = set()
        for w in ranks:
            try:
                self.single.add(w.decode())
            except UnicodeDecodeError:  # part of a character: never a pre-token of its own
                pass
        self.split = Splitter(PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def pieces(self, chunk: str) -> tuple[int, list[str]]:
        """(pieces that are sure, pre-tokens still to be counted)."""
        found = self.split(chunk)
        rest = [p for p in found if p not in self.single]
        return len(found) - len(rest), rest


@lru_cache(maxsize=2)
def cutter(path: str) -> Cutter:
    return Cutter(path)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _postings(part: pa.RecordBatch, path: str, buckets: int, block: int) -> list[dict]:
    """Rows of one block: postings by bucket, and a row with what is known of the documents."""
    c = cutter(path)
    docs = part.column("text").to_pylist()
    code: dict[str, int] = {}
    doc_of, codes = [], []
    sure = np.zeros(len(docs), np.int64)
    for d, text in enumerate(docs):
        spans = [text] if c.cut is None else c.cut.split(text)
        for span in spans:
            if span in c.special:
                sure[d] += 1
            elif span:
                head, *rest = chunks(span)
                found = [code.setdefault(" " + r, len(code)) for r in rest]
                if head:
                    found.append(code.setdefault(head, len(code)))
                codes.append(np.array(found, np.int64))
                doc_of.append(np.full(len(found), d, np.int64))
    rows = [{"block": block, "bucket": block % buckets, "doc_id": part.column("doc_id").to_pylist(),
             "n_bytes": [len(t.encode()) for t in docs], "sure": None, "pre": None, "stop": None, "doc": None, "n": None}]
    if codes:
        # frequencies of chunks in documents, then of the pre-tokens that the chunks hold
        pair, n = np.unique(np.concatenate(codes) * len(docs) + np.concatenate(doc_of), return_counts=True)
        chunk, doc = pair // len(docs), pair % len(docs)
        number: dict[str, int] = {}
        known, starts, inner = [], [0], []
        for text in code:
            one, rest = c.pieces(text)
            known.append(one)
            inner += [number.setdefault(p, len(number)) for p in rest]
            starts.append(len(inner))
        np.add.at(sure, doc, np.array(known)[chunk] * n)
        starts, inner = np.array(starts), np.array(inner, np.int64)
        many = (starts[1:] - starts[:-1])[chunk]
        first = np.repeat(starts[chunk], many)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pre, doc, n = inner[first + step] if len(first) else inner[:0], np.repeat(doc, many), np.repeat(n, many)
        bucket = np.array([crc32(p.encode()) % buckets for p in number], np.int64)
        key = (bucket[pre] * max(len(number), 1) + pre) * len(docs) + doc
        key, back = np.unique(key, return_inverse=True)
        n = np.bincount(back, weights=n, minlength=len(key)).astype(np.int64)
        pre, doc = key // len(docs) % max(len(number), 1), key % len(docs)
        names = list(number)
        edge = np.flatnonzero(np.r_[True, pre[1:] != pre[:-1], True]) if len(pre) else np.zeros(1, np.int64)
        own = bucket[pre[edge[:-1]]]
        for b in np.unique(own).tolist():
            at = np.flatnonzero(own == b)
            lo, hi = edge[at[0]], edge[at[-1] + 1]
            rows.append({"block": block, "bucket": b, "pre": [names[i] for i in pre[edge[at]]], "stop": (edge[at + 1] - lo).astype(np.int32),
                         "doc": doc[lo:hi].astype(np.int16), "n": n[lo:hi].astype(np.int32)})
    rows[0]["sure"] = sure.tolist()
    return rows


_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())),
                     ("sure", pa.list_(pa.int64())), ("pre", pa.list_(pa.string())), ("stop", pa.list_(pa.int32())),
                     ("doc", pa.list_(pa.int16())), ("n", pa.list_(pa.int32()))])
_DDL = ("block long, bucket int, doc_id array<long>, n_bytes array<long>, sure array<long>, "
        "pre array<string>, stop array<int>, doc array<short>, n array<int>")


def count(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``."""
    buckets = 2 * shuffle_width(docs.sparkSession)

    def cut(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for i, part in enumerate(slices(batches, BLOCK_ROWS, BLOCK_BYTES)):
            rows = _postings(part, path, buckets, first + i)
            for lo in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[lo:lo + 64], schema=_SCHEMA)

    def add(batches):
        known: dict[str, int] = {}
        encode = tokenizer(path).encode_batch_fast
        for batch in batches:
            for row in range(batch.num_rows):
                col = {n: batch.column(n)[row] for n in ("block", "doc_id", "n_bytes", "sure", "pre", "stop", "doc", "n")}
                if not col["pre"].is_valid:  # what is known of a block's documents passes through
                    out = {n: col[n].as_py() for n in ("block", "doc_id", "n_bytes")}
                    out |= {"doc": range(len(out["doc_id"])), "pieces": col["sure"].as_py()}
                    yield pa.RecordBatch.from_pylist([out], schema=sums)
                    continue
                pre = col["pre"].as_py()
                if len(known) > 500_000:
                    known.clear()
                new = [p for p in pre if p not in known]
                for lo in range(0, len(new), 4096):
                    part = new[lo:lo + 4096]
                    known.update((p, len(e)) for p, e in zip(part, encode(part, add_special_tokens=False), strict=True))
                stop = col["stop"].values.to_numpy()
                pieces = np.repeat(np.array([known[p] for p in pre], np.int64), np.diff(stop, prepend=0))
                total = np.bincount(col["doc"].values.to_numpy(), weights=pieces * col["n"].values.to_numpy()).astype(np.int64)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pylist([{"block": col["block"].as_py(), "doc": at, "pieces": total[at]}], schema=sums)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["doc_id"].notna()].iloc[0]
        tokens = np.zeros(len(head["doc_id"]), np.int64)
        for doc, pieces in zip(pdf["doc"], pdf["pieces"], strict=True):
            tokens[doc] += pieces
        return pd.DataFrame({"doc_id": pd.array(head["doc_id"], "Int64"), "n_bytes": head["n_bytes"], "n_tokens": tokens})

    sums = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())),
                      ("doc", pa.list_(pa.int16())), ("pieces", pa.list_(pa.int64()))])
    posted = texts(docs).mapInArrow(cut, _DDL).repartition(buckets, "bucket")
    parts = posted.mapInArrow(add, "block long, doc_id array<long>, n_bytes array<long>, doc array<short>, pieces array<long>")
    return parts.groupBy("block").applyInPandas(total, "doc_id long, n_bytes long, n_tokens long")
