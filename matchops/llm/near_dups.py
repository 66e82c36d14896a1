"""Near-duplicate documents: MinHash signatures in an LSH forest.

1. Every text becomes its set of word shingles; texts with equal sets form
   a class, and one signature row per class goes on.
2. The signature is cut into labels, one for each tree.  A tree is the
   classes sorted by its label, range-partitioned so that a crowded region
   spreads over tasks.  Rows that share at least ``MIN_DEPTH`` leading label
   values form a region; a region with more than ``REGION`` rows is divided
   at the next value, and so on down the label: dense regions are compared
   at a greater depth.  Neighbours on both sides of a division, and the
   ``REACH`` predecessors in a region that the whole label cannot divide,
   remain candidates.  A region that a range boundary cuts is put together
   again by its label values.
3. Inside a region, sketches of the signatures rate the pairs.  Surely
   similar pairs are thinned to a spanning forest (they connect the same
   rows); every possible pair between different trees of that forest stays.
4. Candidates are confirmed on the full shingle sets, and confirmed links
   make components.
5. Rows of crowded regions that are not in one component by then are joined
   exactly: a similar pair shares one of the rarest shingles of both sets,
   early enough to reach the threshold.  So every pair that shares a region
   is compared or already connected, whatever the size of the region.

Contract: null and empty texts, and texts of white space, have an empty
set and no links; fewer words than a shingle count as one shingle; repeated
rows and copies share a class and a component; a null id never becomes a
component unless its class has no other.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchops.llm.common import map_texts, shuffle_width, texts
from matchops.llm.components import components
from matchops.session import materialize

TREES, DEPTH = 16, 8  # labels of DEPTH values
MIN_DEPTH = 4
REGION = 32
RANGE = 50_000  # rows of a tree that a task walks, about
REACH = 8
SURE, POSSIBLE = 0.14, -0.2  # sketch similarity against the threshold
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = text.encode().lower().split()  # bytes: A-Z only, and splits at 0x20 and 0x09-0x0D only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    out = h[:len(h) - width + 1].copy()
    for i in range(1, width):
        out *= _PRIME
        out ^= out >> np.uint64(29)
        out += h[i:len(h) - width + 1 + i]
    out ^= out >> np.uint64(32)
    out *= _PRIME
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(low), 2048):
        np.minimum(out, (low[lo:lo + 2048, None] * a + b).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, label of each tree, sketch); h1 and h2 name the set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
                        ("labels", pa.list_(pa.binary())), ("sketch", pa.binary())])

    def run(part: pa.RecordBatch) -> dict:
        a, b = _coefficients(TREES * DEPTH)
        cols: dict[str, list] = {n: [] for n in schema.names}
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            s = shingle_set(text, words)
            name = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
            sig = signature(s, a, b)
            nibbles = (sig & np.uint32(15)).astype(np.uint8)
            row = (doc_id, len(s), name[0], name[1], [x.tobytes() for x in sig.reshape(TREES, DEPTH)],
                   (nibbles[::2] << 4 | nibbles[1::2]).tobytes())
            for col, value in zip(cols.values(), row, strict=True):
                col.append(value)
        return cols

    return map_texts(texts(docs), run, schema,
                     "doc_id long, n_shingles long, h1 long, h2 long, labels array<binary>, sketch binary")


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


class _Region:
    """Candidate pairs among rows that share a label prefix."""

    def __init__(self, threshold: float):
        self.sure, self.possible, self.threshold = threshold + SURE, threshold + POSSIBLE, threshold

    def pairs(self, reps: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[int, int]]:
        nibbles = np.concatenate([sketches >> 4, sketches & 15], axis=1)
        todo = [(0, len(sizes), MIN_DEPTH)]
        # in a crowded region most rows meet the one with the least id, the same in many trees
        every = np.arange(len(sizes) if len(sizes) > REGION else 0)
        left: list[np.ndarray] = [np.full(len(every), np.argmin(reps))]
        right: list[np.ndarray] = [every]
        while todo:
            lo, hi, depth = todo.pop()
            n = hi - lo
            if n <= REGION:
                i, j = np.triu_indices(n, 1)
            elif depth < DEPTH:
                cuts = (np.flatnonzero(np.diff(labels[lo:hi, depth])) + 1 + lo).tolist()
                todo += zip([lo, *cuts], [*cuts, hi], [depth + 1] * (len(cuts) + 1), strict=True)
                i, j = np.array(cuts, int) - 1 - lo, np.array(cuts, int) - lo
            else:
                back = np.arange(1, REACH + 1)
                j = np.repeat(np.arange(n), REACH)
                i = j - np.tile(back, n)
                i, j = np.r_[i[i >= 0], np.zeros(n - 1, int)], np.r_[j[i >= 0], np.arange(1, n)]
            left.append(i + lo)
            right.append(j + lo)
        i, j = np.concatenate(left), np.concatenate(right)
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        keep = (small >= self.threshold * large - 1e-9) & (i != j)
        i, j = i[keep], j[keep]
        alike = np.concatenate([(nibbles[i[k:k + 4096]] == nibbles[j[k:k + 4096]]).mean(axis=1) for k in range(0, len(i), 4096)] or [np.zeros(0)])
        alike = (alike - 1 / 16) * 16 / 15
        parent = list(range(len(sizes)))
        hub = len(sizes) > REGION
        central = (i == np.argmin(reps)) & (alike >= self.sure) if hub else np.zeros(len(i), bool)
        for k in np.lexsort((-alike, ~central)):
            if alike[k] < self.possible:
                break
            p, q = _find(parent, i[k]), _find(parent, j[k])
            if p != q:
                yield int(i[k]), int(j[k])
                if alike[k] >= self.sure:
                    parent[max(p, q)] = min(p, q)


def candidates(classes: DataFrame, threshold: float, about: int = 0) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b), a < b, of class representatives that may be similar,
    and the (id) of those in regions of more than ``REGION`` rows.  ``about``:
    how many classes there are at most."""
    rows = classes.select("rep", "n_shingles", "sketch", F.posexplode("labels").alias("tree", "label"))
    order = ["tree", "label", "spread"]
    rows = rows.withColumn("spread", F.xxhash64("rep", "tree"))
    ranges = max(shuffle_width(classes.sparkSession), -(-TREES * about // RANGE))
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("region", pa.binary()), ("n_shingles", pa.int64())])

    def walk(batches):
        held: list[np.ndarray] = []
        first = True  # no region of the partition is closed yet

        def close(part, last=False):
            """Batches of rows (a, b): a pair; (a, a): a row of a crowded region; (a or null, null, region):
            a row, or more than ``REGION`` rows, of a region that may go on in the next partition."""
            nonlocal first
            reps, sizes, labels, sketches = part
            change = np.flatnonzero((labels[1:, :MIN_DEPTH + 1] != labels[:-1, :MIN_DEPTH + 1]).any(axis=1)) + 1
            pairs, edge, many = [], [], []
            for lo, hi in zip([0, *change], [*change, len(reps)], strict=True):
                own = reps[lo:hi]
                crowded = hi - lo > REGION
                if first or last:
                    name = labels[lo, :MIN_DEPTH + 1].tobytes()
                    edge += [(None, None, name, None)] if crowded else [(r, None, name, n) for r, n in zip(own, sizes[lo:hi], strict=True)]
                    first = False
                if hi - lo > 1:
                    found = np.array(list(region.pairs(own, sizes[lo:hi], labels[lo:hi, 1:], sketches[lo:hi])), np.int64).reshape(-1, 2)
                    pairs.append(np.sort(own[found], axis=1))
                if crowded:
                    many.append(np.stack([own, own], axis=1))
            if edge:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*edge, strict=True), schema, strict=True)], schema=schema)
            if pairs or many:
                a, b = np.unique(np.concatenate(pairs + many), axis=0).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int64())], schema=schema)

        region = _Region(threshold)
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.int32).reshape(-1, DEPTH)
            labels = np.concatenate([batch.column("tree").to_numpy()[:, None], values], axis=1)
            sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            part = [batch.column("rep").to_numpy(), batch.column("n_shingles").to_numpy(), labels, sketches]
            if held:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            same = (part[2][:, :MIN_DEPTH + 1] == part[2][-1, :MIN_DEPTH + 1]).all(axis=1)
            open_from = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [x[open_from:] for x in part]
            if open_from:
                yield from close([x[:open_from] for x in part])
        if held:
            yield from close(held, last=True)

    found = materialize(rows.mapInArrow(walk, "a long, b long, region binary, n_shingles long"), "found")
    edge = found.where("region is not null")
    whole = edge.groupBy("region").agg((F.max(F.col("a").isNull()) | (F.count("*") > REGION)).alias("crowded"))
    edge = edge.where("a is not null").join(whole, "region")
    few = edge.where("not crowded").select("region", "a", "n_shingles")
    other = few.select("region", F.col("a").alias("b"), F.col("n_shingles").alias("n"))
    across = few.join(other, "region").where((F.col("a") < F.col("b")) & (
        F.least("n", "n_shingles") >= threshold * F.greatest("n", "n_shingles") - 1e-9))
    pairs = found.where("a < b").select("a", "b").union(across.select("a", "b")).distinct()
    crowded = found.where("a = b").select(F.col("a").alias("id")).union(edge.where("crowded").select("a")).distinct()
    return pairs, crowded


BITS = 1 << 23


def _wanted(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (1 MB) that holds the hashed ids."""
    ids = ids.select(F.pmod(F.xxhash64("id"), F.lit(BITS)).alias("s"))
    words = ids.groupBy((F.col("s") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("v"))
    out = np.zeros(BITS // 32, np.uint32)
    for w, v in words.collect():
        out[w] = v
    return out


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids``.

    Sets are made again only for documents that the bitmap lets through; it
    may let through others (they meet no pair in the joins), never too few."""
    bits = docs.sparkSession.sparkContext.broadcast(_wanted(ids))
    slim = texts(docs).withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)))
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(part: pa.RecordBatch) -> dict:
        slot = part.column("slot").to_numpy()
        chosen = np.flatnonzero(bits.value[slot // 32] >> (slot % 32).astype(np.uint32) & 1)
        ids, text = part.column("doc_id"), part.column("text")
        return {"id": ids.take(pa.array(chosen)), "shingles": [shingle_set(text[i].as_py(), words).view(np.int64) for i in chosen.tolist()]}

    return materialize(map_texts(slim, run, schema, "id long, shingles array<long>").dropDuplicates(["id"]), "sets")


def confirm(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    per_cent = round(100 * threshold)
    return both.select("a", "b", shared.alias("shared"), F.size("of_a").alias("na"), F.size("of_b").alias("nb")).where(
        100 * F.col("shared") >= per_cent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


SLOTS = 1 << 22


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each slot (fixed size, 16 MB); 1 says
    that a shingle is in one set only."""
    schema = pa.schema([("slot", pa.int64()), ("n", pa.int64())])

    def add(batches):
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("shingles").flatten().to_numpy() & (SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 1 << 16):
            some = at[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], schema=schema)

    many = sets.mapInArrow(add, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    out = np.ones(SLOTS, np.int32)
    out[many.column("slot").to_numpy()] = np.minimum(many.column("n").to_numpy(), np.iinfo(np.int32).max)
    return out


def rare_pairs(sets: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b), a < b, from ``rows(id, label)``: every pair of rows
    with different labels whose sets reach the threshold, and some others.

    Shingles are ordered by frequency, rarest first.  If the first one that
    two sets share has p and q others before it, they share at most
    min(na - p, nb - q); pairs for which that is too little are left out.  Only
    the shingles from which the threshold can still be reached are shuffled."""
    often = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))
    per_cent = round(100 * threshold)
    posting = pa.schema([("shingle", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("left", pa.int64())])

    def prefixes(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, (id_, label) in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                s = batch.column("shingles")[i].values.to_numpy()
                n, f = len(s), often.value[s & (SLOTS - 1)]
                order = np.lexsort((s, f))[:n - -(-per_cent * n // 100) + 1]
                at = np.flatnonzero(f[order] > 1)
                for col, value in zip(out, (s[order[at]], np.full(len(at), id_), np.full(len(at), label), np.full(len(at), n), n - at), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or [np.zeros(0, np.int64)]), pa.int64()) for c in out], schema=posting)

    def meet(batches):
        for batch in batches:
            rows = batch.column("rows")
            size = pc.list_value_length(rows).to_numpy()
            id_, label, n, left = (x.to_numpy(zero_copy_only=False) for x in rows.flatten().flatten())
            after = np.repeat(np.cumsum(size), size) - np.arange(size.sum()) - 1  # rows behind this one with the same shingle
            i, step, kept, held = np.flatnonzero(after), 1, [], 0
            while len(i):
                j = i + step
                at = np.flatnonzero((label[i] != label[j]) & ((100 + per_cent) * np.minimum(left[i], left[j]) >= per_cent * (n[i] + n[j])))
                if len(at):
                    x, y = id_[i[at]], id_[j[at]]
                    kept.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
                    held += len(at)
                step += 1
                i = i[after[i] >= step]
                if kept and (held > 1 << 18 or not len(i)):
                    a, b = np.unique(np.concatenate(kept), axis=0).T
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    kept, held = [], 0

    postings = sets.join(rows, "id").select("id", "label", "shingles").mapInArrow(
        prefixes, "shingle long, id long, label long, n long, left long")
    shared = postings.groupBy("shingle").agg(F.collect_list(F.struct("id", "label", "n", "left")).alias("rows"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return shared.where("lo < hi").select("rows").mapInArrow(meet, "a long, b long").distinct()


def _labels(docs: DataFrame, classes: DataFrame, words: int, threshold: float, about: int) -> DataFrame:
    """(node, label) of the linked class representatives."""
    pairs, crowded = (materialize(x, n) for x, n in zip(candidates(classes, threshold, about), ("pairs", "crowded"), strict=True))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(crowded)
    sets = full_sets(docs, ids, words)
    label = components(confirm(sets, pairs, threshold))
    if crowded.isEmpty():
        return label
    rows = crowded.join(label.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    rows = materialize(rows, "crowded")
    links = confirm(sets, materialize(rare_pairs(sets, rows, threshold), "pairs"), threshold)
    for end in ("a", "b"):  # links between components
        links = links.join(rows.select(F.col("id").alias(end), F.col("label").alias(f"of_{end}")), end)
    of = components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    # a row without links so far is a component of its own
    every = label.union(rows.select("id", "label")).distinct()
    return every.join(of.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left").select(
        "node", F.coalesce("further", "label").alias("label"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    every = materialize(signatures(docs, words), "signatures")
    filled = every.where("n_shingles > 0")
    classes = filled.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
        F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
    label = _labels(docs, classes.where("rep is not null"), words, threshold, every.count()).select(F.col("node").alias("rep"), "label")
    named = (filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")).join(label, "rep", "left")
             .select("h1", "h2", F.coalesce("label", "rep").alias("component_id")))
    out = (filled.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"])
           .select("doc_id", "n_shingles", "component_id")
           .union(every.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
