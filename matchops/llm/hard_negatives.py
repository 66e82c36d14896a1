"""Hard negatives for anchors, for all of an anchor's positives in one search.

Every positive of an anchor has a window of scores its negatives must lie in.
The windows overlap, but their upper limits cut the scores into disjoint
slots: slot j holds the scores above the next lower limit up to limit j.  A
row belongs to one slot, so each search task keeps the best k rows of every
slot, and so does the combiner before and after the shuffle.  The best k rows
under limit i are then the first k of slots i, i+1, ... read downward (a
suffix of one descending list), and a window's lower limit only cuts their
tail.

Rows stand in blocks as matrices; anchors come in parts of about ``PART`` and
meet every block once.  First the meetings give each anchor's positives, then,
with the windows known, its negatives.  A block is followed by its parts in
one sorted stream, so nothing is joined or broadcast, and a task holds one
block and one part.  Blocks grow with the table (from ``BLOCK`` rows up to
``MOST`` components), as every block gets a copy of every part.

Contract: rows with a null id, label or vector, or with a null or non-finite
component take no part; shorter vectors count as padded with zeros;
components saturate at 2^26 in size, and sums must fit 64 bits.  Rows of the
anchor's own id are not "other" rows.  An id on several rows: each is a row of
its own, and each of them that is an anchor is mined for itself.  Ties go to the smaller id.
A window may be empty (always, where the positive's score is negative) and
then gives no row, like an anchor without a positive.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchops.llm.common import shuffle_width
from matchops.session import materialize

BLOCK, PART, SLICE, CHUNK, SOME = 4096, 512, 64, 4096, 8
BLOCKS, MOST, PENDING = 64, 1 << 22, 1 << 16
LARGEST = 1 << 26
#: Sums below these sizes are exact in the type beside.
EXACT = ((1 << 24, np.float32), (1 << 53, np.float64))
NONE = np.iinfo(np.int64).min


def quantised(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part, written once:
    ``row`` tells rows apart that have the same id, v holds 32-bit integers."""
    v = F.col(vector_col)
    if rows.select(v.alias("v")).dtypes[0][1] not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    used = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))

    def whole(batches):
        for batch in batches:
            v = batch.column("v")
            x = pc.fill_null(v.values, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
            cuts = v.offsets.to_numpy()
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])[cuts]
            with np.errstate(over="ignore", invalid="ignore"):
                ints = np.floor(np.clip(np.nan_to_num(x) * scale, -LARGEST, LARGEST)).astype("<i4")
            bytewise = pa.BinaryArray.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(4 * cuts), pa.py_buffer(ints)])
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "label")), bytewise], ["row", "vec_id", "label", "v"])
            yield out.filter(pa.array(bad[1:] == bad[:-1]))

    return materialize(used.mapInArrow(whole, "row long, vec_id long, label long, v binary"), "vectors")


def _matrix(lists: list[np.ndarray], kind: str, empty: int) -> np.ndarray:
    """The lists as rows of a matrix, filled up with ``empty``."""
    sizes = np.array([len(x) for x in lists], np.int64)
    out = np.full((len(sizes), int(sizes.max(initial=0))), empty, kind)
    if len(lists):
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(lists)
    return out


def _packed(rows: DataFrame, into: str, size: int, name: str, extra: str = "") -> tuple[DataFrame, int]:
    """Rows dealt by hash into groups of about ``size``, and the number of
    groups: one row a group, with its columns as arrays of bytes in ascending
    order of labels and ids.  ``extra`` names an array<long> column that is
    kept as a matrix."""
    groups = max(1, -(-rows.count() // size))
    columns = ["row", "vec_id", "label", "v", *([extra] if extra else [])]

    def pack(table: pa.Table) -> pa.Table:
        row, vec_id, label = (table[c].to_numpy() for c in ("row", "vec_id", "label"))
        order = np.lexsort((row, vec_id, label))
        ints = _matrix([np.frombuffer(v, "<i4") for v in table["v"].to_pylist()], "<i4", 0)[order]
        out = {into: table[into].combine_chunks()[:1], "width": pa.array([ints.shape[1]], pa.int32()), "ints": [ints.tobytes()]}
        out |= {f"{c}s": [x[order].astype("<i8").tobytes()] for c, x in (("row", row), ("vec_id", vec_id), ("label", label))}
        if extra:
            out[extra] = [_matrix([np.array(x, "<i8") for x in table[extra].to_pylist()], "<i8", NONE)[order].tobytes()]
        return pa.table(out)

    ddl = f"{into} long, width int, ints binary, rows binary, vec_ids binary, labels binary" + (f", {extra} binary" if extra else "")
    dealt = rows.select(*columns, F.pmod(F.xxhash64("row"), F.lit(groups)).alias(into))
    return materialize(dealt.groupBy(into).applyInArrow(pack, ddl), name), groups


def _blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """The blocks of a table: ``BLOCKS`` of them, or more where these would
    pass ``MOST`` components, or fewer where they would fall below ``BLOCK`` rows."""
    n, width = rows.agg(F.count("*"), F.max(F.length("v"))).first()
    return _packed(rows, "block", max(BLOCK, min(n // BLOCKS, MOST // max((width or 0) // 4, 1))), "blocks")


class Rows:
    """The rows of a block or part, in ascending order of labels and ids."""

    def __init__(self, packed: dict):
        self.rows, self.ids, self.labels = (np.frombuffer(packed[c], "<i8") for c in ("rows", "vec_ids", "labels"))
        self.values = np.frombuffer(packed["ints"], "<i4").reshape(len(self.ids), packed["width"])
        self.largest = int(np.abs(self.values).max(initial=0))
        self.extra = packed.get("limits") and np.frombuffer(packed["limits"], "<i8").reshape(len(self.ids), -1)
        self.kinds: dict[type, np.ndarray] = {}

    def of(self, kind: type) -> np.ndarray:
        if kind not in self.kinds:
            self.kinds[kind] = self.values.astype(kind)
        return self.kinds[kind]

    def groups(self) -> Iterator[tuple[int, int]]:
        """First and last position of every label."""
        cuts = np.flatnonzero(self.labels[1:] != self.labels[:-1]) + 1
        yield from zip([0, *cuts], [*cuts, len(self.labels)], strict=True)

    def span(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows of the labels stand."""
        return np.searchsorted(self.labels, labels, "left"), np.searchsorted(self.labels, labels, "right")


def slots_of(scores: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The slot of every score, below 0 above all limits; ``limits`` descend
    (a row for every score, or one for all), the last slot has no end."""
    return (scores[:, None] <= limits).sum(axis=1) - 1


def best_by_slot(scores: np.ndarray, limits: list[int] | np.ndarray, k: int, ids: np.ndarray | None = None,
                 anchors: np.ndarray | None = None) -> np.ndarray:
    """Positions of the best k scores of every slot of every anchor, smaller
    ids (without ids: smaller positions) first among equals, by anchor, slot
    and falling scores; ``limits`` as in ``slots_of``."""
    limits = np.atleast_2d(np.array(limits, np.int64))
    slots = slots_of(scores, limits)
    inside = np.flatnonzero(slots >= 0)
    group = slots[inside] + (0 if anchors is None else anchors[inside] * limits.shape[1])
    order = np.lexsort(((inside if ids is None else ids[inside]), -scores[inside], group))
    group = group[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[:len(group)])
    nth = np.arange(len(group)) - np.repeat(first, np.diff([*first, len(group)]))
    return inside[order[nth < k]]


class Asked:
    """What some anchors ask of a block: of each the best ``k`` scores of every
    slot that are ``least`` or more, without those of its ``barred`` positions."""

    def __init__(self, anchors: Rows, picked: slice, limits: np.ndarray, least: np.ndarray, barred: tuple[np.ndarray, np.ndarray], k: int):
        self.anchors, self.picked, self.limits, self.least, self.barred, self.k = anchors, picked, limits, least, barred, k
        self.last = (limits > NONE).sum(axis=1) - 1

    def _scores(self, own: np.ndarray, rows: np.ndarray, start: int, end: int, step: int, lowest: float) -> np.ndarray:
        """Scores with every ``step``-th row, those of barred positions ``lowest``."""
        scores = own @ rows[start:end:step].T
        from_, to = (np.clip(-((start - x) // step), 0, scores.shape[1]) for x in self.barred)
        for i in np.flatnonzero(from_ < to).tolist():
            scores[i, from_[i]:to[i]] = lowest
        return scores

    def best(self, block: Rows, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the anchor, slot, position, score) of those among the
        positions ``start`` to ``end``.  The lowest slot takes most scores: the
        ``k``-th of its scores with some of the rows is the least that can
        still count, so few of the others have to be put in order."""
        width = min(block.values.shape[1], self.anchors.values.shape[1])
        kind = next((t for limit, t in EXACT if width * block.largest * self.anchors.largest < limit), np.int64)
        own, rows = self.anchors.of(kind)[self.picked, :width], block.of(kind)[:, :width]
        lowest = NONE if kind is np.int64 else -np.inf
        floor, limit = self.least.astype(kind), self.limits[np.arange(len(own)), self.last].astype(kind)
        some = self._scores(own, rows, start, end, SOME, lowest)
        if (n := some.shape[1]) >= self.k:
            low = np.where(some <= limit[:, None], some, lowest)
            floor = np.maximum(floor, np.partition(low, n - self.k, axis=1)[:, n - self.k])
        pending, size = [np.zeros((3, 0), np.int64)], 0
        for at in range(start, end, CHUNK):
            scores = self._scores(own, rows, at, min(at + CHUNK, end), 1, lowest)
            found = np.flatnonzero(scores >= floor[:, None])
            anchor, position = np.divmod(found, scores.shape[1])
            pending.append(np.stack([anchor, position + at, scores.ravel()[found].astype(np.int64)]))
            size += len(found)
            if size > PENDING or at + CHUNK >= end:
                anchor, position, score = np.concatenate(pending, axis=1)
                kept = best_by_slot(score, self.limits[anchor], self.k, block.ids[position], anchor)
                anchor, position, score = pending[0] = np.stack([anchor, position, score])[:, kept]
                pending, size = pending[:1], 0
                low = slots_of(score, self.limits[anchor]) == self.last[anchor]
                counts = np.bincount(anchor[low], minlength=len(floor))
                full = counts == self.k
                floor[full] = score[low][np.cumsum(counts)[full] - 1]
        anchor, position, score = pending[0]
        return anchor + self.picked.start, slots_of(score, self.limits[anchor]), position, score


_FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _meetings(index: tuple[DataFrame, int], parts: DataFrame, choose: Callable[[Rows, Rows], Iterator[tuple]]) -> DataFrame:
    """Every part with every block: ``choose`` gives numbers of anchors, and
    the slots, positions and scores that they keep of a block."""
    blocks, n = index
    asked = (parts.repartition(shuffle_width(parts.sparkSession), "part")  # few files hold all parts, and each part is written n times
             .withColumn("block", F.explode(F.expr(f"sequence(0L, {n - 1}L)"))))
    lined = (asked.unionByName(blocks, allowMissingColumns=True)
             .repartition(n, "block").sortWithinPartitions("block", F.asc_nulls_first("part")))

    def search(batches):
        number = block = None
        for batch in batches:
            for at in range(batch.num_rows):
                one = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                if one["part"] is None:
                    number, block = one["block"], Rows(one)
                elif one["block"] == number:  # a number may have no rows
                    anchors = Rows(one)
                    for anchor, slot, position, score in choose(anchors, block):
                        columns = anchors.rows[anchor], slot, block.ids[position], score
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return lined.mapInArrow(search, "anchor long, slot int, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of every anchor's slot; tasks cut theirs before the shuffle."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def positives(index: tuple[DataFrame, int], anchors: DataFrame, n: int) -> DataFrame:
    """(anchor, nth, vec_id, score): the first ``n`` other rows of the anchor's label."""

    def choose(anchors, block):
        for first, end in anchors.groups():
            start, stop = (int(x) for x in block.span(anchors.labels[first]))
            for lo in range(first, end if start < stop else first, SLICE):
                own = slice(lo, min(lo + SLICE, end))
                barred = tuple(np.searchsorted(block.ids[start:stop], anchors.ids[own], side) + start for side in ("left", "right"))
                size = own.stop - lo
                yield Asked(anchors, own, np.full((size, 1), np.iinfo(np.int64).max), np.full(size, NONE + 1), barred, n).best(block, start, stop)

    return _best(_meetings(index, _packed(anchors, "part", PART, "anchors")[0], choose), n).drop("slot")


def mine(rows: DataFrame, anchors: Column, n_positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each anchor and positive the first ``k`` rows of
    another label whose score is ``low`` to ``high`` hundredths of the
    positive's.  ``rows`` comes from ``quantised``."""
    chosen = materialize(rows.where(anchors), "chosen")
    index = _blocks(rows)
    score = "CAST(score AS DECIMAL(20,0))"
    found = materialize(positives(index, chosen, n_positives).select(
        "anchor", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr(f"CAST(ceil({score} * {low} / 100) AS LONG)").alias("lower"),
        F.expr(f"CAST(floor({score} * {high} / 100) AS LONG)").alias("upper")).where("lower <= upper"), "positives")
    windows = found.groupBy("anchor").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("limits"), F.min("lower").alias("least"))
    # merge joins: a table's files are far smaller than its rows on the driver
    asking = chosen.join(windows.hint("merge"), chosen["row"] == windows["anchor"]).select(
        "row", "vec_id", "label", "v", F.concat(F.array("least"), "limits").alias("limits"))

    def choose(anchors, block):
        barred = block.span(anchors.labels)
        for lo in range(0, len(anchors.ids), SLICE):
            own = slice(lo, min(lo + SLICE, len(anchors.ids)))
            least, limits = anchors.extra[own, 0], anchors.extra[own, 1:]
            yield Asked(anchors, own, limits, least, tuple(x[own] for x in barred), k).best(block, 0, len(block.ids))

    slots = _best(_meetings(index, _packed(materialize(asking, "asking"), "part", PART, "windows", "limits")[0], choose), k)
    # every slot has k rows at most: one descending list an anchor, of which each window takes the first k
    lists = slots.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("below"), F.col("vec_id").alias("negative_id")))).alias("list"))
    inside = F.slice(F.filter("list", lambda x: (-x["below"] <= F.col("upper")) & (-x["below"] >= F.col("lower"))), 1, k)
    ids = chosen.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = found.join(lists.hint("merge"), "anchor").join(ids.hint("merge"), "anchor").select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("pos", "x"))
    return out.select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.negative_id", "positive_score",
                      (-F.col("x.below")).alias("negative_score"))
