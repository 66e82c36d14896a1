"""Shards of near-equal bytes by sampled splitters, in DataFrame operations only.

Rows are ordered by (text_crc32, doc_id), so equal texts lie side by side.
A sample in which a row's chance grows with its size gives quantile
boundaries of that order; they cut the rows into many ranges of similar
bytes.  A range that turns out overfull is cut again by a denser sample of
its own rows; as the boundaries hold the id, this also divides a text that
very many rows share.  Running sums inside the ranges and over the ranges'
totals then give each row its exact place, and 16 equal stretches of the
byte axis are the shards.

Contract: a null text has size 1 (no bytes plus 1) and the crc of an empty
text; a null id sorts first; rows with equal id and text are placed next to
each other in any order; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchops.llm.common import shuffle_width
from matchops.session import materialize

RANGE_BYTES = 8 << 20
PER_RANGE = 16  # sampled rows to a range, on average
FULL = 2  # times the mean bytes of a range
MOST_RANGES = 1 << 16  # ranges grow beyond this many; each still holds a small part of the ids


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def _splitters(rows: DataFrame, picks: int, total: int) -> list[tuple[int, int | None]]:
    """About ``picks`` keys; a row is drawn with a chance in proportion to its size."""
    draw = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    chance = F.col("size") * F.lit(picks / max(total, 1))
    drawn = rows.where(draw < chance).select("text_crc32", "doc_id", F.greatest(chance, F.lit(1.0)).alias("w")).collect()
    drawn.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
    reached = list(accumulate(r[2] for r in drawn))
    out, step = [], PER_RANGE
    for (crc, doc_id, _), before, after in zip(drawn, [0.0, *reached], reached, strict=False):
        if before // step != after // step:
            out.append((crc, doc_id))
    return out


def _range_of(splitters: list[tuple[int, int | None]]) -> Column:
    """How many splitters lie at or before a row, by binary search."""
    if not splitters:
        return F.lit(0)
    keys = F.array(*(F.struct(F.lit(c).cast("long").alias("text_crc32"), F.lit(i).cast("long").alias("doc_id")) for c, i in splitters))
    own = F.struct("text_crc32", "doc_id")
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        (at + step <= len(splitters)) & (F.element_at(keys, F.least(at + step, F.lit(len(splitters)))) <= own), at + step).otherwise(at))


def shard_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    base = materialize(sized(docs), "sizes")
    total = base.agg(F.sum("size")).first()[0] or 0
    ranges = min(max(total // RANGE_BYTES, 4 * shuffle_width(docs.sparkSession), 16 * shards), MOST_RANGES)
    splitters = _splitters(base, PER_RANGE * ranges, total)
    sums = base.groupBy(_range_of(splitters).alias("r")).agg(F.sum("size").alias("bytes"))
    over = [r[0] for r in sums.where(F.col("bytes") > FULL * total / ranges).collect()]  # at most ranges / FULL
    if over:
        crowded = base.where(_range_of(splitters).isin(over))
        finer = _splitters(crowded, 4 * PER_RANGE * ranges, total)
        splitters = sorted({*splitters, *finer}, key=lambda s: (s[0], s[1] is not None, s[1]))
    rows = materialize(base.withColumn("r", _range_of(splitters)), "ranges")
    earlier = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    totals = rows.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    totals = totals.select("r", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("r").orderBy("text_crc32", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("bytes_before") + F.sum("size").over(inside) - F.col("size") / 2
    placed = materialize(rows.join(totals, "r").select(
        "doc_id", "size", "text_crc32",
        F.least(F.floor(middle * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.count("*").over(inside)).alias("place")), "places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The documents as files, one folder for each shard, rows in slot order."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.withColumn("text_crc32", F.crc32(text))
    (keyed.join(placed.select("doc_id", "text_crc32", "shard", "slot").dropDuplicates(["doc_id", "text_crc32"]), ["doc_id", "text_crc32"])
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
