"""Exact row numbering over a total order without a single-partition step.

``row_number() OVER (ORDER BY …)`` with no PARTITION BY plans an
``Exchange SinglePartition``; with a PARTITION BY on a few huge groups
(regions, one hot lobby) the whole group lands in one task.  Here the
rows are range-partitioned on (group keys, order keys) — the sampler
splits a hot group across many partitions — sorted inside each
partition, stamped with (partition id, position) and written as a table
in the shared checkpoint folder, so the numbers are fixed facts.  A small
table with one row per (partition, group) piece then carries, for each
piece, the number of rows of the same group in earlier partitions; a
join adds it back.

Cost: one range shuffle, one table write, and a join against the
piece table (≤ groups + partitions rows; broadcast when there are no
group keys, since it then has at most one row per partition).
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchops.session import materialize

PART, SEQ, FIRST, CNT, CARRY, TOTAL = "_nb_part", "_nb_seq", "_nb_first", "_nb_cnt", "_nb_carry", "_nb_total"


def range_partitions(df: DataFrame, num_partitions: int | None = None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged_pieces(
    df: DataFrame,
    order: Sequence[Column],
    group_cols: Sequence[str] = (),
    num_partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The rows in range partitions, written as a table, and its pieces.

    A piece is what one partition holds of one group: ``CNT`` rows from
    ``FIRST`` on, after ``CARRY`` rows of the group in earlier partitions;
    ``TOTAL`` is the size of the group.
    """
    n = range_partitions(df, num_partitions)
    keys = [F.col(g).asc_nulls_first() for g in group_cols] + list(order)

    # Positions are stored as columns, so the sorted, numbered rows can be
    # written as a table: partition ids and offsets become fixed facts that
    # survive a lost executor, whatever partitioning the read-back has.
    ranged = materialize(
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(PART, F.spark_partition_id())
        .withColumn(SEQ, F.monotonically_increasing_id()),
        "numbering",
    )

    pieces = ranged.groupBy(PART, *group_cols).agg(
        F.count(F.lit(1)).alias(CNT), F.min(SEQ).alias(FIRST)
    )
    group = Window.partitionBy(*group_cols)
    earlier = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        PART, *group_cols, FIRST, CNT,
        F.coalesce(F.sum(CNT).over(earlier), F.lit(0)).alias(CARRY),
        F.sum(CNT).over(group).alias(TOTAL),
    )
    return ranged, pieces


def numbered(
    ranged: DataFrame,
    pieces: DataFrame,
    group_cols: Sequence[str] = (),
    out: str = "rn",
    extra: Sequence[str] = (),
) -> DataFrame:
    """The rows with their position ``out`` and the ``extra`` columns of their piece."""
    if not group_cols:
        # At most one row per range partition: a fixed, small bound.
        pieces = F.broadcast(pieces)
    p = pieces.alias("_p")
    r = ranged.alias("_r")
    cond = [F.col(f"_r.{PART}") == F.col(f"_p.{PART}")] + [
        F.col(f"_r.{g}").eqNullSafe(F.col(f"_p.{g}")) for g in group_cols
    ]
    joined = r.join(p, reduce(lambda a, b: a & b, cond), "inner")
    rn = (F.col(f"_r.{SEQ}") - F.col(f"_p.{FIRST}") + F.lit(1) + F.col(f"_p.{CARRY}"))
    cols = [F.col(f"_r.{c}") for c in ranged.columns if c not in (PART, SEQ)]
    return joined.select(*cols, *[F.col(f"_p.{c}") for c in extra], rn.cast("long").alias(out))


def ordered_row_number(
    df: DataFrame,
    order: Sequence[Column],
    group_cols: Sequence[str] = (),
    out: str = "rn",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = 1-based position of each row inside its group.

    ``order`` must make the order total (end it with a unique key);
    then the result equals ``row_number() OVER (PARTITION BY group_cols
    ORDER BY order)`` row for row.
    """
    ranged, pieces = ranged_pieces(df, order, group_cols, num_partitions)
    return numbered(ranged, pieces, group_cols, out)


def joined_text(
    items: DataFrame,
    group_cols: Sequence[str],
    pos_col: str,
    text_col: str,
    sep: str,
    segment: int,
    out: str,
    count: str | None = None,
    tie_col: str | None = None,
) -> DataFrame:
    """One row per group: ``text_col`` joined in the order of ``pos_col``.

    ``pos_col`` is a position inside the group (from ``ordered_row_number``;
    a group may begin anywhere).  Segments of ``segment`` positions are joined
    first, wherever they fall, then the texts of a group's segments in their
    order: no task holds a list of all items of a large group, only the text
    that its row has anyway.  ``count`` names a column for the group's items,
    ``tie_col`` orders items of one position.
    """
    cut = items.withColumn("_segment", F.floor((F.col(pos_col) - 1) / segment)).withColumn("_n", F.lit(1).cast("long"))
    order = F.struct(pos_col, *[c for c in [tie_col] if c])
    parts = _joined(cut, [*group_cols, "_segment"], order, F.col(text_col), sep, "_text")
    whole = _joined(parts, group_cols, F.col("_segment"), F.col("_text"), sep, out)
    return whole.withColumnRenamed("_n", count) if count else whole.drop("_n")


def _joined(items: DataFrame, keys: Sequence[str], order: Column, text: Column, sep: str, out: str) -> DataFrame:
    agg = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("p"), text.alias("t")))).alias("_items"),
                                   F.sum("_n").alias("_n"))
    return agg.select(*keys, F.array_join(F.transform("_items", lambda x: x["t"]), sep).alias(out), "_n")


def ordered_text(
    items: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    text_col: str,
    sep: str,
    segment: int,
    out: str,
) -> DataFrame:
    """Per group, ``text_col`` joined in ``order_cols`` order: numbered across
    tasks, so a hot group is split, and joined by segments."""
    numbered = ordered_row_number(items, [F.col(c).asc() for c in order_cols], group_cols, out="_pos")
    return joined_text(numbered, group_cols, "_pos", text_col, sep, segment, out)
