"""Leaderboards.

Clean players are numbered 1..N by (total_score desc, total_deaths asc,
total_kills desc, matches_played desc, player_id asc) with the
range-partitioned numbering — no single-partition window; flagged
players keep their numbers and a NULL rank under ``under_review``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchops.config import DEFAULT
from matchops.functions.text import strip_ws, title_case
from matchops.operators.numbering import ordered_row_number
from matchops.operators.players import player_totals

BOARD_COLUMNS = (
    "rank", "player_id", "total_score", "total_kills", "total_deaths",
    "matches_played", "primary_region", "avg_score_per_match", "status",
)


def rank_order():
    return [
        F.col("total_score").desc(), F.col("total_deaths").asc(),
        F.col("total_kills").desc(), F.col("matches_played").desc(),
        F.col("player_id").asc(),
    ]


def board_input(profile: DataFrame, flagged: DataFrame) -> DataFrame:
    """Totals + status from ONE left join (serves both F1 and F2)."""
    marks = flagged.select("player_id", F.lit(True).alias("_flagged"))
    return player_totals(profile).join(marks, "player_id", "left").select(
        *player_totals(profile).columns,
        F.when(F.col("_flagged"), F.lit("under_review")).otherwise(F.lit("clean")).alias("status"),
    )


def _board(players: DataFrame, group_cols=()) -> DataFrame:
    """One numbering over every player, grouped by status: clean players
    get their position as rank, under-review players a NULL rank."""
    numbered = ordered_row_number(players, rank_order(), group_cols=["status", *group_cols], out="_pos")
    return numbered.withColumn(
        "rank", F.when(F.col("status") == "clean", F.col("_pos")).cast("long")
    ).select(*BOARD_COLUMNS)


def leaderboard_global(profile: DataFrame, flagged: DataFrame) -> DataFrame:
    return _board(board_input(profile, flagged))


def leaderboard_region(profile: DataFrame, flagged: DataFrame, region: str | None = None) -> DataFrame:
    """Rank restarts per primary_region.  With ``region`` (V3) the argument
    is trimmed and title-cased, and the filter runs before the numbering:
    a regional rank depends only on that region's players."""
    players = board_input(profile, flagged)
    if region is not None:
        wanted = title_case(strip_ws(F.lit(region)))
        players = players.filter(F.col("primary_region") == wanted)
    return _board(players, group_cols=["primary_region"])


def order_global(board: DataFrame) -> DataFrame:
    return board.orderBy(
        F.col("rank").asc_nulls_last(), *rank_order())


def order_region(board: DataFrame) -> DataFrame:
    """Region, rank (nulls last), total_score desc, remaining keys."""
    return board.orderBy(F.col("primary_region"), F.col("rank").asc_nulls_last(), *rank_order())


def top_k(profile: DataFrame, flagged: DataFrame, k: int = DEFAULT.top_k) -> DataFrame:
    """The first k rows of the global board without ranking everyone.

    ORDER BY … LIMIT k plans TakeOrderedAndProject (a per-partition top-k
    then a k-row merge); clean rows sort first, so their position is
    their rank.
    """
    players = board_input(profile, flagged)
    status_ord = F.when(F.col("status") == "clean", 0).otherwise(1)
    head = players.withColumn("_s", status_ord).orderBy(F.col("_s"), *rank_order()).limit(k)
    pos = F.row_number().over(Window.orderBy(F.col("_s"), *rank_order()))  # k rows only
    return head.withColumn(
        "rank", F.when(F.col("status") == "clean", pos).cast("long")
    ).select(*BOARD_COLUMNS)


def player_search(board: DataFrame, query: str) -> DataFrame:
    """V1: case-insensitive substring match on player_id."""
    q = F.lower(strip_ws(F.lit(query)))
    return board.filter(F.lower(F.col("player_id")).contains(q))
