"""Event-time views of the match table (J7, J8, J11, J12 batch forms).

The streaming plans in ``matchops.streaming`` use the same window and
season expressions with a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchops.config import Config, DEFAULT
from matchops.operators.numbering import ordered_row_number
from matchops.operators.ranking import rank_order
from matchops.operators.rules import rule_flags
from matchops.session import materialize

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# --- fixed values: region registry (alias -> canonical name) -----------
REGION_REGISTRY = (
    ("India", "India"),
    ("Sea", "SEA"),
    ("Europe", "Europe"),
    ("Us East", "US-East"),
    ("Us-East", "US-East"),
)


def minute_window(ts: str = "created_at", width: str = "1 minute") -> Column:
    return F.window(F.col(ts), width)


def window_seconds(w: str = "w") -> Column:
    """Length of a window, from its own bounds."""
    at = [F.col(f"{w}.{end}").cast("timestamp").cast("double") for end in ("end", "start")]
    return at[0] - at[1]


def ingest_rate(matches: DataFrame, width: str = "1 minute") -> DataFrame:
    """Matches per tumbling window and per second."""
    g = matches.groupBy(minute_window("created_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("matches"))
    return g.select(
        F.date_format(F.col("w.start"), TS_FORMAT).alias("window_start"),
        "matches",
        (F.col("matches") / window_seconds()).alias("matches_per_sec"),
    )


def flagged_per_minute(matches: DataFrame, cfg: Config = DEFAULT, width: str = "1 minute") -> DataFrame:
    """Matches with a rule alert, and distinct alerted players, per window."""
    flagged = matches.filter(F.size(rule_flags(cfg)) > 0)
    g = flagged.groupBy(minute_window("created_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("flagged_matches"),
        F.countDistinct("player_id").alias("flagged_players"),
    )
    return g.select(
        F.date_format(F.col("w.start"), TS_FORMAT).alias("window_start"),
        "flagged_matches", "flagged_players",
    )


def season_of(ts: Column, season_days: int) -> Column:
    """Season number: whole ``season_days`` blocks since 1970-01-01."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    return F.floor(days / F.lit(season_days)).cast("long")


def season_leaderboard(matches: DataFrame, flagged: DataFrame, cfg: Config = DEFAULT,
                       season_days: int = 7) -> DataFrame:
    """Totals and ranks restart every season; flagged stay unranked."""
    per = matches.withColumn("season", season_of(F.col("created_at"), season_days)).groupBy(
        "season", "player_id").agg(
        F.sum("score").alias("total_score"),
        F.sum("kills").cast("long").alias("total_kills"),
        F.sum("deaths").cast("long").alias("total_deaths"),
        F.count(F.lit(1)).alias("matches_played"),
    )
    marks = flagged.select("player_id", F.lit(True).alias("_f"))
    per = per.join(marks, "player_id", "left").withColumn(
        "status", F.when(F.col("_f"), F.lit("under_review")).otherwise(F.lit("clean"))).drop("_f")
    # The range sampler and the shuffle would each rescan the matches:
    # write the (season, player) table once.
    per = materialize(per, "season-totals")
    numbered = ordered_row_number(per, rank_order(), group_cols=["status", "season"], out="_pos")
    cols = ["season", "rank", "player_id", "total_score", "total_kills", "total_deaths",
            "matches_played", "status"]
    return numbered.withColumn(
        "rank", F.when(F.col("status") == "clean", F.col("_pos")).cast("long")).select(*cols)


def canonical_regions(spark: SparkSession, per_player: DataFrame,
                      registry=REGION_REGISTRY) -> DataFrame:
    """Map primary_region through a fixed alias registry.

    The registry is a fixed literal list, so broadcasting it is bounded by
    construction; unknown regions keep their own name.
    """
    reg = spark.createDataFrame(list(registry), "alias string, canonical string")
    return per_player.join(
        F.broadcast(reg), per_player["primary_region"] == reg["alias"], "left"
    ).select(
        "player_id", "primary_region",
        F.coalesce("canonical", "primary_region").alias("canonical_region"),
    )
