"""Player-level aggregates (E1–E4, D1) in one grouped aggregate.

Totals, averages, moments and the two modes all key on player_id, so a
single partial+final aggregate (one shuffle of partial rows, map-side
combine for hot players) produces every player-level number the reports
need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchops.config import Config, DEFAULT
from matchops.functions.numeric import skill_score

STATS_COLUMNS = (
    "player_id", "total_score", "total_kills", "total_deaths", "matches_played",
    "primary_region", "avg_score_per_match",
)


#: |x| from which a value is no longer summed by its whole part, and from which as a double.
_LARGE, _HUGE = 1e9, 1e15


def exact_parts(col: str, prefix: str) -> dict[str, Column]:
    """Aggregates whose sum is the same in any order: whole numbers, and
    decimals of 12 places for fractions (a double counts as it prints).  Only
    values from 1e15 on, infinities and NaN are added up as doubles."""
    x = F.col(col).cast("double")
    size, whole = F.abs(x), F.floor(x)
    printed = x.cast("decimal(28,12)")
    fine = F.when((size < _LARGE) & (x != whole), printed - whole.cast("decimal(10,0)")).when((size >= _LARGE) & (size < _HUGE), printed)
    return {
        f"{prefix}_whole": F.coalesce(F.sum(F.when(size < _LARGE, whole)), F.lit(0).cast("long")),
        f"{prefix}_fine": F.coalesce(F.sum(fine.cast("decimal(28,12)")), F.lit(0).cast("decimal(38,12)")),
        f"{prefix}_huge": F.coalesce(F.sum(F.when(size >= _HUGE, x)), F.lit(0.0)),
    }


def exact_value(prefix: str) -> Column:
    """The sum of ``exact_parts`` as a double, rounded once below 1e15."""
    exact = F.col(f"{prefix}_fine").cast("decimal(37,12)") + F.col(f"{prefix}_whole")
    return F.when(F.col(f"{prefix}_fine") == 0, F.col(f"{prefix}_whole").cast("double")).otherwise(exact.cast("double")) + F.col(f"{prefix}_huge")


def player_profile(matches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per player with every aggregate the reports use.

    Modes break ties toward the smallest value (``mode(x, true)``);
    a player with no region gets ``Unknown``.
    """
    agg = matches.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("matches_played"),
        *[v.alias(k) for k, v in exact_parts("score", "_score").items()],
        F.sum("kills").cast("long").alias("total_kills"),
        F.sum("deaths").cast("long").alias("total_deaths"),
        F.avg("kills").alias("avg_kills"),
        F.avg("deaths").alias("avg_deaths"),
        F.avg("ping").alias("avg_ping"),
        F.stddev_samp("score").alias("std_score"),
        F.stddev_samp("kills").alias("std_kills"),
        F.max("score").alias("max_score"), F.min("score").alias("min_score"),
        F.max("kills").alias("max_kills"), F.min("kills").alias("min_kills"),
        F.mode("region", True).alias("_region_mode"),
        F.mode("device", True).alias("_device_mode"),
    )
    agg = agg.withColumn("total_score", exact_value("_score")).withColumn("avg_score", F.col("total_score") / F.col("matches_played"))
    return agg.select(
        "player_id", "matches_played", "total_score", "total_kills", "total_deaths",
        (F.col("total_score") / F.col("matches_played")).alias("avg_score_per_match"),
        "avg_score", "avg_kills", "avg_deaths", "avg_ping", "std_score", "std_kills",
        "max_score", "min_score", "max_kills", "min_kills",
        F.coalesce("_region_mode", F.lit(cfg.unknown_label)).alias("primary_region"),
        F.coalesce("_device_mode", F.lit(cfg.unknown_label)).alias("device"),
        skill_score("avg_score", "avg_kills", "avg_deaths", cfg).alias("skill_score"),
    )


def player_totals(profile: DataFrame) -> DataFrame:
    """E1 + E2 in the leaderboard's column set."""
    return profile.select(*STATS_COLUMNS)


def player_skill(profile: DataFrame) -> DataFrame:
    """E2–E4 + M3."""
    return profile.select(
        "player_id", "avg_score", "avg_kills", "avg_deaths", "avg_ping",
        "primary_region", "device", "skill_score",
    )


def player_moments(profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """History length, mean and sample std; histories under the
    configured minimum carry no moments."""
    enough = F.col("matches_played") >= cfg.z_min_history
    return profile.select(
        "player_id", "matches_played",
        F.when(enough, F.col("avg_score")).alias("mean_score"),
        F.when(enough, F.col("std_score")).alias("std_score"),
        F.when(enough, F.col("avg_kills")).alias("mean_kills"),
        F.when(enough, F.col("std_kills")).alias("std_kills"),
        "max_score", "min_score", "max_kills", "min_kills",
    )


def _extreme_fires(mx: str, mn: str, mean: str, std: str, limit: float):
    s = F.col(std)
    return (s > 0) & (
        (F.abs((F.col(mx).cast("double") - F.col(mean)) / s) > limit)
        | (F.abs((F.col(mn).cast("double") - F.col(mean)) / s) > limit)
    )


def extremes_fire(cfg: Config = DEFAULT) -> Column:
    """Does a player's largest or smallest score or kill count pass the limit?"""
    return (_extreme_fires("max_score", "min_score", "mean_score", "std_score", cfg.z_limit)
            | _extreme_fires("max_kills", "min_kills", "mean_kills", "std_kills", cfg.z_limit))


def z_candidates(profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Players that can have a z-flagged match at all.

    |x - mean| / std is largest at the player's max or min, so testing the
    two extremes with the same expression decides exactly whether any of
    the player's matches flags.  Only these players' moments are joined
    back to the matches.
    """
    m = player_moments(profile, cfg).filter(F.col("matches_played") >= cfg.z_min_matches)
    return m.filter(extremes_fire(cfg)).select("player_id", "matches_played", "mean_score", "std_score", "mean_kills", "std_kills")
