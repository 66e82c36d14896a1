"""Counts, filters and explodes over the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchops.config import Config, DEFAULT


def status_kpis(matches: DataFrame) -> DataFrame:
    """is_loaded, total_records, unique_players (exact distinct)."""
    return matches.agg(
        (F.count(F.lit(1)) > 0).alias("is_loaded"),
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("player_id").alias("unique_players"),
    )


def run_summary(profile: DataFrame, flagged: DataFrame, names: DataFrame) -> DataFrame:
    """Four counts as one row (union of (metric, value), then a keyless
    pivot).  Matches and players come from the profile, lobbies from their
    names: no scan of the matches, no rosters."""
    metrics = ["total_matches", "unique_players", "flagged_players", "lobbies"]
    m = profile.agg(F.sum("matches_played").alias("a"), F.count("player_id").alias("b")).select(
        F.explode(F.array(
            F.struct(F.lit(metrics[0]).alias("k"), F.col("a").alias("v")),
            F.struct(F.lit(metrics[1]).alias("k"), F.col("b").alias("v")),
        )).alias("kv")).select("kv.k", "kv.v")
    parts = [
        m,
        flagged.agg(F.count(F.lit(1)).alias("v")).select(F.lit(metrics[2]).alias("k"), "v"),
        names.agg(F.count(F.lit(1)).alias("v")).select(F.lit(metrics[3]).alias("k"), "v"),
    ]
    kv = parts[0]
    for p in parts[1:]:
        kv = kv.unionByName(p)
    return kv.groupBy().pivot("k", metrics).agg(F.first("v")).select(
        *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in metrics])


def roster_exploded(members: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """V5: one row per roster entry, with the Low-severity tag detected."""
    return members.select(
        "lobby_name", "player_label", "player_id",
        F.col("player_label").contains(cfg.low_tag.strip()).alias("is_low_flagged"),
    )


def reasons_from_text(report: DataFrame) -> DataFrame:
    """V4 on a rendered report: split the joined reasons back out."""
    return report.select(
        "player_id", F.explode(F.split("flag_reasons", r";\s*")).alias("reason")
    ).select("player_id", F.trim("reason").alias("reason"))
