"""Per-player verdicts (E5–E9, F10, G5) and the suspicious report.

Counts and the base severity are one grouped aggregate with bounded
buffers.  The reason set can grow with a player's flagged matches, so it
is a long table (one row per distinct reason), numbered in code-point
order and joined by segments — never one collect_set per player.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchops.config import Config, DEFAULT
from matchops.operators.numbering import ordered_text

REPORT_COLUMNS = (
    "player_id", "severity", "flagged_matches_count", "total_matches_count", "flag_reasons",
)


def severity_rank(sev: Column) -> Column:
    return (
        F.when(sev == "High", F.lit(3)).when(sev == "Medium", F.lit(2))
        .when(sev == "Low", F.lit(1)).otherwise(F.lit(0))
    )


def severity_name(rank: Column) -> Column:
    return (
        F.when(rank >= 3, F.lit("High")).when(rank == 2, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def severity_order(sev: Column) -> Column:
    """report order High, Medium, Low."""
    return F.when(sev == "High", 0).when(sev == "Medium", 1).when(sev == "Low", 2).otherwise(3)


def flag_counts(hits: DataFrame, profile: DataFrame) -> DataFrame:
    """E5 + E9: per flagged player, from the flagged matches only.

    ``hits`` holds one row per match with at least one flag, so players
    without flags never appear; the match total comes from the profile.
    """
    max_sev = F.array_max(F.transform("all_flags", lambda f: severity_rank(f["severity"])))
    c = hits.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("flagged_matches_count"),
        F.count_if(F.exists("rule_flags", lambda f: f["is_gameplay"])).alias("gameplay_matches_count"),
        F.max(max_sev).alias("base_rank"),
    )
    totals = profile.select("player_id", F.col("matches_played").alias("total_matches_count"))
    return c.join(totals, "player_id")


def flagged_players(hits: DataFrame, profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Flagged players with base severity and escalation."""
    c = flag_counts(hits, profile)
    ratio = F.col("gameplay_matches_count") / F.col("total_matches_count")
    escalate = (
        (F.col("total_matches_count") >= cfg.escalation_min_matches)
        & (ratio > cfg.escalation_ratio)
        & (F.col("base_rank") < 3)
    )
    return c.select(
        "player_id",
        F.when(escalate, F.lit("High")).otherwise(severity_name(F.col("base_rank"))).alias("severity"),
        severity_name(F.col("base_rank")).alias("base_severity"),
        escalate.alias("escalated"),
        F.col("flagged_matches_count").cast("long").alias("flagged_matches_count"),
        F.col("total_matches_count").cast("long").alias("total_matches_count"),
        F.col("gameplay_matches_count").cast("long").alias("gameplay_matches_count"),
    )


def reasons_long(hits: DataFrame, flagged: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Distinct reasons per flagged player (V4), escalation text included.

    ``_last`` orders the escalation line after the code-point-sorted
    reasons when the text is assembled.
    """
    distinct = hits.select("player_id", F.explode("all_flags").alias("f")).select(
        "player_id", F.col("f.text").alias("reason"), F.lit(0).alias("_last")
    ).distinct()
    esc = flagged.filter("escalated").select(
        "player_id", F.lit(cfg.escalation_text).alias("reason"), F.lit(1).alias("_last")
    )
    return distinct.unionByName(esc)


def suspicious_report(hits: DataFrame, flagged: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The report: one row per flagged player, its reasons joined with "; "."""
    reasons = reasons_long(hits, flagged, cfg)
    texts = ordered_text(reasons, ["player_id"], ["_last", "reason"], "reason", cfg.reason_separator, cfg.text_segment, "flag_reasons")
    return flagged.join(texts, "player_id").select(*REPORT_COLUMNS)


def order_report(report: DataFrame) -> DataFrame:
    """High, Medium, Low; flagged matches desc; player id."""
    return report.orderBy(
        severity_order(F.col("severity")), F.col("flagged_matches_count").desc(),
        F.col("player_id"),
    )
