"""Submission verdicts (M10, F9): per micro-batch, over the updated store.

A submission is ``flagged`` when its own row fires a rule or its player is
flagged by the detection over the whole store (the batch included).  The
reasons are the player's report reasons when the player is
flagged, otherwise the rules the row itself fired.

Two tables hold this: one row per submission with the player's number of
reasons, and the reasons of the submitted players, once per player.
``with_reasons`` joins them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchops.config import Config, DEFAULT
from matchops.operators.cleaning import with_derived
from matchops.operators.rules import rule_flags
from matchops.operators.severity import reasons_long
from matchops.plans.batch import Analysis

VERDICT_COLUMNS = ("player_id", "match_id", "status", "severity", "reasons")


def verdicts(a: Analysis, submissions: DataFrame) -> DataFrame:
    """One row per submission; ``own_reasons`` are the rules the row itself
    fired, ``reason_count`` counts the reasons of a flagged player."""
    subs = with_derived(submissions).select(
        "player_id", "match_id", rule_flags(a.cfg).alias("_fired"))
    counts = reasons_long(a.hits, a.flagged, a.cfg).groupBy("player_id").agg(F.count(F.lit(1)).alias("reason_count"))
    players = a.flagged.select("player_id", "severity").join(counts, "player_id")
    # point lookup of the submitted players' verdicts (a join, not a loop).
    return subs.join(players, "player_id", "left").select(
        "player_id", "match_id",
        F.when((F.size("_fired") > 0) | F.col("severity").isNotNull(), F.lit("flagged"))
        .otherwise(F.lit("clean")).alias("status"),
        F.coalesce("severity", F.lit("None")).alias("severity"),
        F.array_join(F.transform("_fired", lambda f: f["text"]), a.cfg.reason_separator).alias("own_reasons"),
        F.coalesce("reason_count", F.lit(0)).alias("reason_count"),
    )


def player_reasons(a: Analysis, submissions: DataFrame) -> DataFrame:
    """(player_id, reasons): all reasons of the submitted flagged players."""
    return a.suspicious_report().select("player_id", F.col("flag_reasons").alias("reasons")).join(
        submissions.select("player_id").distinct(), "player_id", "left_semi")


def with_reasons(rows: DataFrame, texts: DataFrame, keys: tuple[str, ...] = ("player_id",)) -> DataFrame:
    """A row per submission with its reasons."""
    return rows.join(texts, list(keys), "left").withColumn(
        "reasons", F.when(F.col("reason_count") > 0, F.col("reasons")).otherwise(F.col("own_reasons"))).select(*VERDICT_COLUMNS)


def submission_verdicts(store: DataFrame, submissions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    a = Analysis(store, cfg)
    return with_reasons(verdicts(a, submissions), player_reasons(a, submissions))
