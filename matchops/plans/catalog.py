"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver tables of ``sf_dir`` (through the match
adapter) and runs over all of it.  Column names and types line up with
``matchops.plans.oracle`` (DuckDB) query by query.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchops.config import DEFAULT
from matchops.operators import cleaning, history, kpis, lobbies, players, ranking, rules, severity
from matchops.operators import timeline
from matchops.plans.batch import Analysis
from matchops.plans.files import FILE_QUERIES
from matchops.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]

# Arguments of the parameterized views (the feature, not a sample).
REGION_ARG = " india "
SEARCH_ARG = "0001"
LOBBY_REGION = "India"


def _analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return Analysis(fixtures.matches(spark, sf_dir), DEFAULT)


def _raw(spark, sf_dir):
    return fixtures.raw_matches(spark, sf_dir)


CLEAN_OUT = list(cleaning.CLEAN_COLUMNS) + ["ingest_seq"]


def q_clean_matches(spark, sf_dir):
    return cleaning.clean_matches(_raw(spark, sf_dir)).select(*CLEAN_OUT)


def q_drop_accounting(spark, sf_dir):
    return cleaning.drop_accounting(_raw(spark, sf_dir))


def q_quarantine(spark, sf_dir):
    return cleaning.quarantine(_raw(spark, sf_dir))


def q_latest_wins(spark, sf_dir):
    return cleaning.latest_submission_wins(_raw(spark, sf_dir)).select(*CLEAN_OUT)


def q_rule_flags_long(spark, sf_dir):
    m = cleaning.with_derived(fixtures.matches(spark, sf_dir))
    return rules.rule_flags_long(m)


def q_player_moments(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return players.player_moments(a.profile).filter(
        F.col("matches_played") >= DEFAULT.z_min_history
    ).select(
        "player_id", "matches_played", "mean_score",
        F.round("std_score", 6).alias("std_score"), "mean_kills",
        F.round("std_kills", 6).alias("std_kills"),
    )


def q_zscore_outliers(spark, sf_dir):
    return history.zscore_outliers(_analysis(spark, sf_dir).hits)


def q_player_totals(spark, sf_dir):
    return players.player_totals(_analysis(spark, sf_dir).profile)


def q_player_skill(spark, sf_dir):
    return players.player_skill(_analysis(spark, sf_dir).profile)


def q_flag_counts(spark, sf_dir):
    return _analysis(spark, sf_dir).flagged.select(
        "player_id", "total_matches_count", "flagged_matches_count", "gameplay_matches_count")


def q_base_severity(spark, sf_dir):
    return _analysis(spark, sf_dir).flagged.select("player_id", "base_severity")


def q_escalated(spark, sf_dir):
    return _analysis(spark, sf_dir).flagged.filter("escalated").select(
        "player_id", "base_severity", "severity", "gameplay_matches_count", "total_matches_count")


def q_suspicious_report(spark, sf_dir):
    return _analysis(spark, sf_dir).suspicious_report()


def q_leaderboard_global(spark, sf_dir):
    return _analysis(spark, sf_dir).leaderboard_global()


def q_leaderboard_region(spark, sf_dir):
    return _analysis(spark, sf_dir).leaderboard_region()


def q_top10(spark, sf_dir):
    return _analysis(spark, sf_dir).top_k(DEFAULT.top_k)


def q_regional_filtered(spark, sf_dir):
    return _analysis(spark, sf_dir).leaderboard_region(REGION_ARG)


def q_published_region_board(spark, sf_dir):
    """V3 as served: the regional board published partitioned by region,
    read back for one (normalized) region with partition pruning."""
    from matchops.session import work_dir
    from matchops.sources import sinks

    path = work_dir(spark, "board")
    sinks.publish_board(_analysis(spark, sf_dir).leaderboard_region(), path)
    return sinks.read_region_board(spark, path, REGION_ARG).select(*ranking.BOARD_COLUMNS)


def q_player_search(spark, sf_dir):
    return ranking.player_search(_analysis(spark, sf_dir).leaderboard_global(), SEARCH_ARG)


def q_matching_pool(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return lobbies.matching_pool(a.profile, a.flagged).select(
        "player_id", "player_label", "severity", "primary_region", "ping_band", "skill_score")


def q_isolated_pool(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return lobbies.isolated_pool(a.profile, a.flagged).select(
        "player_id", "player_label", "severity", "primary_region", "skill_score")


def q_bucket_quantiles(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return lobbies.bucket_quantiles(a.profile, a.flagged).select(
        "region", "ping_band", F.col("players").cast("long").alias("players"),
        F.round("q_low", 6).alias("q_low"), F.round("q_high", 6).alias("q_high"))


def q_lobby_members(spark, sf_dir):
    return _analysis(spark, sf_dir).lobby_members().select(
        "lobby_name", "region", "ping_band", "skill_tier", "player_id", "player_label", "position")


def q_lobbies(spark, sf_dir):
    return _analysis(spark, sf_dir).lobbies()


def q_lobbies_in_region(spark, sf_dir):
    return _analysis(spark, sf_dir).lobbies(LOBBY_REGION)


def q_regions_with_lobbies(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return lobbies.regions_with_lobbies(a.profile, a.flagged)


def q_roster_exploded(spark, sf_dir):
    return kpis.roster_exploded(_analysis(spark, sf_dir).lobby_members(), DEFAULT)


def q_reasons_exploded(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return severity.reasons_long(a.hits, a.flagged).select("player_id", "reason")


def q_status_kpis(spark, sf_dir):
    return kpis.status_kpis(fixtures.matches(spark, sf_dir))


def q_run_summary(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return kpis.run_summary(a.profile, a.flagged, a.lobby_names())


def q_ingest_rate(spark, sf_dir):
    return timeline.ingest_rate(fixtures.matches(spark, sf_dir))


def q_flagged_per_minute(spark, sf_dir):
    m = cleaning.with_derived(fixtures.matches(spark, sf_dir))
    return timeline.flagged_per_minute(m, DEFAULT)


def q_season_leaderboard(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return timeline.season_leaderboard(a.matches, a.flagged, DEFAULT)


def q_canonical_regions(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return timeline.canonical_regions(spark, players.player_totals(a.profile))


def q_report_by_name(spark, sf_dir):
    """A10 + A11: every published report, as JSON records, by name."""
    from matchops.plans.reports import REPORT_NAMES
    from matchops.sources import sinks

    a = _analysis(spark, sf_dir)
    out = None
    for name in REPORT_NAMES:
        part = sinks.json_records(sinks.report(a, name)).select(F.lit(name).alias("report"), "record")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES: dict[str, Query] = {
    "clean_matches": q_clean_matches,
    "drop_accounting": q_drop_accounting,
    "quarantine_submissions": q_quarantine,
    "latest_submission_wins": q_latest_wins,
    "rule_flags_long": q_rule_flags_long,
    "player_moments": q_player_moments,
    "zscore_outliers": q_zscore_outliers,
    "player_totals": q_player_totals,
    "player_skill": q_player_skill,
    "flag_counts": q_flag_counts,
    "base_severity": q_base_severity,
    "escalated_players": q_escalated,
    "suspicious_report": q_suspicious_report,
    "leaderboard_global": q_leaderboard_global,
    "leaderboard_region": q_leaderboard_region,
    "top10_players": q_top10,
    "regional_board_filtered": q_regional_filtered,
    "published_region_board": q_published_region_board,
    "player_search": q_player_search,
    "matching_pool": q_matching_pool,
    "isolated_pool": q_isolated_pool,
    "bucket_quantiles": q_bucket_quantiles,
    "lobby_members": q_lobby_members,
    "lobbies": q_lobbies,
    "lobbies_in_region": q_lobbies_in_region,
    "regions_with_lobbies": q_regions_with_lobbies,
    "roster_exploded": q_roster_exploded,
    "reasons_exploded": q_reasons_exploded,
    "status_kpis": q_status_kpis,
    "run_summary": q_run_summary,
    "ingest_rate": q_ingest_rate,
    "flagged_per_minute": q_flagged_per_minute,
    "season_leaderboard": q_season_leaderboard,
    "canonical_regions": q_canonical_regions,
    "report_by_name": q_report_by_name,
    **FILE_QUERIES,
}
