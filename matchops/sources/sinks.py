"""Sinks and the report registry.

* ``bulk_replace`` (A6): CSV upload -> clean -> the versioned match store,
  validated first and switched to as a whole.
* ``persist_matches`` / ``reload`` (A7, A9): the match table as parquet
  partitioned by (region, match_date) when an event time exists.
* ``write_report`` (A8): header CSV, globally sorted by a range-
  partitioned ORDER BY (part files are in key order), rosters and
  reasons as text.
* ``REPORTS`` / ``report`` (A10): report name -> DataFrame builder;
  unknown names raise ``KeyError``.
* ``json_records`` (A11): one JSON object per row, NULL rank kept as
  ``null``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchops.config import Config, DEFAULT
from matchops.operators import lobbies, ranking, severity
from matchops.operators.cleaning import clean_matches
from matchops.plans.batch import Analysis
from matchops.sources import store
from matchops.sources.csv_source import read_raw


BOARD_FOLDER = "primary_region_folder"
FOLDER = "_folder"  # partition column; the region itself stays in the files, so no value is re-typed or lost


def with_region_folder(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(FOLDER, F.concat(F.lit("r_"), F.coalesce(F.col(col), F.lit(""))))


def persist_matches(matches: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned parquet; (region, match_date) when created_at exists."""
    matches = with_region_folder(matches, "region")
    parts = [FOLDER]
    if "created_at" in matches.columns:
        matches = matches.withColumn("match_date", F.to_date("created_at"))
        parts.append("match_date")
    matches.write.mode(mode).partitionBy(*parts).parquet(path)


def reload(spark: SparkSession, path: str) -> DataFrame:
    """The persisted match table, of a plain or a versioned store."""
    if store.exists(spark, path):
        return store.read(spark, path, store.MATCHES).drop("match_date")
    return spark.read.parquet(path).drop("match_date", FOLDER)


def bulk_replace(spark: SparkSession, csv_path: str, store_path: str, cfg: Config = DEFAULT) -> int:
    """Replace the match store with a cleaned CSV upload.

    The header is checked first (``MissingColumnsError`` leaves the store
    untouched); readers see the old store until the whole upload is
    published.  A plain parquet folder at that place is an error."""
    raw = read_raw(spark, csv_path, cfg)          # raises before any write
    rows = clean_matches(raw, cfg).drop("ingest_seq").withColumn("match_date", F.lit(None).cast("date"))
    store.replace(rows, store_path, store.MATCHES)
    return reload(spark, store_path).count()


def _orders() -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {
        "leaderboard_global": ranking.order_global,
        "leaderboard_region": ranking.order_region,
        "suspicious_players": severity.order_report,
        "matchmaking_groups": lobbies.order_lobbies,
    }


def REPORTS(a: Analysis) -> dict[str, Callable[[], DataFrame]]:
    """A10: the published reports of one analysis, by name."""
    return {
        "leaderboard_global": a.leaderboard_global,
        "leaderboard_region": a.leaderboard_region,
        "suspicious_players": a.suspicious_report,
        "matchmaking_groups": a.lobbies,
        "players": lambda: a.matches,
    }


def report(a: Analysis, name: str) -> DataFrame:
    builders = REPORTS(a)
    if name not in builders:
        raise KeyError(f"Report not found: {name}")
    df = builders[name]()
    order = _orders().get(name)
    return order(df) if order else df


def write_report(df: DataFrame, path: str) -> None:
    """Header CSV; an ordered DataFrame keeps its order across parts."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row; NULLs (e.g. an unranked player) kept."""
    return df.select(
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


def publish_board(board: DataFrame, path: str) -> None:
    """Serve the regional board as parquet partitioned by its region."""
    board.withColumn(BOARD_FOLDER, F.concat(F.lit("r_"), "primary_region")).write.mode("overwrite").partitionBy(BOARD_FOLDER).parquet(path)


def read_region_board(spark: SparkSession, path: str, region: str) -> DataFrame:
    """V3 on a published board: the argument is trimmed and title-cased,
    and the equality becomes a partition filter (only that folder is read)."""
    from matchops.functions.text import strip_ws, title_case

    # A foldable expression on a literal: the optimizer turns it into a
    # constant, so the filter still prunes partitions.
    wanted = F.concat(F.lit("r_"), title_case(strip_ws(F.lit(region))))
    return spark.read.parquet(path).filter(F.col(BOARD_FOLDER) == wanted).drop(BOARD_FOLDER)
