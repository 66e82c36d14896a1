"""Registered queries over files that Spark writes from the tables and reads back.

CSV uploads in two folders with differing headers, a match store that such an
upload replaces, and the report files with the order of their rows.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchops.operators import cleaning, kpis
from matchops.operators.numbering import ordered_row_number
from matchops.plans.batch import Analysis
from matchops.session import work_dir
from matchops.sources import fixtures, sinks
from matchops.sources.csv_source import read_raw
from matchops.streaming import plans as stream_plans

RECORDS = ("leaderboard_global", "leaderboard_region", "suspicious_players", "matchmaking_groups", "players")


def _uploaded(spark: SparkSession, sf_dir: str) -> str:
    """The raw records as CSV: first arrivals in one folder, copies in a later
    one whose files have their columns in another order and one more."""
    base, raw = work_dir(spark, "upload"), fixtures.raw_matches(spark, sf_dir)
    first, copies = raw.where("ingest_seq < 1000000000").drop("ingest_seq"), raw.where("ingest_seq >= 1000000000").drop("ingest_seq")
    for df, name in ((first, "a"), (copies.select(*reversed(copies.columns), F.lit("again").alias("note")), "b")):
        (df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(f"{base}/{name}"))
    return f"{base}/*"


def q_csv_ingest(spark, sf_dir):
    """A1, A2, A4: CSV files of two headers, read by name and cleaned."""
    return cleaning.clean_matches(read_raw(spark, _uploaded(spark, sf_dir))).select(*cleaning.CLEAN_COLUMNS)


def q_bulk_replaced_store(spark, sf_dir):
    """A store of other matches, replaced by a CSV upload and reloaded."""
    path = work_dir(spark, "replaced")
    stream_plans.append_to_store(fixtures.matches(spark, sf_dir).withColumn("player_id", F.concat(F.lit("old-"), "player_id")), 0, path)
    sinks.bulk_replace(spark, _uploaded(spark, sf_dir), path)
    return sinks.reload(spark, path).select(*cleaning.CLEAN_COLUMNS)


def q_persisted_matches(spark, sf_dir):
    """The match table persisted by region and day, reloaded."""
    path = work_dir(spark, "persisted")
    sinks.persist_matches(fixtures.matches(spark, sf_dir), path)
    return sinks.reload(spark, path).select("player_id", "match_id", "region", "device", "score", "kills")


def _report_file(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A report's CSV files read back, with the place of each row."""
    path = work_dir(spark, "report")
    sinks.write_report(sinks.report(Analysis(fixtures.matches(spark, sf_dir)), name), path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_row"))
    return ordered_row_number(placed, [F.col("_file").asc(), F.col("_block").asc(), F.col("_row").asc()], out="place")


def q_region_board_file(spark, sf_dir):
    """The regional board as written, in its order."""
    return _report_file(spark, sf_dir, "leaderboard_region").select(
        "place", F.col("rank").cast("long").alias("rank"), "player_id", "primary_region", "status",
        F.col("total_score").cast("double").alias("total_score"))


def q_suspicious_file(spark, sf_dir):
    """The suspicious report as written, in its order."""
    return _report_file(spark, sf_dir, "suspicious_players").select(
        "place", "player_id", "severity", F.col("flagged_matches_count").cast("long").alias("flagged_matches_count"), "flag_reasons")


def q_lobbies_file(spark, sf_dir):
    """The lobbies as written, in their order."""
    return _report_file(spark, sf_dir, "matchmaking_groups").select(
        "place", "lobby_name", F.col("player_count").cast("long").alias("player_count"), "status", "player_ids")


def q_reasons_split(spark, sf_dir):
    """V4: the reasons split back out of the report's text."""
    return kpis.reasons_from_text(Analysis(fixtures.matches(spark, sf_dir)).suspicious_report())


def q_report_records(spark, sf_dir):
    """The JSON records of all five reports, by name: their key and
    a number, with NULL ranks kept as null."""
    a, out = Analysis(fixtures.matches(spark, sf_dir)), None
    fields = "player_id string, match_id string, lobby_name string, rank long, flagged_matches_count long, player_count long, kills long"
    for name in RECORDS:
        records = sinks.json_records(sinks.report(a, name)).withColumn("r", F.from_json("record", fields))
        part = records.select(
            F.lit(name).alias("report"), F.concat_ws("/", "r.lobby_name", "r.player_id", "r.match_id").alias("id"),
            F.coalesce("r.rank", "r.flagged_matches_count", "r.player_count", "r.kills").alias("number"),
            F.col("record").contains('"rank":null').alias("null_rank"))
        out = part if out is None else out.unionByName(part)
    return out


FILE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_ingest": q_csv_ingest,
    "bulk_replaced_store": q_bulk_replaced_store,
    "persisted_matches": q_persisted_matches,
    "region_board_file": q_region_board_file,
    "suspicious_file": q_suspicious_file,
    "lobbies_file": q_lobbies_file,
    "reasons_split": q_reasons_split,
    "report_records": q_report_records,
}
