"""Registered streaming queries and their oracles.

Each query stages rows Spark derives from the driver tables as parquet
files under the shared work folder, runs a ``readStream`` over them with
``trigger(availableNow=True)`` — in arrival stages against the same
checkpoint, so later stages are new micro-batches of a restarted query —
and returns the sink as a DataFrame.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchops.config import DEFAULT
from matchops.plans import oracle
from matchops.session import work_dir
from matchops.sources import fixtures
from matchops.streaming import ingest, jobs, plans, refresh
from matchops.streaming.verdicts import with_reasons

LATE_DELAY = "10 minutes"     # watermark for the windowed rates
DEDUP_DELAY = "40 days"       # covers the whole test span: copies meet state
SPLIT_AT = "2024-01-16"       # arrival stages: first half of the month, then the rest
DRAIN = {"availableNow": True}
STORE_DAYS = ("2024-01-10", "2024-01-20")


def _matches(spark, sf_dir) -> DataFrame:
    return fixtures.matches(spark, sf_dir).withColumn(
        "ingest_seq", F.substring("match_id", 2, 64).cast("long"))


def _resent(spark, sf_dir) -> DataFrame:
    """Re-sent copies of every 109th match, one point more score."""
    m = _matches(spark, sf_dir)
    return m.filter(F.col("ingest_seq") % 109 == 0).withColumn(
        "score", F.col("score") + 1).withColumn("ingest_seq", F.col("ingest_seq") + 1_000_000_000)


def _halves(spark, sf_dir):
    m = _matches(spark, sf_dir)
    cut = F.lit(SPLIT_AT).cast("timestamp_ntz")
    return [m.filter(F.col("created_at") < cut), m.filter(F.col("created_at") >= cut)]


def _drain(spark: SparkSession, base: str, stages, start) -> None:
    """Stage each input, then run the job once with availableNow.

    Later stages are new files for the same checkpoint: a restarted
    query picks up exactly the new micro-batches.
    """
    schema = None
    for i, stage in enumerate(stages):
        stage.write.mode("overwrite").parquet(f"{base}/in/s{i:03d}")
        schema = schema or spark.read.parquet(f"{base}/in/s{i:03d}").schema
        stream = jobs.match_source(spark, f"{base}/in/*", schema)
        start(stream, f"{base}/chk").awaitTermination()


def q_stream_rule_alerts(spark, sf_dir):
    base = work_dir(spark, "alerts")
    _drain(spark, base, _halves(spark, sf_dir),
           lambda s, chk: jobs.alerts_job(s, f"{base}/out", chk, DRAIN))
    return spark.read.parquet(f"{base}/out")


def q_stream_dedup(spark, sf_dir):
    base = work_dir(spark, "dedup")
    _drain(spark, base, [_matches(spark, sf_dir), _resent(spark, sf_dir)],
           lambda s, chk: jobs.dedup_job(s, f"{base}/out", chk, DRAIN, DEDUP_DELAY))
    return spark.read.parquet(f"{base}/out").select("player_id", "match_id", "score")


def _store_from_stream(spark, base, stages):
    path = f"{base}/store"
    _drain(spark, base, stages, lambda s, chk: jobs.store_job(s, path, chk, DRAIN))
    return path


def q_stream_upsert(spark, sf_dir):
    base = work_dir(spark, "upsert")
    path = _store_from_stream(spark, base, [_matches(spark, sf_dir), _resent(spark, sf_dir)])
    return plans.read_store(spark, path).select("player_id", "match_id", "region", "score")


def q_stream_ingest_rate(spark, sf_dir):
    base = work_dir(spark, "rate")
    _drain(spark, base, _halves(spark, sf_dir),
           lambda s, chk: jobs.rate_job(s, f"{base}/out", chk, DRAIN, LATE_DELAY))
    return spark.read.parquet(f"{base}/out")


def q_stream_flagged_per_minute(spark, sf_dir):
    base = work_dir(spark, "alert-rate")
    _drain(spark, base, _halves(spark, sf_dir),
           lambda s, chk: jobs.alert_rate_job(s, f"{base}/out", chk, DRAIN, LATE_DELAY))
    return spark.read.parquet(f"{base}/out")


def q_stream_totals(spark, sf_dir):
    base = work_dir(spark, "totals")
    path = f"{base}/totals"
    _drain(spark, base, _halves(spark, sf_dir), lambda s, chk: jobs.totals_job(s, path, chk, DRAIN))
    return plans.read_totals(spark, path)


def q_pruned_region_read(spark, sf_dir):
    base = work_dir(spark, "store")
    path = _store_from_stream(spark, base, _halves(spark, sf_dir))
    return plans.read_store(spark, path, region="India").select(
        "player_id", "match_id", "region", F.date_format("match_date", "yyyy-MM-dd").alias("match_date"),
        "score")


def _refreshed(spark, sf_dir, k: int) -> str:
    """J5 + J6 over both halves of the matches and copies of some; returns the folder."""
    base = work_dir(spark, "refresh")
    first, second = _halves(spark, sf_dir)
    _drain(spark, base, [first, second.unionByName(first.filter(F.col("ingest_seq") % 109 == 0))],
           lambda s, chk: jobs.zscore_job(s, f"{base}/state", chk, DRAIN, DEDUP_DELAY, k=k))
    return f"{base}/state"


def q_zscore_refresh(spark, sf_dir):
    """Z flags kept batch by batch, from mergeable moments."""
    return refresh.read_outliers(spark, _refreshed(spark, sf_dir, DEFAULT.top_k))


def q_topk_refresh(spark, sf_dir):
    """The board's first ten after the last batch."""
    return refresh.read_top(spark, _refreshed(spark, sf_dir, DEFAULT.top_k))


def q_top100_refresh(spark, sf_dir):
    """The board's first hundred after the last batch."""
    return refresh.read_top(spark, _refreshed(spark, sf_dir, 100))


def _odd_regions(df: DataFrame) -> DataFrame:
    """Regions that text must keep apart: '01', '1', blank and null."""
    k = F.col("ingest_seq")
    return df.withColumn("region", F.when(k % 7 == 0, F.lit("01")).when(k % 7 == 1, F.lit("1")).when(k % 7 == 2, F.lit(""))
                         .when(k % 7 == 3, F.lit(None).cast("string")).otherwise(F.col("region")))


def _two_writers(spark, sf_dir) -> str:
    """Two jobs write one store, half of the matches each; then copies of some
    matches move to no region, from the first job, and the store is merged
    before the second job's last batch."""
    base = work_dir(spark, "writers")
    path, m = f"{base}/store", _odd_regions(_matches(spark, sf_dir))
    mine = F.col("ingest_seq") % 2 == 0
    moved = _resent(spark, sf_dir).withColumn("region", F.lit(None).cast("string"))
    early = F.col("created_at") < F.lit(SPLIT_AT).cast("timestamp_ntz")
    start = {w: (lambda s, chk: jobs.store_job(s, path, chk, DRAIN)) for w in "ab"}
    _drain(spark, f"{base}/a", [m.filter(mine), moved.filter(mine)], start["a"])
    _drain(spark, f"{base}/b", [m.filter(~mine & early)], start["b"])
    plans.merge_store(spark, path)
    late = m.filter(~mine & ~early).unionByName(moved.filter(~mine))
    late.write.mode("overwrite").parquet(f"{base}/b/in/s001")
    stream = jobs.match_source(spark, f"{base}/b/in/*", spark.read.parquet(f"{base}/b/in/s001").schema)
    start["b"](stream, f"{base}/b/chk").awaitTermination()
    return path


def q_store_two_writers(spark, sf_dir):
    """The current matches of a store with two writers and a merge."""
    return plans.read_store(spark, _two_writers(spark, sf_dir)).select(
        "player_id", "match_id", "region", "score", F.date_format("match_date", "yyyy-MM-dd").alias("match_date"))


def q_store_dates_read(spark, sf_dir):
    """One region and two days of that store; matches that moved stay out."""
    rows = plans.read_store(spark, _two_writers(spark, sf_dir), region="01", dates=list(STORE_DAYS))
    return rows.select("player_id", "match_id", "region", "score", F.date_format("match_date", "yyyy-MM-dd").alias("match_date"))


def q_stream_verdicts(spark, sf_dir):
    """The re-sent copies arrive as submissions after the store is loaded."""
    base = work_dir(spark, "verdicts")
    store = _store_from_stream(spark, f"{base}/load", [_matches(spark, sf_dir)])
    _drain(spark, f"{base}/subs", [_resent(spark, sf_dir)],
           lambda s, chk: jobs.verdict_job(s, store, f"{base}/verdicts", chk, DRAIN))
    rows = spark.read.parquet(f"{base}/verdicts")
    # the schema is given: without a flagged player there is no file of reasons
    texts = spark.read.schema("player_id string, reasons string, _batch int").parquet(
        jobs.reasons_path(f"{base}/verdicts"))
    return with_reasons(rows, texts, ("player_id", "_batch"))


def q_stream_quarantine(spark, sf_dir):
    """B13 + J1: topic rows with JSON values, validated into store and dead letters."""
    base = work_dir(spark, "ingest")
    raw = fixtures.raw_matches(spark, sf_dir)
    fields = [c for c in raw.columns if c != "ingest_seq"]
    topic = raw.select(F.to_json(F.struct(*fields)).cast("binary").alias("value"), F.lit(0).alias("partition"), F.col("ingest_seq").alias("offset"))
    _drain(spark, base, [topic.where("offset < 1000000000"), topic.where("offset >= 1000000000")],
           lambda s, chk: ingest.ingest_job(ingest.topic_records(s), f"{base}/store", f"{base}/letters", chk, DRAIN))
    good = plans.read_store(spark, f"{base}/store").select(
        "player_id", "match_id", F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("reason"), "region", "score")
    return good.union(ingest.read_letters(spark, f"{base}/letters").select(
        "player_id", "match_id", F.lit("rejected"), "reason", "region", F.lit(None).cast("double")))


def q_stream_late_rows(spark, sf_dir):
    """Every 53rd match arrives after all others; those whose window had
    closed by then, per window."""
    base, m = work_dir(spark, "late"), _matches(spark, sf_dir)
    _drain(spark, base, [m.where("ingest_seq % 53 <> 0"), m.where("ingest_seq % 53 = 0")],
           lambda s, chk: jobs.late_rows_job(s, f"{base}/late", chk, DRAIN, LATE_DELAY))
    return plans.late_counts(spark.read.parquet(f"{base}/late/rows"))


STREAM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_rule_alerts": q_stream_rule_alerts,
    "stream_dedup": q_stream_dedup,
    "stream_upsert": q_stream_upsert,
    "stream_ingest_rate": q_stream_ingest_rate,
    "stream_flagged_per_minute": q_stream_flagged_per_minute,
    "stream_totals": q_stream_totals,
    "pruned_region_read": q_pruned_region_read,
    "zscore_refresh": q_zscore_refresh,
    "topk_refresh": q_topk_refresh,
    "top100_refresh": q_top100_refresh,
    "store_two_writers": q_store_two_writers,
    "store_dates_read": q_store_dates_read,
    "stream_verdicts": q_stream_verdicts,
    "stream_quarantine": q_stream_quarantine,
    "stream_late_rows": q_stream_late_rows,
}


# --- oracles ------------------------------------------------------------

_M = oracle.MATCHES
_CLOSED = "time_bucket(INTERVAL '1 minute', created_at) + INTERVAL '1 minute' <= " \
          "(SELECT max(created_at) FROM matches) - INTERVAL '10 minutes'"
_UPSERTED = ("matches AS (SELECT player_id, match_id, region, device, ping, "
             "CASE WHEN CAST(substr(match_id, 2) AS BIGINT) % 109 = 0 THEN score + 1 ELSE score END score, "
             "kills, deaths, match_duration_seconds, created_at FROM base)")
_BASE = "base AS (" + fixtures.duck_matches_cte() + ")"
_MOVED = """stored AS (
  SELECT player_id, match_id, strftime(CAST(created_at AS DATE), '%Y-%m-%d') match_date,
    CASE WHEN k % 109 = 0 THEN score + 1 ELSE score END score,
    CASE WHEN k % 109 = 0 OR k % 7 = 3 THEN NULL WHEN k % 7 = 0 THEN '01' WHEN k % 7 = 1 THEN '1' WHEN k % 7 = 2 THEN '' ELSE region END region
  FROM (SELECT *, CAST(substr(match_id, 2) AS BIGINT) k FROM base))"""
_STORED = "SELECT player_id, match_id, region, score, match_date FROM stored"

STREAM_ORACLE: dict[str, str] = {
    "stream_rule_alerts": oracle.SQL["rule_flags_long"],
    "stream_dedup": oracle._with(_M) + "SELECT player_id, match_id, score FROM matches",
    "stream_upsert": oracle._with(_BASE, _UPSERTED) + "SELECT player_id, match_id, region, score FROM matches",
    "stream_ingest_rate": oracle._with(_M) + f"""
SELECT strftime(time_bucket(INTERVAL '1 minute', created_at), '%Y-%m-%d %H:%M:%S') window_start,
  count(*) matches, count(*) / 60.0 matches_per_sec
FROM matches WHERE {_CLOSED} GROUP BY 1""",
    "stream_flagged_per_minute": oracle._with(_M, oracle.DERIVED, oracle.RULES) + f"""
SELECT strftime(time_bucket(INTERVAL '1 minute', m.created_at), '%Y-%m-%d %H:%M:%S') window_start,
  count(*) flagged_matches, count(DISTINCT m.player_id) flagged_players
FROM m WHERE EXISTS (SELECT 1 FROM rf WHERE rf.player_id = m.player_id AND rf.match_id = m.match_id)
  AND {_CLOSED.replace('created_at)', 'm.created_at)', 1)}
GROUP BY 1""",
    "stream_totals": oracle._with(_M) + """
SELECT player_id, sum(score) total_score, CAST(sum(kills) AS BIGINT) total_kills,
  CAST(sum(deaths) AS BIGINT) total_deaths, count(*) matches_played FROM matches GROUP BY player_id""",
    "pruned_region_read": oracle._with(_M) + """
SELECT player_id, match_id, region, strftime(CAST(created_at AS DATE), '%Y-%m-%d') match_date, score
FROM matches WHERE region = 'India'""",
    "stream_quarantine": oracle.q_ingested(),
    "stream_late_rows": oracle._with(_M) + """
SELECT strftime(time_bucket(INTERVAL '1 minute', created_at), '%Y-%m-%d %H:%M:%S') window_start, count(*) late_matches
FROM matches
WHERE CAST(substr(match_id, 2) AS BIGINT) % 53 = 0 AND time_bucket(INTERVAL '1 minute', created_at) + INTERVAL '1 minute' <=
  (SELECT max(created_at) FROM matches WHERE CAST(substr(match_id, 2) AS BIGINT) % 53 <> 0) - INTERVAL '10 minutes'
GROUP BY 1""",
    "zscore_refresh": oracle.SQL["zscore_outliers"],
    "topk_refresh": oracle.SQL["top10_players"],
    "top100_refresh": oracle.SQL["top10_players"].replace("LIMIT 10", "LIMIT 100"),
    "store_two_writers": oracle._with(_BASE, _MOVED) + _STORED,
    "store_dates_read": oracle._with(_BASE, _MOVED) + _STORED + f"""
WHERE region = '01' AND match_date IN {STORE_DAYS}""",
    "stream_verdicts": oracle._with(_BASE, _UPSERTED, *oracle.BASE[1:], oracle.REASONS, """texts AS (
  SELECT fl.player_id, fl.severity, string_agg(rs.reason, '; ' ORDER BY rs.pos) flag_reasons
  FROM fl JOIN rs ON fl.player_id = rs.player_id
  GROUP BY fl.player_id, fl.severity),
subs AS (SELECT player_id, match_id FROM m WHERE CAST(substr(match_id, 2) AS BIGINT) % 109 = 0),
own AS (
  SELECT subs.player_id, subs.match_id,
    string_agg(rf.reason, '; ' ORDER BY CASE rf.rule_code WHEN 'SCORE_RATE' THEN 1 WHEN 'ZERO_DEATH' THEN 2
      WHEN 'SHORT_HIGH' THEN 3 WHEN 'EXTREME_KILLS' THEN 4 ELSE 5 END) reasons, count(rf.rule_code) fired
  FROM subs LEFT JOIN rf ON subs.player_id = rf.player_id AND subs.match_id = rf.match_id
  GROUP BY subs.player_id, subs.match_id)""") + """
SELECT own.player_id, own.match_id,
  CASE WHEN own.fired > 0 OR texts.severity IS NOT NULL THEN 'flagged' ELSE 'clean' END status,
  coalesce(texts.severity, 'None') severity,
  CASE WHEN texts.severity IS NOT NULL THEN texts.flag_reasons ELSE coalesce(own.reasons, '') END reasons
FROM own LEFT JOIN texts ON own.player_id = texts.player_id""",
}
