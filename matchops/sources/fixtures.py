"""Match telemetry views over the driver's test tables.

The driver tables carry no match telemetry, so ``matches`` is derived
from ``events`` with one fixed, dialect-neutral SQL text (a test-input
definition, shared verbatim with the DuckDB oracle).  ``raw_matches``
is the same data as all-string CSV-like records with deterministic
corruption and re-sent copies, for the cleaning operators.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: adapter text (must stay identical on both engines) ---
MATCHES_SQL = """
select concat('P', lpad(cast(user_id as string), 6, '0')) player_id,
  concat('M', cast(event_id as string)) match_id,
  case when user_id%4=0 then 'India' when user_id%4=1 then 'Sea'
       when user_id%4=2 then 'Europe' else 'Us East' end region,
  case when event_type='click' then 'Android' when event_type='view' then 'Ios'
       when event_type='error' then 'Pc' else 'Console' end device,
  cast(case when event_id%1009=0 then 600
       else 15+cast(floor(user_id/4) as bigint)%3*80+event_id%23 end as int) ping,
  cast(case when user_id%29=7 and event_id%10<7 then 5200
       else round(400*sqrt(value)) end as double) score,
  cast(case when event_id%701=0 then 25 when event_id%1499=0 then (event_id*7)%19+40
       else (event_id*7)%19 end as int) kills,
  cast(case when event_id%701=0 then 0 else 1+event_id%9 end as int) deaths,
  cast(case when user_id%29=7 and event_id%10<7 then 110
       else 100+(event_id*37)%600 end as int) match_duration_seconds,
  ts as created_at
from {events}
"""

RAW_MATCHES_SQL = """
with b as (select *, cast(substr(match_id, 2) as bigint) k from {matches})
select case when k%97=0 then null else player_id end player_id, match_id,
  case when k%113=0 then 'NA' when k%2=0 then concat(chr(9), ' ', upper(region), ' ') else region end region,
  case when k%2=0 then concat(' ', upper(device), chr(10)) else device end device,
  case when k%107=0 then '-5' else cast(ping as string) end ping,
  case when k%127=0 then '5d' else cast(score as string) end score,
  case when k%101=0 then 'abc' when k%131=0 then '3000000000' else cast(kills as string) end kills,
  cast(deaths as string) deaths,
  case when k%103=0 then '0' else cast(match_duration_seconds as string) end match_duration_seconds,
  k ingest_seq
from b
union all
select player_id, match_id, region, device, cast(ping as string), cast(score+1 as string),
  cast(kills as string), cast(deaths as string), cast(match_duration_seconds as string), k+1000000000
from b where k%109=0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean per-(player, match) rows; ``created_at`` is the event time."""
    return spark.sql(MATCHES_SQL, events=events(spark, sf_dir))


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string records plus ``ingest_seq`` (file order)."""
    m = matches(spark, sf_dir)
    return spark.sql(RAW_MATCHES_SQL, matches=m)


def duck_matches_cte() -> str:
    """The same adapter text for DuckDB (events is a pre-registered view)."""
    return MATCHES_SQL.replace("{events}", "events")


def duck_raw_cte() -> str:
    return RAW_MATCHES_SQL.replace("{matches}", "matches")
