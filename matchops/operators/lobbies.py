"""Matchmaking lobbies.

Players are pooled by severity (High out, Medium isolated, Low tagged),
bucketed by (primary_region, ping band), numbered inside each bucket by
(skill_score, player_id) — or player_id for the isolated pool — with the
range-partitioned numbering; the few rows of a small (Mixed) bucket go by
player_id.  The numbering's piece table gives the bucket sizes and the places
of the 0.33/0.66 quantiles (NumPy's linear rule, exact at any bucket size),
and the numbers each member's place in the roster, so no bucket is ever
collected into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchops.config import Config, DEFAULT
from matchops.functions.numeric import lerp, ping_band
from matchops.operators.numbering import CARRY, CNT, FIRST, PART, SEQ, TOTAL, joined_text, numbered, ranged_pieces
from matchops.operators.players import player_skill
from matchops.session import materialize

LOBBY_COLUMNS = (
    "lobby_name", "region", "ping_band", "skill_tier", "player_count", "status", "player_ids",
)
_BUCKET = ["_iso", "region", "ping_band"]


def _q(q: float) -> float:
    # Series.quantile hands q*100 to NumPy, which divides by 100 again.
    return (q * 100.0) / 100.0


def pools(profile: DataFrame, flagged: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Every non-High player with pool, label and bucket keys."""
    sev = flagged.select("player_id", "severity")
    sk = player_skill(profile).join(sev, "player_id", "left")
    active = sk.filter(F.col("severity").isNull() | (F.col("severity") != "High"))
    iso = F.coalesce(F.col("severity") == "Medium", F.lit(False))
    label = (
        F.when(iso, F.concat("player_id", F.lit(cfg.isolated_tag)))
        .when(F.col("severity") == "Low", F.concat("player_id", F.lit(cfg.low_tag)))
        .otherwise(F.col("player_id"))
    )
    return active.select(
        *player_skill(profile).columns,
        F.col("severity"),
        iso.alias("_iso"),
        label.alias("player_label"),
        F.when(iso, F.lit(cfg.isolated_region)).otherwise(F.col("primary_region")).alias("region"),
        F.when(iso, F.lit(cfg.isolated_band)).otherwise(ping_band("avg_ping", cfg)).alias("ping_band"),
    )


def matching_pool(profile: DataFrame, flagged: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return pools(profile, flagged, cfg).filter(~F.col("_iso")).drop("_iso", "region")


def isolated_pool(profile: DataFrame, flagged: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return pools(profile, flagged, cfg).filter(F.col("_iso")).drop("_iso", "region", "ping_band")


def _ranged(profile: DataFrame, flagged: DataFrame, cfg: Config, region: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The pool in bucket order, and its pieces with the buckets' sizes.

    Buckets are apart by region, so one region is ranged without the others.
    """
    p = pools(profile, flagged, cfg)
    if region is not None:
        p = p.filter(F.col("region") == region)
    p = p.withColumn("_k", F.when(F.col("_iso"), F.lit(0.0)).otherwise(F.col("skill_score")))
    rows, pieces = ranged_pieces(p, [F.col("_k").asc(), F.col("player_id").asc()], _BUCKET)
    tiered = ~F.col("_iso") & (F.col("bucket_size") >= cfg.tier_min_players)
    # One row per bucket and partition, read by every later step.
    return rows, materialize(pieces.withColumnRenamed(TOTAL, "bucket_size").withColumn("_tiered", tiered), "buckets")


def _cuts(rows: DataFrame, pieces: DataFrame, cfg: Config) -> DataFrame:
    """E15 per tiered bucket: values at floor/ceil of (n-1)*q, lerped.

    The pieces tell where in the table those (at most four) rows lie.
    """
    n = F.col("bucket_size")
    wanted, parts = [], {}
    for tag, q in zip(("lo", "hi"), cfg.tier_quantiles, strict=True):
        h = (n - 1).cast("double") * F.lit(_q(q))
        i0 = F.floor(h) + 1
        parts[tag] = (h - F.floor(h)).alias(f"_{tag}_t")
        for name, at in (("i0", i0), ("i1", F.least(i0 + 1, n))):
            wanted.append(F.struct(F.lit(f"_{tag}_{name}v").alias("name"), at.alias("at")))
    places = pieces.filter("_tiered").select(
        PART, *_BUCKET, FIRST, CNT, CARRY, *parts.values(), F.explode(F.array(*wanted)).alias("w"))
    places = places.filter((F.col("w.at") > F.col(CARRY)) & (F.col("w.at") <= F.col(CARRY) + F.col(CNT))).select(
        PART, (F.col(FIRST) + F.col("w.at") - F.col(CARRY) - 1).alias(SEQ), *_BUCKET, "_lo_t", "_hi_t", "w.name")
    picked = rows.select(PART, SEQ, "skill_score").join(places, [PART, SEQ]).groupBy(*_BUCKET).agg(
        *[F.max(F.when(F.col("name") == v, F.col("skill_score"))).alias(v) for v in ("_lo_i0v", "_lo_i1v", "_hi_i0v", "_hi_i1v")],
        F.first("_lo_t").alias("_lo_t"), F.first("_hi_t").alias("_hi_t"),
    )
    return picked.select(
        *_BUCKET,
        lerp(F.col("_lo_i0v"), F.col("_lo_i1v"), F.col("_lo_t")).alias("q_low"),
        lerp(F.col("_hi_i0v"), F.col("_hi_i1v"), F.col("_hi_t")).alias("q_high"),
    )


def bucket_quantiles(profile: DataFrame, flagged: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """E14 + E15: players per (region, band); cut points where tiered."""
    rows, pieces = _ranged(profile, flagged, cfg)
    sizes = pieces.filter(~F.col("_iso")).groupBy("region", "ping_band").agg(F.sum(CNT).alias("players"))
    cuts = _cuts(rows, pieces, cfg).select("region", "ping_band", "q_low", "q_high")
    return sizes.join(cuts, ["region", "ping_band"], "left")


def _seated(profile: DataFrame, flagged: DataFrame, cfg: Config, region: str | None = None) -> DataFrame:
    """M4, M5, F8: the numbered pool with tier and lobby name.

    Sizes and cuts come with the pieces, in the one join that numbers the rows.
    """
    rows, pieces = _ranged(profile, flagged, cfg, region)
    pieces = pieces.join(_cuts(rows, pieces, cfg), _BUCKET, "left")
    m = numbered(rows, pieces, _BUCKET, "bucket_pos", ["_tiered", "q_low", "q_high"])
    tier = (
        F.when(F.col("_iso"), F.lit(cfg.isolated_tier))
        .when(~F.col("_tiered"), F.lit(cfg.mixed_tier))
        .when(F.col("skill_score") <= F.col("q_low"), F.lit("Beginner"))
        .when(F.col("skill_score") <= F.col("q_high"), F.lit("Intermediate"))
        .otherwise(F.lit("Advanced"))
    )
    return m.withColumn("skill_tier", tier).withColumn(
        "lobby_name",
        F.when(F.col("_iso"), F.lit(cfg.isolated_lobby))
        .otherwise(F.concat_ws("_", "region", "ping_band", "skill_tier")),
    )


def _small() -> Column:
    """Rows of a bucket without tiers: fewer than ``tier_min_players``, listed by id."""
    return ~F.col("_iso") & ~F.col("_tiered")


def lobby_names(profile: DataFrame, flagged: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The names of all lobbies, without their rosters."""
    return _seated(profile, flagged, cfg).select("lobby_name").distinct()


def regions_with_lobbies(profile: DataFrame, flagged: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """H4: distinct lobby regions, without the isolated pool's label.  Every
    pooled player has a lobby, so the pool has all of them."""
    return pools(profile, flagged, cfg).filter(~F.col("_iso")).select("region").distinct()


def lobby_members(profile: DataFrame, flagged: DataFrame, cfg: Config = DEFAULT, region: str | None = None) -> DataFrame:
    """One row per lobby member with its roster position."""
    m = _seated(profile, flagged, cfg, region)
    # Tiers are contiguous ranges of the bucket order, so the roster
    # position is the bucket position minus the tier's first position; the
    # same per-lobby aggregate gives the lobby size, and the few ids of a
    # lobby without tiers.
    per_lobby = m.groupBy(*_BUCKET, "skill_tier").agg(
        F.min("bucket_pos").alias("_first"), F.count(F.lit(1)).alias("player_count"),
        F.array_sort(F.collect_list(F.when(_small(), F.col("player_id")))).alias("_ids"))
    position = F.when(_small(), F.array_position("_ids", F.col("player_id"))).otherwise(F.col("bucket_pos") - F.col("_first") + 1)
    m = m.join(per_lobby, [*_BUCKET, "skill_tier"])
    return m.select(
        "lobby_name", "region", "ping_band", "skill_tier", "player_id", "player_label",
        position.alias("position"),
        F.col("player_count").cast("long").alias("player_count"),
        "skill_score", "avg_score", "avg_kills", "avg_deaths", "avg_ping",
        F.col("primary_region"), "device",
    )


def lobbies(profile: DataFrame, flagged: DataFrame, cfg: Config = DEFAULT, region: str | None = None) -> DataFrame:
    """One row per lobby; with a region (V2)
    only its lobbies, ``All`` means every one."""
    m = _seated(profile, flagged, cfg, None if region == "All" else region)
    keys = ["lobby_name", "region", "ping_band", "skill_tier"]
    # Bucket positions order a lobby as well as its own would; a small one goes by id alone.
    m = m.withColumn("_order", F.when(_small(), F.lit(1)).otherwise(F.col("bucket_pos")))
    rosters = joined_text(m, keys, "_order", "player_label", cfg.roster_separator, cfg.text_segment, "player_ids",
                          count="player_count", tie_col="player_id")
    status = (
        F.when(F.col("lobby_name") == cfg.isolated_lobby, F.lit(cfg.isolated_status))
        .when(F.col("player_count") >= cfg.lobby_ready_size, F.lit("Ready"))
        .otherwise(F.lit("Waiting"))
    )
    return rosters.select(
        "lobby_name", "region", "ping_band", "skill_tier", "player_count",
        status.alias("status"), "player_ids",
    )


def order_lobbies(lobby_df: DataFrame) -> DataFrame:
    """G6."""
    return lobby_df.orderBy("lobby_name")
