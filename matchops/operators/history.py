"""Historical outliers (D1–D4, F7): per-player z-scores joined back.

Moments come from the single player aggregate.  Only players that can
flag at all are joined back: histories long enough for |z| to exceed the
limit ((n-1)/sqrt(n) > limit, n >= 11 for 3.0) whose max or min already
exceeds it — exact prunings that cannot change a flag, and a smaller
build side that AQE can broadcast.

``match_flags`` gives every match with its flags; its join salts hot players
over many reducers, candidates or not (see ``joins``).  The reports need
flagged matches only, and for them (``flagged_matches``) the match table is
not shuffled: matches of other players are decided by the rules where they
are scanned, and matches of candidates by an inner join, which is a broadcast
or, past its limit, one that Spark prunes by a runtime filter of the
candidates; what a hot candidate leaves there, Spark's skew join splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchops.config import Config, DEFAULT
from matchops.functions.text import fixed2
from matchops.operators.joins import salted_join
from matchops.operators.players import z_candidates
from matchops.operators.rules import DEFAULT_RULES, FLAG_TYPE, flag_struct, rule_flags

# --- fixed values: z-score messages -----------------------------------
_Z_TEXT = {
    "Z_SCORE": "Historical score outlier: Z-Score = ",
    "Z_KILLS": "Historical kills outlier: Z-Score = ",
}


def _z_flag(code: str, x: str, mean: str, std: str, cfg: Config) -> Column:
    z = (F.col(x).cast("double") - F.col(mean)) / F.col(std)
    fires = F.col(std).isNotNull() & (F.col(std) > 0) & (F.abs(z) > cfg.z_limit)
    text = F.concat(F.lit(_Z_TEXT[code]), fixed2(z), F.lit(f" (Limit: +/-{cfg.z_limit})"))
    return F.when(fires, flag_struct(code, "Low", False, z, text))


def stat_flags(cfg: Config = DEFAULT) -> Column:
    return F.array_compact(F.array(
        _z_flag("Z_SCORE", "score", "mean_score", "std_score", cfg),
        _z_flag("Z_KILLS", "kills", "mean_kills", "std_kills", cfg),
    ))


_MOMENTS = ("mean_score", "std_score", "mean_kills", "std_kills")


def _base(matches: DataFrame) -> DataFrame:
    return matches.select(
        "player_id", "match_id", "score", "kills", "deaths", "ping",
        "match_duration_seconds", "score_per_second",
        *[c for c in ("created_at",) if c in matches.columns],
    )


def _with_flags(joined: DataFrame, columns: list[str], cfg: Config, rules) -> DataFrame:
    out = joined.select(*columns, rule_flags(cfg, rules).alias("rule_flags"), stat_flags(cfg).alias("stat_flags"), *_MOMENTS)
    return out.withColumn("all_flags", F.concat("rule_flags", "stat_flags"))


def match_flags(matches: DataFrame, profile: DataFrame, cfg: Config = DEFAULT,
                rules=DEFAULT_RULES) -> DataFrame:
    """Per match: rule_flags, stat_flags and all_flags (rules first)."""
    moments = z_candidates(profile, cfg).drop("matches_played")
    base = _base(matches)
    joined = salted_join(base, moments, profile, "player_id", "matches_played", "match_id", "left", cfg)
    return _with_flags(joined, base.columns, cfg, rules)


def flagged_matches(matches: DataFrame, profile: DataFrame, cfg: Config = DEFAULT,
                    rules=DEFAULT_RULES) -> DataFrame:
    """The rows of ``match_flags`` that have a flag, without a shuffle of all matches."""
    base, moments = _base(matches), z_candidates(profile, cfg).drop("matches_played")
    of_candidates = _with_flags(base.join(moments, "player_id"), base.columns, cfg, rules).filter(F.size("all_flags") > 0)
    fires = reduce(lambda a, b: a | b, [F.coalesce(r.predicate(cfg), F.lit(False)) for r in rules], F.lit(False))
    by_rule = base.filter(fires).join(moments.select("player_id"), "player_id", "left_anti").select(
        *base.columns, rule_flags(cfg, rules).alias("rule_flags"), F.array().cast(f"array<{FLAG_TYPE}>").alias("stat_flags"),
        *[F.lit(None).cast("double").alias(c) for c in _MOMENTS])
    return by_rule.withColumn("all_flags", F.col("rule_flags")).union(of_candidates)


def zscore_outliers(flags: DataFrame) -> DataFrame:
    """D2–D4 long form: one row per (match, z flag)."""
    return flags.select("player_id", "match_id", F.explode("stat_flags").alias("f")).select(
        "player_id", "match_id", F.col("f.code").alias("stat_code"),
        F.round(F.col("f.observed"), 6).alias("z"),
    )
