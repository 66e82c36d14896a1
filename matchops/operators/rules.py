"""Per-match rules (C1–C5) as a declarative list of Column predicates.

A rule yields a struct ``(code, severity, is_gameplay, observed, text)``
when it fires; ``rule_flags`` is the array of fired structs in rule
order.  The same list serves batch and streaming plans, and callers can
pass their own list.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchops.config import Config, DEFAULT
from matchops.functions.text import fixed2, float_text

SEVERITY_RANK = {"Low": 1, "Medium": 2, "High": 3}

FLAG_TYPE = (
    "struct<code:string,severity:string,is_gameplay:boolean,observed:double,text:string>"
)


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    is_gameplay: bool
    predicate: Callable[[Config], Column]
    observed: Callable[[Config], Column]
    text: Callable[[Config], Column]


def _num(x: float) -> str:
    """A config limit as it appears in the message (50, not 50.0)."""
    return str(int(x)) if float(x).is_integer() else repr(x)


def _s(c: str) -> Column:
    return F.col(c).cast("string")


# --- fixed values: rule messages (text must match the reports) --------
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        "SCORE_RATE", "High", True,
        lambda c: F.col("score_per_second") > c.rate_limit,
        lambda c: F.col("score_per_second"),
        lambda c: F.concat(F.lit("Score rate spike: "), fixed2("score_per_second"),
                           F.lit(f" score/sec (Limit: {_num(c.rate_limit)})")),
    ),
    Rule(
        "ZERO_DEATH", "High", True,
        lambda c: (F.col("kills") >= c.zero_death_min_kills) & (F.col("deaths") == 0),
        lambda c: F.col("kills").cast("double"),
        lambda c: F.concat(F.lit("High-kill zero-death K/D: "), _s("kills"), F.lit(" kills, 0 deaths")),
    ),
    Rule(
        "SHORT_HIGH", "Medium", True,
        lambda c: (F.col("match_duration_seconds") < c.short_match_seconds)
        & (F.col("score") > c.short_match_score),
        lambda c: F.col("score"),
        lambda c: F.concat(F.lit("Short match high score: "), float_text("score"), F.lit(" score in "),
                           _s("match_duration_seconds"), F.lit("s")),
    ),
    Rule(
        "EXTREME_KILLS", "Medium", True,
        lambda c: F.col("kills") > c.extreme_kills,
        lambda c: F.col("kills").cast("double"),
        lambda c: F.concat(F.lit("Extreme kills: "), _s("kills"),
                           F.lit(f" kills in a match (Limit: {_num(c.extreme_kills)})")),
    ),
    Rule(
        "PING", "Low", False,
        lambda c: (F.col("ping") < c.ping_min) | (F.col("ping") > c.ping_max),
        lambda c: F.col("ping").cast("double"),
        lambda c: F.concat(F.lit("Ping anomaly: "), _s("ping"),
                           F.lit(f"ms (Limits: {_num(c.ping_min)}-{_num(c.ping_max)}ms)")),
    ),
)


def flag_struct(code: str, severity: str, is_gameplay: bool, observed: Column, text: Column) -> Column:
    return F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"),
        F.lit(is_gameplay).alias("is_gameplay"), observed.cast("double").alias("observed"),
        text.alias("text"),
    )


def rule_flags(cfg: Config = DEFAULT, rules=DEFAULT_RULES) -> Column:
    """ARRAY of fired rule structs, in rule order (empty when none)."""
    fired = [
        F.when(r.predicate(cfg), flag_struct(r.code, r.severity, r.is_gameplay, r.observed(cfg), r.text(cfg)))
        for r in rules
    ]
    return F.array_compact(F.array(*fired)) if fired else F.array().cast(f"array<{FLAG_TYPE}>")


def with_rule_flags(matches: DataFrame, cfg: Config = DEFAULT, rules=DEFAULT_RULES) -> DataFrame:
    return matches.withColumn("rule_flags", rule_flags(cfg, rules))


def rule_flags_long(matches: DataFrame, cfg: Config = DEFAULT, rules=DEFAULT_RULES) -> DataFrame:
    """One row per (match, fired rule): the alert stream shape (one scan)."""
    return matches.select(
        "player_id", "match_id", F.explode(rule_flags(cfg, rules)).alias("f")
    ).select(
        "player_id", "match_id", F.col("f.code").alias("rule_code"),
        F.col("f.severity").alias("severity"), F.col("f.is_gameplay").alias("is_gameplay"),
        F.col("f.observed").alias("observed"), F.col("f.text").alias("reason"),
    )
