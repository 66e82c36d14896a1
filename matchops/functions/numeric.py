"""Numeric Column helpers (parsing, derived metrics, bands, skill)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchops.config import Config, DEFAULT

# What a numeric text field may look like: optional surrounding ASCII
# whitespace, sign, digits, dot, exponent, or inf/infinity/nan.  Spark's
# cast alone would also take ``5d``/``5f`` suffixes, so the pattern gates it.
_NUMERIC_RE = (
    r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*$"
)


def parse_number(x) -> Column:
    """Text -> DOUBLE; unparsable or NaN -> NULL (``to_numeric(coerce)``).

    One compact expression (gate, cast, NaN -> NULL): the optimizer may
    inline it into several predicates, so it must stay small.
    """
    c = F.col(x) if isinstance(x, str) else x
    v = F.when(c.rlike(_NUMERIC_RE), c.try_cast("double"))
    return F.nanvl(v, F.lit(None).cast("double"))


def is_finite(x) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def safe_rate(score, duration) -> Column:
    """score / duration with float semantics for a zero duration.

    x/0 -> +Infinity for x > 0; 0/0 (NaN) -> NULL, so it never passes a
    ``>`` limit (Spark and DuckDB order NaN above every number).
    """
    s = F.col(score) if isinstance(score, str) else score
    d = F.col(duration) if isinstance(duration, str) else duration
    return (
        F.when(d > 0, s.cast("double") / d.cast("double"))
        .when(s > 0, F.lit(float("inf")))
        .otherwise(F.lit(None).cast("double"))
    )


def kd_ratio(kills, deaths) -> Column:
    k = F.col(kills) if isinstance(kills, str) else kills
    d = F.col(deaths) if isinstance(deaths, str) else deaths
    return k.cast("double") / F.greatest(d, F.lit(1)).cast("double")


def ping_band(avg_ping, cfg: Config = DEFAULT) -> Column:
    p = F.col(avg_ping) if isinstance(avg_ping, str) else avg_ping
    return (
        F.when(p <= cfg.low_ping_max, F.lit("LowPing"))
        .when(p <= cfg.med_ping_max, F.lit("MedPing"))
        .otherwise(F.lit("HighPing"))
    )


def skill_score(avg_score, avg_kills, avg_deaths, cfg: Config = DEFAULT) -> Column:
    ws, wk, wd = cfg.skill_weights
    c = [F.col(x) if isinstance(x, str) else x for x in (avg_score, avg_kills, avg_deaths)]
    return c[0] * F.lit(ws) + c[1] * F.lit(wk) + c[2] * F.lit(wd)


def lerp(a, b, t) -> Column:
    """Linear interpolation the way NumPy's ``quantile`` does it.

    a + (b-a)*t below t = 0.5, b - (b-a)*(1-t) from there on, which is
    what pandas' Series.quantile returns bit for bit.
    """
    diff = b - a
    return F.when(t < 0.5, a + diff * t).otherwise(b - diff * (F.lit(1.0) - t))
