"""Skew-aware equi-join of a fact table to a per-key table (salting).

A key is "hot" when its fact rows exceed both ``hot_key_min_rows`` and one
``hot_key_shares``-th of all rows.  Fewer than ``hot_key_shares`` keys can
hold so much, so the table of hot keys is bounded without a limit, and every
key that is not in it has a small share.  A hot key gets ceil(rows /
that size) salts: its fact rows spread over that many join keys (key, salt)
by a hash of a unique column, and its per-key row is repeated once per salt.
Every other key has the single salt 0.  The plan is one scan of the fact
table, a map-side broadcast tag, and one shuffle join on (key, salt) — a key
with a third of all rows lands on many reducers instead of one, whether or
not the per-key table has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchops.config import Config, DEFAULT

_SALTS, _SALT = "_salts", "_salt"


def hot_keys(counts: DataFrame, key: str, count_col: str, cfg: Config = DEFAULT) -> DataFrame:
    """(key, salts) of the hot keys; ``counts`` has one row for every key of the fact table."""
    share = counts.agg(F.sum(count_col) / F.lit(float(cfg.hot_key_shares))).scalar()
    sized = counts.select(key, F.col(count_col).alias("_rows"),
                          F.greatest(F.lit(float(cfg.hot_key_min_rows)), share).alias("_size"))
    return sized.filter(F.col("_rows") > F.col("_size")).select(
        key, F.ceil(F.col("_rows") / F.col("_size")).cast("int").alias(_SALTS))


def salted_join(fact: DataFrame, per_key: DataFrame, counts: DataFrame, key: str, count_col: str,
                spread_col: str, how: str = "left", cfg: Config = DEFAULT) -> DataFrame:
    """``fact JOIN per_key USING (key)`` with hot keys spread over salts.

    ``counts`` holds the fact rows of every key, also of those that
    ``per_key`` lacks.  ``spread_col`` should be (close to) unique per fact
    row, e.g. a match id.
    """
    hot = F.broadcast(hot_keys(counts, key, count_col, cfg))  # fewer than hot_key_shares rows
    tagged = fact.join(hot, key, "left").select(
        *fact.columns,
        F.when(F.col(_SALTS).isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64(F.col(spread_col)), F.col(_SALTS)).cast("int"))
        .alias(_SALT),
    )
    expanded = per_key.join(hot, key, "left").select(
        *per_key.columns,
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1)).alias(_SALT),
    )
    return tagged.join(expanded, [key, _SALT], how).drop(_SALT)
