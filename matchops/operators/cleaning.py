"""Raw records -> clean matches.

Order follows the published behaviour: null ids, numeric coercion,
domain predicate, integer truncation, keep-first dedup on the raw ids,
then trimming / title-casing and the derived rates.  Every predicate is a
plain Column so Catalyst can push it into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchops.config import Config, DEFAULT
from matchops.functions.numeric import is_finite, kd_ratio, parse_number, safe_rate
from matchops.functions.text import normalize_label, null_if_token, strip_ws

CLEAN_COLUMNS = (
    "player_id", "match_id", "region", "device", "ping", "score", "kills",
    "deaths", "match_duration_seconds", "score_per_second", "kd_ratio",
)
INT_COLUMNS = ("ping", "kills", "deaths", "match_duration_seconds")
REASONS = ("null_id", "non_numeric", "out_of_domain", "non_finite", "duplicate", "kept")


def normalize_nulls(raw: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A3: CSV missing-value tokens become NULL in every required column."""
    return raw.select(*[
        null_if_token(c, cfg.null_tokens).alias(c) if c in cfg.required_columns else F.col(c)
        for c in raw.columns
    ])


def domain_ok(cfg: Config = DEFAULT) -> Column:
    """B4 on the parsed doubles."""
    return (
        (F.col("match_duration_seconds") > 0)
        & (F.col("ping") >= 0) & (F.col("score") >= 0)
        & (F.col("kills") >= 0) & (F.col("deaths") >= 0)
    )


def tag_rows(raw: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Parse numerics and tag each row with its first failing check.

    ``drop_reason`` is NULL for rows that pass every filter (they may still
    lose the dedup).  Integers are truncated toward zero; an infinite or
    out-of-range value in an integer column is ``non_finite``.
    """
    df = normalize_nulls(raw, cfg)
    parsed = df.select(
        *[F.col(c) for c in df.columns if c not in cfg.numeric_columns],
        *[parse_number(c).alias(c) for c in cfg.numeric_columns],
    )
    any_null_num = F.lit(False)
    for c in cfg.numeric_columns:
        any_null_num = any_null_num | F.col(c).isNull()
    ints_ok = F.lit(True)
    for c in INT_COLUMNS:
        ints_ok = ints_ok & is_finite(c) & F.col(c).try_cast("bigint").isNotNull()
    reason = (
        F.when(F.col("player_id").isNull() | F.col("match_id").isNull(), F.lit("null_id"))
        .when(any_null_num, F.lit("non_numeric"))
        .when(~domain_ok(cfg), F.lit("out_of_domain"))
        .when(~ints_ok, F.lit("non_finite"))
    )
    return parsed.withColumn("drop_reason", reason)


def finish(valid: DataFrame, cfg: Config) -> DataFrame:
    """B5, B8–B12 on rows that passed the filters."""
    pid = F.col("player_id")
    mid = F.col("match_id")
    out = valid.select(
        strip_ws(pid).alias("player_id"),
        strip_ws(mid).alias("match_id"),
        normalize_label("region", cfg.null_label).alias("region"),
        normalize_label("device", cfg.null_label).alias("device"),
        F.col("ping").cast("bigint").alias("ping"),
        F.col("score").cast("double").alias("score"),
        F.col("kills").cast("bigint").alias("kills"),
        F.col("deaths").cast("bigint").alias("deaths"),
        F.col("match_duration_seconds").cast("bigint").alias("match_duration_seconds"),
        *[F.col(c) for c in valid.columns if c in ("ingest_seq", "created_at")],
    )
    return with_derived(out)


def with_derived(df: DataFrame) -> DataFrame:
    """B11, B12 (M1 for a zero duration)."""
    return df.withColumn(
        "score_per_second", safe_rate("score", "match_duration_seconds")
    ).withColumn("kd_ratio", kd_ratio("kills", "deaths"))


def _candidates(raw: DataFrame, cfg: Config, trim_ids: bool) -> DataFrame:
    """(key, payload-if-valid, ordinal-if-valid) for the dedup aggregate.

    Invalid rows keep a NULL ordinal, which min_by / max_by skip.  No
    Filter sits below the aggregate: pushing one down would inline every
    parse expression into the scan predicate once per reference.
    """
    tagged = tag_rows(raw, cfg)
    valid = F.col("drop_reason").isNull()
    pid, mid = F.col("player_id"), F.col("match_id")
    if trim_ids:
        pid, mid = strip_ws(pid), strip_ws(mid)
    extra = [c for c in ("ingest_seq", "created_at") if c in tagged.columns]
    payload = F.struct(
        "region", "device",
        *[F.col(c).try_cast("bigint").alias(c) if c in INT_COLUMNS else F.col(c)
          for c in cfg.numeric_columns],
        *extra,
    )
    return tagged.select(
        pid.alias("player_id"), mid.alias("match_id"),
        F.when(valid, payload).alias("_row"), F.when(valid, F.col("ingest_seq")).alias("_ord"),
    )


def dedup(cands: DataFrame, keep: str = "first") -> DataFrame:
    """B6 / B7 as an aggregate: min_by / max_by over the ordinal.

    A grouped aggregate combines map-side, so a key repeated a million
    times never meets in one task (a window would sort them together).
    """
    pick = F.min_by if keep == "first" else F.max_by
    agg = cands.groupBy("player_id", "match_id").agg(pick("_row", "_ord").alias("_row"))
    kept = agg.filter(F.col("_row").isNotNull())
    fields = [f.name for f in cands.schema["_row"].dataType.fields]
    return kept.select("player_id", "match_id", *[F.col(f"_row.{c}").alias(c) for c in fields])


def clean_matches(raw: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Raw all-string records (+ ingest_seq) -> clean matches."""
    kept = dedup(_candidates(raw, cfg, cfg.dedup_after_trim), keep="first")
    return finish(kept, cfg)


def drop_accounting(raw: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A5: rows per outcome (first failing check, duplicate, kept) + input.

    One aggregate: counts per reason, and the distinct valid keys.
    """
    tagged = tag_rows(raw, cfg)
    pid, mid = F.col("player_id"), F.col("match_id")
    if cfg.dedup_after_trim:
        pid, mid = strip_ws(pid), strip_ws(mid)
    r = F.col("drop_reason")
    checks = [x for x in REASONS if x not in ("duplicate", "kept")]
    agg = tagged.agg(
        F.count(F.lit(1)).alias("input"),
        *[F.count_if(r == x).alias(x) for x in checks],
        F.count_if(r.isNull()).alias("_valid"),
        F.count_distinct(F.when(r.isNull(), F.struct(pid, mid))).alias("kept"),
    )
    rows = [F.struct(F.lit(x).alias("outcome"), F.col(x).cast("long").alias("rows")) for x in checks]
    rows += [
        F.struct(F.lit("duplicate").alias("outcome"), (F.col("_valid") - F.col("kept")).cast("long").alias("rows")),
        F.struct(F.lit("kept").alias("outcome"), F.col("kept").cast("long").alias("rows")),
        F.struct(F.lit("input").alias("outcome"), F.col("input").cast("long").alias("rows")),
    ]
    out = agg.select(F.explode(F.array(*rows)).alias("o")).select("o.outcome", "o.rows")
    # Checks that never fired are not listed (a GROUP BY would not list them).
    return out.filter((F.col("rows") > 0) | F.col("outcome").isin("duplicate", "kept", "input"))


def latest_submission_wins(raw: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """B7 + H3: valid rows, re-sent keys resolved to the newest ordinal.

    Submissions are normalized on arrival, so the key is the trimmed id.
    """
    kept = dedup(_candidates(raw, cfg, True), keep="last")
    return finish(kept, cfg)


def parsed_numbers(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The numeric columns read from their text, NULL where that fails."""
    return df.withColumns({c: parse_number(c) for c in cfg.numeric_columns})


def reject_reason(cfg: Config = DEFAULT) -> Column:
    """Why a submitted text record is rejected (NULL: it is accepted).

    Text fields are required (blank ones count as given); ping, kills, deaths
    and duration must be whole numbers, the score any number; ping, score,
    kills, deaths >= 0 and duration > 0.
    """
    num = {c: parse_number(c) for c in cfg.numeric_columns}
    missing = F.lit(False)
    for c in ("player_id", "match_id", "region", "device"):
        missing = missing | F.col(c).isNull()
    bad_type = F.lit(False)
    for c in cfg.numeric_columns:
        bad_type = bad_type | num[c].isNull()
    for c in INT_COLUMNS:
        bad_type = bad_type | ~is_finite(num[c]) | (num[c] != F.floor(num[c]).cast("double")) | num[c].try_cast("bigint").isNull()
    out_of_range = (
        (num["ping"] < 0) | (num["score"] < 0) | (num["kills"] < 0) | (num["deaths"] < 0)
        | (num["match_duration_seconds"] <= 0)
    )
    return (
        F.when(missing, F.lit("missing_field"))
        .when(bad_type, F.lit("bad_type"))
        .when(out_of_range, F.lit("out_of_range"))
    )


def quarantine(raw: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Every submitted record with ``status`` and ``reason``."""
    reason = reject_reason(cfg)
    return raw.select(
        "player_id", "match_id", "ingest_seq",
        F.when(reason.isNull(), F.lit("accepted")).otherwise(F.lit("rejected")).alias("status"),
        reason.alias("reason"),
    )
