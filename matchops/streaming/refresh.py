"""Incremental refreshes (J5, J6): z-scores and the top of the board, kept batch by batch.

Every match comes once (a copy that is sent again is dropped on arrival, as in
J3).  A batch changes only what it touches, in versioned tables below one
folder; none of it reads the match history as a whole:

* ``history`` — the matches, partitioned by a hash of the player;
* ``players`` — a row per player: number of matches, mean and M2 (the sum of
  squared distances from the mean) of score and kills, extremes, exact totals,
  flags.  The batch's own moments join the row's by pairwise combination;
* ``outliers`` — the z flags of a player as of a batch.  A player's flags
  change only with his moments, so only touched players are looked at, of
  these only those whose extremes pass the limit, and of the history only
  their partitions;
* ``slots`` — the clean players per slot of total scores (eighths of a power
  of two), changed by what the batch moves out of and into a slot;
* ``regions`` — matches per player and region;
* ``top`` — the first k of the board: players of the highest slots that hold k
  clean ones are ranked, and only if the batch touched one of these slots.
  It is replaced as a whole.

Each table is published under the job's name and the batch's number, and a
retried batch leaves its own earlier rows out of what it reads, so a job that
stopped anywhere goes on with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from matchops.config import Config, DEFAULT
from matchops.operators.cleaning import with_derived
from matchops.operators.history import stat_flags
from matchops.operators.players import exact_parts, exact_value, extremes_fire
from matchops.operators.ranking import BOARD_COLUMNS, rank_order
from matchops.operators.rules import rule_flags
from matchops.session import materialize
from matchops.sources import store
from matchops.sources.store import Spec
from matchops.streaming import plans

BUCKETS = 64  # partitions of the history
SLOTS_PER_DOUBLING = 8
FLAGGED = -1  # the slot of players under review
MERGE_ABOVE = 16

HISTORY = Spec(("player_id", "match_id"), ("bucket",))
PLAYERS = Spec(("player_id",), ("slot",))
OUTLIERS = Spec(("player_id", "match_id", "stat_code"))
SLOTS = Spec(("slot",))
REGIONS = Spec(("player_id", "region"))
TOP = Spec(("player_id",))
TABLES = {"history": HISTORY, "players": PLAYERS, "outliers": OUTLIERS, "slots": SLOTS, "regions": REGIONS}

_MEASURES = ("score", "kills")
_TOTALS = ("total_fine", "total_whole", "total_huge", "total_kills", "total_deaths")


def slot(total: Column) -> Column:
    """A whole number that never falls as the total rises."""
    return F.floor(F.log2(F.greatest(total, F.lit(0.0)) + 1) * SLOTS_PER_DOUBLING).cast("int")


def batch_moments(rows: DataFrame, cfg: Config) -> DataFrame:
    """Per player of a batch: n, mean and M2 of the measures, extremes, totals."""
    hit = F.size(rule_flags(cfg)) > 0
    own = with_derived(rows).groupBy("player_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(hit).alias("rule_flagged"),
        *[f.alias(c) for c, f in exact_parts("score", "total").items()],
        F.sum("kills").cast("long").alias("total_kills"), F.sum("deaths").cast("long").alias("total_deaths"),
        *[F.avg(x).alias(f"{x}_mean") for x in _MEASURES],
        *[(F.var_pop(x) * F.count(x)).alias(f"{x}_m2") for x in _MEASURES],
        *[f(x).cast("double").alias(f"{x}_{e}") for x in _MEASURES for e, f in (("max", F.max), ("min", F.min))])
    return own


def combined(own: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """Rows of ``own`` joined with what is known of the player: n, mean and M2
    by pairwise combination, the rest by sum and extreme."""
    if earlier is None:
        return own.withColumn("was", F.lit(None).cast("int"))
    known = earlier.select("player_id", F.col("slot").alias("was"), *[F.col(c).alias(f"_{c}") for c in own.columns if c != "player_id"])
    both = own.join(known, "player_id", "left")
    a, b = F.coalesce(F.col("_n"), F.lit(0)).cast("double"), F.col("n").cast("double")
    new = {"n": F.col("n") + F.coalesce("_n", F.lit(0)), "rule_flagged": F.col("rule_flagged") | F.coalesce("_rule_flagged", F.lit(False))}
    for x in _MEASURES:
        mean, m2 = F.coalesce(f"_{x}_mean", F.lit(0.0)), F.coalesce(f"_{x}_m2", F.lit(0.0))
        apart = F.col(f"{x}_mean") - mean
        new[f"{x}_mean"] = mean + apart * b / (a + b)
        new[f"{x}_m2"] = F.col(f"{x}_m2") + m2 + apart * apart * a * b / (a + b)
        new[f"{x}_max"] = F.greatest(f"{x}_max", f"_{x}_max")
        new[f"{x}_min"] = F.least(f"{x}_min", f"_{x}_min")
    for c in _TOTALS:
        kind = dict(own.dtypes)[c]
        addend = kind.replace("decimal(38", "decimal(37")  # their sum keeps all places
        new[c] = (F.col(c).cast(addend) + F.coalesce(F.col(f"_{c}"), F.lit(0)).cast(addend)).cast(kind)
    return both.select("player_id", "was", *[new[c].alias(c) for c in own.columns if c != "player_id"])


def moments(players: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """D1 from the kept rows: history length, means, sample deviations."""
    spread = {x: F.when(F.col("n") > 1, F.sqrt(F.col(f"{x}_m2") / (F.col("n") - 1))) for x in _MEASURES}
    enough = F.col("n") >= cfg.z_min_history
    return players.select(
        "player_id", F.col("n").alias("matches_played"),
        *[F.when(enough, F.col(f"{x}_mean")).alias(f"mean_{x}") for x in _MEASURES],
        *[F.when(enough, spread[x]).alias(f"std_{x}") for x in _MEASURES],
        *[F.col(f"{x}_{e}").alias(f"{e}_{x}") for x in _MEASURES for e in ("max", "min")])


def _publish(df: DataFrame, base: str, table: str, spec: Spec, writer: str, batch: int) -> None:
    store.append(df, f"{base}/{table}", spec, writer, batch)


def _earlier(spark: SparkSession, base: str, table: str, spec: Spec, writer: str, batch: int) -> DataFrame | None:
    return store.newest(spark, f"{base}/{table}", spec, without=(writer, batch))


def _outliers(spark: SparkSession, base: str, touched: DataFrame, cfg: Config, batch: int) -> DataFrame:
    """z flags of the touched players: their extremes choose the players, and
    these the partitions of the history."""
    known = moments(touched, cfg)
    chosen = known.where((F.col("matches_played") >= cfg.z_min_matches) & extremes_fire(cfg)).withColumn(
        "bucket", _bucket()).select("player_id", "bucket", "mean_score", "std_score", "mean_kills", "std_kills")
    buckets = [r.bucket for r in chosen.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    rows = store.read(spark, f"{base}/history", HISTORY, where={"bucket": buckets}, only=chosen.select("player_id"))
    return rows.join(chosen, ["player_id", "bucket"]).select("player_id", "match_id", F.explode(stat_flags(cfg)).alias("f")).select(
        "player_id", "match_id", F.col("f.code").alias("stat_code"), F.col("f.observed").alias("z"), F.lit(batch).cast("long").alias("as_of"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("player_id"), F.lit(BUCKETS)).cast("int")


def _add_counts(df: DataFrame, earlier: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, n): the changes in ``df`` added to earlier counts of the same keys."""
    if earlier is None:
        return df
    known = earlier.select(*keys, F.col("n").alias("_n"))
    return df.join(known, keys, "left").select(*keys, (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))


def _rank(spark: SparkSession, base: str, slots: list[int], k: int) -> DataFrame:
    """The first k players of some slots in the board's columns."""
    rows = store.read(spark, f"{base}/players", PLAYERS, where={"slot": slots}).select(
        "player_id", exact_value("total").alias("total_score"), "total_kills", "total_deaths", F.col("n").alias("matches_played"),
        F.when(F.col("slot") == FLAGGED, F.lit("under_review")).otherwise(F.lit("clean")).alias("status"))
    order = [(F.col("status") != "clean").asc(), *rank_order()]
    head = rows.orderBy(*order).limit(k).withColumn("_at", F.row_number().over(Window.orderBy(*order)))  # k rows only
    seen = store.read(spark, f"{base}/regions", REGIONS).join(F.broadcast(head.select("player_id")), "player_id")
    first = seen.groupBy("player_id").agg(F.min_by("region", F.struct(-F.col("n"), F.col("region"))).alias("_region"))
    return head.join(first, "player_id", "left").select(
        F.when(F.col("status") == "clean", F.col("_at")).cast("long").alias("rank"), "player_id", "total_score", "total_kills", "total_deaths",
        "matches_played", F.coalesce("_region", F.lit(DEFAULT.unknown_label)).alias("primary_region"),
        (F.col("total_score") / F.col("matches_played")).alias("avg_score_per_match"), "status").select(*BOARD_COLUMNS)


def top_slots(counts: dict[int, int], k: int) -> list[int]:
    """The highest slots that hold k clean players together; all, with the
    flagged ones, if there are not so many."""
    out, held = [], 0
    for s in sorted((s for s, n in counts.items() if s != FLAGGED and n > 0), reverse=True):
        out.append(s)
        held += counts[s]
        if held >= k:
            return out
    return [*out, FLAGGED]


def _by_bucket(rows: DataFrame) -> DataFrame:
    """Dealt out so that a task holds one or few buckets, and a bucket goes to
    several tasks if there are more of them: about one file a task."""
    tasks = max(BUCKETS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "bucket", F.pmod(F.xxhash64("match_id"), F.lit(tasks // BUCKETS)))


def apply_batch(batch: DataFrame, number: int, base: str, writer: str, cfg: Config = DEFAULT, k: int = 100,
                spark: SparkSession | None = None) -> dict:
    """Take one batch into all tables; says what it touched.

    Only the history is written by the session of the stream, which has no
    adaptive execution and so a task and its files for each state partition,
    however small.  All else reads tables, in the session ``spark``."""
    spark = spark or batch.sparkSession
    columns = ["player_id", "match_id", "region", "score", "kills", "deaths", "ping", "match_duration_seconds"]
    store.append(_by_bucket(batch.select(*columns, _bucket().alias("bucket"))), f"{base}/history", HISTORY, writer, number)
    fresh = store.batch_rows(spark, f"{base}/history", HISTORY, writer, number)

    if store.exists(spark, f"{base}/top") and fresh.isEmpty():  # a batch that only moves the watermark
        return {"slots": [], "ranked": False}
    earlier = _earlier(spark, base, "players", PLAYERS, writer, number)
    touched = materialize(combined(batch_moments(fresh, cfg), earlier), "touched")
    _publish(_outliers(spark, base, touched, cfg, number), base, "outliers", OUTLIERS, writer, number)
    marked = store.read(spark, f"{base}/outliers", OUTLIERS).where(F.col("as_of") == number).select(
        "player_id", F.lit(True).alias("z_flagged")).distinct()
    flagged = F.col("rule_flagged") | F.coalesce("z_flagged", F.lit(False))
    rows = materialize(touched.join(marked, "player_id", "left").withColumns({
        "slot": F.when(flagged, F.lit(FLAGGED)).otherwise(slot(exact_value("total"))), "as_of": F.lit(number).cast("long")}).drop("z_flagged"), "rows")
    _publish(rows.drop("was"), base, "players", PLAYERS, writer, number)

    regions = fresh.where("region IS NOT NULL").groupBy("player_id", "region").agg(F.count(F.lit(1)).alias("n"))
    _publish(_add_counts(regions, _earlier(spark, base, "regions", REGIONS, writer, number), ["player_id", "region"]),
             base, "regions", REGIONS, writer, number)
    moves = rows.select(F.explode(F.array(F.struct(F.col("slot"), F.lit(1).alias("by")), F.struct(F.col("was").alias("slot"), F.lit(-1).alias("by"))))
                        .alias("x")).where("x.slot IS NOT NULL").groupBy("x.slot").agg(F.sum("x.by").alias("n"))
    moves = materialize(moves, "moves")
    _publish(_add_counts(moves, _earlier(spark, base, "slots", SLOTS, writer, number), ["slot"]), base, "slots", SLOTS, writer, number)

    counts = {r.slot: r.n for r in store.read(spark, f"{base}/slots", SLOTS).collect()}  # a few hundred slots
    top = top_slots(counts, k)
    moved = {r.slot for r in moves.select("slot").collect()}
    ranked = bool(moved & set(top)) or not store.exists(spark, f"{base}/top")
    if ranked:
        store.replace(_rank(spark, base, top, k), f"{base}/top", TOP)
    # only now: until all is published, a retry has to tell this batch's rows from earlier ones
    for table, spec in TABLES.items():
        store.merge(spark, f"{base}/{table}", spec, MERGE_ABOVE)
    return {"slots": top, "ranked": ranked}


def refresh_job(stream: DataFrame, base: str, checkpoint: str, trigger: dict, delay: str, cfg: Config = DEFAULT,
                k: int = 100) -> StreamingQuery:
    """J5 + J6: keep z-scores and the first k of the board under ``base``."""
    writer = store.writer_of(checkpoint)
    once = plans.dedup_within_watermark(stream, delay)
    query = once.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, base, writer, cfg, k, stream.sparkSession) and None)
    return query.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_moments(spark: SparkSession, base: str, cfg: Config = DEFAULT) -> DataFrame:
    """D1 of all players as of the last batch."""
    return moments(store.read(spark, f"{base}/players", PLAYERS), cfg)


def read_outliers(spark: SparkSession, base: str) -> DataFrame:
    """The z flags that hold now (those as of a player's last batch)."""
    now = store.read(spark, f"{base}/players", PLAYERS).select("player_id", "as_of")
    return store.read(spark, f"{base}/outliers", OUTLIERS).join(now, ["player_id", "as_of"]).select(
        "player_id", "match_id", "stat_code", F.round("z", 6).alias("z"))


def read_top(spark: SparkSession, base: str) -> DataFrame:
    """The first k rows of the board."""
    return store.read(spark, f"{base}/top", TOP)
