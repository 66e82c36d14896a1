"""The incremental refreshes equal the batch analysis after every batch."""

import datetime as dt
import random

import pytest

from matchops.operators import history
from matchops.operators.players import player_moments
from matchops.plans.batch import Analysis
from matchops.session import work_dir
from matchops.sources import store
from matchops.streaming import jobs, refresh

SCHEMA = ("player_id string, match_id string, region string, device string, ping int, score double, kills int, deaths int, "
          "match_duration_seconds int, created_at timestamp")
T0 = dt.datetime(2024, 1, 1)


def batches(n):
    """n batches of matches: fractional scores, late outliers, flagged players, regions that tie."""
    rng, out = random.Random(6), []
    for b in range(n):
        rows = []
        for i in range(90):
            p = rng.randrange(12)
            score = round(rng.gauss(500, 20), 1) + (0.1 if p % 2 else 0)
            if rng.random() < 0.04:
                score += 900
            ping = 600 if p == 5 and b == 1 else 40
            rows.append((f"p{p:02d}", f"m{b}-{i}", rng.choice(["India", "Sea", None]), "Pc", ping, score, rng.choice([1, 2, 3]) + (40 if rng.random() < 0.02 else 0),
                         1, 300, T0 + dt.timedelta(minutes=b * 100 + i)))
        out.append(rows)
    return out


def near(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-6 * max(1, abs(b)))


def check(spark, base, so_far, k):
    a = Analysis(spark.createDataFrame(so_far, SCHEMA))
    want = {r.player_id: r for r in player_moments(a.profile).collect()}
    got = {r.player_id: r for r in refresh.read_moments(spark, base).collect()}
    assert got.keys() == want.keys()
    for p, r in got.items():
        assert all(near(r[c], want[p][c]) for c in r.asDict() if c != "player_id"), (r, want[p])
    flags = [sorted((r.player_id, r.match_id, r.stat_code, round(r.z, 5)) for r in df.collect())
             for df in (refresh.read_outliers(spark, base), history.zscore_outliers(a.hits))]
    assert flags[0] == flags[1]
    top = [sorted(map(tuple, df.collect()), key=str) for df in (refresh.read_top(spark, base).select(*a.top_k(k).columns), a.top_k(k))]
    assert top[0] == top[1]
    return len(flags[0])


def test_equal_to_batch_after_every_batch(spark, monkeypatch):
    monkeypatch.setattr(refresh, "MERGE_ABOVE", 2)
    base, so_far, flagged = work_dir(spark, "t-refresh"), [], 0
    for n, rows in enumerate(batches(3)):
        so_far += rows
        refresh.apply_batch(spark.createDataFrame(rows, SCHEMA), n, base, "w", k=4)
        flagged += check(spark, base, so_far, 4)
    assert flagged > 3


def test_a_batch_that_stops_anywhere_is_taken_once(spark, monkeypatch):
    base, (one, two) = work_dir(spark, "t-refresh"), batches(2)
    refresh.apply_batch(spark.createDataFrame(one, SCHEMA), 0, base, "w", k=3)
    publish = refresh._publish
    for table in ("outliers", "players", "regions", "slots"):
        def stops(df, folder, name, *args, stop=table):
            publish(df, folder, name, *args)
            if name == stop:
                raise InterruptedError(stop)

        monkeypatch.setattr(refresh, "_publish", stops)
        with pytest.raises(InterruptedError):
            refresh.apply_batch(spark.createDataFrame(two, SCHEMA), 1, base, "w", k=3)
    monkeypatch.setattr(refresh, "_publish", publish)
    refresh.apply_batch(spark.createDataFrame(two, SCHEMA), 1, base, "w", k=3)
    check(spark, base, one + two, 3)


def test_job_drops_copies_and_ranks_only_touched_slots(spark, monkeypatch):
    base, said = work_dir(spark, "t-refresh"), []
    apply = refresh.apply_batch
    monkeypatch.setattr(refresh, "apply_batch", lambda *args: said.append(apply(*args)) or said[-1])
    rows = [(f"p{i:02d}", "m", "India", "Pc", 40, 10.0 * 2 ** i, 1, 1, 300, T0) for i in range(8)]
    stages = [rows, rows[:2] + [("p00", "m2", "Sea", "Pc", 40, 1.0, 1, 1, 300, T0)], [("p00", "m3", "Sea", "Pc", 40, 5000.0, 1, 1, 300, T0)]]
    for n, stage in enumerate(stages):
        spark.createDataFrame(stage, SCHEMA).coalesce(1).write.parquet(f"{base}/in/s{n}")
        stream = jobs.match_source(spark, f"{base}/in/*", spark.createDataFrame([], SCHEMA).schema)
        refresh.refresh_job(stream, f"{base}/state", f"{base}/chk", {"availableNow": True}, "1 day", k=2).awaitTermination()
    assert [x["ranked"] for x in said if x["slots"]] == [True, False, True]
    assert [(r["rank"], r.player_id, r.primary_region) for r in refresh.read_top(spark, f"{base}/state").orderBy("rank").collect()] == [
        (1, "p00", "Sea"), (2, "p07", "India")]
    assert sum(r.n for r in store.read(spark, f"{base}/state/slots", refresh.SLOTS).collect()) == 8


def test_files_do_not_multiply_with_shuffle_partitions(spark):
    """A table has about a file for each of its folders, not one for each folder and state partition."""
    base = work_dir(spark, "t-refresh")
    rows = [(f"p{i % 200}", f"m{i}", "Sea", "Pc", 40, 10.0 * 2 ** (i % 5), 1, 1, 300, T0) for i in range(2000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{base}/in/s0")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        stream = jobs.match_source(spark, f"{base}/in/*", spark.createDataFrame([], SCHEMA).schema)
        refresh.refresh_job(stream, f"{base}/state", f"{base}/chk", {"availableNow": True}, "1 day", k=2).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def files(table):
        return spark.read.parquet(f"{base}/state/{table}/data").inputFiles()

    players = store.read(spark, f"{base}/state/players", refresh.PLAYERS)
    assert len(files("history")) <= refresh.BUCKETS
    assert len(files("players")) <= 4 * players.select("slot").distinct().count()
    assert store.read(spark, f"{base}/state/history", refresh.HISTORY).count() == 2000 and players.count() == 200


def test_a_bucket_goes_to_several_tasks_of_a_wide_shuffle(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "256")
    try:
        rows = spark.range(400).selectExpr("'p' AS player_id", "concat('m', id) AS match_id").withColumn("bucket", refresh._bucket())
        assert 1 < refresh._by_bucket(rows).selectExpr("spark_partition_id() AS t").distinct().count() <= 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_outliers_compare_versions_of_wanted_players_only(spark):
    base = work_dir(spark, "t-refresh")
    for n, score in enumerate((1.0, 2.0)):
        rows = [(p, "m", p and p[0], score) for p in ("a1", "a2", "b1", None)]
        store.append(spark.createDataFrame(rows, "player_id string, match_id string, bucket string, score double"), base, refresh.HISTORY, "w", n)
    only = spark.createDataFrame([("a1",), ("b1",)], "player_id string")
    got = store.read(spark, base, refresh.HISTORY, where={"bucket": ["a"]}, only=only)
    assert [(r.player_id, r.score) for r in got.collect()] == [("a1", 2.0)]


def test_slots_rise_with_totals_and_reach_k():
    assert refresh.top_slots({5: 2, 9: 1, 7: 3, -1: 4}, 2) == [9, 7]
    assert refresh.top_slots({5: 2, 9: 0, -1: 4}, 3) == [5, -1]
    assert refresh.top_slots({}, 3) == [-1]
