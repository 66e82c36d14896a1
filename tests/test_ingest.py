"""Validated ingest, dead letters, topic values; late rows beside the windows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from matchops.operators.cleaning import quarantine
from matchops.session import work_dir
from matchops.sources import store
from matchops.streaming import ingest, jobs, plans

GOOD = {"player_id": " a ", "match_id": "m1", "region": " us-EAST ", "device": "pc", "ping": 40, "score": 12.5, "kills": 3, "deaths": 1,
        "match_duration_seconds": 300, "created_at": "2024-01-02 03:04:05"}
VALUES = [
    json.dumps(GOOD), json.dumps(GOOD | {"score": 99}), json.dumps(GOOD | {"player_id": "b", "score": 1e400}).replace("Infinity", '"inf"'),
    json.dumps(GOOD | {"ping": 12.5}), json.dumps(GOOD | {"kills": "many"}), json.dumps(GOOD | {"deaths": -1}),
    json.dumps({k: v for k, v in GOOD.items() if k != "region"}), json.dumps(GOOD | {"match_duration_seconds": 0}), "no json", None,
    json.dumps(GOOD | {"player_id": "c", "region": "", "created_at": "never", "kills": 3_000_000_000}),
]
REASONS = sorted(["bad_type", "bad_type", "out_of_range", "missing_field", "out_of_range", "missing_field", "missing_field"])


def topic(spark, values):
    return spark.createDataFrame([(v.encode() if v is not None else None, 0, i) for i, v in enumerate(values)], "value binary, partition int, offset long")


def stored(spark, path):
    return {r.player_id: (r.match_id, r.region, r.score, r.kills, str(r.match_date)) for r in plans.read_store(spark, path).collect()}


WANT = {"a": ("m1", "Us-East", 99.0, 3, "2024-01-02"), "b": ("m1", "Us-East", float("inf"), 3, "2024-01-02"),
        "c": ("m1", "", 12.5, 3_000_000_000, "None")}


def test_records_go_to_store_or_letters(spark):
    base = work_dir(spark, "t-ingest")
    records = ingest.topic_records(topic(spark, VALUES))
    ingest.take(records, 0, f"{base}/store", f"{base}/letters")
    assert stored(spark, f"{base}/store") == WANT
    letters = ingest.read_letters(spark, f"{base}/letters").collect()
    assert sorted(r.reason for r in letters) == REASONS
    assert {r.raw for r in letters} >= {"no json", None} and all(r.raw is None or r.raw in VALUES for r in letters)


def test_a_stop_between_the_two_sinks_is_made_good(spark, monkeypatch):
    base, records = work_dir(spark, "t-ingest"), ingest.topic_records(topic(spark, VALUES))
    append = store.append

    def stops(df, path, *args):
        if path.endswith("letters"):
            raise InterruptedError
        return append(df, path, *args)

    monkeypatch.setattr(store, "append", stops)
    with pytest.raises(InterruptedError):
        ingest.take(records, 0, f"{base}/store", f"{base}/letters")
    monkeypatch.undo()
    for _ in range(2):
        ingest.take(records, 0, f"{base}/store", f"{base}/letters")
    assert stored(spark, f"{base}/store") == WANT
    assert ingest.read_letters(spark, f"{base}/letters").count() == len(REASONS)


def test_verdicts_of_text_submissions(spark):
    base = work_dir(spark, "t-ingest")
    fields = [c for c in GOOD]
    rows = [{c: str(v) for c, v in GOOD.items()}, {c: str(v) for c, v in (GOOD | {"player_id": "x ", "ping": 700}).items()},
            {c: str(v) for c, v in (GOOD | {"player_id": "y", "ping": -4}).items()}]
    spark.createDataFrame([tuple(r[c] for c in fields) for r in rows], ", ".join(f"{c} string" for c in fields)).coalesce(1).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    jobs.verdict_job(stream, f"{base}/store", f"{base}/v", f"{base}/chk", {"availableNow": True}, letters=f"{base}/letters").awaitTermination()
    got = {r.player_id: (r.status, r.severity) for r in spark.read.parquet(f"{base}/v").collect()}
    assert got == {"a": ("clean", "None"), "x": ("flagged", "Low")}
    assert [r.reason for r in ingest.read_letters(spark, f"{base}/letters").collect()] == ["out_of_range"]


def test_an_infinite_score_is_a_number_and_infinite_kills_are_not(spark):
    cols = [c for c in GOOD if c != "created_at"]
    rows = [tuple(str((GOOD | change)[c]) for c in cols) + (0,) for change in ({"score": "inf"}, {"kills": "inf"})]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols) + ", ingest_seq int")
    assert [r.reason for r in quarantine(raw).collect()] == [None, "bad_type"]


SCHEMA = "player_id string, match_id string, region string, device string, ping int, score double, kills int, deaths int, match_duration_seconds int, created_at timestamp"


def test_late_rows_are_those_the_windows_drop(spark):
    base, t0 = work_dir(spark, "t-late"), dt.datetime(2024, 1, 1)

    def rows(minutes):
        return [("p", f"m{i}", "India", "Pc", 40, 1.0, 1, 1, 300, t0 + dt.timedelta(minutes=i)) for i in minutes]

    stages = [rows(range(0, 30)), rows([1, 5, 5.5, 18, 19, 25, 40]), rows([2, 28, 29.5, 33, 60])]
    dropped = 0
    for n, stage in enumerate(stages):
        spark.createDataFrame(stage, SCHEMA).coalesce(1).write.parquet(f"{base}/in/s{n}")
        stream = jobs.match_source(spark, f"{base}/in/*", spark.createDataFrame([], SCHEMA).schema)
        jobs.late_rows_job(stream, f"{base}/late", f"{base}/chk-late", {"availableNow": True}, "10 minutes").awaitTermination()
        q = jobs.rate_job(stream, f"{base}/out", f"{base}/chk-rate", {"availableNow": True}, "10 minutes")
        q.awaitTermination()
        dropped += sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p.get("stateOperators", []))
    late = {r.window_start: r.late_matches for r in plans.late_counts(spark.read.parquet(f"{base}/late/rows")).collect()}
    assert late == {"2024-01-01 00:01:00": 1, "2024-01-01 00:05:00": 2, "2024-01-01 00:18:00": 1, "2024-01-01 00:02:00": 1,
                    "2024-01-01 00:28:00": 1, "2024-01-01 00:29:00": 1}
    counted = {r.window_start: r.matches for r in spark.read.parquet(f"{base}/out").collect()}
    assert counted["2024-01-01 00:19:00"] == 2 and counted["2024-01-01 00:18:00"] == 1
    assert dropped == len([1 for w in late])  # Spark counts groups of a window that it drops
