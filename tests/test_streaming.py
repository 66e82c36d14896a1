"""Streaming plans on small staged inputs: batch equality, late data, dedup."""

import datetime as dt

from matchops.operators.cleaning import with_derived
from matchops.operators.rules import rule_flags_long
from matchops.session import work_dir
from matchops.streaming import plans

SCHEMA = ("player_id string, match_id string, region string, device string, ping int, "
          "score double, kills int, deaths int, match_duration_seconds int, created_at timestamp")
T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _rows(specs):
    out = []
    for pid, mid, minute, score, kills, deaths, dur, ping in specs:
        out.append((pid, mid, "India", "Pc", ping, float(score), kills, deaths, dur,
                    T0 + dt.timedelta(minutes=minute)))
    return out


def _drain(spark, base, stages, build, sink):
    schema = None
    for i, rows in enumerate(stages):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{base}/in/s{i:03d}")
        schema = schema or spark.read.parquet(f"{base}/in/s{i:03d}").schema
        stream = spark.readStream.schema(schema).parquet(f"{base}/in/*")
        q = sink(build(stream).writeStream.option("checkpointLocation", f"{base}/chk"))
        q = q.trigger(availableNow=True).start()
        q.awaitTermination()
        yield q


def test_stream_alerts_equal_batch(spark):
    rows = _rows([("A", "M1", 0, 6000, 1, 1, 100, 40), ("B", "M2", 1, 100, 25, 0, 300, 40),
                  ("C", "M3", 2, 100, 1, 1, 300, 700), ("D", "M4", 3, 100, 1, 1, 300, 40)])
    base = work_dir(spark, "t-alerts")
    list(_drain(spark, base, [rows[:2], rows[2:]], plans.rule_alerts,
                lambda w: w.format("parquet").option("path", f"{base}/out")))
    got = sorted(map(tuple, spark.read.parquet(f"{base}/out").collect()))
    want = sorted(map(tuple, rule_flags_long(with_derived(spark.createDataFrame(rows, SCHEMA))).collect()))
    assert got == want


def test_late_rows_dropped_and_counted(spark):
    first = _rows([("A", f"M{i}", i, 100, 1, 1, 300, 40) for i in range(0, 30)])
    late = _rows([("B", "L1", 1, 100, 1, 1, 300, 40)])          # 29 minutes behind, delay 10
    closing = _rows([("A", "Z", 60, 100, 1, 1, 300, 40)])
    base = work_dir(spark, "t-late")
    qs = list(_drain(spark, base, [first, late, closing],
                     lambda s: plans.windowed_counts(s, "10 minutes"),
                     lambda w: w.format("parquet").option("path", f"{base}/out")))
    dropped = sum(
        sum(op.get("numRowsDroppedByWatermark", 0) for op in p.get("stateOperators", []))
        for q in qs for p in q.recentProgress)
    assert dropped >= 1
    got = {r.window_start: r.matches for r in spark.read.parquet(f"{base}/out").collect()}
    assert got["2024-01-01 00:01:00"] == 1                      # the late row did not count
    assert len(got) == 30                                       # windows closed by the watermark


def test_dedup_and_store_policies(spark):
    orig = _rows([("A", "M1", 0, 100, 1, 1, 300, 40), ("A", "M2", 1, 100, 1, 1, 300, 40)])
    again = _rows([("A", "M1", 0, 999, 1, 1, 300, 40)])
    base = work_dir(spark, "t-dedup")
    list(_drain(spark, base, [orig, again], lambda s: plans.dedup_within_watermark(s, "1 day"),
                lambda w: w.format("parquet").option("path", f"{base}/out")))
    got = {(r.match_id, r.score) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {("M1", 100.0), ("M2", 100.0)}                # keep-first
    store = f"{base}/store"
    list(_drain(spark, base + "/s", [orig, again], lambda s: s,
                lambda w: w.foreachBatch(lambda df, bid: plans.append_to_store(df, bid, store))))
    cur = {(r.match_id, r.score) for r in plans.read_store(spark, store).collect()}
    assert cur == {("M1", 999.0), ("M2", 100.0)}                # last write wins
    pruned = plans.read_store(spark, store, region="India")
    assert "PartitionFilters: [isnotnull(region" in pruned._jdf.queryExecution().executedPlan().toString() \
        or "region" in str(pruned.inputFiles())


def test_submission_verdicts(spark):
    from matchops.streaming.verdicts import submission_verdicts

    store = spark.createDataFrame(_rows([
        ("A", "M1", 0, 100, 1, 1, 300, 40),          # clean history
        ("B", "M1", 0, 100, 1, 1, 300, 700),         # B already flagged (ping, Low)
    ]), SCHEMA)
    subs = spark.createDataFrame(_rows([
        ("A", "M2", 1, 100, 1, 1, 300, 40),          # clean, clean player
        ("C", "M1", 1, 9000, 1, 1, 100, 40),         # own rules fire (rate 90, short match)
        ("B", "M2", 1, 100, 1, 1, 300, 40),          # clean row, flagged player
    ]), SCHEMA)
    updated = store.unionByName(subs)
    got = {r.player_id: r for r in submission_verdicts(updated, subs).collect()}
    assert (got["A"].status, got["A"].severity, got["A"].reasons) == ("clean", "None", "")
    assert (got["C"].status, got["C"].severity) == ("flagged", "High")
    assert got["C"].reasons.startswith("Score rate spike: 90.00 score/sec")
    assert (got["B"].status, got["B"].severity) == ("flagged", "Low")
    assert got["B"].reasons == "Ping anomaly: 700ms (Limits: 5-500ms)"


def test_submission_verdicts_keep_all_reasons(spark):
    from dataclasses import replace

    from matchops.config import DEFAULT
    from matchops.plans.batch import Analysis
    from matchops.streaming import jobs
    from matchops.streaming.verdicts import submission_verdicts, with_reasons

    cfg = replace(DEFAULT, text_segment=3)
    old = _rows([("B", f"M{i}", 0, 100, 1, 1, 300, 700 + i) for i in range(7)])  # 7 distinct reasons
    new = _rows([("B", "M8", 1, 100, 1, 1, 300, 40), ("B", "M9", 1, 100, 1, 1, 300, 40), ("A", "M1", 1, 100, 1, 1, 300, 40)])
    store, subs = spark.createDataFrame(old + new, SCHEMA), spark.createDataFrame(new, SCHEMA)
    reasons = {r.flag_reasons for r in Analysis(store, cfg).suspicious_report().collect()}
    everything = sorted(x for r in reasons for x in r.split("; "))
    assert len(everything) >= 7

    def held(rows, match):
        return sorted(x for r in rows if r.match_id == match for x in r.reasons.split("; "))

    base = work_dir(spark, "t-verdicts")
    list(_drain(spark, base + "/load", [old], lambda s: s,
                lambda w: w.foreachBatch(lambda df, bid: plans.append_to_store(df, bid, f"{base}/store"))))
    src = f"{base}/subs"
    subs.coalesce(1).write.parquet(src)
    q = jobs.verdict_job(spark.readStream.schema(subs.schema).parquet(src), f"{base}/store", f"{base}/v", f"{base}/chk",
                         {"availableNow": True}, cfg)
    q.awaitTermination()
    table, texts = spark.read.parquet(f"{base}/v"), spark.read.parquet(jobs.reasons_path(f"{base}/v"))
    counts = {r.match_id: r.reason_count for r in table.collect()}
    assert table.count() == 3 and counts == {"M8": len(everything), "M9": len(everything), "M1": 0}
    assert [r.player_id for r in texts.collect()] == ["B"]
    for rows in (submission_verdicts(store, subs, cfg).collect(), with_reasons(table, texts, ("player_id", "_batch")).collect()):
        assert held(rows, "M8") == held(rows, "M9") == everything
        assert [(r.status, r.reasons) for r in rows if r.player_id == "A"] == [("clean", "")]
