"""The versioned store: writers, order, replace, merge, moved keys, odd regions."""

import datetime as dt
import random

import pytest

from matchops.session import work_dir
from matchops.sources import sinks, store
from matchops.streaming import jobs, plans

SCHEMA = ("player_id string, match_id string, region string, device string, ping int, score double, kills int, deaths int, "
          "match_duration_seconds int, created_at timestamp, ingest_seq long")
DAY = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    """rows: (player, match, region, score, day, seq)"""
    return spark.createDataFrame([(p, m, r, "Pc", 40, float(s), 1, 1, 300, d and DAY + dt.timedelta(days=d - 1), q) for p, m, r, s, d, q in rows], SCHEMA)


def rows(df):
    return sorted(((r.player_id, r.match_id, r.region, r.score) for r in df.collect()), key=str)


def test_writers_share_a_store_and_retries_change_nothing(spark):
    path = work_dir(spark, "t-store")
    one = frame(spark, [("a", "m1", "India", 1, 1, 0), ("b", "m1", "India", 1, 1, 0)])
    assert plans.append_to_store(one, 0, path, "x") and plans.append_to_store(frame(spark, [("c", "m1", "Sea", 1, 1, 0)]), 0, path, "y")
    assert not plans.append_to_store(frame(spark, [("a", "m1", "India", 99, 1, 0)]), 0, path, "x")
    assert plans.append_to_store(frame(spark, [("b", "m1", "India", 7, 1, 0)]), 1, path, "y")
    assert plans.append_to_store(frame(spark, [("b", "m1", "India", 8, 1, 0)]), 1, path, "x")
    assert rows(plans.read_store(spark, path)) == [("a", "m1", "India", 1.0), ("b", "m1", "India", 8.0), ("c", "m1", "Sea", 1.0)]


def test_unpublished_folder_is_not_read_and_is_written_again(spark):
    path = work_dir(spark, "t-store")
    plans.append_to_store(frame(spark, [("a", "m1", "India", 1, 1, 0)]), 0, path, "x")
    frame(spark, [("z", "m9", "India", 1, 1, 0)]).write.parquet(store._data(path, "x", 1))  # its writer stopped here
    assert len(rows(plans.read_store(spark, path))) == 1
    plans.append_to_store(frame(spark, [("b", "m2", "India", 1, 1, 0)]), 1, path, "x")
    assert [r[0] for r in rows(plans.read_store(spark, path))] == ["a", "b"]


def test_regions_keep_their_text_and_null_is_not_blank(spark):
    path = work_dir(spark, "t-store")
    plans.append_to_store(frame(spark, [("a", "m", "01", 1, 1, 0), ("b", "m", "1", 1, 1, 0), ("c", "m", "", 1, 1, 0), ("d", "m", None, 1, None, 0)]), 0, path)
    assert [(r[0], r[2]) for r in rows(plans.read_store(spark, path))] == [("a", "01"), ("b", "1"), ("c", ""), ("d", None)]
    assert [r[0] for r in rows(plans.read_store(spark, path, region="01"))] == ["a"]
    assert [r[0] for r in rows(plans.read_store(spark, path, region=""))] == ["c"]
    plans.append_to_store(frame(spark, [("a", "m", None, 2, 1, 0)]), 1, path)  # moved to no region
    assert rows(plans.read_store(spark, path, region="01")) == []


def test_region_and_date_reads_take_only_their_folders(spark):
    path = work_dir(spark, "t-store")
    plans.append_to_store(frame(spark, [("a", "m1", "India", 1, 1, 0), ("a", "m2", "India", 1, 2, 0)]), 0, path)
    plans.append_to_store(frame(spark, [("b", "m1", "Sea", 1, 3, 0)]), 1, path)
    assert rows(plans.read_store(spark, path, dates=dt.date(2024, 1, 2))) == [("a", "m2", "India", 1.0)]
    assert rows(plans.read_store(spark, path, "India", [dt.date(2024, 1, 1), dt.date(2024, 1, 3)])) == [("a", "m1", "India", 1.0)]
    assert rows(plans.read_store(spark, path, region="Nowhere")) == []
    plans.merge_store(spark, path)
    one = plans.read_store(spark, path, region="Sea", dates="2024-01-03")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = one._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan.split("PartitionFilters: [")[1].split("], ")[0]
    assert plan.count("FileScan") == 1 and "= vSea)" in filters and "= v2024-01-03)" in filters and "Aggregate" not in plan
    assert rows(one) == [("b", "m1", "Sea", 1.0)]
    missing = store._read  # no entry without such rows is opened
    plans.append_to_store(frame(spark, [("c", "m1", "Sea", 1, 4, 0)]), 2, path)
    opened = []
    store._read = lambda *args: opened.append([e.batch for e in args[3]]) or missing(*args)
    try:
        assert [r[0] for r in rows(plans.read_store(spark, path, region="Sea", dates="2024-01-04"))] == ["c"]
    finally:
        store._read = missing
    assert opened == [[2], [2]]


def test_merge_and_vacuum_keep_rows_order_and_retries(spark):
    path, rng, want = work_dir(spark, "t-store"), random.Random(2), {}
    for n in range(5):
        batch = [(f"p{rng.randrange(6)}", f"m{i}", rng.choice(["India", "Sea", None]), 100 * n + i, rng.randint(1, 3), i) for i in range(4)]
        plans.append_to_store(frame(spark, batch), n, path, "w")
        want |= {(p, m): (p, m, r, float(s)) for p, m, r, s, *_ in batch}
        if n in (2, 3):
            assert plans.merge_store(spark, path) and len(store.entries(spark, path)) == 1
    assert not plans.merge_store(spark, path, most=2)
    assert rows(plans.read_store(spark, path)) == sorted(want.values(), key=str)
    for region in ("India", "Sea"):
        assert rows(plans.read_store(spark, path, region=region)) == sorted((x for x in want.values() if x[2] == region), key=str)
    plans.merge_store(spark, path)
    assert store.vacuum(spark, path) == 7 and len(store._log(spark, path)) == 1
    assert rows(plans.read_store(spark, path)) == sorted(want.values(), key=str)
    assert not plans.append_to_store(frame(spark, [("q", "q", "Sea", 1, 1, 0)]), 4, path, "w")  # a retry after all that


def test_a_batch_published_while_others_merge_keeps_its_place(spark, monkeypatch):
    path = work_dir(spark, "t-store")
    plans.append_to_store(frame(spark, [("a", "m", "India", 1, 1, 0)]), 0, path, "x")
    plans.append_to_store(frame(spark, [("a", "m", "Sea", 2, 1, 0)]), 1, path, "x")
    publish, live = store._publish, store.entries(spark, path)

    def late(*args, **kw):
        monkeypatch.setattr(store, "_publish", publish)
        monkeypatch.setattr(store, "entries", lambda *_: live[:1])  # it saw the first batch only
        plans.append_to_store(frame(spark, [("a", "m", "India", 3, 1, 0), ("b", "m", "India", 3, 1, 0)]), 0, path, "a")
        monkeypatch.undo()
        publish(*args, **kw)

    monkeypatch.setattr(store, "_publish", late)
    plans.merge_store(spark, path)
    # the late batch has the arrival of the second one and the smaller name
    assert rows(plans.read_store(spark, path)) == [("a", "m", "Sea", 2.0), ("b", "m", "India", 3.0)]
    assert rows(plans.read_store(spark, path, region="India")) == [("b", "m", "India", 3.0)]


def test_replace_is_seen_as_a_whole(spark, monkeypatch, csv_file):
    path = work_dir(spark, "t-store")
    plans.append_to_store(frame(spark, [("old", "m", "India", 1, 1, 0)]), 0, path, "x")
    publish, seen = store._publish, []

    def half(rows_, *args, **kw):
        publish(rows_.limit(0), work_dir(spark, "aside"), *args[1:], **kw)
        seen.append(rows(sinks.reload(spark, path)))  # the upload is on its way
        publish(rows_, *args, **kw)

    monkeypatch.setattr(store, "_publish", half)
    assert sinks.bulk_replace(spark, csv_file(["new,m1,india,pc,40,10,1,1,300", "new2,m1,sea,pc,40,10,1,1,300"]), path) == 2
    assert seen == [[("old", "m", "India", 1.0)]]
    monkeypatch.undo()
    plans.append_to_store(frame(spark, [("late", "m", "India", 1, 1, 0)]), 1, path, "x")
    assert [r[0] for r in rows(sinks.reload(spark, path))] == ["late", "new", "new2"]


def test_two_jobs_on_one_store(spark):
    base = work_dir(spark, "t-jobs")
    for name, region in (("one", "India"), ("two", "Sea")):
        for n in range(2):
            frame(spark, [(name, f"m{n}", region, n, 1, 0)]).coalesce(1).write.parquet(f"{base}/{name}/s{n}")
            stream = jobs.match_source(spark, f"{base}/{name}/*", frame(spark, []).schema)
            jobs.store_job(stream, f"{base}/store", f"{base}/chk-{name}", {"availableNow": True}, merge_above=2).awaitTermination()
    assert rows(plans.read_store(spark, f"{base}/store")) == [
        ("one", "m0", "India", 0.0), ("one", "m1", "India", 1.0), ("two", "m0", "Sea", 0.0), ("two", "m1", "Sea", 1.0)]


def test_names_and_empty_stores(spark):
    path = work_dir(spark, "t-store")
    with pytest.raises(FileNotFoundError):
        plans.read_store(spark, path)
    with pytest.raises(ValueError):
        plans.append_to_store(frame(spark, []), 0, path, "../x")
    assert store.vacuum(spark, path) == 0 and not store.exists(spark, path)
    plans.append_to_store(frame(spark, []), 0, path)
    assert plans.read_store(spark, path).count() == 0 and plans.read_store(spark, path, "India").count() == 0


def test_published_board_keeps_region_text(spark):
    path = work_dir(spark, "t-board")
    sinks.publish_board(spark.createDataFrame([("a", "01"), ("b", "1")], "player_id string, primary_region string"), path)
    assert [tuple(r) for r in sinks.read_region_board(spark, path, " 01 ").collect()] == [("a", "01")]
