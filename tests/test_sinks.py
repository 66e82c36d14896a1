"""Sources and sinks: store round trip, bulk replace, reports, JSON, empty input."""

import json
import os

import pytest

from conftest import CLEAN_SCHEMA, row
from matchops.plans.batch import Analysis
from matchops.plans.reports import REPORT_NAMES, run
from matchops.session import work_dir
from matchops.sources import sinks
from matchops.sources.csv_source import MissingColumnsError
from test_golden import SAMPLE


def test_run_writes_four_sorted_reports(spark, csv_file, tmp_path):
    out = str(tmp_path / "reports")
    summary = run(spark, csv_file(SAMPLE), out).first()
    assert tuple(summary) == (18, 16, 1, 7)
    board = spark.read.option("header", True).csv(os.path.join(out, "leaderboard_global")).collect()
    assert [r.player_id for r in board][:3] == ["P001", "P015", "P014"]
    assert board[-1].player_id == "P003" and board[-1]["rank"] is None
    for name in REPORT_NAMES:
        assert spark.read.option("header", True).csv(os.path.join(out, name)).count() > 0


def test_bulk_replace_and_reload(spark, csv_file):
    store = work_dir(spark, "t-store")
    assert sinks.bulk_replace(spark, csv_file(SAMPLE), store) == 18
    assert sorted(r.region for r in sinks.reload(spark, store).select("region").distinct().collect()) == [
        "Europe", "India", "Sea"]
    bad = csv_file(["P1,M1,1"], header="player_id,match_id,score", name="bad.csv")
    with pytest.raises(MissingColumnsError):
        sinks.bulk_replace(spark, bad, store)
    assert sinks.reload(spark, store).count() == 18          # untouched


def test_registry_and_json(spark, matches_df):
    a = Analysis(matches_df([row("A", "M1"), row("B", "M1", ping=700)]))
    recs = [json.loads(r.record) for r in sinks.json_records(sinks.report(a, "leaderboard_global")).collect()]
    assert recs[-1]["player_id"] == "B" and recs[-1]["rank"] is None
    with pytest.raises(KeyError):
        sinks.report(a, "nope")


def test_empty_input_contract(spark):
    a = Analysis(spark.createDataFrame([], CLEAN_SCHEMA))
    assert a.leaderboard_global().columns == [
        "rank", "player_id", "total_score", "total_kills", "total_deaths",
        "matches_played", "primary_region", "avg_score_per_match", "status"]
    assert a.leaderboard_global().count() == 0
    assert a.suspicious_report().count() == 0
    assert a.lobbies().columns[:7] == [
        "lobby_name", "region", "ping_band", "skill_tier", "player_count", "status", "player_ids"]
    assert a.lobbies().count() == 0


def test_published_board_region_read_prunes(spark, matches_df, tmp_path):
    a = Analysis(matches_df([row("A", "M1", region="India"), row("B", "M1", region="Sea")]))
    path = str(tmp_path / "board")
    sinks.publish_board(a.leaderboard_region(), path)
    df = sinks.read_region_board(spark, path, "  india ")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(primary_region" in plan
    assert [(r.player_id, r["rank"]) for r in df.collect()] == [("A", 1)]


HEADER = "player_id,match_id,region,device,ping,score,kills,deaths,match_duration_seconds"


def test_files_of_several_headers_are_read_by_name(spark, tmp_path):
    from matchops.sources.csv_source import header_table, read_raw

    folder = tmp_path / "with blank"
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER + "\nP1,M1,India,Pc,40,1000,3,1,300\n")
    (folder / "b.csv").write_text(HEADER.replace("kills,deaths", "deaths,kills") + ",extra\r\nP2,M2,India,Pc,40,1000,1,3,300,x\r\n")
    (folder / "c.csv").write_text(HEADER + '\nP3,M3,"In\ndia",Pc,40,1000,3,1,300\nP4,M4,"a ""b"", c",Pc,40,1000,3,1,300\n')
    (folder / "empty.csv").write_text("")
    assert sorted(map(len, header_table(spark, str(folder)).values())) == [1, 2]
    rows = {r.player_id: r for r in read_raw(spark, str(folder)).collect()}
    assert {p: (r.kills, r.deaths, r.extra) for p, r in rows.items()} == {p: ("3", "1", "x" if p == "P2" else None) for p in ("P1", "P2", "P3", "P4")}
    assert rows["P3"].region == "In\ndia" and rows["P4"].region == 'a "b", c' and rows["P2"].match_duration_seconds == "300"
    (folder / "d.csv").write_text("player_id,match_id\nP9,M9\n")
    with pytest.raises(MissingColumnsError, match="d.csv"):
        read_raw(spark, str(folder))


def test_open_quotes_are_an_error_where_files_are_split(spark, tmp_path):
    from matchops.sources.csv_source import read_raw

    (tmp_path / "c.csv").write_text(HEADER + '\nP3,M3,"In\ndia",Pc,40,1000,3,1,300\n')
    with pytest.raises(Exception, match="multi_line=True"):
        read_raw(spark, str(tmp_path), multi_line=False).collect()
    assert [r.region for r in read_raw(spark, str(tmp_path), multi_line=True).collect()] == ["In\ndia"]


def test_a_large_plain_file_is_split_and_keeps_its_order(spark, tmp_path):
    from matchops.operators.cleaning import clean_matches
    from matchops.sources.csv_source import read_raw

    lines = [f"P{i % 50},M{i % 400},India,Pc,40,{i},1,1,300" for i in range(20_000)]
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        raw = read_raw(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() >= 4
        first = {(r.player_id, r.match_id): r.score for r in clean_matches(raw).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == {(f"P{i % 50}", f"M{i % 400}"): float(i) for i in range(400)}


def test_bulk_replace_from_mixed_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\nP1,M1,India,Pc,40,1000,3,1,300\n")
    (tmp_path / "b.csv").write_text(",".join(reversed(HEADER.split(","))) + "\n300,1,3,1000,40,Pc,Sea,M2,P2\n")
    store = work_dir(spark, "t-store")
    assert sinks.bulk_replace(spark, str(tmp_path), store) == 2
    assert {(r.player_id, r.region, r.kills) for r in sinks.reload(spark, store).collect()} == {("P1", "India", 3), ("P2", "Sea", 3)}
