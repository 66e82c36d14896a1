"""Cleaning edge fixtures (FIXTURES.md §4) and the text helpers."""

import math

from hypothesis import given, settings, strategies as st

from matchops.functions.text import fixed2, float_text, strip_ws, title_case
from matchops.operators.cleaning import (
    clean_matches, drop_accounting, latest_submission_wins, quarantine,
)
from matchops.sources.csv_source import read_raw


def _clean(spark, csv_file, rows):
    return {(r.player_id, r.match_id): r for r in clean_matches(read_raw(spark, csv_file(rows))).collect()}


def test_domain_and_truncation(spark, csv_file):
    got = _clean(spark, csv_file, [
        "P1,Z,India,Pc,40,100,1,1,0",            # zero duration -> dropped
        "P1,S1,India,Pc,40,10,1,1,0.5",          # sub-second, score > 0 -> +inf rate
        "P1,S0,India,Pc,40,0,1,1,0.5",           # sub-second, score 0 -> NULL rate
        "P1,T,India,Pc,55.9,100,3.9,1,300",      # truncation
        "P1,NEG,India,Pc,-1,100,1,1,300",        # negative ping -> dropped
    ])
    assert ("P1", "Z") not in got and ("P1", "NEG") not in got
    assert got[("P1", "S1")].score_per_second == math.inf
    assert got[("P1", "S1")].match_duration_seconds == 0
    assert got[("P1", "S0")].score_per_second is None
    assert (got[("P1", "T")].ping, got[("P1", "T")].kills) == (55, 3)


def test_numeric_parsing(spark, csv_file):
    got = _clean(spark, csv_file, [
        "P1,A,India,Pc,abc,100,1,1,300",
        "P1,B,India,Pc,40,5d,1,1,300",
        "P1,C,India,Pc,40,1_000,1,1,300",
        "P1,D,India,Pc,40,NaN,1,1,300",
        "P1,E,India,Pc,40,,1,1,300",
        "P1,F,India,Pc,40,1e3,1,1,300",
        'P1,G,India,Pc," 12 ",100,1,1,300',
        "P1,H,India,Pc,inf,100,1,1,300",          # non-finite int -> dropped (deviation)
    ])
    assert set(got) == {("P1", "F"), ("P1", "G")}
    assert got[("P1", "F")].score == 1000.0
    assert got[("P1", "G")].ping == 12


def test_labels_and_whitespace(spark, csv_file):
    got = _clean(spark, csv_file, [
        "P1,A,,Pc,40,100,1,1,300",
        "P1,B,NA,Pc,40,100,1,1,300",
        "P1,C,us-EAST o'neil p2p 3d,iOS,40,100,1,1,300",
        'P1,D,"\t SEA ","PC\n",40,100,1,1,300',
        'P1,E,"a,b","q""z",40,100,1,1,300',
        "P1,F,Us_East,Pc,40,100,1,1,300",
    ])
    assert got[("P1", "A")].region == "Nan"
    assert got[("P1", "B")].region == "Nan"
    assert (got[("P1", "C")].region, got[("P1", "C")].device) == ("Us-East O'Neil P2P 3D", "Ios")
    assert (got[("P1", "D")].region, got[("P1", "D")].device) == ("Sea", "Pc")
    assert (got[("P1", "E")].region, got[("P1", "E")].device) == ("A,B", 'Q"Z')
    assert got[("P1", "F")].region == "Us_East"


def test_dedup_policies(spark, csv_file):
    rows = [
        "P1,M1,India,Pc,40,100,1,1,300",
        "P1,M1,India,Pc,40,200,1,1,300",          # duplicate: first wins
        " P1,M2,India,Pc,40,300,1,1,300",
        "P1,M2,India,Pc,40,400,1,1,300",          # padded id: both kept (parity)
        "001,M3,India,Pc,40,1,1,1,300",
        "1,M3,India,Pc,40,2,1,1,300",             # zero-padded ids stay distinct
        "P2,M9,India,Pc,-5,100,1,1,300",          # invalid original ...
        "P2,M9,India,Pc,40,700,1,1,300",          # ... so the copy survives
    ]
    got = clean_matches(read_raw(spark, csv_file(rows))).collect()
    scores = sorted((r.player_id, r.match_id, r.score) for r in got)
    assert ("P1", "M1", 100.0) in scores and ("P1", "M1", 200.0) not in scores
    assert [s for s in scores if s[1] == "M2"] == [("P1", "M2", 300.0), ("P1", "M2", 400.0)]
    assert {s[0] for s in scores if s[1] == "M3"} == {"001", "1"}
    assert ("P2", "M9", 700.0) in scores
    last = {(r.player_id, r.match_id): r.score for r in
            latest_submission_wins(read_raw(spark, csv_file(rows, name="b.csv"))).collect()}
    assert last[("P1", "M1")] == 200.0
    assert last[("P1", "M2")] == 400.0           # trimmed key: the later copy wins


def test_drop_accounting_and_quarantine(spark, csv_file):
    rows = [
        ",M1,India,Pc,40,100,1,1,300",
        "P1,M2,India,Pc,x,100,1,1,300",
        "P1,M3,India,Pc,40,100,1,1,0",
        "P1,M4,India,Pc,inf,100,1,1,300",
        "P1,M5,India,Pc,40,100,1,1,300",
        "P1,M5,India,Pc,40,100,1,1,300",
        "P1,M6,India,Pc,40.5,100,1,1,300",
    ]
    raw = read_raw(spark, csv_file(rows))
    acc = {r.outcome: r.rows for r in drop_accounting(raw).collect()}
    assert acc == {"null_id": 1, "non_numeric": 1, "out_of_domain": 1, "non_finite": 1,
                   "duplicate": 1, "kept": 2, "input": 7}
    q = {r.match_id: r.reason for r in quarantine(raw).collect()}
    assert q["M1"] == "missing_field" and q["M2"] == "bad_type" and q["M3"] == "out_of_range"
    assert q["M4"] == "bad_type" and q["M5"] is None and q["M6"] == "bad_type"


def test_title_and_strip(spark):
    df = spark.createDataFrame([("  us-EAST o'neil p2p 3d\n",), (" SEA\t",), ("iOS",)], "x string")
    got = [r[0] for r in df.select(title_case(strip_ws("x"))).collect()]
    assert got == ["Us-East O'Neil P2P 3D", "Sea", "Ios"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(
    st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False),
    st.integers(min_value=0, max_value=10**6).map(lambda k: k / 1000.0),
    st.sampled_from([2.675, 0.125, 0.375, 1.005, 1650.0, 33.333333, -3.015, 1e-9])),
    min_size=1, max_size=40))
def test_fixed2_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(fixed2("x")).collect()]
    assert got == [f"{v:.2f}" for v in values]


def test_float_text(spark):
    vals = [99000.0, 12345678.0, 5200.0, 0.5, 1234.5678, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r[0] for r in df.select(float_text("x")).collect()] == [str(v) for v in vals]
    inf = spark.createDataFrame([(math.inf,)], "x double").select(fixed2("x"), float_text("x")).first()
    assert tuple(inf) == ("inf", "inf")


def test_ingest_order_across_files(spark, tmp_path):
    d = tmp_path / "upload"
    d.mkdir()
    header = "player_id,match_id,region,device,ping,score,kills,deaths,match_duration_seconds"
    (d / "b.csv").write_text(header + "\nP1,M1,India,Pc,40,222,1,1,300\nP2,M2,India,Pc,40,5,1,1,300\n")
    (d / "a.csv").write_text(header + "\nP3,M3,India,Pc,40,7,1,1,300\nP1,M1,India,Pc,40,111,1,1,300\n")
    got = {(r.player_id, r.match_id): r.score for r in clean_matches(read_raw(spark, str(d))).collect()}
    assert got == {("P1", "M1"): 111.0, ("P2", "M2"): 5.0, ("P3", "M3"): 7.0}
