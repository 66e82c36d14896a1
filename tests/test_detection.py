"""Rule boundaries, z-score edges, severity and escalation."""

from dataclasses import replace

import pytest

from conftest import row
from matchops.config import DEFAULT
from matchops.operators.cleaning import with_derived
from matchops.operators.players import player_profile
from matchops.operators.rules import rule_flags_long
from matchops.plans.batch import Analysis


def _codes(spark, matches_df, **fields):
    m = with_derived(matches_df([row("P1", "M1", **fields)]))
    return {r.rule_code for r in rule_flags_long(m).collect()}


@pytest.mark.parametrize("fields,expected", [
    (dict(score=15000, dur=300), set()),                       # rate exactly 50
    (dict(kills=20, deaths=0), {"ZERO_DEATH"}),                # kills exactly 20
    (dict(score=5500, dur=120), set()),                        # duration exactly 120
    (dict(score=5000, dur=110), set()),                        # score exactly 5000
    (dict(kills=50, deaths=1), set()),                         # kills exactly 50
    (dict(ping=5), set()),
    (dict(ping=500), set()),
    (dict(ping=4), {"PING"}),
])
def test_rule_boundaries(spark, matches_df, fields, expected):
    assert _codes(spark, matches_df, **fields) == expected


def test_zscore_edges(spark, matches_df):
    std_zero = [row("A", f"M{i}") for i in range(11)]
    short = [row("B", f"M{i}") for i in range(9)] + [row("B", "M9", score=14000.0, kills=40)]
    a = Analysis(matches_df(std_zero + short))
    assert a.flagged.count() == 0
    assert DEFAULT.z_min_matches == 11


def test_severity_max_and_ping_only(spark, matches_df):
    m = matches_df([
        row("A", "M1", score=6000, dur=100),                       # High (rate 60) + Medium
        row("B", "M1", ping=4),                                    # ping only -> Low
    ])
    got = {r.player_id: r for r in Analysis(m).flagged.collect()}
    assert got["A"].severity == "High"
    assert got["B"].severity == "Low" and got["B"].gameplay_matches_count == 0


@pytest.mark.parametrize("flagged_n,total_n,severity,escalated", [
    (6, 10, "High", True),
    (5, 10, "Medium", False),
    (4, 4, "Medium", False),
])
def test_escalation(spark, matches_df, flagged_n, total_n, severity, escalated):
    rows = [row("P", f"F{i}", score=5500, dur=115) for i in range(flagged_n)]   # C3 only (rate 47.8)
    rows += [row("P", f"C{i}", score=1000, dur=300) for i in range(total_n - flagged_n)]
    a = Analysis(matches_df(rows))
    f = a.flagged.first()
    assert (f.severity, f.escalated) == (severity, escalated)
    rep = a.suspicious_report().first()
    if escalated:
        assert rep.flag_reasons.endswith(DEFAULT.escalation_text)
    else:
        assert DEFAULT.escalation_text not in rep.flag_reasons


def test_one_row_keeps_every_reason(spark, matches_df):
    from dataclasses import replace
    cfg = replace(DEFAULT, text_segment=3)
    rows = [row("P", f"M{i}", ping=600 + i) for i in range(8)]     # 8 distinct ping reasons
    a = Analysis(matches_df(rows), cfg)
    report = a.suspicious_report().collect()
    assert len(report) == 1
    assert report[0].flag_reasons.split("; ") == sorted(f"Ping anomaly: {600 + i}ms (Limits: 5-500ms)" for i in range(8))


def test_2500_reasons_are_one_row_of_the_report(spark, matches_df):
    a = Analysis(matches_df([row("P", f"M{i}", ping=600 + i) for i in range(2500)] + [row("Q", "M", ping=700)]))
    report = {r.player_id: r for r in a.suspicious_report().collect()}
    assert len(report) == 2 and report["P"].flagged_matches_count == 2500
    assert report["P"].flag_reasons.split("; ") == sorted(f"Ping anomaly: {600 + i}ms (Limits: 5-500ms)" for i in range(2500))


def test_zscore_pruning_matches_brute_force(spark, matches_df):
    """Candidate pruning + salted join == pandas z-scores over every match."""
    import random

    import pandas as pd

    rnd = random.Random(7)
    rows = []
    for p in range(12):
        n = rnd.randint(3, 25)
        for i in range(n):
            spike = rnd.random() < 0.08
            rows.append(row(f"P{p:02d}", f"M{p}_{i}", score=float(rnd.randint(900, 1100) * (8 if spike else 1)),
                            kills=rnd.randint(3, 7) * (6 if rnd.random() < 0.05 else 1), deaths=2, dur=600))
    pdf = pd.DataFrame(rows)
    want = set()
    for pid, g in pdf.groupby("player_id"):
        if len(g) < 3:
            continue
        for col, code in (("score", "Z_SCORE"), ("kills", "Z_KILLS")):
            m, s = g[col].mean(), g[col].std()
            if s > 0:
                for _, r in g.iterrows():
                    if abs((r[col] - m) / s) > 3.0:
                        want.add((pid, r["match_id"], code))
    from matchops.operators.history import zscore_outliers
    got = {(r.player_id, r.match_id, r.stat_code) for r in zscore_outliers(Analysis(matches_df(rows)).hits).collect()}
    assert got == want and want


def test_hot_player_salting_is_exact(spark, matches_df):
    """One player with a third of all rows: the salted join gives the same flags."""
    import random
    from dataclasses import replace

    from matchops.operators.history import zscore_outliers
    from matchops.operators.joins import hot_keys

    rnd = random.Random(3)
    rows = [row("HOT", f"H{i}", score=float(rnd.randint(900, 1100) * (9 if i % 97 == 0 else 1)),
                kills=rnd.randint(2, 8), dur=600) for i in range(300)]
    for p in range(30):
        rows += [row(f"P{p:02d}", f"M{p}_{i}", score=float(rnd.randint(900, 1100) * (9 if i == 5 else 1)),
                     kills=rnd.randint(2, 8), dur=600) for i in range(20)]
    m = matches_df(rows)
    hot_cfg = replace(DEFAULT, hot_key_min_rows=40)
    plain = Analysis(m)
    salted = Analysis(m, hot_cfg)
    hk = hot_keys(salted.profile, "player_id", "matches_played", hot_cfg).collect()
    assert [(r.player_id, r["_salts"]) for r in hk] == [("HOT", 8)]
    key = lambda a: sorted(map(tuple, zscore_outliers(a.hits).collect()))
    assert key(salted) == key(plain) and key(plain)
    assert sorted(map(tuple, salted.flagged.collect())) == sorted(map(tuple, plain.flagged.collect()))


def test_hot_player_without_outliers_is_split(spark, matches_df):
    """A hot player that is no z candidate is still spread over salts."""
    from dataclasses import replace

    from matchops.operators.joins import hot_keys
    from matchops.operators.players import z_candidates

    rows = [row("CALM", f"H{i}", score=1000.0 + i % 7, dur=600) for i in range(200)]
    rows += [row("WILD", f"W{i}", score=1000.0 if i else 90000.0, dur=600) for i in range(20)]
    cfg = replace(DEFAULT, hot_key_min_rows=50)
    a = Analysis(matches_df(rows), cfg)
    assert [r.player_id for r in z_candidates(a.profile, cfg).collect()] == ["WILD"]
    assert [(r.player_id, r["_salts"]) for r in hot_keys(a.profile, "player_id", "matches_played", cfg).collect()] == [("CALM", 4)]


def test_hot_keys_are_bounded_by_their_share(spark):
    from dataclasses import replace

    from matchops.operators.joins import hot_keys

    cfg = replace(DEFAULT, hot_key_min_rows=1, hot_key_shares=10)
    counts = spark.createDataFrame([("big", 500)] + [(f"p{i}", 10) for i in range(50)], "k string, n long")
    assert [tuple(r) for r in hot_keys(counts, "k", "n", cfg).collect()] == [("big", 5)]
    assert hot_keys(counts.limit(0), "k", "n", cfg).count() == 0


def _history(n, player="A", spike=True):
    from conftest import row

    return [row(player, f"M{i}", score=9000.0 if spike and i == 0 else 100.0 + i % 3, ping=700 if i % 7 == 3 else 40) for i in range(n)]


@pytest.mark.parametrize("cfg", [DEFAULT, replace(DEFAULT, hot_key_min_rows=20, hot_key_shares=4)])
def test_flagged_matches_are_the_flagged_rows_of_all(spark, matches_df, cfg):
    from matchops.operators import history

    m = with_derived(matches_df(_history(30) + _history(60, "B") + _history(40, "C", False) + _history(4, "D")))
    profile = player_profile(m, cfg)
    want = history.match_flags(m, profile, cfg).filter("size(all_flags) > 0")
    got = history.flagged_matches(m, profile, cfg)
    assert got.columns == want.columns
    shown = [sorted((r.player_id, r.match_id, tuple(f.code for f in r.all_flags), len(r.stat_flags)) for r in df.collect()) for df in (got, want)]
    assert shown[0] == shown[1] and {c for r in shown[0] for c in r[2]} >= {"Z_SCORE", "PING"}


def test_flags_do_not_shuffle_all_matches(spark, tmp_path, matches_df):
    """Past the broadcast limit, matches reach the exchange of the candidates'
    join only through a runtime filter, and otherwise only where a rule fires."""
    from matchops.operators import history

    with_derived(matches_df(_history(200))).write.parquet(f"{tmp_path}/m")
    m = spark.read.parquet(f"{tmp_path}/m")
    player_profile(m).write.parquet(f"{tmp_path}/p")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.maxPlanStringLength": "10000000",
            "spark.sql.exchange.reuse": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        flags = history.flagged_matches(m, spark.read.parquet(f"{tmp_path}/p"))
        plan = flags._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert "might_contain" in plan
    assert flags.count() > 0
