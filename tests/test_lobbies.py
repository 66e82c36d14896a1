"""Lobby edges: ping bands, tiers, sizes, isolation, quantile parity."""

import pandas as pd
from hypothesis import HealthCheck, given, settings, strategies as st

from conftest import row
from matchops.operators import lobbies
from matchops.plans.batch import Analysis


def _lobbies(spark, m, flagged=None):
    a = Analysis(m)
    f = flagged if flagged is not None else a.flagged
    return {r.lobby_name: r for r in lobbies.lobbies(a.profile, f).collect()}, a


def test_ping_band_edges(spark, matches_df):
    m = matches_df([
        row("A", "M1", ping=80), row("B", "M1", ping=80), row("B", "M2", ping=81),
        row("C", "M1", ping=150), row("D", "M1", ping=150), row("D", "M2", ping=151),
    ])
    got, _ = _lobbies(spark, m)
    assert got["India_LowPing_Mixed"].player_ids == "A"
    assert got["India_MedPing_Mixed"].player_ids == "B, C"
    assert got["India_HighPing_Mixed"].player_ids == "D"


def test_bucket_5_vs_6_and_ready(spark, matches_df):
    five = [row(f"P{i}", "M1", score=1000 + 100 * i) for i in range(5)]
    got, _ = _lobbies(spark, matches_df(five))
    assert list(got) == ["India_LowPing_Mixed"]
    assert (got["India_LowPing_Mixed"].player_count, got["India_LowPing_Mixed"].status) == (5, "Ready")
    six = [row(f"P{i}", "M1", score=1000 + 100 * i) for i in range(6)]
    got, _ = _lobbies(spark, matches_df(six))
    assert sorted(got) == ["India_LowPing_Advanced", "India_LowPing_Beginner", "India_LowPing_Intermediate"]
    assert all(r.status == "Waiting" for r in got.values())


def test_isolated_large_and_low_tag(spark, matches_df):
    m = matches_df([row(f"M{i}", "X1") for i in range(5)] + [row("L", "X1"), row("C", "X1")])
    flagged = spark.createDataFrame(
        [(f"M{i}", "Medium") for i in range(5)] + [("L", "Low")], "player_id string, severity string")
    got, _ = _lobbies(spark, m, flagged)
    iso = got["Isolated_UnderReview"]
    assert (iso.region, iso.ping_band, iso.skill_tier, iso.status, iso.player_count) == (
        "Global", "Mixed", "Under Review", "Isolated", 5)
    assert iso.player_ids == ", ".join(f"M{i} (Isolated)" for i in range(5))
    assert got["India_LowPing_Mixed"].player_ids == "C, L (Flagged: Low)"


def test_region_with_underscore_keeps_columns(spark, matches_df):
    got, _ = _lobbies(spark, matches_df([row("A", "M1", region="Us_East")]))
    r = got["Us_East_LowPing_Mixed"]
    assert (r.region, r.ping_band, r.skill_tier) == ("Us_East", "LowPing", "Mixed")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=6, max_size=30))
def test_quantile_cuts_match_pandas(spark, matches_df, scores):
    rows = [row(f"P{i:03d}", "M1", score=100.0 * s, kills=i % 3, deaths=1) for i, s in enumerate(scores)]
    a = Analysis(matches_df(rows))
    q = lobbies.bucket_quantiles(a.profile, a.flagged).first()
    skill = pd.Series([100.0 * s * 0.5 + (i % 3) * 3.0 - 1.0 for i, s in enumerate(scores)])
    assert q.q_low == skill.quantile(0.33)
    assert q.q_high == skill.quantile(0.66)
    members = lobbies.lobby_members(a.profile, a.flagged).collect()
    for r in members:
        s = r.skill_score
        want = "Beginner" if s <= skill.quantile(0.33) else (
            "Intermediate" if s <= skill.quantile(0.66) else "Advanced")
        assert r.skill_tier == want


def test_one_row_keeps_every_member(spark, matches_df):
    from dataclasses import replace
    from matchops.config import DEFAULT
    cfg = replace(DEFAULT, text_segment=2)
    m = matches_df([row(f"P{i}", "M1") for i in range(5)])
    a = Analysis(m, cfg)
    rows = lobbies.lobbies(a.profile, a.flagged, cfg).collect()
    assert [r.player_ids for r in rows] == ["P0, P1, P2, P3, P4"]
    assert {r.player_count for r in rows} == {5}


def test_small_bucket_goes_by_id_over_segments(spark, matches_df):
    from dataclasses import replace
    from matchops.config import DEFAULT
    cfg = replace(DEFAULT, text_segment=2)
    a = Analysis(matches_df([row(f"P{i}", "M1", score=9000 - 1000 * i) for i in range(5)]), cfg)
    got = {r.player_id: (r.position, r.player_count) for r in lobbies.lobby_members(a.profile, a.flagged, cfg).collect()}
    assert got == {f"P{i}": (i + 1, 5) for i in range(5)}
    assert lobbies.lobbies(a.profile, a.flagged, cfg).first().player_ids == "P0, P1, P2, P3, P4"


def test_numbered_pool_is_read_twice(spark, matches_df):
    """Once for the rows, once for the few at the cuts; sizes come from the pieces."""
    a = Analysis(matches_df([row(f"P{i}", "M1", score=1000 + i) for i in range(8)]))
    plan = lobbies.lobbies(a.profile, a.flagged)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "_nb_seq" in line for line in plan.splitlines()) == 2
