"""Golden sample: 18 raw rows -> the four published reports, exactly."""

from matchops.operators import lobbies, ranking, severity
from matchops.operators.cleaning import clean_matches
from matchops.plans.batch import Analysis
from matchops.sources.csv_source import read_raw

# The sample rows and the reports published for them.
SAMPLE = """\
P001,M001,India,Android,55,3200,18,4,420
P002,M001,India,Android,70,2800,14,5,430
P003,M002,SEA,iOS,90,99000,250,0,60
P004,M002,India,PC,40,3500,20,6,460
P005,M003,Europe,Android,130,1200,6,8,390
P006,M004,India,PC,45,3000,10,2,400
P007,M004,India,Android,50,3000,12,4,410
P008,M005,Europe,PC,220,1500,8,7,450
P009,M005,Europe,PC,35,1600,9,5,440
P001,M006,India,Android,60,3400,20,3,400
P001,M007,India,Android,58,3100,17,4,410
P010,M008,SEA,Android,85,2500,11,6,420
P011,M008,SEA,iOS,92,2600,13,5,415
P012,M008,SEA,PC,88,2700,14,4,425
P013,M008,SEA,Console,95,2400,10,7,430
P014,M009,India,iOS,30,4000,22,5,450
P015,M009,India,PC,35,4200,24,4,440
P016,M009,India,Android,32,3800,19,6,460""".splitlines()

GLOBAL = [
    (1, "P001", 9700.0, 55, 11, 3, "India", 3233.3333333333335, "clean"),
    (2, "P015", 4200.0, 24, 4, 1, "India", 4200.0, "clean"),
    (3, "P014", 4000.0, 22, 5, 1, "India", 4000.0, "clean"),
    (4, "P016", 3800.0, 19, 6, 1, "India", 3800.0, "clean"),
    (5, "P004", 3500.0, 20, 6, 1, "India", 3500.0, "clean"),
    (6, "P006", 3000.0, 10, 2, 1, "India", 3000.0, "clean"),
    (7, "P007", 3000.0, 12, 4, 1, "India", 3000.0, "clean"),
    (8, "P002", 2800.0, 14, 5, 1, "India", 2800.0, "clean"),
    (9, "P012", 2700.0, 14, 4, 1, "Sea", 2700.0, "clean"),
    (10, "P011", 2600.0, 13, 5, 1, "Sea", 2600.0, "clean"),
    (11, "P010", 2500.0, 11, 6, 1, "Sea", 2500.0, "clean"),
    (12, "P013", 2400.0, 10, 7, 1, "Sea", 2400.0, "clean"),
    (13, "P009", 1600.0, 9, 5, 1, "Europe", 1600.0, "clean"),
    (14, "P008", 1500.0, 8, 7, 1, "Europe", 1500.0, "clean"),
    (15, "P005", 1200.0, 6, 8, 1, "Europe", 1200.0, "clean"),
    (None, "P003", 99000.0, 250, 0, 1, "Sea", 99000.0, "under_review"),
]
REGION_ORDER = ["P009", "P008", "P005", "P001", "P015", "P014", "P016", "P004", "P006",
                "P007", "P002", "P012", "P011", "P010", "P013", "P003"]
REGION_RANKS = [1, 2, 3, 1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, None]
SUSPICIOUS = [(
    "P003", "High", 1, 1,
    "Extreme kills: 250 kills in a match (Limit: 50); High-kill zero-death K/D: 250 kills, 0 deaths; "
    "Score rate spike: 1650.00 score/sec (Limit: 50); Short match high score: 99000.0 score in 60s",
)]
LOBBIES = [
    ("Europe_HighPing_Mixed", "Europe", "HighPing", "Mixed", 1, "Waiting", "P008"),
    ("Europe_LowPing_Mixed", "Europe", "LowPing", "Mixed", 1, "Waiting", "P009"),
    ("Europe_MedPing_Mixed", "Europe", "MedPing", "Mixed", 1, "Waiting", "P005"),
    ("India_LowPing_Advanced", "India", "LowPing", "Advanced", 3, "Waiting", "P016, P014, P015"),
    ("India_LowPing_Beginner", "India", "LowPing", "Beginner", 3, "Waiting", "P002, P006, P007"),
    ("India_LowPing_Intermediate", "India", "LowPing", "Intermediate", 2, "Waiting", "P001, P004"),
    ("Sea_MedPing_Mixed", "Sea", "MedPing", "Mixed", 4, "Ready", "P010, P011, P012, P013"),
]


def _analysis(spark, csv_file):
    return Analysis(clean_matches(read_raw(spark, csv_file(SAMPLE))))


def test_golden_reports(spark, csv_file):
    a = _analysis(spark, csv_file)
    g = [tuple(r) for r in ranking.order_global(a.leaderboard_global()).collect()]
    assert g == GLOBAL
    reg = ranking.order_region(a.leaderboard_region()).collect()
    assert [r.player_id for r in reg] == REGION_ORDER
    assert [r.rank for r in reg] == REGION_RANKS
    s = [tuple(r)[:5] for r in severity.order_report(a.suspicious_report()).collect()]
    assert s == SUSPICIOUS
    lb = [tuple(r)[:7] for r in lobbies.order_lobbies(a.lobbies()).collect()]
    assert lb == LOBBIES


def test_top10_matches_board_head(spark, csv_file):
    a = _analysis(spark, csv_file)
    top = [tuple(r) for r in a.top_k(10).collect()]
    assert sorted(top, key=lambda r: r[0]) == GLOBAL[:10]
    top20 = [tuple(r) for r in a.top_k(20).collect()]
    assert sorted(top20, key=lambda r: (r[0] is None, r[0] or 0)) == GLOBAL
