import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from matchops.session import local_session  # noqa: E402

HEADER = "player_id,match_id,region,device,ping,score,kills,deaths,match_duration_seconds"
CLEAN_SCHEMA = (
    "player_id string, match_id string, region string, device string, ping int, "
    "score double, kills int, deaths int, match_duration_seconds int"
)


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, app="matchops-tests")
    yield s


@pytest.fixture
def csv_file(tmp_path):
    def make(rows, header=HEADER, name="in.csv"):
        p = tmp_path / name
        p.write_text("\n".join([header] + list(rows)) + "\n")
        return str(p)
    return make


@pytest.fixture
def matches_df(spark):
    """Clean match rows from dicts (derived columns added by the engine)."""
    def make(rows):
        cols = [c.split()[0] for c in CLEAN_SCHEMA.split(", ")]
        data = [tuple(r.get(c) for c in cols) for r in rows]
        return spark.createDataFrame(data, CLEAN_SCHEMA)
    return make


def row(pid, mid, region="India", device="Pc", ping=40, score=1000.0, kills=5, deaths=3, dur=300):
    return dict(player_id=pid, match_id=mid, region=region, device=device, ping=ping,
                score=float(score), kills=kills, deaths=deaths, match_duration_seconds=dur)
