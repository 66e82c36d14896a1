"""Match telemetry analytics expressed as Spark DataFrame / SQL plans.

Every public function takes and returns DataFrames (or Columns); nothing
pulls match-level data to the driver.  See README.md for the map from
report to operator.
"""

from matchops.config import Config, DEFAULT

__all__ = ["Config", "DEFAULT"]
