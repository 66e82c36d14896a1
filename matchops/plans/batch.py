"""One batch analysis over a clean ``matches`` DataFrame.

``Analysis`` wires the operators together.  Two small intermediates are
cut from their lineage the first time they are needed, written as parquet
tables under the session's checkpoint folder (shared on a cluster):

* ``profile`` — one row per player (totals, averages, moments, modes);
* ``hits`` — only the matches that carry a flag (rule or z-score).

Every report then reads those two tables, so the match table is scanned for
the player aggregate and for the flags (by the rules, and for the matches of
z-score candidates) however many reports are built; the season board scans it
again.  A lost executor re-reads those tables instead of
recomputing from the raw scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from matchops.config import Config, DEFAULT
from matchops.operators import history, lobbies, players, ranking, severity
from matchops.operators.cleaning import with_derived
from matchops.session import materialize


@dataclass
class Analysis:
    matches: DataFrame
    cfg: Config = DEFAULT
    _cache: dict = field(default_factory=dict)

    def __post_init__(self):
        if "score_per_second" not in self.matches.columns:
            self.matches = with_derived(self.matches)

    def _cut(self, name: str, build) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = materialize(build(), f"analysis-{name}")
        return self._cache[name]

    # shared intermediates ------------------------------------------------
    @property
    def profile(self) -> DataFrame:
        return self._cut("profile", lambda: players.player_profile(self.matches, self.cfg))

    @property
    def flags(self) -> DataFrame:
        """Per-match flags for every match (lazy; full size)."""
        return history.match_flags(self.matches, self.profile, self.cfg)

    @property
    def hits(self) -> DataFrame:
        """Flagged matches only (checkpointed; a small fraction of rows)."""
        return self._cut("hits", lambda: history.flagged_matches(self.matches, self.profile, self.cfg))

    @property
    def flagged(self) -> DataFrame:
        return severity.flagged_players(self.hits, self.profile, self.cfg)

    # reports ---------------------------------------------------------------
    def suspicious_report(self) -> DataFrame:
        return severity.suspicious_report(self.hits, self.flagged, self.cfg)

    def leaderboard_global(self) -> DataFrame:
        return ranking.leaderboard_global(self.profile, self.flagged)

    def leaderboard_region(self, region: str | None = None) -> DataFrame:
        return ranking.leaderboard_region(self.profile, self.flagged, region)

    def top_k(self, k: int | None = None) -> DataFrame:
        return ranking.top_k(self.profile, self.flagged, k or self.cfg.top_k)

    def lobby_members(self) -> DataFrame:
        return lobbies.lobby_members(self.profile, self.flagged, self.cfg)

    def lobbies(self, region: str | None = None) -> DataFrame:
        return lobbies.lobbies(self.profile, self.flagged, self.cfg, region)

    def lobby_names(self) -> DataFrame:
        return lobbies.lobby_names(self.profile, self.flagged, self.cfg)
