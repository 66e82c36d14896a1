"""All thresholds and policies in one frozen object.

The defaults are the fixed values the reports must reproduce; every one
of them can be overridden with ``dataclasses.replace(DEFAULT, ...)``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # --- fixed values (must equal the published behaviour) -------------
    # Input contract, in header order.
    required_columns: tuple[str, ...] = (
        "player_id", "match_id", "region", "device", "ping",
        "score", "kills", "deaths", "match_duration_seconds",
    )
    numeric_columns: tuple[str, ...] = (
        "ping", "score", "kills", "deaths", "match_duration_seconds",
    )
    # Text a CSV reader treats as missing (pandas read_csv default list).
    null_tokens: tuple[str, ...] = (
        "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
        "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
        "n/a", "nan", "null",
    )
    # Label a missing region/device gets after str() + title-case.
    null_label: str = "Nan"
    unknown_label: str = "Unknown"

    # Per-match rules.
    rate_limit: float = 50.0               # C1: score_per_second > 50
    zero_death_min_kills: int = 20         # C2: kills >= 20 and deaths == 0
    short_match_seconds: int = 120         # C3: duration < 120 ...
    short_match_score: float = 5000.0      #     ... and score > 5000
    extreme_kills: int = 50                # C4: kills > 50
    ping_min: int = 5                      # C5: ping < 5 or ping > 500
    ping_max: int = 500

    # Historical outliers.
    z_min_history: int = 3
    z_limit: float = 3.0

    # Escalation.
    escalation_min_matches: int = 5
    escalation_ratio: float = 0.5
    escalation_text: str = (
        "Escalation: Repeated gameplay anomalies across multiple matches (>50%)"
    )

    # Matchmaking.
    low_ping_max: float = 80.0
    med_ping_max: float = 150.0
    skill_weights: tuple[float, float, float] = (0.5, 3.0, -1.0)  # score, kills, deaths
    tier_min_players: int = 6
    tier_quantiles: tuple[float, float] = (0.33, 0.66)
    lobby_ready_size: int = 4
    isolated_lobby: str = "Isolated_UnderReview"
    isolated_region: str = "Global"
    isolated_band: str = "Mixed"
    isolated_tier: str = "Under Review"
    isolated_status: str = "Isolated"
    mixed_tier: str = "Mixed"
    low_tag: str = " (Flagged: Low)"
    isolated_tag: str = " (Isolated)"
    reason_separator: str = "; "
    roster_separator: str = ", "
    top_k: int = 10

    # --- policies (ours) ----------------------------------------------
    # Dedup on raw ids (parity) or after trimming.
    dedup_after_trim: bool = False
    # Text lists (rosters, reasons) are joined by segments of this many
    # items, so that no list of all items of a group is held anywhere.
    text_segment: int = 1000
    # Keys with more than hot_key_min_rows rows and more than one
    # hot_key_shares-th of all rows are salted in the skew-aware join.
    # Fewer than hot_key_shares keys can hold that much, which bounds the
    # broadcast hot-key table.
    hot_key_min_rows: int = 1_000_000
    hot_key_shares: int = 1000

    @property
    def z_min_matches(self) -> int:
        """Smallest history length at which |z| can exceed the limit.

        With the row itself in the sample, max |z| = (n-1)/sqrt(n), so
        shorter histories can be pruned before the join without changing
        any flag.
        """
        n = max(self.z_min_history, 2)
        while (n - 1) / math.sqrt(n) <= self.z_limit:
            n += 1
        return n


DEFAULT = Config()
