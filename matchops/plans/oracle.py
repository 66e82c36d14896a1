"""DuckDB SQL oracles: an independent, single-node re-derivation of every
registered query from the pre-registered driver views.

Only the adapter text (``sources.fixtures``) is shared with the Spark side.
Each query is one SQL statement built from the CTE pieces below; floats
whose last bits depend on the summation order (std, z, quantiles) are
rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from matchops.config import DEFAULT
from matchops.sources.fixtures import duck_matches_cte, duck_raw_cte
from matchops.operators.timeline import REGION_REGISTRY

C = DEFAULT
_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in C.null_tokens)
_WS = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NUM_RE = r"\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*"
_RUNS = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _title(x: str) -> str:
    return ("array_to_string(list_transform(regexp_extract_all(" + x + ", '" + _RUNS
            + "', 1), lambda r: upper(r[1]) || lower(r[2:])), '')")


def _label(x: str) -> str:
    return f"coalesce({_title(_strip(x))}, '{C.null_label}')"


def _num(x: str) -> str:
    v = f"CASE WHEN regexp_full_match({x}, '{_NUM_RE}') THEN try_cast({x} AS DOUBLE) END"
    return f"CASE WHEN isnan({v}) THEN NULL ELSE {v} END"


def _fin(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isinf({x}) AND try_cast(trunc({x}) AS BIGINT) IS NOT NULL)"


MATCHES = "matches AS (" + duck_matches_cte() + ")"
DERIVED = """m AS (
  SELECT *,
    CASE WHEN match_duration_seconds > 0 THEN score / CAST(match_duration_seconds AS DOUBLE)
         WHEN score > 0 THEN CAST('inf' AS DOUBLE) END AS score_per_second,
    CAST(kills AS DOUBLE) / CAST(greatest(deaths, 1) AS DOUBLE) AS kd_ratio
  FROM matches)"""

RAW = "raw AS (" + duck_raw_cte() + ")"

TAGGED = f"""tok AS (
  SELECT CASE WHEN player_id IN ({_TOKENS}) THEN NULL ELSE player_id END player_id,
    CASE WHEN match_id IN ({_TOKENS}) THEN NULL ELSE match_id END match_id,
    CASE WHEN region IN ({_TOKENS}) THEN NULL ELSE region END region,
    CASE WHEN device IN ({_TOKENS}) THEN NULL ELSE device END device,
    CASE WHEN ping IN ({_TOKENS}) THEN NULL ELSE ping END ping,
    CASE WHEN score IN ({_TOKENS}) THEN NULL ELSE score END score,
    CASE WHEN kills IN ({_TOKENS}) THEN NULL ELSE kills END kills,
    CASE WHEN deaths IN ({_TOKENS}) THEN NULL ELSE deaths END deaths,
    CASE WHEN match_duration_seconds IN ({_TOKENS}) THEN NULL ELSE match_duration_seconds END match_duration_seconds,
    ingest_seq
  FROM raw),
parsed AS (
  SELECT player_id, match_id, region, device, ingest_seq,
    {_num('ping')} ping, {_num('score')} score, {_num('kills')} kills,
    {_num('deaths')} deaths, {_num('match_duration_seconds')} match_duration_seconds
  FROM tok),
tagged AS (
  SELECT *, CASE
    WHEN player_id IS NULL OR match_id IS NULL THEN 'null_id'
    WHEN ping IS NULL OR score IS NULL OR kills IS NULL OR deaths IS NULL OR match_duration_seconds IS NULL THEN 'non_numeric'
    WHEN NOT (match_duration_seconds > 0 AND ping >= 0 AND score >= 0 AND kills >= 0 AND deaths >= 0) THEN 'out_of_domain'
    WHEN NOT ({_fin('ping')} AND {_fin('kills')} AND {_fin('deaths')} AND {_fin('match_duration_seconds')}) THEN 'non_finite'
  END AS drop_reason
  FROM parsed)"""


def _finish(src: str) -> str:
    return f"""SELECT {_strip('player_id')} AS player_id, {_strip('match_id')} AS match_id,
    {_label('region')} AS region, {_label('device')} AS device,
    CAST(trunc(ping) AS BIGINT) ping, CAST(score AS DOUBLE) score,
    CAST(trunc(kills) AS BIGINT) kills, CAST(trunc(deaths) AS BIGINT) deaths,
    CAST(trunc(match_duration_seconds) AS BIGINT) match_duration_seconds,
    CASE WHEN trunc(match_duration_seconds) > 0 THEN score / trunc(match_duration_seconds)
         WHEN score > 0 THEN CAST('inf' AS DOUBLE) END score_per_second,
    trunc(kills) / greatest(trunc(deaths), 1) kd_ratio,
    ingest_seq
  FROM {src}"""


RULES = """rf AS (
  SELECT player_id, match_id, 'SCORE_RATE' rule_code, 'High' severity, true is_gameplay,
    score_per_second observed,
    'Score rate spike: ' || printf('%.2f', score_per_second) || ' score/sec (Limit: 50)' reason
  FROM m WHERE score_per_second > 50
  UNION ALL
  SELECT player_id, match_id, 'ZERO_DEATH', 'High', true, CAST(kills AS DOUBLE),
    'High-kill zero-death K/D: ' || CAST(kills AS VARCHAR) || ' kills, 0 deaths'
  FROM m WHERE kills >= 20 AND deaths = 0
  UNION ALL
  SELECT player_id, match_id, 'SHORT_HIGH', 'Medium', true, score,
    'Short match high score: ' || CAST(score AS VARCHAR) || ' score in '
      || CAST(match_duration_seconds AS VARCHAR) || 's'
  FROM m WHERE match_duration_seconds < 120 AND score > 5000
  UNION ALL
  SELECT player_id, match_id, 'EXTREME_KILLS', 'Medium', true, CAST(kills AS DOUBLE),
    'Extreme kills: ' || CAST(kills AS VARCHAR) || ' kills in a match (Limit: 50)'
  FROM m WHERE kills > 50
  UNION ALL
  SELECT player_id, match_id, 'PING', 'Low', false, CAST(ping AS DOUBLE),
    'Ping anomaly: ' || CAST(ping AS VARCHAR) || 'ms (Limits: 5-500ms)'
  FROM m WHERE ping < 5 OR ping > 500)"""

PROFILE = """agg AS (
  SELECT player_id, count(*) matches_played, sum(score) total_score,
    CAST(sum(kills) AS BIGINT) total_kills, CAST(sum(deaths) AS BIGINT) total_deaths,
    avg(score) avg_score, avg(kills) avg_kills, avg(deaths) avg_deaths, avg(ping) avg_ping,
    stddev_samp(score) std_score, stddev_samp(kills) std_kills
  FROM m GROUP BY player_id),
rmode AS (
  SELECT player_id, region primary_region FROM (
    SELECT player_id, region, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, region) k
    FROM (SELECT player_id, region, count(*) n FROM m GROUP BY player_id, region)) WHERE k = 1),
dmode AS (
  SELECT player_id, device FROM (
    SELECT player_id, device, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, device) k
    FROM (SELECT player_id, device, count(*) n FROM m GROUP BY player_id, device)) WHERE k = 1),
prof AS (
  SELECT agg.*, total_score / matches_played avg_score_per_match,
    coalesce(rmode.primary_region, 'Unknown') primary_region, coalesce(dmode.device, 'Unknown') device,
    avg_score * CAST(0.5 AS DOUBLE) + avg_kills * CAST(3.0 AS DOUBLE) + avg_deaths * CAST(-1.0 AS DOUBLE) skill_score
  FROM agg LEFT JOIN rmode ON agg.player_id = rmode.player_id
           LEFT JOIN dmode ON agg.player_id = dmode.player_id)"""

ZFLAGS = """zs AS (
  SELECT m.player_id, m.match_id, m.score, m.kills, p.avg_score, p.std_score, p.avg_kills, p.std_kills
  FROM m JOIN prof p ON m.player_id = p.player_id WHERE p.matches_played >= 3),
zf AS (
  SELECT player_id, match_id, 'Z_SCORE' stat_code, (score - avg_score) / std_score z
  FROM zs WHERE std_score > 0 AND abs((score - avg_score) / std_score) > 3.0
  UNION ALL
  SELECT player_id, match_id, 'Z_KILLS', (kills - avg_kills) / std_kills
  FROM zs WHERE std_kills > 0 AND abs((kills - avg_kills) / std_kills) > 3.0),
af AS (
  SELECT player_id, match_id, severity, is_gameplay, reason FROM rf
  UNION ALL
  SELECT player_id, match_id, 'Low', false,
    CASE WHEN stat_code = 'Z_SCORE' THEN 'Historical score outlier: Z-Score = '
         ELSE 'Historical kills outlier: Z-Score = ' END || printf('%.2f', z) || ' (Limit: +/-3.0)'
  FROM zf)"""

FLAGGED = """tot AS (SELECT player_id, count(*) total FROM m GROUP BY player_id),
fm AS (
  SELECT player_id, count(DISTINCT match_id) flagged,
    count(DISTINCT CASE WHEN is_gameplay THEN match_id END) gameplay,
    max(CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) base_rank
  FROM af GROUP BY player_id),
fl0 AS (
  SELECT fm.player_id, tot.total total_matches_count, fm.flagged flagged_matches_count,
    fm.gameplay gameplay_matches_count,
    CASE base_rank WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END base_severity,
    (tot.total >= 5 AND fm.gameplay / tot.total > 0.5 AND base_rank < 3) escalated
  FROM fm JOIN tot ON fm.player_id = tot.player_id),
fl AS (SELECT *, CASE WHEN escalated THEN 'High' ELSE base_severity END severity FROM fl0)"""

REASONS = f"""rs1 AS (
  SELECT DISTINCT player_id, reason, 0 last FROM af
  UNION ALL
  SELECT player_id, '{C.escalation_text}', 1 FROM fl WHERE escalated),
rs AS (
  SELECT player_id, reason,
    row_number() OVER (PARTITION BY player_id ORDER BY last, reason) pos FROM rs1)"""

BOARD = """bi AS (
  SELECT p.player_id, p.total_score, p.total_kills, p.total_deaths, p.matches_played,
    p.primary_region, p.avg_score_per_match,
    CASE WHEN fl.player_id IS NULL THEN 'clean' ELSE 'under_review' END status
  FROM prof p LEFT JOIN fl ON p.player_id = fl.player_id)"""

_KEYS = "total_score DESC, total_deaths, total_kills DESC, matches_played DESC, player_id"
_BOARD_COLS = ("player_id, total_score, total_kills, total_deaths, matches_played, "
               "primary_region, avg_score_per_match, status")

LOBBY = f"""sk AS (
  SELECT p.*, fl.severity FROM prof p LEFT JOIN fl ON p.player_id = fl.player_id),
pool0 AS (
  SELECT *, coalesce(severity = 'Medium', false) iso FROM sk
  WHERE severity IS NULL OR severity <> 'High'),
pool AS (
  SELECT *,
    CASE WHEN iso THEN player_id || ' (Isolated)'
         WHEN severity = 'Low' THEN player_id || ' (Flagged: Low)' ELSE player_id END player_label,
    CASE WHEN iso THEN 'Global' ELSE primary_region END region,
    CASE WHEN iso THEN 'Mixed' WHEN avg_ping <= 80 THEN 'LowPing'
         WHEN avg_ping <= 150 THEN 'MedPing' ELSE 'HighPing' END ping_band
  FROM pool0),
bs AS (SELECT iso, region, ping_band, count(*) bucket_size FROM pool GROUP BY iso, region, ping_band),
nb AS (
  SELECT pool.*, bs.bucket_size, (NOT pool.iso AND bs.bucket_size >= 6) tiered,
    row_number() OVER (PARTITION BY pool.iso, pool.region, pool.ping_band ORDER BY
      CASE WHEN NOT pool.iso AND bs.bucket_size >= 6 THEN skill_score ELSE CAST(0.0 AS DOUBLE) END,
      player_id) bucket_pos
  FROM pool JOIN bs ON pool.iso = bs.iso AND pool.region = bs.region AND pool.ping_band = bs.ping_band),
qp AS (
  SELECT DISTINCT iso, region, ping_band, bucket_size,
    (bucket_size - 1) * CAST(0.33 AS DOUBLE) h1, (bucket_size - 1) * CAST(0.66 AS DOUBLE) h2
  FROM nb WHERE tiered),
qi AS (
  SELECT *, floor(h1) + 1 a0, least(floor(h1) + 2, bucket_size) a1, h1 - floor(h1) t1,
    floor(h2) + 1 b0, least(floor(h2) + 2, bucket_size) b1, h2 - floor(h2) t2 FROM qp),
qv AS (
  SELECT qi.iso, qi.region, qi.ping_band, qi.t1, qi.t2,
    max(CASE WHEN nb.bucket_pos = qi.a0 THEN nb.skill_score END) va0,
    max(CASE WHEN nb.bucket_pos = qi.a1 THEN nb.skill_score END) va1,
    max(CASE WHEN nb.bucket_pos = qi.b0 THEN nb.skill_score END) vb0,
    max(CASE WHEN nb.bucket_pos = qi.b1 THEN nb.skill_score END) vb1
  FROM qi JOIN nb ON qi.iso = nb.iso AND qi.region = nb.region AND qi.ping_band = nb.ping_band
  GROUP BY qi.iso, qi.region, qi.ping_band, qi.t1, qi.t2),
cuts AS (
  SELECT iso, region, ping_band,
    CASE WHEN t1 < 0.5 THEN va0 + (va1 - va0) * t1 ELSE va1 - (va1 - va0) * (1 - t1) END q_low,
    CASE WHEN t2 < 0.5 THEN vb0 + (vb1 - vb0) * t2 ELSE vb1 - (vb1 - vb0) * (1 - t2) END q_high
  FROM qv),
tiers AS (
  SELECT nb.*, cuts.q_low, cuts.q_high,
    CASE WHEN nb.iso THEN 'Under Review' WHEN NOT nb.tiered THEN 'Mixed'
         WHEN nb.skill_score <= cuts.q_low THEN 'Beginner'
         WHEN nb.skill_score <= cuts.q_high THEN 'Intermediate' ELSE 'Advanced' END skill_tier
  FROM nb LEFT JOIN cuts ON nb.iso = cuts.iso AND nb.region = cuts.region AND nb.ping_band = cuts.ping_band),
lm AS (
  SELECT CASE WHEN iso THEN 'Isolated_UnderReview' ELSE region || '_' || ping_band || '_' || skill_tier END lobby_name,
    region, ping_band, skill_tier, player_id, player_label,
    bucket_pos - min(bucket_pos) OVER (PARTITION BY iso, region, ping_band, skill_tier) + 1 position
  FROM tiers),
lc AS (SELECT lobby_name, count(*) player_count FROM lm GROUP BY lobby_name),
lb AS (
  SELECT lm.lobby_name, lm.region, lm.ping_band, lm.skill_tier, lc.player_count,
    CASE WHEN lm.lobby_name = 'Isolated_UnderReview' THEN 'Isolated'
         WHEN lc.player_count >= 4 THEN 'Ready' ELSE 'Waiting' END status,
    string_agg(lm.player_label, ', ' ORDER BY lm.position) player_ids
  FROM lm JOIN lc ON lm.lobby_name = lc.lobby_name
  GROUP BY lm.lobby_name, lm.region, lm.ping_band, lm.skill_tier, lc.player_count)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (MATCHES, DERIVED, RULES, PROFILE, ZFLAGS, FLAGGED)


def _q_clean() -> str:
    return _with(MATCHES, RAW, TAGGED, """kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, match_id ORDER BY ingest_seq) k
                 FROM tagged WHERE drop_reason IS NULL) WHERE k = 1)""") + _finish("kept")


def _q_latest() -> str:
    return _with(MATCHES, RAW, TAGGED, f"""kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_strip('player_id')}, {_strip('match_id')}
                 ORDER BY ingest_seq DESC) k FROM tagged WHERE drop_reason IS NULL) WHERE k = 1)""") + _finish("kept")


def _q_drops() -> str:
    return _with(MATCHES, RAW, TAGGED) + """
SELECT drop_reason outcome, count(*) rows FROM tagged WHERE drop_reason IS NOT NULL GROUP BY drop_reason
UNION ALL
SELECT 'duplicate', (SELECT count(*) FROM tagged WHERE drop_reason IS NULL)
  - (SELECT count(*) FROM (SELECT DISTINCT player_id, match_id FROM tagged WHERE drop_reason IS NULL))
UNION ALL
SELECT 'kept', (SELECT count(*) FROM (SELECT DISTINCT player_id, match_id FROM tagged WHERE drop_reason IS NULL))
UNION ALL
SELECT 'input', (SELECT count(*) FROM tagged)"""


def _judged() -> str:
    def bad(c, integral):
        v = _num(c)
        if not integral:
            return f"({v} IS NULL)"
        return f"({v} IS NULL OR isinf({v}) OR {v} <> floor({v}) OR try_cast({v} AS BIGINT) IS NULL)"
    ints = ("ping", "kills", "deaths", "match_duration_seconds")
    bad_type = " OR ".join(bad(c, c in ints) for c in C.numeric_columns)
    rng = (f"({_num('ping')} < 0 OR {_num('score')} < 0 OR {_num('kills')} < 0 "
           f"OR {_num('deaths')} < 0 OR {_num('match_duration_seconds')} <= 0)")
    return f"""judged AS (
  SELECT *, CASE
    WHEN player_id IS NULL OR match_id IS NULL OR region IS NULL OR device IS NULL THEN 'missing_field'
    WHEN {bad_type} THEN 'bad_type'
    WHEN {rng} THEN 'out_of_range' END r
  FROM raw)"""


def _q_quarantine() -> str:
    return _with(MATCHES, RAW, _judged()) + """
SELECT player_id, match_id, ingest_seq, CASE WHEN r IS NULL THEN 'accepted' ELSE 'rejected' END status, r reason
FROM judged"""


def q_ingested() -> str:
    """Accepted records, the newest of a key, and all rejected ones."""
    return _with(MATCHES, RAW, _judged()) + f"""
SELECT {_strip('player_id')} player_id, {_strip('match_id')} match_id, 'accepted' status, NULL reason, {_label('region')} region,
  {_num('score')} score
FROM (SELECT *, row_number() OVER (PARTITION BY {_strip('player_id')}, {_strip('match_id')} ORDER BY ingest_seq DESC) k
      FROM judged WHERE r IS NULL)
WHERE k = 1
UNION ALL
SELECT player_id, match_id, 'rejected', r, region, NULL FROM judged WHERE r IS NOT NULL"""


def _board(partition: str, where: str = "") -> str:
    return f"""SELECT CASE WHEN status = 'clean' THEN
    row_number() OVER (PARTITION BY status{partition} ORDER BY {_KEYS}) END AS rank, {_BOARD_COLS}
FROM bi {where}"""


def _lobby_q(select: str) -> str:
    return _with(*BASE, LOBBY) + select


SQL: dict[str, str] = {
    "clean_matches": _q_clean(),
    "drop_accounting": _q_drops(),
    "quarantine_submissions": _q_quarantine(),
    "latest_submission_wins": _q_latest(),
    "rule_flags_long": _with(MATCHES, DERIVED, RULES) + "SELECT * FROM rf",
    "player_moments": _with(MATCHES, DERIVED, PROFILE) + """
SELECT player_id, matches_played, avg_score mean_score, round(std_score, 6) std_score,
  avg_kills mean_kills, round(std_kills, 6) std_kills FROM prof WHERE matches_played >= 3""",
    "zscore_outliers": _with(*BASE) + "SELECT player_id, match_id, stat_code, round(z, 6) z FROM zf",
    "player_totals": _with(MATCHES, DERIVED, PROFILE) + """
SELECT player_id, total_score, total_kills, total_deaths, matches_played, primary_region,
  avg_score_per_match FROM prof""",
    "player_skill": _with(MATCHES, DERIVED, PROFILE) + """
SELECT player_id, avg_score, avg_kills, avg_deaths, avg_ping, primary_region, device, skill_score FROM prof""",
    "flag_counts": _with(*BASE) + """
SELECT player_id, total_matches_count, flagged_matches_count, gameplay_matches_count FROM fl""",
    "base_severity": _with(*BASE) + "SELECT player_id, base_severity FROM fl",
    "escalated_players": _with(*BASE) + """
SELECT player_id, base_severity, severity, gameplay_matches_count, total_matches_count FROM fl WHERE escalated""",
    "suspicious_report": _with(*BASE, REASONS) + f"""
SELECT fl.player_id, fl.severity, fl.flagged_matches_count, fl.total_matches_count,
  string_agg(rs.reason, '; ' ORDER BY rs.pos) flag_reasons
FROM fl JOIN rs ON fl.player_id = rs.player_id
GROUP BY fl.player_id, fl.severity, fl.flagged_matches_count, fl.total_matches_count""",
    "leaderboard_global": _with(*BASE, BOARD) + _board(""),
    "leaderboard_region": _with(*BASE, BOARD) + _board(", primary_region"),
    "top10_players": _with(*BASE, BOARD) + f"""
SELECT * FROM ({_board("")}) ORDER BY CASE WHEN status = 'clean' THEN 0 ELSE 1 END, {_KEYS} LIMIT {C.top_k}""",
    "regional_board_filtered": _with(*BASE, BOARD) + _board(", primary_region", "WHERE primary_region = 'India'"),
    "published_region_board": _with(*BASE, BOARD) + f"""
SELECT * FROM ({_board(", primary_region")}) WHERE primary_region = 'India'""",
    "player_search": _with(*BASE, BOARD) + f"""
SELECT * FROM ({_board("")}) WHERE contains(lower(player_id), '0001')""",
    "matching_pool": _lobby_q("""
SELECT player_id, player_label, severity, primary_region, ping_band, skill_score FROM pool WHERE NOT iso"""),
    "isolated_pool": _lobby_q("""
SELECT player_id, player_label, severity, primary_region, skill_score FROM pool WHERE iso"""),
    "bucket_quantiles": _lobby_q("""
SELECT s.region, s.ping_band, s.players, round(c.q_low, 6) q_low, round(c.q_high, 6) q_high
FROM (SELECT region, ping_band, count(*) players FROM pool WHERE NOT iso GROUP BY region, ping_band) s
LEFT JOIN cuts c ON NOT c.iso AND s.region = c.region AND s.ping_band = c.ping_band"""),
    "lobby_members": _lobby_q("""
SELECT lobby_name, region, ping_band, skill_tier, player_id, player_label, position FROM lm"""),
    "lobbies": _lobby_q("SELECT * FROM lb"),
    "lobbies_in_region": _lobby_q("SELECT * FROM lb WHERE region = 'India'"),
    "regions_with_lobbies": _lobby_q(
        "SELECT DISTINCT region FROM lb WHERE lobby_name <> 'Isolated_UnderReview'"),
    "roster_exploded": _lobby_q("""
SELECT lobby_name, player_label, player_id, contains(player_label, '(Flagged: Low)') is_low_flagged FROM lm"""),
    "csv_ingest": f"SELECT * EXCLUDE (ingest_seq) FROM ({_q_clean()})",
    "bulk_replaced_store": f"SELECT * EXCLUDE (ingest_seq) FROM ({_q_clean()})",
    "persisted_matches": _with(MATCHES) + "SELECT player_id, match_id, region, device, score, kills FROM matches",
    "region_board_file": _with(*BASE, BOARD) + f"""
SELECT row_number() OVER (ORDER BY primary_region, rank NULLS LAST, {_KEYS}) place, rank, player_id, primary_region, status, total_score
FROM ({_board(", primary_region")})""",
    "suspicious_file": _with(*BASE, REASONS) + """
SELECT row_number() OVER (ORDER BY CASE severity WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, flagged_matches_count DESC, player_id) place,
  player_id, severity, flagged_matches_count, flag_reasons
FROM fl JOIN (SELECT player_id p, string_agg(reason, '; ' ORDER BY pos) flag_reasons FROM rs GROUP BY player_id) ON p = player_id""",
    "lobbies_file": _lobby_q("""
SELECT row_number() OVER (ORDER BY lobby_name) place, lobby_name, player_count, status, player_ids FROM lb"""),
    "reasons_split": _with(*BASE, REASONS) + "SELECT player_id, reason FROM rs",
    "report_records": _with(*BASE, BOARD, LOBBY) + f"""
SELECT 'leaderboard_global' report, player_id id, rank number, rank IS NULL null_rank FROM ({_board("")})
UNION ALL SELECT 'leaderboard_region', player_id, rank, rank IS NULL FROM ({_board(", primary_region")})
UNION ALL SELECT 'suspicious_players', player_id, flagged_matches_count, false FROM fl
UNION ALL SELECT 'matchmaking_groups', lobby_name, player_count, false FROM lb
UNION ALL SELECT 'players', player_id || '/' || match_id, kills, false FROM m""",
    "reasons_exploded": _with(*BASE, REASONS) + "SELECT player_id, reason FROM rs",
    "status_kpis": _with(MATCHES) + """
SELECT count(*) > 0 is_loaded, count(*) total_records, count(DISTINCT player_id) unique_players FROM matches""",
    "run_summary": _lobby_q("""
SELECT (SELECT count(*) FROM m) total_matches, (SELECT count(DISTINCT player_id) FROM m) unique_players,
  (SELECT count(*) FROM fl) flagged_players, (SELECT count(DISTINCT lobby_name) FROM lb) lobbies"""),
    "ingest_rate": _with(MATCHES) + """
SELECT strftime(time_bucket(INTERVAL '1 minute', created_at), '%Y-%m-%d %H:%M:%S') window_start,
  count(*) matches, count(*) / 60.0 matches_per_sec
FROM matches GROUP BY 1""",
    "flagged_per_minute": _with(MATCHES, DERIVED, RULES) + """
SELECT strftime(time_bucket(INTERVAL '1 minute', m.created_at), '%Y-%m-%d %H:%M:%S') window_start,
  count(*) flagged_matches, count(DISTINCT m.player_id) flagged_players
FROM m WHERE EXISTS (SELECT 1 FROM rf WHERE rf.player_id = m.player_id AND rf.match_id = m.match_id)
GROUP BY 1""",
    "season_leaderboard": _with(*BASE, """sp AS (
  SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(created_at AS DATE)) // 7 AS BIGINT) season,
    player_id, sum(score) total_score, CAST(sum(kills) AS BIGINT) total_kills,
    CAST(sum(deaths) AS BIGINT) total_deaths, count(*) matches_played
  FROM m GROUP BY 1, 2),
sb AS (
  SELECT sp.*, CASE WHEN fl.player_id IS NULL THEN 'clean' ELSE 'under_review' END status
  FROM sp LEFT JOIN fl ON sp.player_id = fl.player_id)""") + f"""
SELECT season, CASE WHEN status = 'clean' THEN
    row_number() OVER (PARTITION BY status, season ORDER BY {_KEYS}) END rank,
  player_id, total_score, total_kills, total_deaths, matches_played, status FROM sb""",
    "canonical_regions": _with(MATCHES, DERIVED, PROFILE, "reg(alias, canonical) AS (VALUES "
                               + ", ".join(f"('{a}', '{b}')" for a, b in REGION_REGISTRY) + ")") + """
SELECT p.player_id, p.primary_region, coalesce(reg.canonical, p.primary_region) canonical_region
FROM prof p LEFT JOIN reg ON p.primary_region = reg.alias""",
}
