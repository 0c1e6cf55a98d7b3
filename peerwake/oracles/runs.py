"""SQL twins of keyed study runs: alternative peers, specifications, placebos and nulls."""

from __future__ import annotations

from .base import cte, outcome_sql

ALL_HORIZONS = "1, 3, 5, 10, 20"


def detection_ctes(px: str, movers: str, days: int = 21) -> str:
    """Greedy group cooldown over movers(k, date, security_id, subsector, peer_group, rel, vol)."""
    return f"""
{px}_next AS MATERIALIZED (
  SELECT a.k, a.peer_group, a.date, min(b.date) AS next_date FROM (SELECT DISTINCT k, peer_group, date FROM {movers}) a
  LEFT JOIN (SELECT DISTINCT k, peer_group, date FROM {movers}) b ON b.k = a.k AND b.peer_group = a.peer_group AND b.date > a.date + {days} GROUP BY 1, 2, 3),
{px}_kept AS (
  SELECT k, peer_group, min(date) AS date FROM {movers} GROUP BY 1, 2
  UNION ALL
  SELECT n.k, n.peer_group, n.next_date FROM {px}_kept q JOIN {px}_next n ON n.k = q.k AND n.peer_group = q.peer_group AND n.date = q.date
  WHERE n.next_date IS NOT NULL),
{px}_events AS MATERIALIZED (
  SELECT m.k, 'evt_' || substr(sha256(CAST(m.date AS VARCHAR) || '|' || m.security_id || '|economic_subsector_peers'), 1, 16) AS event_id,
    m.date, m.security_id, m.subsector, m.peer_group, CASE WHEN rel > 0 THEN 1.0 ELSE -1.0 END AS sgn
  FROM {movers} m JOIN {px}_kept q ON q.k = m.k AND q.peer_group = m.peer_group AND q.date = m.date)"""


def run_ctes(px: str, events: str, edges: str, edges_on: str, returns: str = "ct_adjusted", value: str = "adj", returns_key: str = "",
             pre: int = 5, post: int = 20, horizons: str = ALL_HORIZONS, calendar: str = "ct_calendar") -> str:
    """Event panel and outcomes for events(k, event_id, date, security_id, sgn); edges have peer_id and weight."""
    on = lambda a: f" AND {a}.{returns_key} = d.k" if returns_key else ""
    return f"""
{px}_days AS MATERIALIZED (
  SELECT e.k, e.event_id, e.date AS event_date, e.security_id, e.sgn, d.day, c2.date AS calendar_date
  FROM {events} e JOIN {calendar} c ON c.date = e.date CROSS JOIN (SELECT CAST(unnest(range(-{pre}, {post} + 1)) AS INTEGER) AS day) d
  LEFT JOIN {calendar} c2 ON c2.pos = c.pos + d.day),
{px}_peers AS MATERIALIZED (
  SELECT d.k, d.event_id, d.day, count(*) AS n, count(b.{value}) AS seen, sum(x.weight * b.{value}) AS peer
  FROM {px}_days d JOIN {edges} x ON {edges_on} LEFT JOIN {returns} b ON b.date = d.calendar_date AND b.security_id = x.peer_id{on('b')}
  GROUP BY 1, 2, 3),
{px}_panel AS MATERIALIZED (
  SELECT d.*, a.{value} AS own, CASE WHEN p.seen = p.n THEN p.peer END AS peer, coalesce(p.n, 0) > 0 AS has_peers
  FROM {px}_days d LEFT JOIN {returns} a ON a.date = d.calendar_date AND a.security_id = d.security_id{on('a')}
  LEFT JOIN {px}_peers p ON p.k = d.k AND p.event_id = d.event_id AND p.day = d.day),
{px}_out AS MATERIALIZED ({outcome_sql(f'{px}_panel', horizons, 'k')})"""


PAIRS_ON = "x.date = d.event_date AND x.security_id = d.security_id"

# --- Correlation peers ------------------------------------------------------------------

cte("ct_unit_dates", """
SELECT t, date FROM (SELECT t, date, row_number() OVER (PARTITION BY t ORDER BY date DESC) AS rk FROM (
  SELECT DISTINCT e.date AS t, x.date FROM (SELECT DISTINCT date FROM ct_events) e JOIN ct_panel m ON m.date = e.date AND m.eligible
  JOIN ct_panel x ON x.security_id = m.security_id AND x.date < e.date)) WHERE rk <= 60""")
cte("ct_corr", """
SELECT e.event_id, e.date, e.security_id, p.security_id AS peer_id, corr(a.ret, b.ret) AS c, count(*) AS n
FROM ct_events e JOIN ct_panel p ON p.date = e.date AND p.eligible AND p.security_id <> e.security_id
JOIN ct_unit_dates d ON d.t = e.date JOIN ct_panel a ON a.security_id = e.security_id AND a.date = d.date
JOIN ct_panel b ON b.security_id = p.security_id AND b.date = d.date
WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 30""")
cte("ct_corr_top", """
SELECT *, 1.0 / count(*) OVER (PARTITION BY event_id) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(c, 10) DESC, peer_id) AS rk FROM ct_corr WHERE c IS NOT NULL AND NOT isnan(c)) WHERE rk <= 10""")
cte("ct_def_edges", """
SELECT 'economic_subsector_peers' AS k, e.event_id, x.peer_id, x.weight FROM ct_events e JOIN ct_pairs x ON x.date = e.date AND x.security_id = e.security_id
UNION ALL SELECT 'trailing_return_similarity_peers' AS k, event_id, peer_id, weight FROM ct_corr_top
UNION ALL SELECT 'broad_semiconductor_peers' AS k, e.event_id, p.security_id AS peer_id, 1.0 / count(*) OVER (PARTITION BY e.event_id) AS weight
FROM ct_events e JOIN ct_panel p ON p.date = e.date AND p.eligible AND p.security_id <> e.security_id""")
cte("ct_def_events", """
SELECT k, event_id, date, security_id, sgn FROM ct_events CROSS JOIN (SELECT unnest(['economic_subsector_peers', 'trailing_return_similarity_peers', 'broad_semiconductor_peers']) AS k)""")
DEFINITION_RUN = run_ctes("df", "ct_def_events", "ct_def_edges", "x.k = d.k AND x.event_id = d.event_id", post=10, horizons="1, 3, 5, 10")

# --- Peer quality -------------------------------------------------------------------------

cte("ct_quality_dates", """
SELECT event_id, date FROM (SELECT event_id, date, row_number() OVER (PARTITION BY event_id ORDER BY date DESC) AS rk FROM (
  SELECT DISTINCT e.event_id, x.date FROM ct_events e JOIN ct_panel m ON m.date = e.date AND m.eligible AND m.peer_group = e.peer_group
  JOIN ct_panel x ON x.security_id = m.security_id AND x.date < e.date)) WHERE rk <= 60""")
cte("ct_quality_pairs", """
SELECT d.event_id, x.peer_id, d.date, a.ret AS own, b.ret AS peer
FROM ct_quality_dates d JOIN ct_events e USING (event_id) JOIN ct_pairs x ON x.date = e.date AND x.security_id = e.security_id
LEFT JOIN ct_panel a ON a.security_id = e.security_id AND a.date = d.date LEFT JOIN ct_panel b ON b.security_id = x.peer_id AND b.date = d.date""")
cte("ct_quality", """
SELECT e.event_id, e.date AS event_date, e.security_id, CASE WHEN h.n >= 30 THEN p.mean_corr END AS mean_corr,
  CASE WHEN h.n >= 30 THEN h.basket_corr END AS basket_corr, coalesce(h.n, 0) AS n, l.last_date
FROM ct_events e
LEFT JOIN (SELECT event_id, avg(c) AS mean_corr FROM (SELECT event_id, peer_id, corr(own, peer) AS c FROM ct_quality_pairs GROUP BY 1, 2) WHERE NOT isnan(c) GROUP BY 1) p USING (event_id)
LEFT JOIN (SELECT event_id, count(*) AS n, corr(own, b) AS basket_corr FROM (
    SELECT event_id, date, any_value(own) AS own, avg(peer) AS b FROM ct_quality_pairs GROUP BY 1, 2) WHERE own IS NOT NULL AND b IS NOT NULL GROUP BY 1) h USING (event_id)
LEFT JOIN (SELECT event_id, max(date) AS last_date FROM ct_quality_dates GROUP BY 1) l USING (event_id)""")
cte("ct_volume_rank", """
SELECT e.event_id, e.volume AS now, p.volume AS v, p.date, row_number() OVER (PARTITION BY e.event_id ORDER BY p.date DESC) AS rk
FROM ct_events e JOIN ct_panel p ON p.security_id = e.security_id AND p.date < e.date AND p.volume IS NOT NULL""")
cte("ct_volume", """
SELECT e.event_id, coalesce(count(v), 0) AS n, CASE WHEN count(v) >= 20 THEN avg(CASE WHEN v <= now THEN 1.0 ELSE 0.0 END) END AS pct,
  CASE WHEN count(v) >= 20 THEN median(v) END AS med, max(r.date) AS last_date
FROM ct_events e LEFT JOIN (SELECT * FROM ct_volume_rank WHERE rk <= 252) r USING (event_id) GROUP BY 1""")
cte("ct_coverage", """
SELECT e.event_id, r.peer_count, n.possible - 1 AS possible, r.peer_count / nullif(n.possible - 1, 0) AS coverage, r.peer_adj
FROM ct_events e LEFT JOIN ct_relative r ON r.date = e.date AND r.security_id = e.security_id
LEFT JOIN (SELECT date, peer_group, count(*) AS possible FROM ct_panel WHERE eligible GROUP BY 1, 2) n ON n.date = e.date AND n.peer_group = e.peer_group""")
cte("ct_detail", """
SELECT e.*, m.ticker, m.company_name, e.relative_return / e.relative_volatility AS z, v.pct, v.n AS vn, v.last_date AS vlast, e.volume / nullif(v.med, 0) AS ratio,
  c.peer_count AS pc, c.possible, c.coverage, c.peer_adj
FROM ct_events e LEFT JOIN ct_master m USING (security_id) LEFT JOIN ct_volume v USING (event_id) LEFT JOIN ct_coverage c USING (event_id)""")
cte("ct_state", """
SELECT date, lag(date) OVER (ORDER BY date) AS info,
  CASE WHEN count(factor) OVER m1 >= 15 THEN list_product(list_transform(list(factor) OVER m1, lambda q: 1 + q)) - 1 END AS mom1,
  CASE WHEN count(factor) OVER m3 >= 45 THEN list_product(list_transform(list(factor) OVER m3, lambda q: 1 + q)) - 1 END AS mom3,
  CASE WHEN count(factor) OVER m1 >= 15 THEN stddev_samp(factor) OVER m1 * sqrt(252) END AS vol,
  CASE WHEN count(factor) OVER v20 >= 10 THEN stddev_samp(factor) OVER v20 * sqrt(252) END AS vol20,
  CASE WHEN count(factor) OVER v126 >= 60 THEN sum(factor) OVER v126 END AS sum126,
  CASE WHEN count(factor) OVER m1 >= 15 THEN sum(factor) OVER m1 END AS sum21
FROM ct_factor
WINDOW m1 AS (ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING), m3 AS (ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING),
  v20 AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), v126 AS (ORDER BY date ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING)""")
cte("ct_liquid", """
SELECT date, security_id, CASE WHEN count(*) OVER w >= 10 THEN median(adj_close * volume) OVER w END AS liq
FROM ct_panel WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
cte("ct_chars", """
SELECT e.event_id, abs(e.relative_return) AS shock_magnitude, abs(e.relative_return) / e.relative_volatility AS standardized_shock,
  CAST(NULL AS DOUBLE) AS log_market_cap, ln(1 + l.liq) AS log_trailing_dollar_volume, v.pct AS volume_percentile, e.volume / nullif(v.med, 0) AS abnormal_volume_ratio,
  s.vol20 AS semiconductor_volatility, CAST(NULL AS DOUBLE) AS market_volatility, s.sum126 AS trailing_semiconductor_return,
  CAST(CASE WHEN s.sum126 < 0 THEN 1 ELSE 0 END AS DOUBLE) AS bear_regime, CAST(CASE WHEN e.direction = 'negative' THEN 1 ELSE 0 END AS DOUBLE) AS negative_event,
  CAST(c.peer_count AS DOUBLE) AS peer_count, q.mean_corr AS average_peer_correlation, q.basket_corr AS peer_return_similarity, c.coverage AS peer_portfolio_coverage
FROM ct_events e LEFT JOIN ct_liquid l ON l.date = e.date AND l.security_id = e.security_id LEFT JOIN ct_volume v USING (event_id)
LEFT JOIN ct_state s ON s.date = e.date LEFT JOIN ct_coverage c USING (event_id) LEFT JOIN ct_quality q USING (event_id)""")
cte("ct_pre_volume", """
SELECT e.event_id, CASE WHEN near_n >= 3 AND far_n >= 20 AND far_m > 0 THEN ln(near_m / far_m) END AS measure, last_date, coalesce(near_n, 0) AS near_n, coalesce(far_n, 0) AS far_n
FROM ct_events e LEFT JOIN (SELECT event_id, count(*) FILTER (rk <= 5) AS near_n, avg(v) FILTER (rk <= 5) AS near_m,
    count(*) FILTER (rk BETWEEN 6 AND 65) AS far_n, median(v) FILTER (rk BETWEEN 6 AND 65) AS far_m, max(date) AS last_date FROM ct_volume_rank GROUP BY 1) USING (event_id)""")
cte("ct_mech", """
SELECT e.event_id, e.date, e.subsector, e.security_id, CASE WHEN e.subsector = 'ASIA' THEN 1 ELSE 0 END AS equipment, abs(e.relative_return) / nullif(e.relative_volatility, 0) AS shock,
  CASE WHEN e.direction = 'positive' THEN 1 ELSE 0 END AS up, s.mom1, s.mom3, s.vol, s.info, v.measure, v.last_date
FROM ct_events e LEFT JOIN ct_state s ON s.date = e.date LEFT JOIN ct_pre_volume v USING (event_id)""")

# --- Specifications -----------------------------------------------------------------------

cte("ct_k_movers", """
SELECT k, date, security_id, subsector, peer_group, rel, vol FROM ct_scored CROSS JOIN (SELECT unnest([1.5, 2.0, 2.5, 3.0])::DOUBLE AS k)
WHERE vol IS NOT NULL AND peer_count >= 2 AND NOT extreme_return_flag AND abs(rel) > greatest(0.05, k * vol)""")
THRESHOLD_RUN = detection_ctes("th", "ct_k_movers") + "," + run_ctes("th", "th_events", "ct_pairs", PAIRS_ON)
cte("ct_spec_returns", """
SELECT 'raw_returns' AS k, date, security_id, ret AS v FROM ct_adjusted UNION ALL SELECT 'semiconductor_factor_adjusted' AS k, date, security_id, adj FROM ct_adjusted""")
cte("ct_spec_events", """
SELECT k, event_id, date, security_id, sgn FROM ct_events CROSS JOIN (SELECT unnest(['raw_returns', 'semiconductor_factor_adjusted']) AS k)""")
RETURN_RUN = run_ctes("rd", "ct_spec_events", "ct_pairs", PAIRS_ON, "ct_spec_returns", "v", "k")
cte("ct_var", """
SELECT v.k, p.date, p.security_id, p.subsector, p.peer_group, p.ret, p.volume, p.extreme_return_flag,
  CASE WHEN v.k = 'core_plus_extension' THEN extension_eligible ELSE eligible END AS ok
FROM ct_panel p CROSS JOIN (SELECT unnest(['core', 'core_plus_extension', 'excluding_questionable']) AS k) v""")
cte("ct_var_adj", """
SELECT a.*, a.ret - f.factor AS adj FROM ct_var a LEFT JOIN (SELECT k, date, avg(ret) AS factor FROM ct_var WHERE ok GROUP BY 1, 2) f USING (k, date)""")
cte("ct_var_pairs", """
SELECT a.k, a.date, a.security_id, b.security_id AS peer_id, 1.0 / count(*) OVER (PARTITION BY a.k, a.date, a.security_id) AS weight
FROM ct_var a JOIN ct_var b ON b.k = a.k AND a.date = b.date AND a.peer_group = b.peer_group AND a.security_id <> b.security_id WHERE a.ok AND b.ok""")
cte("ct_var_rel", """
SELECT x.k, x.date, x.security_id, count(b.adj) AS peer_count, any_value(a.adj) - avg(b.adj) AS rel, any_value(a.subsector) AS subsector,
  any_value(a.peer_group) AS peer_group, any_value(a.extreme_return_flag) AS ext
FROM ct_var_pairs x JOIN ct_var_adj b ON b.k = x.k AND b.date = x.date AND b.security_id = x.peer_id
JOIN ct_var_adj a ON a.k = x.k AND a.date = x.date AND a.security_id = x.security_id GROUP BY 1, 2, 3""")


def movers_sql(relative: str) -> str:
    """Threshold passers of relative(k, date, security_id, peer_count, rel, ext) at the baseline settings."""
    return f"""
SELECT * FROM (SELECT *, CASE WHEN count(u) OVER w >= 20 THEN stddev_samp(u) OVER w END AS vol
  FROM (SELECT *, CASE WHEN peer_count >= 2 AND NOT ext THEN rel END AS u FROM {relative} WHERE rel IS NOT NULL)
  WINDOW w AS (PARTITION BY k, security_id ORDER BY date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING))
WHERE vol IS NOT NULL AND u IS NOT NULL AND abs(rel) > greatest(0.05, 2.0 * vol)"""


cte("ct_var_movers", movers_sql("ct_var_rel"))
UNIVERSE_RUN = detection_ctes("un", "ct_var_movers") + "," + run_ctes(
    "un", "un_events", "ct_var_pairs", "x.k = d.k AND " + PAIRS_ON, "ct_var_adj", "adj", "k")

# --- Placebos -------------------------------------------------------------------------------

cte("ct_circle", """
SELECT p.date, p.security_id, row_number() OVER (PARTITION BY p.date ORDER BY sha256(concat_ws('|', 42, p.date, p.security_id))) - 1 AS place,
  count(*) OVER (PARTITION BY p.date) AS pool
FROM ct_panel p JOIN (SELECT DISTINCT date FROM ct_events) d ON d.date = p.date WHERE p.eligible""")


def feistel(rounds: int = 4) -> str:
    """(event, iteration, j) with its place in the keyed permutation, a select for each round."""
    out = "SELECT *, j // size AS l, j % size AS r FROM ct_random_keys CROSS JOIN LATERAL (SELECT unnest(range(0, size * size)) AS j) n"
    for k in range(rounds):
        number = lambda at, digits: f"('0x' || substr(h, {at}, {digits}))::BIGINT"
        mixed = f"(((r * {number(1 + 15 * k, 7)} + {number(8 + 15 * k, 8)}) % 2147483647) >> 12) % size"
        out = f"SELECT * REPLACE (r AS l, xor(l, {mixed}) AS r) FROM ({out})"
    return out


cte("ct_random_keys", """
SELECT it, e.event_id, e.date, e.security_id, c.place AS mine, c.pool - 1 AS others, z.n, 1.0 / z.n AS weight, sha256(concat_ws('|', 42, 'peers', it, e.event_id)) AS h,
  1::BIGINT << greatest(3, (length(bin(greatest(c.pool - 1, 1) - 1)) + 1) // 2)::INTEGER AS size
FROM ct_events e JOIN ct_circle c ON c.date = e.date AND c.security_id = e.security_id
JOIN (SELECT date, security_id, count(*) AS n FROM ct_pairs GROUP BY 1, 2) z ON z.date = e.date AND z.security_id = e.security_id
CROSS JOIN (SELECT unnest(range(0, 20)) AS it)""")
cte("ct_random_slots", f"""
SELECT it, event_id, date, security_id, weight, mine, l * size + r AS step, n FROM ({feistel()}) WHERE l * size + r < others
QUALIFY row_number() OVER (PARTITION BY it, event_id ORDER BY j) <= n""")
cte("ct_random_edges", """
SELECT s.it AS k, s.event_id, s.date, s.security_id, c.security_id AS peer_id, s.weight
FROM ct_random_slots s JOIN ct_circle c ON c.date = s.date AND c.place = CASE WHEN s.step >= s.mine THEN s.step + 1 ELSE s.step END""")
cte("ct_random_events", "SELECT it AS k, event_id, date, security_id, sgn FROM ct_events CROSS JOIN (SELECT unnest(range(0, 20)) AS it)")
RANDOM_RUN = run_ctes("rp", "ct_random_events", "ct_random_edges", "x.k = d.k AND x.event_id = d.event_id", post=10, horizons="1, 3, 5, 10")

cte("ct_strata_raw", """
SELECT date, security_id, eligible, subsector, peer_group, CASE WHEN count(ret) OVER w21 >= 15 THEN stddev_samp(ret) OVER w21 END AS vol,
  CASE WHEN count(*) OVER w20 >= 10 THEN median(adj_close * volume) OVER w20 END AS liq, lag(date) OVER (PARTITION BY security_id ORDER BY date) AS info
FROM ct_panel WINDOW w21 AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING),
  w20 AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
cte("ct_strata", """
SELECT r.date, r.security_id, r.eligible, r.subsector, r.peer_group,
  CASE WHEN r.vol >= CASE WHEN count(r.vol) OVER past >= 20 THEN median(r.vol) OVER past END THEN 'high' ELSE 'normal' END AS volatility_regime,
  CASE WHEN s.date IS NULL THEN NULL WHEN s.sum21 >= 0 THEN 'sector_up' ELSE 'sector_down' END AS market_regime,
  CASE WHEN liq >= median(liq) OVER (PARTITION BY r.date) THEN 'high' ELSE 'low' END AS liquidity_bucket, r.info
FROM ct_strata_raw r LEFT JOIN ct_state s ON s.date = r.date
WINDOW past AS (PARTITION BY r.security_id ORDER BY r.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
# A date without an eligible security has no factor row and no regime.
cte("ct_pseudo_pool", """
SELECT e.event_id, c.date, row_number() OVER (PARTITION BY e.event_id ORDER BY c.date) AS k, count(*) OVER (PARTITION BY e.event_id) AS n
FROM ct_events e JOIN ct_strata s ON s.date = e.date AND s.security_id = e.security_id
JOIN ct_strata c ON c.security_id = e.security_id AND c.eligible AND c.subsector = s.subsector AND c.volatility_regime = s.volatility_regime
  AND c.market_regime = s.market_regime AND c.liquidity_bucket = s.liquidity_bucket
WHERE NOT EXISTS (SELECT 1 FROM ct_events o WHERE o.security_id = e.security_id AND abs(o.date - c.date) <= 30)
  AND EXISTS (SELECT 1 FROM ct_pairs x WHERE x.date = c.date AND x.security_id = c.security_id)""")
cte("ct_pseudo", """
SELECT b.it AS k, e.event_id AS source_event_id, 'pseudo_' || substr(sha256(e.event_id || '|' || CAST(p.date AS VARCHAR)), 1, 16) AS event_id,
  p.date, e.security_id, e.sgn, e.subsector, e.direction
FROM ct_events e CROSS JOIN (SELECT unnest(range(0, 20)) AS it) b
JOIN ct_pseudo_pool p ON p.event_id = e.event_id AND p.k = ('0x' || substr(sha256(concat_ws('|', 42, b.it, e.event_id)), 1, 15))::BIGINT % p.n + 1""")
PSEUDO_RUN = run_ctes("ps", "ct_pseudo", "ct_pairs", PAIRS_ON, post=10, horizons="1, 3, 5, 10")

cte("ct_regime_rank", """
SELECT date, regime, row_number() OVER (PARTITION BY regime ORDER BY date) AS rk FROM (SELECT date, min(market_regime) AS regime FROM ct_strata GROUP BY 1)""")
cte("ct_donors", """
SELECT b.it AS k, t.date AS target_date, s.date AS source_date, t.regime
FROM ct_regime_rank t CROSS JOIN (SELECT unnest(range(0, 10)) AS it) b LEFT JOIN ct_regime_rank s ON s.regime = t.regime
  AND s.rk = ('0x' || substr(sha256(concat_ws('|', 42, b.it, t.date)), 1, 15))::BIGINT % t.rk + 1""")
cte("ct_sim", """
SELECT d.k, p.date, p.security_id, p.eligible, p.subsector, p.peer_group, p.volume, p.extreme_return_flag AS ext, m.mean + (q.adj - mq.mean) AS adj, d.source_date
FROM ct_adjusted p JOIN ct_donors d ON d.target_date = p.date
JOIN (SELECT date, avg(adj) AS mean FROM ct_adjusted GROUP BY 1) m ON m.date = p.date
LEFT JOIN ct_adjusted q ON q.date = d.source_date AND q.security_id = p.security_id
LEFT JOIN (SELECT date, avg(adj) AS mean FROM ct_adjusted GROUP BY 1) mq ON mq.date = d.source_date""")
cte("ct_sim_rel", """
SELECT a.k, a.date, a.security_id, any_value(a.subsector) AS subsector, any_value(a.peer_group) AS peer_group, any_value(a.ext) AS ext,
  count(b.adj) AS peer_count, any_value(a.adj) AS own, avg(b.adj) AS peer, any_value(a.adj) - avg(b.adj) AS rel
FROM ct_sim a JOIN ct_pairs x ON x.date = a.date AND x.security_id = a.security_id JOIN ct_sim b ON b.k = a.k AND b.date = a.date AND b.security_id = x.peer_id
GROUP BY 1, 2, 3""")
cte("ct_sim_movers", movers_sql("ct_sim_rel"))
NULL_RUN = detection_ctes("nl", "ct_sim_movers") + "," + run_ctes("nl", "nl_events", "ct_pairs", PAIRS_ON, "ct_sim", "adj", "k",
                                                                  post=10, horizons="1, 3, 5, 10")


def long_k(px: str) -> str:
    """Valid values of a run in long form: (k, event_id, horizon, outcome, x)."""
    return " UNION ALL ".join(f"SELECT k, event_id, horizon, '{o}' AS outcome, {o} AS x FROM {px}_out WHERE valid"
                              for o in ("convergence", "peer_catchup", "initiator_reversal"))
