"""SQL twins of the study stages, as named common table expressions.

``compose`` prepends only the expressions a statement needs, in dependency order.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
RECURSIVE_ORDER: list[str] = []


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _needs(sql: str) -> set[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", sql.lower()))
    return words & set(CTES)


def compose(body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in sorted(_needs(CTES[name]) - {name}):
            visit(need)
        order.append(name)

    for need in sorted(_needs(body)):
        visit(need)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" if "UNION ALL" not in CTES[n] or not re.search(rf"\b{n}\b", CTES[n])
                       else f"{n} AS ({CTES[n]})" for n in order)
    own = re.match(r"\s*WITH(?:\s+RECURSIVE)?\s", body)
    rest = f",\n{body[own.end():]}" if own else f"\n{body}"
    return f"WITH RECURSIVE {parts}{rest}".strip()


def r(expr: str, digits: int = 8) -> str:
    return f"round({expr}, {digits}) + 0.0"


cte("ct_vendor", """
SELECT l_suppkey, DATE '1995-01-02' + CAST(floor((CAST(l_shipdate AS DATE) - DATE '1995-01-02') / 14.0) AS INTEGER) * 14 AS date,
       avg(l_discount) AS d, avg(l_tax) AS t, min(l_discount) AS lo, max(l_discount) AS hi, min(l_tax) AS tx,
       sum(l_quantity) AS volume
FROM lineitem GROUP BY 1, 2""")
cte("ct_prices", """
SELECT date, 'SEC_S_' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS security_id,
       'S.' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS ticker,
       round((1 + tx) * 100, 6) AS open, round((1 + hi) * 100, 6) AS high, round((1 + lo) * 100, 6) AS low,
       round((1 + d) * 100, 6) AS close, round((1 + d - t) * 100, 6) AS adj_close, volume
FROM ct_vendor""")
cte("ct_meta", """
SELECT upper('s.' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0')) AS ticker, s_name AS company_name,
       n_name || CASE WHEN s_suppkey % 10 = 0 THEN ' ADR' ELSE '' END AS exchange_or_market,
       r_name AS subsector, 'supplier' AS semiconductor_role, 'ships from ' || n_name AS business_description,
       'listed supplier' AS inclusion_reason, 'reviewed' AS review_flag,
       CASE WHEN s_acctbal >= 0 THEN 'core' ELSE 'extension' END AS universe_tier,
       'nation ' || CAST(n_nationkey AS VARCHAR) AS notes
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
cte("ct_master", """
SELECT 'SEC_' || regexp_replace(regexp_replace(upper(ticker), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS security_id,
       ticker, company_name, exchange_or_market, subsector, semiconductor_role, universe_tier, review_flag,
       exchange_or_market AS exchange,
       CASE WHEN exchange_or_market LIKE '% ADR' THEN 'adr' ELSE 'common_stock' END AS security_type,
       'Semiconductor ecosystem' AS sector, subsector AS sub_industry
FROM ct_meta""")
cte("ct_returns", """
SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY security_id ORDER BY date) - 1 AS ret FROM ct_prices""")
cte("ct_features", """
SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date) AS history_days,
  CASE WHEN count(*) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10
       THEN avg(close * volume) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS adv
FROM ct_returns""")


def reasons(min_history: int, tiers: str) -> str:
    """Ordered exclusion labels of one parameter set over a row of grid columns."""
    return f"""concat_ws(';',
      CASE WHEN date < DATE '1995-05-01' THEN 'before_eligibility_start_date' END,
      CASE WHEN date > DATE '2001-10-01' THEN 'after_eligibility_end_date' END,
      CASE WHEN universe_tier NOT IN ({tiers}) THEN 'universe_tier_not_allowed' END,
      CASE WHEN exchange_or_market IN ('NATION_24', 'NATION_24 ADR') THEN 'listing_restriction' END,
      CASE WHEN close IS NULL THEN 'missing_data;no_market_data' END,
      CASE WHEN close IS NOT NULL AND history_days < {min_history} THEN 'insufficient_history' END,
      CASE WHEN close < 101 THEN 'below_minimum_price' END,
      CASE WHEN close IS NOT NULL AND adv IS NULL THEN 'insufficient_liquidity_history' END,
      CASE WHEN close IS NOT NULL AND adv < 6600 THEN 'insufficient_liquidity;below_minimum_liquidity' END)"""


BASE_REASONS = reasons(26, "'core'")
EXT_REASONS = reasons(8, "'core', 'extension'")
cte("ct_grid", """
SELECT d.date, m.security_id, m.ticker, m.subsector, m.universe_tier, m.exchange_or_market, f.close, f.history_days, f.adv
FROM (SELECT DISTINCT date FROM ct_prices) d CROSS JOIN ct_master m
LEFT JOIN ct_features f ON f.date = d.date AND f.security_id = m.security_id""")
cte("ct_verdicts", f"""
SELECT date, security_id, ticker, subsector, universe_tier, {BASE_REASONS} AS why, {EXT_REASONS} AS ext_why FROM ct_grid""")
cte("ct_membership", """
SELECT date, security_id, subsector, universe_tier, why = '' AS eligible, nullif(why, '') AS exclusion_reason,
       ext_why = '' AS extension_eligible, nullif(ext_why, '') AS extension_reason
FROM ct_verdicts WHERE date BETWEEN DATE '1995-05-01' AND DATE '2001-10-01'""")
cte("ct_panel", """
SELECT f.date, f.security_id, m.ticker, m.subsector, m.universe_tier, 'star_schema_v1' AS universe_version, f.adj_close,
       f.ret, f.volume, coalesce(e.eligible, false) AS eligible, coalesce(e.extension_eligible, false) AS extension_eligible,
       coalesce(abs(f.ret) > 0.15, false) AS extreme_return_flag, f.close, m.company_name,
       m.subsector || '/' || CAST(CAST(substr(m.ticker, 3, 10) AS BIGINT) // 25 AS VARCHAR) AS peer_group
FROM ct_features f JOIN ct_master m USING (security_id)
LEFT JOIN ct_membership e ON e.date = f.date AND e.security_id = f.security_id""")
cte("ct_factor", "SELECT date, avg(ret) AS factor FROM ct_panel WHERE eligible GROUP BY date")
cte("ct_adjusted", """
SELECT p.*, f.factor, p.ret - f.factor AS adj FROM ct_panel p LEFT JOIN ct_factor f USING (date)""")
cte("ct_pairs", """
SELECT a.date, a.security_id, b.security_id AS peer_id, a.subsector, a.peer_group,
       1.0 / count(*) OVER (PARTITION BY a.date, a.security_id) AS weight
FROM ct_adjusted a JOIN ct_adjusted b ON a.date = b.date AND a.peer_group = b.peer_group AND a.security_id <> b.security_id
WHERE a.eligible AND b.eligible""")
cte("ct_relative", """
SELECT x.date, x.security_id, x.subsector, x.peer_group, count(b.adj) AS peer_count, avg(b.adj) AS peer_adj, avg(b.ret) AS peer_ret,
       any_value(a.adj) AS own_adj, any_value(a.ret) AS own_ret, any_value(a.adj) - avg(b.adj) AS rel
FROM ct_pairs x JOIN ct_adjusted b ON b.date = x.date AND b.security_id = x.peer_id
JOIN ct_adjusted a ON a.date = x.date AND a.security_id = x.security_id
GROUP BY 1, 2, 3, 4""")
cte("ct_scored", """
SELECT r.*, p.volume, p.extreme_return_flag,
  CASE WHEN count(CASE WHEN r.peer_count >= 2 AND NOT p.extreme_return_flag THEN r.rel END) OVER w >= 20
       THEN stddev_samp(CASE WHEN r.peer_count >= 2 AND NOT p.extreme_return_flag THEN r.rel END) OVER w END AS vol
FROM ct_relative r JOIN ct_panel p USING (date, security_id) WHERE r.rel IS NOT NULL
WINDOW w AS (PARTITION BY r.security_id ORDER BY r.date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)""")
cte("ct_movers", """
SELECT *, greatest(0.05, 2.0 * vol) AS threshold FROM ct_scored
WHERE vol IS NOT NULL AND peer_count >= 2 AND NOT extreme_return_flag AND abs(rel) > greatest(0.05, 2.0 * vol)""")
cte("ct_next", """
SELECT c.peer_group, c.date, min(n.date) AS next_date
FROM (SELECT DISTINCT peer_group, date FROM ct_movers) c
LEFT JOIN (SELECT DISTINCT peer_group, date FROM ct_movers) n ON n.peer_group = c.peer_group AND n.date > c.date + 21
GROUP BY 1, 2""")
cte("ct_kept", """
SELECT peer_group, min(date) AS date FROM ct_movers GROUP BY peer_group
UNION ALL
SELECT n.peer_group, n.next_date FROM ct_kept k JOIN ct_next n ON n.peer_group = k.peer_group AND n.date = k.date
WHERE n.next_date IS NOT NULL""")
cte("ct_events", """
SELECT 'evt_' || substr(sha256(CAST(m.date AS VARCHAR) || '|' || m.security_id || '|economic_subsector_peers'), 1, 16) AS event_id,
       m.date, m.security_id, m.subsector, m.peer_group, CASE WHEN rel > 0 THEN 'positive' ELSE 'negative' END AS direction,
       CASE WHEN rel > 0 THEN 1.0 ELSE -1.0 END AS sgn, rel AS relative_return, vol AS relative_volatility, threshold, volume,
       CASE WHEN count(*) OVER (PARTITION BY m.date, m.peer_group) >= 2
            THEN 'sim_' || substr(sha256(CAST(m.date AS VARCHAR) || '|economic_subsector_peers|' || m.peer_group), 1, 16)
       END AS sim, peer_count
FROM ct_movers m JOIN ct_kept k ON k.peer_group = m.peer_group AND k.date = m.date""")
cte("ct_calendar", """
SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS pos FROM (SELECT DISTINCT date FROM ct_panel)""")
cte("ct_days", """
SELECT e.event_id, e.date AS event_date, e.security_id, e.direction, e.sgn, d.day, c2.date AS calendar_date
FROM ct_events e JOIN ct_calendar c ON c.date = e.date CROSS JOIN (SELECT CAST(unnest(range(-5, 11)) AS INTEGER) AS day) d
LEFT JOIN ct_calendar c2 ON c2.pos = c.pos + d.day""")
cte("ct_peer_days", """
SELECT d.event_id, d.day, count(*) AS n, count(b.adj) AS seen, avg(b.adj) AS peer
FROM ct_days d JOIN ct_pairs x ON x.date = d.event_date AND x.security_id = d.security_id
LEFT JOIN ct_adjusted b ON b.date = d.calendar_date AND b.security_id = x.peer_id
GROUP BY 1, 2""")
cte("ct_epanel", """
SELECT d.*, a.adj AS own, CASE WHEN p.seen = p.n THEN p.peer END AS peer, coalesce(p.n, 0) > 0 AS has_peers
FROM ct_days d LEFT JOIN ct_adjusted a ON a.date = d.calendar_date AND a.security_id = d.security_id
LEFT JOIN ct_peer_days p ON p.event_id = d.event_id AND p.day = d.day""")
cte("ct_overlap", """
SELECT event_id, max(c) > 1 AS overlapped FROM (
  SELECT event_id, count(*) OVER (PARTITION BY calendar_date) AS c FROM ct_epanel
  WHERE day BETWEEN 1 AND 10 AND calendar_date IS NOT NULL) GROUP BY 1""")


def outcome_sql(panel: str, horizons: str = "1, 3, 5, 10", extra: str = "") -> str:
    """Horizon windows over an event panel with columns event_id, day, calendar_date, own, peer, has_peers, sgn."""
    cols = "".join(f"w.{c}, " for c in extra.split())
    return f"""
SELECT {cols}w.event_id, w.horizon, w.reason, w.reason IS NULL AS valid,
       CASE WHEN w.reason IS NULL THEN w.own END AS initiator_car, CASE WHEN w.reason IS NULL THEN w.peer END AS peer_car,
       CASE WHEN w.reason IS NULL THEN w.sgn * w.peer END AS peer_catchup,
       CASE WHEN w.reason IS NULL THEN -w.sgn * w.own END AS initiator_reversal,
       CASE WHEN w.reason IS NULL THEN w.sgn * (w.peer - w.own) END AS convergence
FROM (SELECT {extra.replace(' ', ', ') + ', ' if extra else ''}event_id, h.horizon, any_value(sgn) AS sgn, sum(own) AS own, sum(peer) AS peer,
        nullif(concat_ws(';',
          CASE WHEN count(*) <> h.horizon OR bool_or(calendar_date IS NULL) THEN 'end_of_sample' END,
          CASE WHEN bool_or(own IS NULL) THEN 'missing_initiator_observation' END,
          CASE WHEN NOT bool_and(has_peers) THEN 'missing_event_date_peer_membership'
               WHEN bool_or(peer IS NULL) THEN 'missing_peer_observation' END), '') AS reason
      FROM {panel} JOIN (SELECT unnest([{horizons}]) AS horizon) h ON day BETWEEN 1 AND h.horizon
      GROUP BY {extra.replace(' ', ', ') + ', ' if extra else ''}event_id, h.horizon) w"""


cte("ct_windows", outcome_sql("ct_epanel"))
cte("ct_outcomes", """
SELECT w.*, e.date AS event_date, e.security_id, e.direction, e.sgn, e.subsector, e.relative_return, e.relative_volatility, e.sim,
       coalesce(o.overlapped, false) AS overlapped
FROM ct_windows w JOIN ct_events e USING (event_id) LEFT JOIN ct_overlap o USING (event_id)""")
cte("ct_long", """
SELECT event_id, horizon, direction, event_date, security_id, subsector, valid, 'convergence' AS outcome, convergence AS x FROM ct_outcomes
UNION ALL BY NAME SELECT event_id, horizon, direction, event_date, security_id, subsector, valid, 'peer_catchup' AS outcome, peer_catchup AS x FROM ct_outcomes
UNION ALL BY NAME SELECT event_id, horizon, direction, event_date, security_id, subsector, valid, 'initiator_reversal' AS outcome, initiator_reversal AS x FROM ct_outcomes""")
