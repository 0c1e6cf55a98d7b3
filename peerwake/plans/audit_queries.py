"""Audits, contract checks and sample tables.

Checks run on deliberately damaged copies of the study tables: a fixed rule on the data
breaks some rows, and the SQL twin counts the same rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..contracts import CONTRACTS, contract_issues
from ..functions.exprs import union_all
from ..operators import audits as au
from ..operators import panel as pn
from ..operators import reports as rp
from ..oracles.base import cte, r
from ..oracles.stats import quantile_ctes
from ..params import OUTCOMES
from .registry import query
from .workspace import BASE_UNIVERSE, DETECTION, GROUP, STUDY, Workspace

N = "CAST(volume AS BIGINT)"


def lots(k: int):
    return F.col("volume").cast("bigint") % k == 0


# --- H. Contract checks ---------------------------------------------------------------

cte("ct_bad_panel", f"""
SELECT CASE WHEN {N} % 17 = 0 THEN NULL ELSE date END AS date, CASE WHEN {N} % 19 = 0 THEN ' ' ELSE security_id END AS security_id,
  CASE WHEN {N} % 23 = 0 THEN -adj_close ELSE adj_close END AS adjusted_close, CASE WHEN {N} % 29 = 0 THEN CAST('inf' AS DOUBLE) ELSE close END AS close,
  CASE WHEN {N} % 31 = 0 THEN -volume ELSE volume END AS volume, ret FROM ct_returns""")


def damaged_panel(ws):
    p = pn.simple_returns(ws.prices)
    pick = lambda k, bad, good: F.when(lots(k), bad).otherwise(good)
    return p.select(pick(17, F.lit(None).cast("date"), F.col("date")).alias("date"), pick(19, F.lit(" "), F.col("security_id")).alias("security_id"),
                    pick(23, -F.col("adj_close"), F.col("adj_close")).alias("adjusted_close"),
                    pick(29, F.lit(float("inf")), F.col("close")).alias("close"), pick(31, -F.col("volume"), F.col("volume")).alias("volume"), "return")


@query("contract_issues", """
SELECT 'daily_panel' AS dataset, code, subject, violations FROM (
  SELECT 'null_values' AS code, 'date' AS subject, count(*) AS violations FROM ct_bad_panel WHERE date IS NULL
  UNION ALL SELECT 'blank_string', 'security_id', count(*) FROM ct_bad_panel WHERE trim(security_id) = ''
  UNION ALL SELECT 'non_finite', 'close', count(*) FROM ct_bad_panel WHERE isinf(close)
  UNION ALL SELECT 'duplicate_primary_key', 'date,security_id', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM ct_bad_panel GROUP BY date, security_id) WHERE n > 1)
WHERE violations > 0""")
def _(ws: Workspace):
    return contract_issues(damaged_panel(ws), CONTRACTS["daily_panel"])


@query("referential_integrity", f"""
SELECT 'daily_panel' AS dataset, 'invalid_security_reference' AS code, 'security_id' AS subject, count(*) AS violations FROM ct_prices WHERE {N} % 19 = 0""")
def _(ws):
    stray = ws.prices.withColumn("security_id", F.when(lots(19), F.concat(F.lit("X"), "security_id")).otherwise(F.col("security_id")))
    return au.unknown_references(stray, ["security_id"], ws.master, "daily_panel")


@query("daily_panel_rules", f"""
WITH p AS (SELECT date, security_id, adj_close AS a, close, CASE WHEN {N} % 31 = 0 THEN -volume ELSE volume END AS volume,
    CASE WHEN {N} % 37 = 0 THEN ret + 0.01 ELSE ret END AS got, lag(adj_close) OVER (PARTITION BY security_id ORDER BY date) AS prior FROM ct_returns)
SELECT 'daily_panel' AS dataset, code, subject, violations FROM (
  SELECT 'negative_volume' AS code, 'volume' AS subject, count(*) AS violations FROM p WHERE volume < 0
  UNION ALL SELECT 'invalid_return', 'return', count(*) FROM p WHERE CASE WHEN prior IS NULL THEN got IS NOT NULL
    ELSE got IS NULL OR abs(got - (a / prior - 1)) > 1e-12 + 1e-10 * abs(a / prior - 1) END)""")
def _(ws):
    p = pn.simple_returns(ws.prices).withColumnRenamed("adj_close", "adjusted_close")
    p = p.withColumn("return", F.when(lots(37), F.col("return") + 0.01).otherwise(F.col("return")))
    p = p.withColumn("volume", F.when(lots(31), -F.col("volume")).otherwise(F.col("volume")))
    return au.daily_panel_rules(p)


cte("ct_bad_edges", """
SELECT date, security_id, CASE WHEN rk = 10 THEN security_id WHEN rk = 9 THEN 'SEC_UNKNOWN' ELSE peer_id END AS peer_id,
  CASE WHEN rk = 8 THEN -weight ELSE weight END AS weight, event_id FROM ct_corr_top""")


def damaged_edges(ws):
    rank = F.col("rank")
    return ws.correlation_edges.select(
        "date", "security_id", F.when(rank == 10, F.col("security_id")).when(rank == 9, F.lit("SEC_UNKNOWN")).otherwise(F.col("peer_id")).alias("peer_id"),
        "peer_definition", F.when(rank == 8, -F.col("weight")).otherwise(F.col("weight")).alias("weight"))


@query("peer_membership_rules", """
SELECT 'peer_membership' AS dataset, code, subject, violations FROM (
  SELECT 'self_peer' AS code, 'peer_id' AS subject, count(*) AS violations FROM ct_bad_edges WHERE security_id = peer_id
  UNION ALL SELECT 'negative_weight', 'weight', count(*) FROM ct_bad_edges WHERE weight < 0
  UNION ALL SELECT 'invalid_weight_sum', 'weight', count(*) FROM (SELECT sum(weight) AS w FROM ct_bad_edges GROUP BY date, security_id) WHERE abs(w - 1) > 1e-8
  UNION ALL SELECT 'ineligible_peer_endpoint', 'security_id', count(*) FROM (SELECT date, security_id FROM ct_bad_edges UNION ALL SELECT date, peer_id FROM ct_bad_edges) x
    WHERE NOT EXISTS (SELECT 1 FROM ct_membership m WHERE m.date = x.date AND m.security_id = x.security_id AND m.eligible)) WHERE violations > 0""")
def _(ws):
    return au.peer_membership_rules(damaged_edges(ws), ws.membership)


@query("event_rules", f"""
SELECT 'events' AS dataset, code, subject, violations FROM (
  SELECT 'invalid_direction' AS code, 'direction' AS subject, count(*) AS violations FROM ct_events WHERE {N} % 7 = 0
  UNION ALL SELECT 'negative_threshold', 'threshold_used', count(*) FROM ct_events WHERE {N} % 11 = 0
  UNION ALL SELECT 'non_event', 'relative_return', count(*) FROM ct_events WHERE {N} % 13 = 0 AND NOT {N} % 11 = 0) WHERE violations > 0""")
def _(ws):
    e = ws.events.withColumn("direction", F.when(lots(7), F.lit("sideways")).otherwise(F.col("direction")))
    e = e.withColumn("relative_return", F.when(lots(13), F.col("threshold_used")).otherwise(F.col("relative_return")))
    return au.event_rules(e.withColumn("threshold_used", F.when(lots(11), F.lit(-1.0)).otherwise(F.col("threshold_used"))))


@query("event_panel_rules", """
SELECT 'event_panel' AS dataset, 'invalid_observation_flag' AS code, 'valid_observation' AS subject, count(*) AS violations FROM ct_epanel WHERE day = 3""")
def _(ws):
    flipped = F.when(F.col("relative_day") == 3, ~F.col("valid_observation")).otherwise(F.col("valid_observation"))
    return au.event_panel_rules(ws.event_panel.withColumn("valid_observation", flipped))


@query("event_outcome_rules", """
SELECT 'event_outcomes' AS dataset, code, subject, violations FROM (
  SELECT 'invalid_missing_reason' AS code, 'missing_reason' AS subject, count(*) AS violations FROM ct_outcomes WHERE horizon = 3 AND NOT valid
  UNION ALL SELECT 'invalid_convergence', 'convergence', count(*) FROM ct_outcomes WHERE horizon = 5 AND valid)""")
def _(ws):
    o = ws.outcomes.withColumn("missing_reason", F.when(F.col("horizon") == 3, F.lit(None)).otherwise(F.col("missing_reason")))
    return au.event_outcome_rules(o.withColumn("convergence", F.when(F.col("horizon") == 5, F.col("convergence") + 1).otherwise(F.col("convergence"))))


@query("relative_return_rules", """
SELECT 'relative_returns' AS dataset, 'invalid_security_reference' AS code, 'security_id' AS subject, count(*) AS violations FROM ct_relative
WHERE peer_group LIKE 'ASIA%' HAVING count(*) > 0""")
def _(ws):
    return au.relative_return_rules(ws.relative, ws.master.where(f"subsector <> '{GROUP}'"))


@query("research_data_issues", """
SELECT dataset, code, subject, violations FROM (
  SELECT 'peer_membership' AS dataset, 'self_peer' AS code, 'peer_id' AS subject, count(*) AS violations FROM ct_bad_edges WHERE security_id = peer_id
  UNION ALL SELECT 'peer_membership', 'negative_weight', 'weight', count(*) FROM ct_bad_edges WHERE weight < 0
  UNION ALL SELECT 'peer_membership', 'invalid_security_reference', 'peer_id', count(*) FROM ct_bad_edges WHERE peer_id = 'SEC_UNKNOWN'
  UNION ALL SELECT 'peer_membership', 'invalid_weight_sum', 'weight', count(*) FROM (SELECT sum(weight) AS w FROM ct_bad_edges GROUP BY date, security_id) WHERE abs(w - 1) > 1e-8
  UNION ALL SELECT 'peer_membership', 'ineligible_peer_endpoint', 'security_id', count(*) FROM ct_bad_edges WHERE peer_id = 'SEC_UNKNOWN') WHERE violations > 0""")
def _(ws):
    p = pn.simple_returns(ws.prices).withColumnRenamed("adj_close", "adjusted_close")
    return au.research_data_issues(ws.master, ws.membership, p, damaged_edges(ws))


@query("classification_rules", """
WITH m AS (SELECT *, CAST(substr(ticker, 3) AS BIGINT) AS k FROM ct_meta)
SELECT dataset, code, subject, violations FROM (
  SELECT 'semiconductor_classification' AS dataset, 'missing_classification' AS code, 'notes' AS subject, count(*) AS violations FROM m WHERE k % 9 = 0
  UNION ALL SELECT 'semiconductor_classification', 'invalid_subsector', 'subsector', count(*) FROM m WHERE subsector = 'EUROPE'
  UNION ALL SELECT 'semiconductor_classification', 'invalid_universe_tier', 'universe_tier', count(*) FROM m WHERE universe_tier = 'extension'
  UNION ALL SELECT 'semiconductor_classification', 'duplicate_security', 'ticker', count(*) FROM m WHERE k BETWEEN 10 AND 12
  UNION ALL SELECT 'semiconductor_classification', 'missing_classification', 'eligible securities', count(*) FROM m JOIN ct_master c USING (ticker)
    WHERE k BETWEEN 11 AND 12 AND EXISTS (SELECT 1 FROM ct_membership e WHERE e.security_id = c.security_id AND e.eligible)
  UNION ALL SELECT 'peer_classification', 'inconsistent_subsector', 'subsector', count(*) FROM m WHERE k % 8 = 0) WHERE violations > 0""")
def _(ws):
    k = F.substring("ticker", 3, 10).cast("bigint")
    bad = ws.classification.withColumn("notes", F.when(k % 9 == 0, F.lit(" ")).otherwise(F.col("notes")))
    bad = bad.withColumn("ticker", F.when(k.between(10, 12), F.lit(" s.0000000010")).otherwise(F.col("ticker")))
    peers = ws.view.withColumn("subsector", F.when(k % 8 == 0, F.lit("OTHER")).otherwise(F.col("subsector")))
    return au.classification_rules(bad, ["AFRICA", "AMERICA", "ASIA", "MIDDLE EAST"], ["core"], ws.membership, ws.master, peers)


# --- H. Coverage and quality ----------------------------------------------------------------

cte("ct_gaps", """
SELECT security_id, date, date - lag(date) OVER (PARTITION BY security_id ORDER BY date) AS gap FROM ct_prices""")



WEEKDAY_LIST = "len(list_filter(range({a}::TIMESTAMP, {b}::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6))"


def issue(name: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN '{name}=' || CAST({n} AS VARCHAR) END"


@query("data_audit", f"""
WITH f AS (SELECT security_id, count(*) AS n, min(date) AS a, max(date) AS b, avg(volume) AS v,
    CAST(sum(CASE WHEN open <= 100 THEN 1 ELSE 0 END + CASE WHEN low <= 100 THEN 1 ELSE 0 END) AS BIGINT) AS low FROM ct_prices GROUP BY 1),
g AS (SELECT security_id, count(*) FILTER (gap >= 28) AS big, max(gap) FILTER (gap >= 28) AS widest FROM ct_gaps GROUP BY 1),
m AS (SELECT security_id, count(*) FILTER (abs(ret) > 0.1) AS ext FROM ct_returns GROUP BY 1),
x AS (SELECT f.*, {WEEKDAY_LIST.format(a='a', b='b')} AS days, big, widest, ext FROM f JOIN g USING (security_id) JOIN m USING (security_id))
SELECT c.security_id, c.ticker, coalesce(n, 0) AS observation_count, a AS first_date, b AS last_date, {r('CASE WHEN n IS NULL THEN 100.0 ELSE 100.0 * (days - n) / days END')} AS missing_percentage,
  {r('v')} AS average_volume, CASE WHEN n IS NULL THEN 'no_data' ELSE concat_ws('; ', {issue('missing_weekdays_or_holidays', '(days - n)')},
    CASE WHEN big > 0 THEN 'large_gaps=' || CAST(big AS VARCHAR) || '(max_calendar_days=' || CAST(widest AS VARCHAR) || ')' END,
    {issue('non_positive_prices', 'low')}, {issue('extreme_returns', 'ext')}) END AS issues
FROM ct_master c LEFT JOIN x USING (security_id)""")
def _(ws):
    p = ws.prices
    for c in ("open", "low"):
        p = p.withColumn(c, F.when(F.col(c) <= 100, F.lit(0.0)).otherwise(F.col(c)))
    return au.data_audit(ws.master, p, large_gap_days=28, extreme=0.10)


@query("mapping_audit", f"""
WITH p AS (SELECT date, security_id, CASE WHEN security_id LIKE '%5' THEN 'ODD' ELSE ticker END AS ticker FROM ct_prices WHERE security_id NOT LIKE '%77'
  UNION ALL SELECT date, 'SEC_STRAY', 'STRAY' FROM ct_prices WHERE security_id LIKE '%77'
  UNION ALL SELECT date, security_id, 'SECOND' FROM ct_prices WHERE security_id LIKE '%8'),
o AS (SELECT security_id, list_sort(list(DISTINCT ticker)) AS t, min(date) AS a, max(date) AS b FROM p GROUP BY 1)
SELECT coalesce(m.security_id, o.security_id) AS security_id, coalesce(m.ticker, array_to_string(o.t, '|')) AS ticker,
  CASE WHEN m.security_id IS NULL THEN '' ELSE 'Y-' || m.ticker END AS yahoo_symbol, o.t IS NOT NULL AS data_found, o.a AS first_date, o.b AS last_date,
  CASE WHEN m.security_id IS NULL THEN 'downloaded_security_not_in_master' ELSE concat_ws('; ',
    CASE WHEN len(o.t) > 1 THEN 'multiple_downloaded_tickers=' || array_to_string(o.t, '|') END,
    CASE WHEN len(o.t) = 1 AND o.t[1] <> m.ticker THEN 'downloaded_ticker_mismatch=' || o.t[1] END,
    CASE WHEN o.t IS NULL THEN 'no_downloaded_data' END) END AS issues
FROM ct_master m FULL OUTER JOIN o ON o.security_id = m.security_id""")
def _(ws):
    p = ws.prices.select("date", "security_id", "ticker")
    lost = F.col("security_id").like("%77")
    base = p.where(~lost).withColumn("ticker", F.when(F.col("security_id").like("%5"), F.lit("ODD")).otherwise(F.col("ticker")))
    stray = p.where(lost).select("date", F.lit("SEC_STRAY").alias("security_id"), F.lit("STRAY").alias("ticker"))
    second = p.where(F.col("security_id").like("%8")).withColumn("ticker", F.lit("SECOND"))
    return au.mapping_audit(ws.vendor_master, union_all([base, stray, second]))


cte("ct_coverage_audit", """
SELECT m.security_id, m.ticker, f.a, f.b, coalesce(f.n, 0) AS n, coalesce((f.b - f.a) / 365.25, 0) AS years,
  coalesce((SELECT max(date) FROM ct_prices) - f.a < 6.85 * 365.25, false) AS recent
FROM ct_master m LEFT JOIN (SELECT security_id, count(*) AS n, min(date) AS a, max(date) AS b FROM ct_prices GROUP BY 1) f USING (security_id)""")
COVERAGE_SQL = """
SELECT security_id, ticker, a AS first_trading_date, b AS last_trading_date, n AS number_of_observations, round(years, 3) + 0.0 AS years_covered,
  n < 172 AS insufficient_history_for_factor_models, n < 170 AS short_history_company, recent AS recent_ipo,
  concat_ws('; ', CASE WHEN n = 0 THEN 'no_data' END, CASE WHEN n < 172 THEN 'insufficient_history_for_factor_models' END,
    CASE WHEN n < 170 THEN 'short_history_company' END, CASE WHEN recent THEN 'recent_ipo_proxy' END) AS issues
FROM ct_coverage_audit"""


def coverage(ws):
    return au.coverage_audit(ws.master, ws.prices, 172, 170, 6.85)


@query("coverage_audit", COVERAGE_SQL)
def _(ws):
    return coverage(ws)


@query("trading_calendar_audit", f"""
WITH s AS (SELECT DISTINCT m.exchange, p.date FROM ct_prices p JOIN ct_master m USING (security_id)),
o AS (SELECT security_id, min(date) AS a, max(date) AS b, count(*) AS n, max(gap) AS gap FROM ct_gaps GROUP BY 1),
x AS (SELECT m.security_id, m.ticker, m.exchange, o.a, o.b, coalesce(o.n, 0) AS n, coalesce(o.gap, 0) AS gap, (SELECT count(*) FROM s WHERE s.exchange = m.exchange
    AND (o.a IS NULL OR s.date BETWEEN o.a AND o.b)) AS local, o.a - (SELECT min(date) FROM ct_prices) AS head, (SELECT max(date) FROM ct_prices) - o.b AS tail
  FROM ct_master m LEFT JOIN o USING (security_id))
SELECT security_id, ticker, exchange, a AS first_trading_date, b AS last_trading_date, n AS observed_sessions, local AS local_exchange_sessions_in_observed_period,
  local - n AS missing_local_exchange_dates, CAST(gap AS INTEGER) AS max_calendar_gap_days, CAST(head AS INTEGER) AS non_overlap_start_calendar_days, CAST(tail AS INTEGER) AS non_overlap_end_calendar_days,
  concat_ws('; ', {issue('missing_local_exchange_dates', '(local - n)')}, {issue('non_overlap_start_calendar_days', 'head')}, {issue('non_overlap_end_calendar_days', 'tail')}) AS issues
FROM x""")
def _(ws):
    return au.trading_calendar_audit(ws.master, ws.prices)


@query("exchange_calendar_summary", f"""
WITH s AS (SELECT DISTINCT m.exchange, p.date FROM ct_prices p JOIN ct_master m USING (security_id)),
e AS (SELECT exchange, min(date) AS a, max(date) AS b, count(*) AS n FROM s GROUP BY 1)
SELECT exchange, (SELECT count(*) FROM ct_master m WHERE m.exchange = e.exchange) AS number_of_securities, a AS first_observed_session, b AS last_observed_session,
  n AS observed_exchange_sessions, {WEEKDAY_LIST.format(a='a', b='b')} - n AS weekdays_without_observed_exchange_session,
  CAST(a - (SELECT min(date) FROM ct_prices) AS INTEGER) AS non_overlap_start_calendar_days, CAST((SELECT max(date) FROM ct_prices) - b AS INTEGER) AS non_overlap_end_calendar_days FROM e""")
def _(ws):
    return au.exchange_calendar_summary(ws.master, ws.prices)


@query("return_quality_report", f"""
WITH p AS (SELECT security_id, date, volume, CASE WHEN {N} % 41 = 0 THEN NULL WHEN {N} % 43 = 0 THEN -adj_close ELSE adj_close END AS px FROM ct_prices),
q AS (SELECT *, px / lag(px) OVER (PARTITION BY security_id ORDER BY date) - 1 AS ret FROM p),
f AS (SELECT security_id, count(*) AS n, count(*) FILTER (ret IS NULL) AS gone, count(*) FILTER (abs(ret) > 0.12) AS ext, count(*) FILTER (ret <= -1) AS imp,
    count(*) FILTER (px IS NULL) AS mis, count(*) FILTER (px <= 0) AS neg, max(abs(ret)) AS top, coalesce(string_agg(CASE WHEN abs(ret) > 0.12 THEN CAST(date AS VARCHAR) END, '|' ORDER BY date), '') AS days
  FROM q GROUP BY 1)
SELECT m.security_id, m.ticker, coalesce(n, 0) AS number_of_observations, coalesce(gone, 0) AS missing_returns, coalesce(greatest(gone - 1, 0), 0) AS missing_returns_after_first,
  0::BIGINT AS duplicate_dates, coalesce(ext, 0) AS extreme_daily_returns, coalesce(imp, 0) AS impossible_returns, coalesce(mis, 0) AS missing_adj_close, 0::BIGINT AS non_finite_adj_close,
  coalesce(neg, 0) AS non_positive_adj_close, 0::BIGINT AS negative_volume, {r('top')} AS max_abs_return, coalesce(days, '') AS extreme_return_dates,
  concat_ws('; ', {issue('extreme_daily_returns', 'ext')}, {issue('impossible_returns', 'imp')}, {issue('missing_adj_close', 'mis')}, {issue('non_positive_adj_close', 'neg')},
    {issue('missing_returns_after_first', '(gone - 1)')}) AS issues
FROM ct_master m LEFT JOIN f USING (security_id)""")
def _(ws):
    price = F.when(lots(41), F.lit(None)).when(lots(43), -F.col("adj_close")).otherwise(F.col("adj_close"))
    return au.return_quality_report(ws.master, ws.prices.withColumn("adj_close", price), 0.12)


@query("historical_coverage", f"""
WITH o AS (SELECT security_id, min(date) AS a, max(date) AS b, count(*) AS n, bool_or(gap > 30) AS jump FROM ct_gaps GROUP BY 1)
SELECT m.security_id, a AS first_available_trading_date, b AS last_available_trading_date, coalesce(n, 0) AS number_of_observations,
  CASE WHEN n IS NULL THEN 0 ELSE greatest({WEEKDAY_LIST.format(a='a', b='b')} - n, 0) END AS missing_days, coalesce(n, 0) < 172 AS insufficient_factor_model_history,
  coalesce(n, 0) < 170 AS short_public_history, coalesce(jump, false) AS possible_ticker_change FROM ct_master m LEFT JOIN o USING (security_id)""")
def _(ws):
    return au.historical_coverage(ws.master, ws.prices, 172, 170, 30)


@query("universe_diagnostics", """
WITH c AS (SELECT * FROM ct_membership WHERE date = (SELECT max(date) FROM ct_membership)),
l AS (SELECT m.subsector, m.universe_tier, coalesce(c.eligible, false) AS ok FROM ct_master m LEFT JOIN c USING (security_id))
SELECT 'overall' AS section, 'all' AS label, count(*) AS classified, count(*) FILTER (ok) AS eligible FROM l
UNION ALL SELECT 'by_subsector', subsector, count(*), count(*) FILTER (ok) FROM l GROUP BY 2 UNION ALL SELECT 'by_universe_tier', universe_tier, count(*), count(*) FILTER (ok) FROM l GROUP BY 2
UNION ALL SELECT 'exclusion_reasons', reason, count(*), 0 FROM (SELECT unnest(string_split(exclusion_reason, ';')) AS reason FROM c WHERE NOT eligible) GROUP BY 2""")
def _(ws):
    d = au.universe_diagnostics(ws.master, ws.membership)
    named = lambda k, label, a, b: d[k].select(F.lit(k).alias("section"), label.alias("label"), a.cast("bigint").alias("classified"), b.cast("bigint").alias("eligible"))
    return union_all([
        named("overall", F.lit("all"), F.col("total_manually_classified"), F.col("total_eligible")),
        named("by_subsector", F.col("subsector"), F.col("classified"), F.col("eligible")),
        named("by_universe_tier", F.col("universe_tier"), F.col("classified"), F.col("eligible")),
        named("exclusion_reasons", F.col("reason"), F.col("count"), F.lit(0))])


CHECKS = ("no_self_peers", "point_in_time_eligible_peer_endpoints", "event_dates_within_frozen_sample", "sign_normalization_valid",
          "convergence_identity_valid", "strictly_trailing_event_volatility", "sector_information", "volume_information", "correlation_information",
          "peer_quality_information", "matching_information")


def _independent_volatility(ws):
    usable = F.when((F.col("peer_count") >= DETECTION.minimum_peer_count) & ~F.col("extreme_return_flag"), F.col("relative_abnormal_return"))
    past = Window.partitionBy("security_id", "peer_definition").orderBy("date").rowsBetween(-DETECTION.volatility_window, -1)
    # Independent route to the deviation: collected values and a fold, not the detector's aggregate.
    rows = ws.relative_abnormal.join(ws.panel.select("date", "security_id", "extreme_return_flag"), ["date", "security_id"])
    kept = rows.select("date", "security_id", "peer_definition", F.collect_list(usable).over(past).alias("h"))
    mean = F.aggregate("h", F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size("h"), F.lit(0))
    kept = kept.withColumn("m", mean)
    ss = F.aggregate("h", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m")))
    return kept.select("date", "security_id", "peer_definition",
                              F.when(F.size("h") >= DETECTION.minimum_history_requirement, F.sqrt(ss / F.nullif(F.size("h") - 1, F.lit(0)))).alias("independent_volatility"))


@query("leakage_checks", f"""
SELECT unnest([{', '.join(f"'{c}'" for c in CHECKS)}]) AS check_name, 0::BIGINT AS violations, (SELECT count(*) FROM ct_events) > 0 AS passed""")
def _(ws):
    independent = _independent_volatility(ws)
    base = au.baseline_checks(ws.events, ws.outcomes, ws.portfolios, ws.membership, independent, BASE_UNIVERSE.eligibility_start_date, BASE_UNIVERSE.eligibility_end_date)
    from ..operators import similarity as sm
    audit = sm.correlation_audit(ws.similarity_inputs[0], ws.calendar, ws.correlation_edges)
    return union_all([
        base, au.strictly_before(ws.mechanism, "sector_information_max_date", "date", "sector_information"),
        au.strictly_before(ws.mechanism, "volume_information_max_date", "date", "volume_information"),
        au.strictly_before(audit, "correlation_information_max_date", "event_date", "correlation_information"),
        au.strictly_before(ws.peer_quality, "correlation_information_max_date", "event_date", "peer_quality_information"),
        au.strictly_before(ws.matching, "matching_information_max_date", "date", "matching_information")])


# The same checks on inputs damaged on purpose, so that each of these counts something.
@query("leakage_checks_damaged", """
WITH held AS (SELECT DISTINCT date, security_id FROM ct_pairs), valid AS (SELECT * FROM ct_outcomes WHERE valid AND horizon = 1),
found AS (SELECT 'no_self_peers' AS check_name, count(*) FILTER (day(date) <= 9) AS violations FROM held
  UNION ALL SELECT 'point_in_time_eligible_peer_endpoints', count(*) FILTER (day(date) >= 20) FROM held
  UNION ALL SELECT 'event_dates_within_frozen_sample', count(*) FILTER (sgn > 0) FROM ct_events
  UNION ALL SELECT 'sign_normalization_valid', count(*) FROM valid
  UNION ALL SELECT 'convergence_identity_valid', count(*) FROM valid
  UNION ALL SELECT 'strictly_trailing_event_volatility', count(*) FILTER (sgn > 0) FROM ct_events
  UNION ALL SELECT 'matching_information', count(*) FILTER (eligible) FROM ct_strata)
SELECT check_name, violations, violations = 0 AS passed FROM found""")
def _(ws):
    late = ws.events.withColumn("date", F.when(F.col("direction") == "positive", F.add_months("date", 1200)).otherwise(F.col("date")))
    moved = ws.outcomes.withColumn("convergence", F.col("convergence") + F.when(F.col("horizon") == 1, 1.0).otherwise(0.0))
    lonely = ws.portfolios.withColumn("portfolio_size", F.when(F.dayofmonth("date") <= 9, F.lit(0)).otherwise(F.col("portfolio_size")))
    fewer = ws.membership.withColumn("eligible", F.col("eligible") & (F.dayofmonth("date") < 20))
    known = ws.matching.withColumn("matching_information_max_date", F.when(F.col("eligible"), F.col("date")).otherwise(F.col("matching_information_max_date")))
    base = au.baseline_checks(late, moved, lonely, fewer, _independent_volatility(ws), BASE_UNIVERSE.eligibility_start_date, BASE_UNIVERSE.eligibility_end_date)
    return base.unionByName(au.strictly_before(known, "matching_information_max_date", "date", "matching_information"))


# --- I. Sample and result tables -------------------------------------------------------------

cte("ct_sample", """
SELECT m.security_id, m.ticker, m.company_name, m.subsector, m.universe_tier, coalesce(e.ever, false) AS ever, l.eligible, coalesce(l.exclusion_reason, '') AS why,
  CASE WHEN coalesce(e.ever, false) THEN '' WHEN c.n < 170 THEN 'universe_tier_not_allowed;insufficient_history' ELSE 'universe_tier_not_allowed' END AS base_why
FROM ct_master m LEFT JOIN (SELECT security_id, bool_or(eligible) AS ever FROM ct_membership GROUP BY 1) e USING (security_id)
LEFT JOIN (SELECT * FROM ct_membership WHERE date = (SELECT max(date) FROM ct_membership)) l USING (security_id) LEFT JOIN ct_coverage_audit c USING (security_id)""")
SAMPLE_SQL = """
SELECT security_id, ticker, company_name, subsector, universe_tier, ever AS ever_baseline_eligible, eligible, why AS exclusion_reason, base_why AS baseline_exclusion_reason FROM ct_sample"""


def sample(ws):
    return rp.security_sample(ws.master, ws.membership, coverage(ws))


@query("security_sample", SAMPLE_SQL)
def _(ws):
    return sample(ws)


@query("excluded_securities", SAMPLE_SQL + " WHERE NOT ever")
def _(ws):
    return rp.excluded_securities(sample(ws))


@query("sample_report", """
SELECT 'total_classified_securities' AS metric, CAST(count(*) AS VARCHAR) AS value FROM ct_sample UNION ALL SELECT 'baseline_eligible_securities', CAST(count(*) AS VARCHAR) FROM ct_sample WHERE ever
UNION ALL SELECT 'excluded_securities', CAST(count(*) AS VARCHAR) FROM ct_sample WHERE NOT ever
UNION ALL SELECT 'eligible_on_final_global_calendar_date', CAST(count(*) AS VARCHAR) FROM ct_sample WHERE eligible
UNION ALL SELECT 'sample_end', CAST(max(date) AS VARCHAR) FROM ct_membership""")
def _(ws):
    return rp.sample_report(sample(ws), ws.membership)


@query("exclusion_reason_summary", """
SELECT reason AS baseline_exclusion_reason, count(*) AS security_count FROM (SELECT unnest(string_split(base_why, ';')) AS reason FROM ct_sample WHERE NOT ever) GROUP BY 1""")
def _(ws):
    return rp.exclusion_reason_summary(sample(ws))


@query("short_history_exclusions", "SELECT security_id, ticker, first_trading_date, last_trading_date, number_of_observations, issues FROM (" + COVERAGE_SQL + ") WHERE short_history_company")
def _(ws):
    return rp.short_history_exclusions(coverage(ws))


@query("event_summary", """
SELECT 'total' AS dimension, 'all' AS label, count(*) AS event_count FROM ct_events UNION ALL SELECT 'direction', direction, count(*) FROM ct_events GROUP BY 2
UNION ALL SELECT 'year', CAST(year(date) AS VARCHAR), count(*) FROM ct_events GROUP BY 2 UNION ALL SELECT 'subsector', subsector, count(*) FROM ct_events GROUP BY 2""")
def _(ws):
    return rp.event_summary(ws.events)


@query("event_summary_with_share", f"""
WITH d AS (SELECT 'total' AS dimension, 'all' AS label, event_id FROM ct_events UNION ALL SELECT 'year', CAST(year(date) AS VARCHAR), event_id FROM ct_events
  UNION ALL SELECT 'month', strftime(date, '%Y-%m'), event_id FROM ct_events UNION ALL SELECT 'company', ticker, event_id FROM ct_detail
  UNION ALL SELECT 'subsector', subsector, event_id FROM ct_events UNION ALL SELECT 'direction', direction, event_id FROM ct_events)
SELECT dimension, label, count(*) AS event_count, {r('count(*) / (SELECT count(*) FROM ct_events)')} AS event_share FROM d GROUP BY 1, 2""")
def _(ws):
    from .analysis_queries import five_dimensions
    return rp.event_summary(ws.events.join(ws.master.select("security_id", "ticker"), "security_id", "left"), five_dimensions(), share=True)


@query("company_concentration", f"""
WITH f AS (SELECT security_id, count(*) AS n, min(subsector) AS subsector FROM ct_events GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS firms FROM f)
SELECT security_id, ticker, company_name, f.subsector, n AS event_count, {r('n / total')} AS event_share, n / total > greatest(0.10, 2.0 / firms) AS dominant_company_flag
FROM f CROSS JOIN t LEFT JOIN ct_master m USING (security_id)""")
def _(ws):
    return rp.company_concentration(ws.events, ws.master)


@query("date_concentration", """
SELECT date, count(*) AS event_count, count(DISTINCT subsector) AS subsector_count, count(*) >= 3 AS many_simultaneous_shocks_flag FROM ct_events GROUP BY 1""")
def _(ws):
    return rp.date_concentration(ws.events)


@query("horizon_missingness", """
SELECT horizon, count(*) AS total_events, count(*) FILTER (valid) AS complete_horizons, count(*) FILTER (NOT valid) AS excluded_horizons FROM ct_outcomes GROUP BY 1""")
def _(ws):
    return rp.horizon_missingness(ws.outcomes)


@query("missingness_reasons", """
SELECT horizon, reason AS missing_reason, count(*) AS excluded_events FROM (SELECT horizon, unnest(string_split(reason, ';')) AS reason FROM ct_outcomes WHERE NOT valid) GROUP BY 1, 2""")
def _(ws):
    return rp.missingness_reasons(ws.outcomes)


@query("mechanism_decomposition", f"""
WITH v AS MATERIALIZED (SELECT horizon, outcome, security_id, x FROM ct_long WHERE valid),
c AS MATERIALIZED (SELECT horizon, outcome, count(x) AS n, avg(x) AS m, median(x) AS med FROM v GROUP BY 1, 2),
f AS MATERIALIZED (SELECT horizon, outcome, count(*) AS g, sqrt(count(*) / nullif(count(*) - 1.0, 0) * sum(d * d)) / any_value(n) AS se FROM (
  SELECT v.horizon, v.outcome, security_id, any_value(n) AS n, sum(x - m) AS d FROM v JOIN c USING (horizon, outcome) GROUP BY 1, 2, 3) GROUP BY 1, 2),
{quantile_ctes('SELECT g - 1 AS df FROM f')},
s AS (SELECT c.horizon, c.outcome, m, med, m - q * se AS lo, m + q * se AS hi, n FROM c JOIN f USING (horizon, outcome) LEFT JOIN tq ON tq.df = f.g - 1)
SELECT horizon, any_value(n) AS valid_events, {', '.join(f"{r(f'max(CASE WHEN outcome = {chr(39)}{o}{chr(39)} THEN {c} END)')} AS {o}_{n}" for o in OUTCOMES for n, c in (('mean', 'm'), ('median', 'med'), ('ci_lower', 'lo'), ('ci_upper', 'hi')))}
FROM s GROUP BY 1""")
def _(ws):
    from ..operators import inference as inf
    return rp.mechanism_decomposition(inf.summarize_event_outcomes(ws.outcomes)["summary_table"], ws.outcomes)


@query("subsector_summary", """
SELECT m.subsector, coalesce(e.n, 0) AS event_count, coalesce(e.p, 0) AS positive_shocks, coalesce(e.q, 0) AS negative_shocks, coalesce(e.f, 0) AS initiating_companies, m.n AS classified_securities
FROM (SELECT subsector, count(*) AS n FROM ct_master GROUP BY 1) m LEFT JOIN (SELECT subsector, count(*) AS n, count(*) FILTER (direction = 'positive') AS p,
  count(*) FILTER (direction = 'negative') AS q, count(DISTINCT security_id) AS f FROM ct_events GROUP BY 1) e USING (subsector)""")
def _(ws):
    return rp.subsector_summary(ws.events, ws.master)
