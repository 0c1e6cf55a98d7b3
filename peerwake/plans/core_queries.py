"""Sources, identity, panel, peers, events and the event study."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.checkpoints import shared_dir
from ..functions.exprs import union_all
from ..operators import events as ev
from ..operators import panel as pn
from ..operators import peers as pr
from ..operators import reports as rp
from ..operators import study as st
from ..oracles.base import r
from ..params import BROAD, ECONOMIC, Detection
from ..sources import driver_tables, market
from ..sources.pluggable import ParquetGroups
from .registry import query
from .workspace import ADJUSTED, BASE_UNIVERSE, DETECTION, EXTENDED_UNIVERSE, STUDY, Workspace

EVENT_SQL = f"""event_id, date, security_id, direction, {r('relative_return')} AS relative_return,
  {r('relative_volatility')} AS relative_volatility, {r('threshold')} AS threshold_used,
  'economic_subsector_peers' AS peer_definition, subsector, volume, CAST(NULL AS DOUBLE) AS market_cap,
  sim AS simultaneous_event_group, 'none' AS corporate_action_type, false AS earnings_flag, false AS news_identified_flag"""

# --- A. Scans -------------------------------------------------------------------


@query("csv_market_source", """
SELECT date, ticker, adj_close AS adjusted_close, close, volume FROM ct_prices""")
def _(ws: Workspace):
    path = f"{shared_dir(ws.spark)}/{ws.spark.sparkContext.applicationId}/vendor-csv-{uuid.uuid4().hex}"
    vendor = ws.prices.select(F.date_format("date", "yyyy-MM-dd").alias("Date"), F.col("ticker").alias("Symbol"), F.col("adj_close").alias("Adj Close"),
                              F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    market.write_csv_tables({"prices": vendor}, path)
    renamed = market.read_csv(ws.spark, f"{path}/prices", "Date string, Symbol string, `Adj Close` double, Close double, Volume double",
                              {"Date": "date", "Symbol": "ticker", "Adj Close": "adjusted_close", "Close": "close", "Volume": "volume"})
    return renamed.withColumn("date", market.parse_date(F.col("date")))


@query("panel_scan_date_range", f"""
SELECT date, security_id, eligible, exclusion_reason FROM ct_membership WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
def _(ws):
    published = pn.publish_membership(ws.membership).withColumn(
        "reason", F.when(F.col("reason") != "passes_core_requirements", F.col("reason")))
    return market.scan_dates(published, "1997-01-01", "1998-12-31")


@query("load_security_master", """
SELECT security_id, ticker, 'Y-' || ticker AS yahoo_symbol, company_name, exchange, 'USD' AS currency FROM ct_master""")
def _(ws):
    padded = ws.vendor_master.select(*[F.concat(F.lit(" "), F.col(c), F.lit("  ")).alias(c) for c in ws.vendor_master.columns])
    return market.load_security_master(padded)


@query("load_classification", "SELECT * FROM ct_meta")
def _(ws):
    return ws.classification


@query("standardize_vendor_prices", """
SELECT date, security_id, ticker, open, high, low, CASE WHEN volume % 7 = 0 THEN NULL ELSE close END AS close,
       CASE WHEN volume % 7 = 0 THEN NULL ELSE adj_close END AS adj_close, volume
FROM ct_prices WHERE volume <> 25""")
def _(ws):
    # Damage the vendor text: some cells unreadable, some rows empty placeholders.
    v = ws.vendor
    empty = F.col("Volume") == 25
    broken = F.col("Volume") % 7 == 0
    text = lambda c: F.when(empty, F.lit(None)).otherwise(F.col(c).cast("string"))
    raw = v.select(F.concat(F.date_format("Date", "yyyy-MM-dd"), F.lit("T00:00:00+09:00")).alias("Datetime"), "security_id", "ticker",
                   *[text(c).alias(c) for c in ("Open", "High", "Low")],
                   *[F.when(broken & ~empty, F.lit("n/a")).otherwise(text(c)).alias(c) for c in ("Close", "Adj Close")],
                   F.when(empty, F.lit("0")).otherwise(F.col("Volume").cast("string")).alias("Volume"))
    return market.standardize_prices(raw)


@query("combine_daily_prices", "SELECT date, security_id, ticker, open, high, low, close, adj_close, volume FROM ct_prices")
def _(ws):
    p = ws.prices
    return market.combine_prices([p.where("close < 105"), p.where("close >= 105")])


@query("dataset_fingerprint", """
SELECT 'events' AS table_name, count(*) AS row_count,
       CAST(sum(('0x' || substr(sha256(CAST(date AS VARCHAR) || '|' || direction || '|' || event_id || '|' || security_id || '|' || subsector), 1, 8))::BIGINT) AS BIGINT) AS content_sum
FROM ct_events
UNION ALL
SELECT 'membership', count(*), CAST(sum(('0x' || substr(sha256(CAST(date AS VARCHAR) || '|' || CAST(eligible AS VARCHAR) || '|' || coalesce(exclusion_reason, '') || '|' || security_id), 1, 8))::BIGINT) AS BIGINT)
FROM ct_membership""")
def _(ws):
    return market.fingerprint({"events": ws.events.select("event_id", "date", "security_id", "direction", "subsector"),
                               "membership": ws.membership})


# --- B. Identity ----------------------------------------------------------------


@query("normalize_market_rows", """
SELECT CASE WHEN CAST(volume AS BIGINT) % 11 = 0 THEN NULL ELSE date END AS date, ticker, adj_close AS adjusted_close,
       CASE WHEN CAST(volume AS BIGINT) % 13 = 0 THEN NULL ELSE close END AS close, volume,
       CASE WHEN CAST(volume AS BIGINT) % 11 = 0 THEN 'malformed_date' WHEN CAST(volume AS BIGINT) % 13 = 0 THEN 'invalid_type' END AS defect
FROM ct_prices""")
def _(ws):
    v = F.col("volume").cast("bigint")
    fmt = F.when(v % 3 == 0, F.date_format("date", "yyyy/MM/dd")).when(v % 3 == 1, F.date_format("date", "MM/dd/yyyy")).otherwise(
        F.date_format("date", "yyyy-MM-dd"))
    raw = ws.prices.select(F.when(v % 11 == 0, F.lit("not a date")).otherwise(fmt).alias("date"),
                           F.concat(F.lit(" "), "ticker").alias("ticker"), F.col("adj_close").cast("string").alias("adjusted_close"),
                           F.when(v % 13 == 0, F.lit("abc")).otherwise(F.col("close").cast("string")).alias("close"), "volume")
    return market.normalize_rows(raw)


@query("build_daily_panel", f"""
SELECT date, security_id, adj_close AS adjusted_close, close, volume, {r('ret')} AS "return" FROM ct_returns""")
def _(ws):
    raw = ws.prices.select(F.date_format("date", "MM/dd/yyyy").alias("date"), "ticker", F.col("adj_close").alias("adjusted_close"),
                           "close", "volume")
    return market.build_daily_panel(raw, ws.master)


@query("ingest_market_data", f"""
SELECT date, security_id, adj_close AS adjusted_close, close, volume, {r('ret')} AS "return" FROM ct_returns""")
def _(ws):
    # The order lines come through a plugged-in source, row group by row group, and dates in mixed notations.
    kinds = {c: t for c, t in driver_tables.table(ws.spark, ws.sf_dir, "lineitem").dtypes if c in ("l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")}
    source = ParquetGroups([f"{ws.sf_dir}/lineitem.parquet"], kinds)

    def prices(lines):
        p = market.standardize_prices(driver_tables.vendor_prices(ws.spark, ws.sf_dir, lines))
        kind = F.pmod(F.xxhash64("date"), F.lit(5))
        forms = ("MMMM d, yyyy", "d MMM yyyy", "EEE, dd-MMM-yyyy", "yyyy.M.d", "M/d/yyyy")
        text = F.coalesce(*[F.when(kind == k, F.date_format("date", f)) for k, f in enumerate(forms)])
        return p.select(text.alias("date"), "ticker", F.col("adj_close").alias("adjusted_close"), "close", "volume")
    return market.ingest_market_data(ws.spark, source, ws.master, prepare=prices)


@query("security_id_from_ticker", "SELECT ticker, security_id FROM ct_master")
def _(ws):
    return ws.classification.select("ticker", pn.security_id_from_ticker(F.col("ticker")).alias("security_id"))


@query("build_security_master", "SELECT * FROM ct_master")
def _(ws):
    return pn.build_security_master(ws.classification)


@query("classification_view", """
SELECT m.security_id, m.ticker, t.company_name, t.subsector, t.notes AS classification_notes
FROM ct_master m JOIN ct_meta t ON t.ticker = m.ticker""")
def _(ws):
    return ws.view


@query("production_peer_classification", """
SELECT security_id, subsector, subsector AS peer_group, 'peer group equals the reviewed subsector' AS classification_notes FROM ct_master""")
def _(ws):
    return pn.production_peer_classification(ws.view)


@query("event_ids", """
SELECT event_id, date, security_id, sim AS simultaneous_event_group,
       'pseudo_' || substr(sha256(event_id || '|' || CAST(date AS VARCHAR)), 1, 16) AS pseudo_id FROM ct_events""")
def _(ws):
    from ..functions.exprs import tagged_id
    return ws.events.select("event_id", "date", "security_id", "simultaneous_event_group",
                            tagged_id("pseudo_", F.col("event_id"), F.col("date")).alias("pseudo_id"))


# --- C. Returns, eligibility, panel -----------------------------------------------


@query("simple_returns", f"""SELECT date, security_id, adj_close, {r('ret')} AS "return" FROM ct_returns""")
def _(ws):
    return pn.simple_returns(ws.prices).select("date", "security_id", "adj_close", "return")


@query("market_features", f"""
SELECT date, security_id, history_days, {r('adv')} AS average_dollar_volume FROM ct_features""")
def _(ws):
    return pn.market_features(ws.prices, BASE_UNIVERSE.average_dollar_volume_window_days).select(
        "date", "security_id", "history_days", "average_dollar_volume")


@query("date_security_grid", "SELECT date, security_id FROM ct_grid")
def _(ws):
    return pn.date_security_grid(ws.prices, ws.master)


@query("universe_membership", """
SELECT date, security_id, why = '' AS eligible, nullif(why, '') AS exclusion_reason FROM ct_verdicts""")
def _(ws):
    return pn.universe_membership(ws.prices, ws.master, ws.view, BASE_UNIVERSE)


@query("historical_eligibility", """
SELECT date, security_id, 'star_schema_v1' AS universe_version, eligible, exclusion_reason AS reason, extension_eligible, extension_reason
FROM ct_membership""")
def _(ws):
    return ws.eligibility


@query("assemble_daily_panel", f"""
SELECT date, security_id, ticker, subsector, universe_tier, universe_version, adj_close, {r('ret')} AS "return", volume, eligible,
       extension_eligible, extreme_return_flag FROM ct_panel""")
def _(ws):
    return ws.panel.drop("peer_group")


@query("membership_publication", """
SELECT date, security_id, eligible, CASE WHEN eligible THEN 'passes_core_requirements' ELSE exclusion_reason END AS reason FROM ct_membership""")
def _(ws):
    return pn.publish_membership(ws.membership)


# --- D. Peers and factors ---------------------------------------------------------

PORTFOLIO_SQL = """
SELECT date, security_id, '{d}' AS peer_definition, {g} AS peer_group, n - 1 AS portfolio_size, {w} AS weight
FROM (SELECT *, count(*) OVER (PARTITION BY date{by}) AS n FROM ct_panel WHERE eligible) WHERE n > 1"""
ECONOMIC_SQL = PORTFOLIO_SQL.format(d=ECONOMIC, g="peer_group", by=", peer_group", w=r("1.0 / (n - 1)"))
BROAD_SQL = PORTFOLIO_SQL.format(d=BROAD, g="'*'", by="", w=r("1.0 / (n - 1)"))


@query("economic_peers", ECONOMIC_SQL)
def _(ws):
    return pr.peer_portfolios(ws.panel)


@query("broad_peers", BROAD_SQL)
def _(ws):
    return pr.peer_portfolios(ws.panel, (BROAD,))


@query("peer_membership_multi", f"{ECONOMIC_SQL} UNION ALL {BROAD_SQL}")
def _(ws):
    return pr.peer_portfolios(ws.panel, (ECONOMIC, BROAD))


@query("peer_portfolio_return", f"""
SELECT x.date, x.security_id, 'economic_subsector_peers' AS peer_definition, {r('avg(b.ret)')} AS peer_return, count(b.ret) AS peer_count
FROM ct_pairs x JOIN ct_panel b ON b.date = x.date AND b.security_id = x.peer_id GROUP BY 1, 2""")
def _(ws):
    return pr.peer_returns(ws.panel).select("date", "security_id", "peer_definition", "peer_return", "peer_count")


@query("sector_factor", f"SELECT date, {r('factor')} AS semiconductor_return FROM ct_factor")
def _(ws):
    return pr.sector_factor(ws.panel)


@query("abnormal_returns", f"""
SELECT date, security_id, {r('ret')} AS stock_return, {r('factor')} AS factor_return, {r('adj')} AS abnormal_return FROM ct_adjusted""")
def _(ws):
    joined = pr.abnormal_returns(ws.panel, ws.factor).join(
        F.broadcast(ws.factor.withColumnRenamed("semiconductor_return", "factor_return")), "date", "left")
    return joined.select("date", "security_id", F.col("return").alias("stock_return"), "factor_return", "abnormal_return")


@query("relative_abnormal_returns", f"""
SELECT date, security_id, 'economic_subsector_peers' AS peer_definition, peer_group, peer_count,
       {r('own_adj')} AS stock_abnormal_return, {r('peer_adj')} AS peer_abnormal_return, {r('rel')} AS relative_abnormal_return FROM ct_relative""")
def _(ws):
    return pr.relative_abnormal_returns(ws.adjusted, ADJUSTED)


@query("relative_returns", f"""
SELECT date, security_id, 'economic_subsector_peers' AS peer_definition, {r('own_ret')} AS stock_return, {r('peer_ret')} AS peer_return,
       {r('own_ret - peer_ret')} AS relative_return, CAST(NULL AS DOUBLE) AS market_adjusted_return, {r('own_adj')} AS semiconductor_adjusted_return
FROM ct_relative""")
def _(ws):
    return ws.relative


# The market of the test tables: the mean of all securities, eligible or not, on dates on which ten or more were seen.
@query("relative_returns_market", f"""
WITH market AS (SELECT date, avg(ret) AS m FROM ct_panel GROUP BY date HAVING count(ret) >= 10)
SELECT x.date, security_id, 'economic_subsector_peers' AS peer_definition, {r('own_ret')} AS stock_return, {r('peer_ret')} AS peer_return,
       {r('own_ret - peer_ret')} AS relative_return, {r('own_ret - m')} AS market_adjusted_return, {r('own_adj')} AS semiconductor_adjusted_return
FROM ct_relative x LEFT JOIN market USING (date)""")
def _(ws):
    market = ws.panel.groupBy("date").agg(F.avg("return").alias("market_return"), F.count("return").alias("n")).where("n >= 10")
    return pr.relative_returns(ws.adjusted, market.drop("n"))


@query("trailing_factor_residuals", f"""
WITH full_rows AS (SELECT date, security_id, ret, factor FROM ct_adjusted WHERE ret IS NOT NULL AND factor IS NOT NULL),
fits AS (SELECT *, count(*) OVER w AS n, min(date) OVER w AS first_date, max(date) OVER w AS last_date,
    regr_slope(ret, factor) OVER w AS b, regr_intercept(ret, factor) OVER w AS a FROM full_rows
  WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT p.date, p.security_id, {r('p.ret')} AS stock_return, f.first_date AS estimation_start, f.last_date AS estimation_end,
       f.n AS observation_count, {r('f.a')} AS intercept, {r('f.b')} AS beta_factor, {r('f.ret - f.a - f.b * f.factor')} AS factor_residual_return
FROM ct_adjusted p LEFT JOIN (SELECT * FROM fits WHERE n >= 40) f ON f.date = p.date AND f.security_id = p.security_id""")
def _(ws):
    rows = ws.panel.select("date", "security_id", "return").join(F.broadcast(ws.factor), "date", "left")
    return pr.one_factor_residuals(rows, "semiconductor_return", window=60, minimum=40)


# --- E. Detection -----------------------------------------------------------------


@query("trailing_relative_volatility", f"""
SELECT date, security_id, 'economic_subsector_peers' AS peer_definition, {r('rel')} AS relative_abnormal_return, {r('vol')} AS relative_volatility FROM ct_scored""")
def _(ws):
    return ev.trailing_volatility(ws.candidates, DETECTION).select(
        "date", "security_id", "peer_definition", "relative_abnormal_return", "relative_volatility")


@query("event_threshold", f"""
SELECT date, security_id, {r('rel')} AS relative_abnormal_return, {r('threshold')} AS threshold_used FROM ct_movers""")
def _(ws):
    return ev.threshold_candidates(ev.trailing_volatility(ws.candidates, DETECTION), DETECTION).select(
        "date", "security_id", "relative_abnormal_return", "threshold_used")


@query("cooldown_filter", """
WITH RECURSIVE firm_next AS MATERIALIZED (
  SELECT a.security_id, a.date, min(b.date) AS next_date FROM ct_movers a
  LEFT JOIN ct_movers b ON b.security_id = a.security_id AND b.date > a.date + 70 GROUP BY 1, 2),
firm_kept AS (
  SELECT security_id, min(date) AS date FROM ct_movers GROUP BY 1
  UNION ALL
  SELECT n.security_id, n.next_date FROM firm_kept k JOIN firm_next n ON n.security_id = k.security_id AND n.date = k.date WHERE n.next_date IS NOT NULL)
SELECT 'firm' AS cooldown_scope, m.date, m.security_id FROM ct_movers m JOIN firm_kept k USING (security_id, date)
UNION ALL SELECT 'peer_group', m.date, m.security_id FROM ct_movers m JOIN ct_kept k USING (peer_group, date)
UNION ALL SELECT 'none', date, security_id FROM ct_movers""")
def _(ws):
    movers = ev.threshold_candidates(ev.trailing_volatility(ws.candidates, DETECTION), DETECTION)
    runs = [("firm", 70), ("peer_group", 21), ("none", 21)]
    return union_all([ev.apply_cooldown(movers, days, scope).select(F.lit(scope).alias("cooldown_scope"), "date", "security_id")
                      for scope, days in runs])


@query("detect_events", f"SELECT {EVENT_SQL} FROM ct_events")
def _(ws):
    return ws.events.drop("peer_group")


@query("simultaneous_groups", """
SELECT sim AS simultaneous_event_group, date, peer_group, count(*) AS securities FROM ct_events WHERE sim IS NOT NULL GROUP BY ALL""")
def _(ws):
    return (ws.events.where("simultaneous_event_group IS NOT NULL")
            .groupBy("simultaneous_event_group", "date", "peer_group").agg(F.count("*").alias("securities")))


# --- F. Event study ---------------------------------------------------------------


@query("trading_calendar", """
SELECT event_id, day AS relative_day, calendar_date FROM ct_days""")
def _(ws):
    days = st._event_days(ws.events.select("event_id", "date"), ws.calendar, STUDY, ())
    return days.select("event_id", "relative_day", "calendar_date")


@query("frozen_peer_return", f"""SELECT event_id, day AS relative_day, {r('peer')} AS peer_return FROM ct_epanel""")
def _(ws):
    return ws.event_panel.select("event_id", "relative_day", "peer_return")


@query("event_panel", f"""
SELECT event_id, event_date, security_id, day AS relative_day, calendar_date, direction, 'economic_subsector_peers' AS peer_definition,
       'semiconductor_adjusted_return' AS return_specification, {r('own')} AS initiator_return, {r('peer')} AS peer_return,
       {r('sgn * own')} AS signed_initiator_return, {r('sgn * peer')} AS signed_peer_return,
       own IS NOT NULL AND peer IS NOT NULL AS valid_observation, has_peers AS event_date_peer_membership_valid FROM ct_epanel""")
def _(ws):
    return ws.event_panel


@query("missing_reason", "SELECT event_id, horizon, reason AS missing_reason FROM ct_outcomes")
def _(ws):
    return ws.outcomes.select("event_id", "horizon", "missing_reason")


OUTCOME_SQL = f"""event_id, event_date, security_id, direction, 'economic_subsector_peers' AS peer_definition, subsector, horizon,
  'semiconductor_adjusted_return' AS return_specification, {r('initiator_car')} AS initiator_car, {r('peer_car')} AS peer_car,
  {r('peer_catchup')} AS peer_catchup, {r('initiator_reversal')} AS initiator_reversal, {r('convergence')} AS convergence,
  {r('relative_return')} AS initial_relative_shock, {r('relative_volatility')} AS relative_volatility, sim AS simultaneous_event_group,
  false AS earnings_flag, overlapped AS overlapping_post_event_window, valid AS valid_horizon, reason AS missing_reason"""


@query("event_outcomes", f"SELECT {OUTCOME_SQL} FROM ct_outcomes")
def _(ws):
    return ws.outcomes


@query("overlap_flags", """
SELECT e.event_id, coalesce(o.overlapped, false) AS overlapping_post_event_window FROM ct_events e LEFT JOIN ct_overlap o USING (event_id)""")
def _(ws):
    flags = st.overlap_flags(ws.event_panel, STUDY)
    return ws.events.select("event_id").join(flags, "event_id", "left").withColumn(
        "overlapping_post_event_window", F.coalesce("overlapping_post_event_window", F.lit(False)))


@query("run_event_study", """
SELECT 'event_panel' AS artifact, count(*) AS row_count FROM ct_epanel UNION ALL SELECT 'outcomes', count(*) FROM ct_outcomes
UNION ALL SELECT 'valid_outcomes', count(*) FROM ct_outcomes WHERE valid""")
def _(ws):
    bundle = rp.run_event_study(ws.events, ws.frame, STUDY, ADJUSTED)
    parts = {"event_panel": bundle["event_panel"], "outcomes": bundle["outcomes"],
             "valid_outcomes": bundle["outcomes"].where("valid_horizon")}
    return union_all([df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("artifact"), "row_count") for n, df in parts.items()])
