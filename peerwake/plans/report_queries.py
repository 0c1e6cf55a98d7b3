"""Descriptive reports, statistical inference, audits and sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import CONTRACTS, contract_issues
from ..functions.exprs import union_all
from ..operators import audits as au
from ..operators import events as ev
from ..operators import inference as inf
from ..operators import peers as pr
from ..operators import regress as rg
from ..operators import reports as rp
from ..oracles.base import r
from ..oracles.stats import p_greater, p_two_sided, quantile_ctes, summary
from ..params import ECONOMIC, Inference
from .registry import query
from .workspace import DETECTION, INFERENCE, Workspace

CELL_SQL = "horizon, 'semiconductor_adjusted_return' AS return_specification, 'economic_subsector_peers' AS peer_definition"
BOTH_DIRECTIONS = """
  SELECT horizon, direction, outcome, event_id, security_id, event_date, x FROM ct_long WHERE valid
  UNION ALL SELECT horizon, 'all', outcome, event_id, security_id, event_date, x FROM ct_long WHERE valid"""

# --- F. Descriptive event-study reports -----------------------------------------------


@query("descriptive_summary", f"""
WITH rows_ AS (SELECT * FROM ct_outcomes WHERE valid),
d AS (SELECT 'all' AS dir, * FROM rows_ UNION ALL SELECT direction AS dir, * FROM rows_)
SELECT horizon, dir AS direction, count(*) AS event_count, {r('avg(convergence)')} AS mean_convergence, {r('median(convergence)')} AS median_convergence,
  {r('avg(peer_catchup)')} AS mean_peer_catchup, {r('median(peer_catchup)')} AS median_peer_catchup,
  {r('avg(initiator_reversal)')} AS mean_initiator_reversal, {r('median(initiator_reversal)')} AS median_initiator_reversal,
  {r('avg(CASE WHEN convergence > 0 THEN 1.0 ELSE 0.0 END)')} AS proportion_positive_convergence
FROM d GROUP BY 1, 2""")
def _(ws: Workspace):
    return rp.descriptive_summary(ws.outcomes)


@query("event_diagnostics", """
SELECT 'total_events' AS diagnostic, 'all' AS label, count(*) AS n FROM ct_events
UNION ALL SELECT 'valid_by_horizon', CAST(horizon AS VARCHAR), count(*) FILTER (valid) FROM ct_outcomes GROUP BY horizon
UNION ALL SELECT 'invalid_by_reason', CAST(horizon AS VARCHAR) || ' ' || why, count(*) FROM (
  SELECT horizon, unnest(string_split(reason, ';')) AS why FROM ct_outcomes WHERE NOT valid) GROUP BY horizon, why
UNION ALL SELECT 'events_by_firm', security_id, count(*) FROM ct_events GROUP BY 2
UNION ALL SELECT 'events_by_date', CAST(date AS VARCHAR), count(*) FROM ct_events GROUP BY 2
UNION ALL SELECT 'events_by_subsector', subsector, count(*) FROM ct_events GROUP BY 2""")
def _(ws):
    d = rp.event_diagnostics(ws.events, ws.outcomes)
    label = {"total_events": F.lit("all"), "valid_by_horizon": F.col("horizon").cast("string"),
             "invalid_by_reason": F.concat_ws(" ", F.col("horizon").cast("string"), "missing_reason"),
             "events_by_firm": F.col("security_id"), "events_by_date": F.col("date").cast("string"), "events_by_subsector": F.col("subsector")}
    count = {"total_events": "total_detected_events", "valid_by_horizon": "valid_events", "invalid_by_reason": "invalid_events"}
    return union_all([d[k].select(F.lit(k).alias("diagnostic"), c.alias("label"), F.col(count.get(k, "event_count")).alias("n"))
                      for k, c in label.items()])


@query("cumulative_event_path", f"""
WITH p AS (SELECT day, sum(sgn * own) OVER w AS i, sum(sgn * peer) OVER w AS q FROM ct_epanel WHERE own IS NOT NULL AND peer IS NOT NULL
  WINDOW w AS (PARTITION BY event_id ORDER BY day))
SELECT day AS relative_day, {r('avg(i)')} AS initiator_path, {r('avg(q)')} AS peer_path, {r('avg(q - i)')} AS gap_path, count(*) AS event_count
FROM p GROUP BY 1""")
def _(ws):
    return rp.cumulative_event_path(ws.event_panel)


# --- G. Inference -----------------------------------------------------------------------

DISTRIBUTION_SQL = f"""
WITH v AS ({BOTH_DIRECTIONS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY horizon, direction, outcome ORDER BY x) AS k,
                  count(*) OVER (PARTITION BY horizon, direction, outcome) AS n FROM v),
trimmed AS (SELECT horizon, direction, outcome, avg(x) AS trimmed_mean FROM ranked
            WHERE k > floor(0.1 * n) AND k <= n - floor(0.1 * n) GROUP BY ALL)
SELECT {CELL_SQL}, direction, outcome, count(x) AS sample_size, {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS standard_deviation,
  {r('avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END)')} AS proportion_positive, {r('min(x)')} AS minimum, {r('max(x)')} AS maximum,
  {r('skewness(x)')} AS skewness, {r('kurtosis(x)')} AS excess_kurtosis, {r('median(x)')} AS median,
  {r('quantile_cont(x, 0.05)')} AS p05, {r('quantile_cont(x, 0.25)')} AS p25, {r('quantile_cont(x, 0.75)')} AS p75,
  {r('quantile_cont(x, 0.95)')} AS p95, {r('any_value(trimmed_mean)')} AS trimmed_mean
FROM v JOIN trimmed USING (horizon, direction, outcome) GROUP BY horizon, direction, outcome"""


@query("distribution_statistics", DISTRIBUTION_SQL)
def _(ws):
    return inf.distribution(inf.cell_values(ws.outcomes), inf.CELL_KEYS)


#: Valid horizons without a value, as a scalar over (horizon, direction, outcome) of the row at hand.
MISSING = ("(SELECT count(*) FROM ct_long g WHERE g.valid AND g.x IS NULL AND g.horizon = {cell}.horizon AND g.outcome = {cell}.outcome"
           " AND {cell}.direction IN ('all', g.direction))")


def inference_sql(errors: str, df: str, clusters: str, tests: bool = False, extra: str = "") -> str:
    """Mean inference from a relation e(horizon, direction, outcome, n, m, sd, se, df, g)."""
    t = "m / nullif(se, 0)"
    p = f"CASE WHEN outcome = 'convergence' THEN {p_greater(t, 'e.df')} ELSE {p_two_sided(t, 'e.df')} END"
    alt = "CASE WHEN outcome = 'convergence' THEN 'greater' ELSE 'two-sided' END"
    columns = f"""{CELL_SQL}, direction, outcome, n AS sample_size, {r('m')} AS mean, {r('se')} AS standard_error, {r(t, 6)} AS test_statistic,
      {r(p)} AS p_value, {r('m - q * se')} AS ci_lower, {r('m + q * se')} AS ci_upper, e.df AS degrees_of_freedom, g AS cluster_count,
      {alt} AS alternative"""
    if tests:
        columns = f"""{CELL_SQL}, direction, outcome, n AS sample_size, {MISSING.format(cell='e')} AS missing_outcome_count, CAST(0 AS DOUBLE) AS null_value, {alt} AS alternative,
      {r(t, 6)} AS test_statistic, {r(p)} AS p_value, {r('m - q * se')} AS ci_lower, {r('m + q * se')} AS ci_upper,
      {r('m / nullif(sd, 0)')} AS effect_size, {r('se')} AS standard_error, e.df AS degrees_of_freedom, 'firm' AS cluster_by, g AS cluster_count"""
    return f"""
WITH v AS MATERIALIZED ({BOTH_DIRECTIONS}),
c AS MATERIALIZED (SELECT horizon, direction, outcome, count(x) AS n, avg(x) AS m, stddev_samp(x) AS sd FROM v GROUP BY ALL),
{errors},
{quantile_ctes('SELECT df FROM e')}
SELECT {columns} FROM e LEFT JOIN tq ON tq.df = e.df"""


def cluster_cte(name: str, by: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT horizon, direction, outcome, count(*) AS g, CASE WHEN count(*) > 1 THEN count(*) / (count(*) - 1.0) * sum(d * d) / (any_value(n) * any_value(n)) END AS var
  FROM (SELECT v.horizon, v.direction, v.outcome, {by}, any_value(n) AS n, sum(x - m) AS d FROM v JOIN c USING (horizon, direction, outcome)
        GROUP BY v.horizon, v.direction, v.outcome, {by}) GROUP BY ALL)"""


IID_SQL = inference_sql("e AS MATERIALIZED (SELECT *, sd / sqrt(n) AS se, n - 1 AS df, CAST(NULL AS BIGINT) AS g FROM c)", "", "")
FIRM_ERRORS = cluster_cte("f", "security_id") + """,
e AS MATERIALIZED (SELECT c.*, sqrt(var) AS se, CASE WHEN f.g > 1 THEN f.g - 1 END AS df, f.g FROM c JOIN f USING (horizon, direction, outcome))"""
TWO_WAY_ERRORS = ",\n".join([cluster_cte("f", "security_id"), cluster_cte("d", "event_date"), cluster_cte("b", "security_id, event_date")]) + """,
e AS MATERIALIZED (SELECT c.*, CASE WHEN f.var + d.var - b.var >= 0 THEN sqrt(f.var + d.var - b.var) END AS se, least(f.g, d.g) - 1 AS df, least(f.g, d.g) AS g
  FROM c JOIN f USING (horizon, direction, outcome) JOIN d USING (horizon, direction, outcome) JOIN b USING (horizon, direction, outcome))"""


def _tests(ws, cluster_by):
    out = inf.mean_inference(inf.cell_values(ws.outcomes), inf.CELL_KEYS, cluster_by, alternative=inf.alternatives())
    return out.withColumn("test_statistic", F.round("test_statistic", 6))


@query("mean_inference_iid", IID_SQL)
def _(ws):
    return _tests(ws, None)


@query("mean_inference_clustered", inference_sql(FIRM_ERRORS, "", ""))
def _(ws):
    return _tests(ws, "firm")


@query("mean_inference_event_date", inference_sql(FIRM_ERRORS.replace("security_id", "event_date"), "", ""))
def _(ws):
    return _tests(ws, "event_date")


@query("mean_inference_two_way", inference_sql(TWO_WAY_ERRORS, "", ""))
def _(ws):
    return _tests(ws, "two_way")


@query("hypothesis_tests", inference_sql(FIRM_ERRORS, "", "", tests=True))
def _(ws):
    return inf.hypothesis_tests(ws.outcomes).withColumn("test_statistic", F.round("test_statistic", 6))


def bootstrap_sql(unit: str, iterations: int, seed: int, values: str = BOTH_DIRECTIONS) -> str:
    """boot(horizon, direction, outcome, it, statistic, n): resampled means of whole units."""
    spec = "'semiconductor_adjusted_return', 'economic_subsector_peers'"
    return f"""
v AS MATERIALIZED ({values}),
units AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY horizon, direction, outcome ORDER BY sha256({unit})) - 1 AS i,
    count(*) OVER (PARTITION BY horizon, direction, outcome) AS total
  FROM (SELECT horizon, direction, outcome, {unit}, sum(x) AS s, count(x) AS c FROM v GROUP BY ALL)),
draws AS (SELECT u.horizon, u.direction, u.outcome, b.it,
    ('0x' || substr(sha256(concat_ws('|', '{seed}', u.horizon, {spec}, u.direction, u.outcome, b.it, u.i)), 1, 15))::BIGINT % u.total AS pick
  FROM units u CROSS JOIN (SELECT unnest(range(0, {iterations})) AS it) b),
boot AS MATERIALIZED (SELECT d.horizon, d.direction, d.outcome, d.it, sum(u.s) / sum(u.c) AS statistic, sum(u.c) AS n
  FROM draws d JOIN units u ON u.horizon = d.horizon AND u.direction = d.direction AND u.outcome = d.outcome AND u.i = d.pick
  GROUP BY ALL)"""


@query("bootstrap_mean_interval", f"""
WITH {bootstrap_sql('security_id', 200, 42)}
SELECT {CELL_SQL}, direction, outcome, {r('quantile_cont(statistic, 0.025)')} AS ci_lower, {r('quantile_cont(statistic, 0.975)')} AS ci_upper,
  {r('stddev_samp(statistic)')} AS bootstrap_standard_error, count(*) AS bootstrap_iterations
FROM boot GROUP BY horizon, direction, outcome""")
def _(ws):
    return inf.bootstrap_interval(inf.cell_values(ws.outcomes), inf.CELL_KEYS, INFERENCE)


@query("attrition", f"""
WITH d AS (SELECT * REPLACE ('all' AS direction) FROM ct_outcomes UNION ALL SELECT * FROM ct_outcomes),
why AS (SELECT horizon, direction, string_agg(w, ';' ORDER BY w) AS missing_reasons FROM (
  SELECT DISTINCT horizon, direction, unnest(string_split(reason, ';')) AS w FROM d WHERE NOT valid) GROUP BY ALL)
SELECT {CELL_SQL}, direction, count(DISTINCT event_id) AS total_events, count(*) FILTER (valid) AS valid_horizons,
  count(*) FILTER (NOT valid) AS invalid_horizons, coalesce(any_value(missing_reasons), '') AS missing_reasons
FROM d LEFT JOIN why USING (horizon, direction) GROUP BY horizon, direction""")
def _(ws):
    return inf.attrition(ws.outcomes)


@query("summarize_event_outcomes", f"""
WITH v AS MATERIALIZED ({BOTH_DIRECTIONS}),
c AS MATERIALIZED (SELECT horizon, direction, outcome, count(x) AS n, avg(x) AS m, stddev_samp(x) AS sd, median(x) AS med,
   avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS pos FROM v GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY horizon, direction, outcome ORDER BY x) AS k,
                  count(*) OVER (PARTITION BY horizon, direction, outcome) AS n FROM v),
trimmed AS MATERIALIZED (SELECT horizon, direction, outcome, avg(x) AS tm FROM ranked
            WHERE k > floor(0.1 * n) AND k <= n - floor(0.1 * n) GROUP BY ALL),
{FIRM_ERRORS},
{quantile_ctes('SELECT df FROM e')}
SELECT {CELL_SQL}, direction, outcome, n AS sample_size, {MISSING.format(cell='e')} AS missing_outcome_count, {r('m')} AS mean, {r('med')} AS median, {r('sd')} AS standard_deviation,
  {r('tm')} AS trimmed_mean, {r('pos')} AS proportion_positive, {r('se')} AS standard_error, {r('m - q * se')} AS ci_lower, {r('m + q * se')} AS ci_upper,
  {r(f"CASE WHEN outcome = 'convergence' THEN {p_greater('m / nullif(se, 0)', 'e.df')} ELSE {p_two_sided('m / nullif(se, 0)', 'e.df')} END")} AS p_value,
  CAST(NULL AS DOUBLE) AS bootstrap_standard_error, CAST(0.95 AS DOUBLE) AS confidence_level, 'analytical' AS interval_method
FROM e JOIN trimmed USING (horizon, direction, outcome) LEFT JOIN tq ON tq.df = e.df""")
def _(ws):
    return inf.summarize_event_outcomes(ws.outcomes)["summary_table"]


def _characteristics(ws):
    """Event-date regressors for the regression design, from the panel and the sector state."""
    from ..operators import mechanism as me
    state = me.sector_state(ws.factor)
    regime = lambda c: F.when(F.col(c) >= 0.02, F.lit("high")).otherwise(F.lit("low"))
    return (ws.events.join(F.broadcast(state), "date", "left").select(
        "event_id", "volume", (F.col("volume") * 100).alias("market_cap"),
        F.when(F.col("SectorMomentum_1m") > 0, F.lit("up")).otherwise(F.lit("down")).alias("market_volatility_regime"),
        regime("SectorVolatility").alias("semiconductor_volatility_regime"), F.date_sub("date", 1).alias("information_date")))


@query("event_regressions")
def _(ws):
    return rg.event_regressions(ws.outcomes, _characteristics(ws))


@query("event_regressions_hc1")
def _(ws):
    return rg.event_regressions(ws.outcomes, _characteristics(ws), cluster_by=None)


@query("event_regressions_two_way")
def _(ws):
    return rg.event_regressions(ws.outcomes, _characteristics(ws), cluster_by="two_way")


PATH_SQL = """
paths AS (SELECT *, min(CASE WHEN own IS NOT NULL AND peer IS NOT NULL THEN 1 ELSE 0 END) OVER w = 1 AS ok, sum(own) OVER w AS i, sum(peer) OVER w AS q
  FROM ct_epanel {where} WINDOW w AS (PARTITION BY event_id ORDER BY day))"""


@query("event_time_statistics", f"""
WITH {PATH_SQL.format(where='WHERE day > 0')},
one AS (SELECT day, direction, event_id, security_id, 'initiator_car' AS outcome, i AS x FROM paths WHERE ok
  UNION ALL SELECT day, direction, event_id, security_id, 'peer_car', q FROM paths WHERE ok
  UNION ALL SELECT day, direction, event_id, security_id, 'convergence', sgn * (q - i) FROM paths WHERE ok),
v AS MATERIALIZED (SELECT * FROM one UNION ALL SELECT * REPLACE ('all' AS direction) FROM one),
c AS MATERIALIZED (SELECT day, direction, outcome, count(x) AS n, avg(x) AS m FROM v GROUP BY ALL),
f AS MATERIALIZED (SELECT day, direction, outcome, count(*) AS g, sqrt(count(*) / nullif(count(*) - 1.0, 0) * sum(d * d)) / any_value(n) AS se
  FROM (SELECT v.day, v.direction, v.outcome, security_id, any_value(n) AS n, sum(x - m) AS d FROM v JOIN c USING (day, direction, outcome)
        GROUP BY v.day, v.direction, v.outcome, security_id) GROUP BY ALL),
{quantile_ctes('SELECT g - 1 AS df FROM f')}
SELECT day AS relative_day, 'semiconductor_adjusted_return' AS return_specification, 'economic_subsector_peers' AS peer_definition, direction, outcome,
  {r('m')} AS mean, {r('m - q * se')} AS ci_lower, {r('m + q * se')} AS ci_upper, {r('se')} AS standard_error, n AS sample_size
FROM c JOIN f USING (day, direction, outcome) LEFT JOIN tq ON tq.df = f.g - 1""")
def _(ws):
    return inf.event_time_statistics(ws.event_panel)


@query("event_path_statistics", f"""
WITH {PATH_SQL.format(where='')},
v AS MATERIALIZED (SELECT day, 'initiator_car' AS outcome, CASE WHEN ok THEN sgn * i END AS x FROM paths
  UNION ALL SELECT day, 'peer_car', CASE WHEN ok THEN sgn * q END FROM paths
  UNION ALL SELECT day, 'convergence', CASE WHEN ok THEN sgn * (q - i) END FROM paths),
c AS MATERIALIZED (SELECT day, outcome, count(x) AS n, avg(x) AS m, stddev_samp(x) AS sd FROM v GROUP BY ALL),
{quantile_ctes('SELECT n - 1 AS df FROM c')}
SELECT day AS relative_day, outcome, {r('m')} AS mean, {r('m - q * sd / sqrt(n)')} AS ci_lower, {r('m + q * sd / sqrt(n)')} AS ci_upper, n AS sample_size
FROM c LEFT JOIN tq ON tq.df = n - 1""")
def _(ws):
    return inf.event_path_statistics(ws.event_panel)


@query("run_statistical_inference", """
WITH cells AS (SELECT DISTINCT horizon, direction FROM ct_outcomes), n AS (SELECT (SELECT count(*) FROM cells) + (SELECT count(DISTINCT horizon) FROM cells) AS k)
SELECT 'summary_table' AS table_name, k * 3 AS row_count FROM n UNION ALL SELECT 'distribution_summary', k * 3 FROM n
UNION ALL SELECT 'hypothesis_tests', k * 3 FROM n UNION ALL SELECT 'attrition_table', k FROM n
UNION ALL SELECT 'event_time_statistics', 10 * 3 * (1 + count(DISTINCT direction)) FROM ct_events""")
def _(ws):
    return rp.bundle_counts(inf.run_statistical_inference(ws.outcomes, ws.event_panel))
