"""Diagnostics, mechanism tests, placebos, resampling and stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import union_all
from ..operators import audits as au
from ..operators import diagnostics as dg
from ..operators import mechanism as me
from ..operators import reports as rp
from ..operators import resample as rs
from ..operators import similarity as sm
from ..oracles import runs as rn
from ..oracles.base import r
from ..oracles.stats import LABEL, normal_interval, ols_ctes, p_normal, quantile_ctes, summary
from ..params import BROAD, CORRELATION, ECONOMIC, OUTCOMES
from .registry import query
from .report_queries import CELL_SQL, bootstrap_sql
from .workspace import ADJUSTED, GROUP, LOOKBACK, MULTIPLIERS, OVERLAP, PERIODS, RESAMPLING, STUDY, TOP_PEERS, Workspace



def five_dimensions():
    return {"year": F.year("date"), "month": F.date_format("date", "yyyy-MM"), "company": F.col("ticker"),
            "subsector": F.col("subsector"), "direction": F.col("direction")}


FIVE_SQL = """
dims AS (SELECT event_id, 'year' AS dimension, CAST(year(date) AS VARCHAR) AS label FROM ct_events
  UNION ALL SELECT event_id, 'month', strftime(date, '%Y-%m') FROM ct_events UNION ALL SELECT event_id, 'company', ticker FROM ct_detail
  UNION ALL SELECT event_id, 'subsector', subsector FROM ct_events UNION ALL SELECT event_id, 'direction', direction FROM ct_events)"""

# --- D/J. Correlation peers -----------------------------------------------------------------


@query("trailing_correlation_peers", f"""
SELECT event_id, date, security_id, peer_id, 'trailing_return_similarity_peers' AS peer_definition, {r('weight')} AS weight, {r('c')} AS correlation,
  CAST(rk AS INTEGER) AS rank FROM ct_corr_top""")
def _(ws: Workspace):
    return sm.correlation_peers(*ws.similarity_inputs, minimum=OVERLAP, top=TOP_PEERS)


@query("peer_portfolio_explicit_edges", f"""
SELECT t.date, t.security_id, 'trailing_return_similarity_peers' AS peer_definition, {r('sum(weight * b.ret) / sum(CASE WHEN b.ret IS NOT NULL THEN weight END)')} AS peer_return,
  count(b.ret) AS peer_count
FROM ct_corr_top t LEFT JOIN ct_panel b ON b.date = t.date AND b.security_id = t.peer_id GROUP BY 1, 2""")
def _(ws):
    from ..operators import peers as pr
    return pr.weighted_peer_returns(ws.correlation_edges, ws.panel)


@query("correlation_audit", """
SELECT e.event_id, e.date AS event_date, coalesce(t.n, 0) AS correlation_peer_count, d.last AS correlation_information_max_date,
  d.last IS NULL OR d.last < e.date AS no_future_information_check
FROM ct_events e LEFT JOIN (SELECT event_id, count(*) AS n FROM ct_corr_top GROUP BY 1) t USING (event_id)
LEFT JOIN (SELECT t, max(date) AS last FROM ct_unit_dates GROUP BY 1) d ON d.t = e.date""")
def _(ws):
    return sm.correlation_audit(ws.similarity_inputs[0], ws.calendar, ws.correlation_edges)


@query("peer_quality", f"""
SELECT event_id, event_date, security_id, {r('mean_corr')} AS average_peer_correlation, {r('basket_corr')} AS peer_return_similarity,
  n AS correlation_history_count, last_date AS correlation_information_max_date, last_date IS NULL OR last_date < event_date AS no_future_information_check
FROM ct_quality""")
def _(ws):
    return ws.peer_quality


# --- J. Event quality and characteristics ------------------------------------------------------


@query("summarize_outcomes", summary("SELECT subsector, horizon, outcome, event_id, x FROM ct_long WHERE valid", "subsector, horizon, outcome"))
def _(ws):
    return rp.summarize_outcomes(ws.outcomes, ["subsector", "horizon"])


@query("trailing_percentile", f"""
SELECT event_id, {r('pct')} AS volume_percentile, {r('med')} AS trailing_volume_median, n AS volume_history_count, last_date AS volume_history_max_date FROM ct_volume""")
def _(ws):
    return dg.trailing_percentile(ws.panel, ws.events)


@query("peer_coverage", f"""
SELECT event_id, peer_count, possible AS possible_peer_count, {r('coverage')} AS peer_portfolio_coverage, {r('peer_adj')} AS peer_return FROM ct_coverage""")
def _(ws):
    return ws.coverage


@query("event_quality_detail", f"""
SELECT event_id, date, ticker, company_name, subsector, direction, {r('relative_return')} AS relative_return, {r('z')} AS z_score,
  {r('relative_volatility')} AS relative_volatility, volume, {r('pct')} AS volume_percentile, {r('ratio')} AS abnormal_volume_ratio, CAST(NULL AS DOUBLE) AS market_cap,
  pc AS peer_count, possible AS possible_peer_count, {r('coverage')} AS peer_portfolio_coverage, {r('peer_adj')} AS peer_return, vn AS volume_history_count,
  vlast AS volume_history_max_date FROM ct_detail""")
def _(ws):
    return ws.quality_detail


@query("event_concentration", f"""
WITH {FIVE_SQL}, n AS (SELECT dimension, label, count(*) AS c, count(*) / (SELECT count(*) FROM ct_events) AS share FROM dims GROUP BY 1, 2)
SELECT dimension, count(*) AS category_count, arg_min(label, (-c, label)) AS largest_category, {r('max(share)')} AS largest_category_share,
  {r('sum(share * share)')} AS herfindahl_index, {r('1 / sum(share * share)')} AS effective_category_count, (SELECT count(*) FROM ct_events) AS event_count
FROM n GROUP BY 1""")
def _(ws):
    named = ws.events.join(ws.master.select("security_id", "ticker"), "security_id", "left")
    return rp.concentration(named, five_dimensions())


@query("largest_events", f"""
SELECT date AS event_date, ticker AS initiator, company_name, subsector, {r('relative_return')} AS relative_shock_magnitude, {r('z')} AS z_score,
  CAST(NULL AS DOUBLE) AS market_cap, {r('pct')} AS volume_percentile, {r('ratio')} AS abnormal_volume_ratio, {r('peer_adj')} AS peer_return,
  {r('relative_return + peer_adj')} AS initiator_return, pc AS peer_count, {r('coverage')} AS peer_portfolio_coverage
FROM ct_detail ORDER BY abs(relative_return) DESC, date, event_id LIMIT 25""")
def _(ws):
    return dg.largest_events(ws.quality_detail)


@query("peer_definition_outcomes", f"""
WITH {rn.DEFINITION_RUN}
SELECT event_id, k AS peer_definition, horizon, {r('initiator_car')} AS initiator_car, {r('peer_car')} AS peer_car, {r('convergence')} AS convergence,
  valid AS valid_horizon, reason AS missing_reason FROM df_out""")
def _(ws):
    return ws.definition_outcomes.select("event_id", "peer_definition", "horizon", "initiator_car", "peer_car", "convergence", "valid_horizon", "missing_reason")


@query("compare_peer_definitions", summary(f"SELECT k AS peer_definition, * EXCLUDE (k) FROM ({rn.long_k('df')})", "peer_definition, horizon, outcome",
                                           head=rn.DEFINITION_RUN + ", "))
def _(ws):
    return rp.summarize_outcomes(ws.definition_outcomes, ["peer_definition", "horizon"])


@query("event_characteristics", "SELECT event_id, " + ", ".join(f"{r(c)} AS {c}" for c in dg.PREDICTORS) + " FROM ct_chars")
def _(ws):
    return ws.characteristics


RELATIONSHIPS_SQL = f"""
WITH p AS (UNPIVOT (SELECT event_id, {', '.join(f'coalesce({c}, CAST(1e300 AS DOUBLE)) AS {c}' for c in dg.PREDICTORS)} FROM ct_chars) ON {', '.join(dg.PREDICTORS)} INTO NAME predictor VALUE raw),
v AS MATERIALIZED (SELECT l.horizon, l.outcome, p.predictor, l.event_id, l.x AS y, nullif(p.raw, 1e300) AS x FROM ct_long l JOIN p USING (event_id) WHERE l.valid),
a AS MATERIALIZED (SELECT horizon, outcome, predictor, count(*) AS total, count(x) AS n, avg(x) AS mx, stddev_samp(x) AS sx,
    avg(CASE WHEN x IS NOT NULL THEN y END) AS my, min(x) <> max(x) AS varies FROM v GROUP BY ALL),
b AS MATERIALIZED (SELECT v.horizon, v.outcome, v.predictor, sum((x - mx) / sx * (y - my)) / (any_value(n) - 1) AS slope FROM v JOIN a USING (horizon, outcome, predictor)
    WHERE x IS NOT NULL AND n >= 20 AND varies GROUP BY ALL),
c AS (SELECT v.horizon, v.outcome, v.predictor, any_value(slope) AS slope, sqrt(sum(pow((x - mx) / sx / (n - 1) * (y - my - slope * (x - mx) / sx)
    / (1 - 1.0 / n - pow((x - mx) / sx, 2) / (n - 1)), 2))) AS se
  FROM v JOIN a USING (horizon, outcome, predictor) JOIN b USING (horizon, outcome, predictor) WHERE x IS NOT NULL GROUP BY ALL)
SELECT a.horizon, a.outcome, a.predictor, n AS sample_size, {r('n / total')} AS coverage, {LABEL.format(n='n', adequate='adequate_descriptive_sample')} AS sample_label,
  {r('slope')} AS coefficient_per_1sd, {r('se')} AS standard_error_hc3, {r('slope - 1.959963984540054 * se')} AS ci_lower, {r('slope + 1.959963984540054 * se')} AS ci_upper,
  CASE WHEN slope IS NOT NULL THEN 'estimated_exploratory' ELSE 'insufficient_data' END AS status
FROM a LEFT JOIN c USING (horizon, outcome, predictor)"""


@query("characteristic_relationships", RELATIONSHIPS_SQL)
def _(ws):
    return dg.characteristic_relationships(ws.outcomes, ws.characteristics).drop("p_value_exploratory")


@query("characteristic_relationships_p_values", RELATIONSHIPS_SQL.replace(
    "CASE WHEN slope IS NOT NULL", f"{r(p_normal('(slope / nullif(se, 0))'))} AS p_value_exploratory, CASE WHEN slope IS NOT NULL", 1))
def _(ws):
    return dg.characteristic_relationships(ws.outcomes, ws.characteristics)


# --- J. Specifications -----------------------------------------------------------------------------


def spec_sql(run: str, px: str, variation: str, name: str, notes: str) -> str:
    return summary(f"SELECT {name} AS specification, horizon, outcome, event_id, x FROM ({rn.long_k(px)})", "specification, horizon, outcome",
                   ["event_count", "sample_size", "mean", "median", "ci_lower", "ci_upper", "sample_label"], head=run + ", ",
                   extra=f", '{variation}' AS variation_type, 'estimated_exploratory' AS status, '{notes}' AS notes")


THRESHOLD_NOTE = "only the multiple of the volatility band differs from the main run"
MARKET_NOTE = "no input table holds a market index"
RETURN_NOTE = "events of the main run under each return definition"
UNIVERSE_NOTE = "eligibility as known on each date"


def sigma(c):
    return F.concat(F.regexp_replace(F.format_number(c, 1), r"\.0$", ""), F.lit("_sigma"))


def threshold_rows(ws):
    return dg.specification_rows(ws.threshold_outcomes, "event_threshold", sigma(F.col("multiplier")), THRESHOLD_NOTE,
                                 [f"{m:g}_sigma" for m in MULTIPLIERS])


def return_rows(ws):
    found = dg.specification_rows(ws.return_outcomes, "return_definition", F.col("spec"), RETURN_NOTE, ["raw_returns", "semiconductor_factor_adjusted"])
    return found.unionByName(dg.unavailable_rows(ws.spark, "return_definition", "market_adjusted", (1, 3, 5, 10, 20),
                                                 MARKET_NOTE))


def universe_rows(ws):
    return dg.specification_rows(ws.universe_outcomes, "universe", F.col("variant"), UNIVERSE_NOTE,
                                 ["core", "core_plus_extension", "excluding_questionable"])


def outlier_rows(ws):
    kind = "extreme_event_treatment"
    return union_all([dg.specification_rows(ws.outcomes, kind, "all_events"),
                      dg.specification_rows(dg.winsorize_outcomes(ws.outcomes), kind, "winsorized_1_99", "outcomes winsorized within horizon"),
                      dg.specification_rows(dg.exclude_outliers(ws.outcomes), kind, "exclude_flagged_extremes",
                                            "without events whose convergence lies over three quartile ranges out at its horizon")])


THRESHOLD_SQL = spec_sql(rn.THRESHOLD_RUN, "th", "event_threshold", "format('{:g}', k) || '_sigma'", THRESHOLD_NOTE)


@query("threshold_sweep", THRESHOLD_SQL)
def _(ws):
    return threshold_rows(ws)


MARKET_GAP = f"""
UNION ALL BY NAME SELECT 'market_adjusted' AS specification, horizon, outcome, 0 AS event_count, 0 AS sample_size, 'small_sample_descriptive_only' AS sample_label,
  'return_definition' AS variation_type, 'unavailable' AS status, '{MARKET_NOTE}' AS notes
FROM (SELECT unnest([1, 3, 5, 10, 20]) AS horizon) CROSS JOIN (SELECT unnest(['convergence', 'peer_catchup', 'initiator_reversal']) AS outcome)"""


RETURN_SQL = spec_sql(rn.RETURN_RUN, "rd", "return_definition", "k", RETURN_NOTE) + MARKET_GAP


@query("return_definition_sweep", RETURN_SQL)
def _(ws):
    return return_rows(ws)


UNIVERSE_SQL = spec_sql(rn.UNIVERSE_RUN, "un", "universe", "k", UNIVERSE_NOTE)


@query("universe_sweep", UNIVERSE_SQL)
def _(ws):
    return universe_rows(ws)


TAILS = """
SELECT horizon, {cols} FROM ct_outcomes WHERE valid GROUP BY 1"""
WINSOR_SQL = TAILS.format(cols=", ".join(f"quantile_cont({o}, 0.01) AS {o}_lo, quantile_cont({o}, 0.99) AS {o}_hi" for o in OUTCOMES))


@query("winsorize_outcomes", f"""
WITH t AS ({WINSOR_SQL})
SELECT event_id, horizon, valid AS valid_horizon, {', '.join(f"{r(f'CASE WHEN valid THEN least(greatest({o}, {o}_lo), {o}_hi) END')} AS {o}" for o in OUTCOMES)}
FROM ct_outcomes LEFT JOIN t USING (horizon)""")
def _(ws):
    return dg.winsorize_outcomes(ws.outcomes).select("event_id", "horizon", "valid_horizon", *OUTCOMES)


IQR_SQL = TAILS.format(cols="quantile_cont(convergence, 0.25) AS q1, quantile_cont(convergence, 0.75) AS q3")


@query("iqr_outlier_exclusion", f"""
WITH t AS ({IQR_SQL})
SELECT event_id, horizon, valid AND NOT (convergence < q1 - 3 * (q3 - q1) OR convergence > q3 + 3 * (q3 - q1)) IS TRUE AS valid_horizon
FROM ct_outcomes LEFT JOIN t USING (horizon)""")
def _(ws):
    return dg.exclude_outliers(ws.outcomes).select("event_id", "horizon", "valid_horizon")


@query("specification_rows", summary("""
  SELECT 'all_events' AS specification, '' AS notes, horizon, outcome, event_id, x FROM ct_long WHERE valid
  UNION ALL SELECT 'winsorized_1_99', 'outcomes winsorized within horizon', horizon, outcome, event_id, least(greatest(x, lo), hi)
  FROM ct_long JOIN (SELECT horizon, outcome, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM ct_long WHERE valid GROUP BY 1, 2) USING (horizon, outcome) WHERE valid
  UNION ALL SELECT 'exclude_flagged_extremes', 'without events whose convergence lies over three quartile ranges out at its horizon', l.horizon, outcome, l.event_id, x
  FROM ct_long l JOIN (SELECT event_id, horizon FROM ct_outcomes JOIN (""" + IQR_SQL + """) USING (horizon)
    WHERE valid AND convergence BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)) k ON k.event_id = l.event_id AND k.horizon = l.horizon""",
    "specification, notes, horizon, outcome", ["event_count", "sample_size", "mean", "median", "ci_lower", "ci_upper", "sample_label"],
    extra=", 'extreme_event_treatment' AS variation_type, 'estimated_exploratory' AS status"))
def _(ws):
    return outlier_rows(ws)


# --- K. Mechanism ------------------------------------------------------------------------------------


@query("sector_state", f"""
SELECT date, {r('mom1')} AS "SectorMomentum", {r('mom1')} AS "SectorMomentum_1m", {r('mom3')} AS "SectorMomentum_3m", {r('vol')} AS "SectorVolatility",
  CAST(NULL AS DOUBLE) AS "MarketVolatility", info AS sector_information_max_date FROM ct_state""")
def _(ws):
    return me.sector_state(ws.factor)


@query("pre_event_volume", f"""
SELECT event_id, {r('measure')} AS "VolumeMeasure", CASE WHEN near_n > 0 THEN last_date END AS volume_information_max_date, near_n AS volume_recent_count, far_n AS volume_reference_count FROM ct_pre_volume""")
def _(ws):
    return me.pre_event_volume(ws.panel, ws.events)


@query("mechanism_characteristics", f"""
SELECT event_id, equipment AS "EquipmentIndicator", 1 AS "EconomicPeerIndicator", {r('shock')} AS "ShockMagnitude", {r('shock * shock')} AS "ShockMagnitudeSquared",
  up AS "EventDirection", {r('mom1')} AS "SectorMomentum", {r('mom3')} AS "SectorMomentum_3m", {r('vol')} AS "SectorVolatility", {r('measure')} AS "VolumeMeasure",
  info IS NULL OR info < date AS no_future_sector_information, last_date IS NULL OR last_date < date AS no_future_volume_information FROM ct_mech""")
def _(ws):
    return ws.mechanism.select("event_id", "EquipmentIndicator", "EconomicPeerIndicator", "ShockMagnitude", "ShockMagnitudeSquared", "EventDirection",
                               "SectorMomentum", "SectorMomentum_3m", "SectorVolatility", "VolumeMeasure", "no_future_sector_information",
                               "no_future_volume_information")


MECHANISM_X = {"EquipmentIndicator": "equipment", "ShockMagnitude": "shock", "SectorMomentum": "mom1", "VolumeMeasure": "measure", "EventDirection": "up",
               "ShockMagnitudeSquared": "shock * shock"}


def mechanism_model(px: str, names: list[str]) -> str:
    """CTEs of one specification over the outcomes and horizons."""
    return ols_ctes(px, "SELECT horizon, outcome AS dependent_variable, x AS y, " + ", ".join(f'{MECHANISM_X[n]} AS {n}' for n in names)
                    + " FROM ct_long l JOIN ct_mech c USING (event_id) WHERE l.valid AND l.horizon IN (1, 5, 10)", "horizon, dependent_variable", names)


def mechanism_terms(px: str, label: str) -> str:
    return f"""SELECT '{label}' AS model_specification, horizon, dependent_variable, n AS sample_size, n AS event_count, {r('r2', 6)} AS r_squared, {r('adj', 6)} AS adjusted_r_squared,
  'HC3' AS covariance_estimator, {LABEL.format(n='n', adequate='adequate_analysis_sample')} AS sample_label,
  CASE WHEN ok THEN 'estimated_confirmatory' ELSE 'insufficient_data' END AS status, coalesce(term, 'model') AS term, {normal_interval(p='p_value_context_only')}
FROM {px}_models LEFT JOIN {px}_terms USING (horizon, dependent_variable)"""


MECHANISM_SQL = (f"WITH {mechanism_model('lin', me.PRIMARY)}, {mechanism_model('quad', [*me.PRIMARY, 'ShockMagnitudeSquared'])}\n"
                 f"{mechanism_terms('lin', 'primary_linear')} UNION ALL {mechanism_terms('quad', 'targeted_shock_quadratic')}")


@query("mechanism_regressions", MECHANISM_SQL, digits=6)
def _(ws):
    return me.mechanism_regressions(ws.outcomes, ws.mechanism)


@query("mechanism_regression_samples", f"""
WITH m AS (SELECT l.horizon, l.outcome, l.event_id FROM ct_long l JOIN ct_mech c USING (event_id)
  WHERE l.valid AND l.horizon IN (1, 5, 10) AND shock IS NOT NULL AND mom1 IS NOT NULL AND measure IS NOT NULL)
SELECT s AS model_specification, horizon, outcome AS dependent_variable, count(*) AS sample_size
FROM m CROSS JOIN (SELECT unnest(['primary_linear', 'targeted_shock_quadratic']) AS s) GROUP BY ALL""")
def _(ws):
    return me.mechanism_regressions(ws.outcomes, ws.mechanism).select("model_specification", "horizon", "dependent_variable", "sample_size").distinct()


@query("group_concentration", f"""
WITH g AS (SELECT 'company' AS dimension, m.ticker AS label FROM ct_events e JOIN ct_master m USING (security_id) WHERE e.subsector = '{GROUP}'
  UNION ALL SELECT 'year', CAST(year(date) AS VARCHAR) FROM ct_events WHERE subsector = '{GROUP}')
SELECT dimension, label, count(*) AS event_count, {r(f"count(*) / (SELECT count(*) FROM ct_events WHERE subsector = '{GROUP}')")} AS event_share_within_group,
  {LABEL.format(n='count(*)', adequate='adequate_analysis_sample')} AS sample_label FROM g GROUP BY 1, 2""")
def _(ws):
    chosen = ws.mechanism.where("EquipmentIndicator = 1").join(ws.master.select("security_id", "ticker"), "security_id", "left")
    return rp.labelled_counts(chosen, {"company": F.col("ticker"), "year": F.year("date")})


SHORT_COLS = ["event_count", "sample_size", "mean", "median", "ci_lower", "ci_upper", "sample_label"]
GROUP_NAME = f"CASE WHEN subsector = '{GROUP}' THEN 'equipment' ELSE 'all_non_equipment' END"


@query("group_comparison", summary(f"""
  SELECT g.grouping, g.name AS "group", horizon, outcome, event_id, x FROM (
    SELECT event_id, subsector, horizon, 'convergence' AS outcome, convergence AS x FROM ct_outcomes WHERE valid AND horizon IN (1, 5, 10)
    UNION ALL SELECT event_id, subsector, horizon, 'peer_catchup', peer_catchup FROM ct_outcomes WHERE valid AND horizon IN (1, 5, 10)
    UNION ALL SELECT event_id, subsector, horizon, 'initiator_reversal', initiator_reversal FROM ct_outcomes WHERE valid AND horizon IN (1, 5, 10)
    UNION ALL SELECT event_id, subsector, horizon, 'initiator_car', initiator_car FROM ct_outcomes WHERE valid AND horizon IN (1, 5, 10)
    UNION ALL SELECT event_id, subsector, horizon, 'peer_car', peer_car FROM ct_outcomes WHERE valid AND horizon IN (1, 5, 10)) o
  CROSS JOIN LATERAL (SELECT 'binary' AS grouping, {GROUP_NAME} AS name UNION ALL SELECT 'subsector_full_disclosure', subsector) g""",
    'grouping, "group", horizon, outcome', SHORT_COLS, adequate="adequate_analysis_sample"))
def _(ws):
    return me.group_comparison(ws.outcomes, ws.mechanism)


@query("group_event_path", summary(f"""
  SELECT "group", day AS relative_day, outcome, event_id, x FROM (UNPIVOT (
    SELECT event_id, day, "group", CASE WHEN ok THEN i END AS initiator_car, CASE WHEN ok THEN q END AS peer_car, CASE WHEN ok THEN sgn * q END AS peer_catchup,
      CASE WHEN ok THEN -sgn * i END AS initiator_reversal, CASE WHEN ok THEN sgn * (q - i) END AS convergence
    FROM (SELECT p.*, {GROUP_NAME} AS "group", min(CASE WHEN own IS NOT NULL AND peer IS NOT NULL THEN 1 ELSE 0 END) OVER w = 1 AS ok, sum(own) OVER w AS i, sum(peer) OVER w AS q
      FROM ct_epanel p JOIN (SELECT event_id, subsector FROM ct_events) USING (event_id) WHERE day > 0 WINDOW w AS (PARTITION BY event_id ORDER BY day)))
    ON initiator_car, peer_car, peer_catchup, initiator_reversal, convergence INTO NAME outcome VALUE x)""",
    '"group", relative_day, outcome', ["sample_size", "mean", "ci_lower", "ci_upper", "sample_label"], adequate="adequate_analysis_sample"))
def _(ws):
    return me.group_event_path(ws.event_panel, ws.mechanism).where("sample_size > 0")


COMMON = """
common AS MATERIALIZED (SELECT event_id, horizon FROM df_out WHERE valid GROUP BY 1, 2 HAVING count(DISTINCT k) = 3),
cl AS MATERIALIZED (SELECT l.* FROM ({long}) l JOIN common USING (event_id, horizon))"""


@query("common_sample", f"WITH {rn.DEFINITION_RUN} SELECT event_id, horizon, count(*) AS definitions FROM df_out WHERE valid GROUP BY 1, 2 HAVING count(DISTINCT k) = 3")
def _(ws):
    return me.common_sample(ws.definition_outcomes).groupBy("event_id", "horizon").agg(F.count("*").alias("definitions"))


def paired_values() -> str:
    return f"""SELECT a.event_id, a.horizon, a.outcome, a.x - b.x AS x FROM cl a JOIN cl b ON b.event_id = a.event_id AND b.horizon = a.horizon AND b.outcome = a.outcome
  WHERE a.k = 'economic_subsector_peers' AND b.k = 'trailing_return_similarity_peers'"""


def paired_boot(replications: int, seed: int) -> str:
    return f"""
pv AS MATERIALIZED ({paired_values()}),
pu AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY horizon, outcome ORDER BY sha256(event_id)) - 1 AS i, count(*) OVER (PARTITION BY horizon, outcome) AS total FROM pv),
pd AS (SELECT u.horizon, u.outcome, b.it, ('0x' || substr(sha256(concat_ws('|', '{seed}', u.horizon, u.outcome, b.it, u.i)), 1, 15))::BIGINT % u.total AS pick
  FROM pu u CROSS JOIN (SELECT unnest(range(0, {replications})) AS it) b),
pm AS (SELECT d.horizon, d.outcome, d.it, avg(u.x) AS statistic FROM pd d JOIN pu u ON u.horizon = d.horizon AND u.outcome = d.outcome AND u.i = d.pick GROUP BY ALL),
pb AS MATERIALIZED (SELECT horizon, outcome, quantile_cont(statistic, 0.025) AS lo, quantile_cont(statistic, 0.975) AS hi FROM pm GROUP BY 1, 2)"""


# The difference needs both of its definitions only: the broad portfolio of a large panel is hardly ever complete.
PAIRED = ("economic_subsector_peers", "trailing_return_similarity_peers")
PAIRED_COMMON = f"""
common AS MATERIALIZED (SELECT event_id, horizon FROM df_out WHERE valid AND k IN {PAIRED} GROUP BY 1, 2 HAVING count(DISTINCT k) = 2),
cl AS MATERIALIZED (SELECT l.* FROM ({{long}}) l JOIN common USING (event_id, horizon))"""


@query("paired_difference", f"""
WITH {rn.DEFINITION_RUN}, {PAIRED_COMMON.format(long=rn.long_k('df'))}, {paired_boot(500, 13)}
SELECT horizon, outcome, count(*) AS event_count, count(*) AS sample_size, {r('avg(x)')} AS mean, {r('median(x)')} AS median,
  {LABEL.format(n='count(*)', adequate='adequate_analysis_sample')} AS sample_label, {r('CASE WHEN count(*) > 1 THEN any_value(lo) END')} AS ci_lower,
  {r('CASE WHEN count(*) > 1 THEN any_value(hi) END')} AS ci_upper, 500 AS bootstrap_replications
FROM pv JOIN pb USING (horizon, outcome) GROUP BY 1, 2""")
def _(ws):
    return me.paired_difference(me.common_sample(ws.definition_outcomes, PAIRED), 500)


@query("peer_definition_comparison", summary(
    "SELECT k AS peer_definition, horizon, outcome, event_id, x FROM cl WHERE horizon IN (1, 5, 10)", "peer_definition, horizon, outcome", SHORT_COLS,
    adequate="adequate_analysis_sample", head=f"{rn.DEFINITION_RUN}, {COMMON.format(long=rn.long_k('df'))}, ",
    extra=", 'peer_definition_level' AS comparison_type"))
def _(ws):
    table = me.peer_definition_comparison(ws.definition_outcomes, 200)
    return table.where("comparison_type = 'peer_definition_level'").drop("bootstrap_replications")


REGIME_ROWS = """
  SELECT horizon, momentum_window, CASE WHEN m <= 0 THEN 'weak_nonpositive' ELSE 'strong_positive' END AS regime, event_id, x FROM (
    SELECT o.event_id, horizon, 'SectorMomentum_1m' AS momentum_window, mom1 AS m, convergence AS x FROM ct_outcomes o JOIN ct_mech USING (event_id) WHERE valid AND horizon IN (1, 5, 10)
    UNION ALL SELECT o.event_id, horizon, 'SectorMomentum_3m', mom3, convergence FROM ct_outcomes o JOIN ct_mech USING (event_id) WHERE valid AND horizon IN (1, 5, 10))
  WHERE m IS NOT NULL"""
REGIME_X = [("SectorMomentum_1m", "mom1"), ("SectorMomentum_3m", "mom3")]
REGIME_MODEL = ols_ctes("reg", " UNION ALL ".join(
    f"""SELECT horizon, '{w}' AS momentum_window, convergence AS y, {c} AS momentum, vol AS SectorVolatility, shock AS ShockMagnitude, equipment AS EquipmentIndicator,
      up AS EventDirection, measure AS VolumeMeasure FROM ct_outcomes JOIN ct_mech USING (event_id) WHERE valid AND horizon IN (1, 5, 10)""" for w, c in REGIME_X),
    "horizon, momentum_window", ["momentum", "SectorVolatility", *me.CONTROLS])
REGIME_SQL = f"""
WITH {REGIME_MODEL}
SELECT horizon, momentum_window, 'continuous_regression' AS analysis_type, 'continuous' AS regime, CASE WHEN term = 'momentum' THEN momentum_window ELSE term END AS term,
  n AS sample_size, n AS event_count, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, {normal_interval()}, {r('r2', 6)} AS r_squared, 'estimated_confirmatory' AS status,
  {LABEL.format(n='n', adequate='adequate_analysis_sample')} AS sample_label
FROM reg_models JOIN reg_terms USING (horizon, momentum_window) WHERE term IN ('momentum', 'SectorVolatility')
UNION ALL BY NAME (SELECT horizon, momentum_window, 'sign_based_regime_comparison' AS analysis_type, regime, 'convergence' AS term, sample_size, sample_size AS event_count,
    {', '.join(f"{r(c, 6)} AS {c}" for c in ('mean', 'median', 'ci_lower', 'ci_upper'))}, 'descriptive_regime_comparison' AS status, sample_label
  FROM ({summary(REGIME_ROWS, "horizon, momentum_window, regime", ["sample_size", "mean", "median", "ci_lower", "ci_upper", "sample_label"],
                 adequate="adequate_analysis_sample").replace('WITH ', 'WITH RECURSIVE ', 1)}))
UNION ALL BY NAME SELECT 'data_availability' AS analysis_type, 'not_applicable' AS momentum_window, 'not_applicable' AS regime, 'MarketVolatility' AS term, 0 AS sample_size,
  0 AS event_count, 'small_sample_descriptive_only' AS sample_label, 'unavailable_frozen_baseline_has_no_market_return_series' AS status"""


@query("regime_analysis", REGIME_SQL, digits=6)
def _(ws):
    return me.regime_analysis(ws.outcomes, ws.mechanism)


@query("regime_sign_split", summary(REGIME_ROWS, "horizon, momentum_window, regime", ["sample_size", "mean", "median", "ci_lower", "ci_upper"]))
def _(ws):
    out = me.regime_analysis(ws.outcomes, ws.mechanism).where("analysis_type = 'sign_based_regime_comparison'")
    return out.select("horizon", "momentum_window", "regime", "sample_size", "mean", "median", "ci_lower", "ci_upper")


# --- L. Placebos and resampling --------------------------------------------------------------------------


@query("random_peer_membership", f"SELECT k AS iteration, event_id, date, security_id, peer_id, 'economic_subsector_peers' AS peer_definition, {r('weight')} AS weight FROM ct_random_edges")
def _(ws):
    return ws.random_edges.withColumn("iteration", F.col("iteration").cast("bigint"))


# Rules run on deliberately damaged placebos, so that each kind of violation is counted.
DAMAGED_EDGES = """
bad AS (SELECT k, event_id, date, security_id, CASE WHEN k = 5 THEN security_id ELSE peer_id END AS peer_id, CASE WHEN k = 3 THEN 2 * weight ELSE weight END AS weight
  FROM ct_random_edges),
held AS (SELECT k, event_id, sum(weight) AS w, count(*) AS n, count(DISTINCT peer_id) AS d, max(weight) AS w1 FROM bad GROUP BY 1, 2),
sizes AS (SELECT e.event_id, count(*) AS n, 1.0 / count(*) AS was FROM ct_events e JOIN ct_pairs x ON x.date = e.date AND x.security_id = e.security_id GROUP BY 1)"""


@query("random_peer_rules", f"""
WITH {DAMAGED_EDGES}
SELECT 'random_peers' AS dataset, code, subject, violations FROM (
  SELECT 'self_peer' AS code, 'peer_id' AS subject, count(*) AS violations FROM bad WHERE security_id = peer_id
  UNION ALL SELECT 'invalid_weight_sum', 'weight', count(*) FROM held WHERE abs(w - 1) > 1e-10
  UNION ALL SELECT 'peer_count_changed', 'peer_id', count(*) FROM held WHERE d <> n
  UNION ALL SELECT 'weight_rule_changed', 'weight', count(*) FROM held JOIN sizes USING (event_id) WHERE abs(w1 - was) > 1e-12) WHERE violations > 0""")
def _(ws):
    damaged = ws.random_edges.withColumn("peer_id", F.when(F.col("iteration") == 5, F.col("security_id")).otherwise(F.col("peer_id")))
    damaged = damaged.withColumn("weight", F.when(F.col("iteration") == 3, 2 * F.col("weight")).otherwise(F.col("weight")))
    return rs.random_peer_rules(damaged, ws.event_sizes, ws.pool)


RUN_OUT = f"""event_id, horizon, {r('peer_car')} AS peer_car, {r('convergence')} AS convergence, valid AS valid_horizon, reason AS missing_reason"""
RUN_COLS = ("event_id", "horizon", "peer_car", "convergence", "valid_horizon", "missing_reason")


@query("random_peer_placebo", f"WITH {rn.RANDOM_RUN} SELECT k AS iteration, {RUN_OUT} FROM rp_out")
def _(ws):
    return ws.random_outcomes.select(F.col("iteration").cast("bigint").alias("iteration"), *RUN_COLS)


@query("matching_panel", """
SELECT date, security_id, eligible, subsector, volatility_regime, market_regime, liquidity_bucket, info AS matching_information_max_date FROM ct_strata""")
def _(ws):
    return ws.matching.drop("peer_group")


@query("pseudo_events", """
SELECT k AS iteration, source_event_id, event_id, date, security_id, direction FROM ct_pseudo""")
def _(ws):
    return ws.pseudo.select(F.col("iteration").cast("bigint").alias("iteration"), "source_event_id", "event_id", "date", "security_id", "direction")


@query("pseudo_event_rules", """
WITH bad AS (SELECT p.source_event_id, CASE WHEN p.k = 2 THEN e.date ELSE p.date END AS date, e.date AS real_date, p.security_id FROM ct_pseudo p JOIN ct_events e ON e.event_id = p.source_event_id)
SELECT 'pseudo_events' AS dataset, 'inside_exclusion_window' AS code, 'date' AS subject, count(*) AS violations FROM bad WHERE abs(date - real_date) <= 30""")
def _(ws):
    real = ws.events.select(F.col("event_id").alias("source_event_id"), F.col("date").alias("__d"))
    damaged = ws.pseudo.join(real, "source_event_id").withColumn("date", F.when(F.col("iteration") == 2, F.col("__d")).otherwise(F.col("date")))
    return rs.pseudo_event_rules(damaged, ws.events, ws.matching, RESAMPLING.match_columns, RESAMPLING.pseudo_event_exclusion_days)


@query("pseudo_event_placebo", f"WITH {rn.PSEUDO_RUN} SELECT k AS iteration, {RUN_OUT} FROM ps_out")
def _(ws):
    return ws.pseudo_outcomes.select(F.col("iteration").cast("bigint").alias("iteration"), *RUN_COLS)


@query("temporal_placebo", f"""
WITH rev AS (SELECT * REPLACE (-day AS day) FROM ct_epanel), hs AS (SELECT unnest([1, 3, 5, 10]) AS h),
w AS (SELECT event_id, h AS horizon, any_value(sgn) AS sgn, sum(own) AS own, sum(peer) AS peer, nullif(concat_ws(';',
    CASE WHEN count(*) <> h OR bool_or(calendar_date IS NULL) THEN 'end_of_sample' END, CASE WHEN bool_or(own IS NULL) THEN 'missing_initiator_observation' END,
    CASE WHEN NOT bool_and(has_peers) THEN 'missing_event_date_peer_membership' WHEN bool_or(peer IS NULL) THEN 'missing_peer_observation' END), '') AS reason
  FROM rev JOIN hs ON day BETWEEN 1 AND h GROUP BY event_id, h)
SELECT event_id, horizon, reason IS NULL AS valid_horizon, reason AS missing_reason, {r('CASE WHEN reason IS NULL THEN sgn * (peer - own) END')} AS convergence,
  'temporal_placebo' AS method FROM w""")
def _(ws):
    out = rs.temporal_placebo(ws.events, ws.event_panel, STUDY)
    return out.select("event_id", "horizon", "valid_horizon", "missing_reason", "convergence", "method")


@query("null_donor_dates", "SELECT CAST(k AS INTEGER) AS null_iteration, target_date, source_date, regime, coalesce(source_date > target_date, false) AS future_data_used FROM ct_donors")
def _(ws):
    return ws.donors


@query("null_resample", f"SELECT CAST(k AS INTEGER) AS null_iteration, date, security_id, {r('adj')} AS semiconductor_adjusted_return, source_date FROM ct_sim")
def _(ws):
    return ws.simulated


@query("null_detection_input", f"""
SELECT CAST(k AS INTEGER) AS null_iteration, date, security_id, peer_group, peer_count, {r('own')} AS stock_abnormal_return, {r('peer')} AS peer_abnormal_return,
  {r('rel')} AS relative_abnormal_return, CASE WHEN ext THEN 'unknown' ELSE 'none' END AS corporate_action_type FROM ct_sim_rel WHERE rel IS NOT NULL""")
def _(ws):
    return ws.null_input.select("null_iteration", "date", "security_id", "peer_group", "peer_count", "stock_abnormal_return", "peer_abnormal_return",
                                "relative_abnormal_return", "corporate_action_type")


NULL_DIST = f"""
nd AS MATERIALIZED (SELECT k, horizon, outcome, avg(x) AS statistic, count(x) AS n FROM ({rn.long_k('nl')}) GROUP BY ALL)"""


@query("selection_preserving_null", f"""
WITH {rn.NULL_RUN}, {NULL_DIST}
SELECT CAST(nd.k AS INTEGER) AS null_iteration, {CELL_SQL}, outcome, {r('statistic')} AS statistic, n AS sample_size, e.c AS detected_event_count
FROM nd JOIN (SELECT k, count(*) AS c FROM nl_events GROUP BY 1) e ON e.k = nd.k""")
def _(ws):
    return ws.null["distribution"]


@query("null_diagnostics", f"""
WITH {rn.NULL_RUN}
SELECT CAST(i.k AS INTEGER) AS null_iteration, coalesce(e.c, 0) AS detected_event_count, coalesce(o.c, 0) AS valid_outcome_count, false AS future_data_used
FROM (SELECT DISTINCT k FROM ct_donors) i LEFT JOIN (SELECT k, count(*) AS c FROM nl_events GROUP BY 1) e ON e.k = i.k
LEFT JOIN (SELECT k, count(*) FILTER (valid) AS c FROM nl_out GROUP BY 1) o ON o.k = i.k""")
def _(ws):
    return ws.null["diagnostics"].drop("detection_config_signature", "event_study_config_signature")


@query("empirical_p_value", f"""
WITH {rn.NULL_RUN}, {NULL_DIST},
ob AS (SELECT horizon, outcome, avg(x) AS o, count(x) AS n FROM ct_long WHERE valid GROUP BY 1, 2)
SELECT {CELL_SQL}, outcome, {r('any_value(o)')} AS observed_statistic, any_value(ob.n) AS observed_sample_size, {r('avg(statistic)')} AS null_mean,
  {r('stddev_samp(statistic)')} AS null_standard_deviation, count(statistic) AS null_iterations, {r('(1 + count(*) FILTER (statistic >= o)) / (count(statistic) + 1)')} AS empirical_p_value,
  {r('100 * (count(*) FILTER (statistic < o) + 0.5 * count(*) FILTER (statistic = o)) / count(statistic)')} AS percentile_location, 'greater' AS alternative
FROM ob LEFT JOIN nd USING (horizon, outcome) GROUP BY horizon, outcome""")
def _(ws):
    return rs.empirical_p_value(ws.outcomes, ws.null["distribution"])


def unit_draws(method: str, seed: int, iterations: int = 200, block: int = 5) -> str:
    """ub(it, i, unit): drawn units of the firm or date bootstrap."""
    if method == "firm":
        return f"""
un AS MATERIALIZED (SELECT security_id AS unit, row_number() OVER (ORDER BY sha256(security_id)) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT security_id FROM ct_outcomes WHERE valid)),
ud AS (SELECT b.it, ('0x' || substr(sha256(concat_ws('|', '{seed}', b.it, u.i)), 1, 15))::BIGINT % u.n AS pick FROM un u CROSS JOIN (SELECT unnest(range(0, {iterations})) AS it) b)"""
    return f"""
un AS MATERIALIZED (SELECT event_date AS unit, row_number() OVER (ORDER BY event_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT event_date FROM ct_outcomes WHERE valid)),
ud AS (SELECT b.it, (('0x' || substr(sha256(concat_ws('|', '{seed}', b.it, u.i // {block})), 1, 15))::BIGINT % u.n + u.i % {block}) % u.n AS pick
  FROM un u CROSS JOIN (SELECT unnest(range(0, {iterations})) AS it) b)"""


def dependence_sql(method: str, seed: int) -> str:
    column = "security_id" if method == "firm" else "event_date"
    return f"""
WITH {unit_draws(method, seed)},
us AS MATERIALIZED (SELECT {column} AS unit, horizon, outcome, sum(x) AS s, count(x) AS c FROM ct_long WHERE valid GROUP BY ALL)
SELECT CAST(ud.it AS INTEGER) AS bootstrap_iteration, {CELL_SQL}, outcome, {r('sum(s) / sum(c)')} AS statistic, CAST(sum(c) AS BIGINT) AS sample_size, '{method}' AS bootstrap_method
FROM ud JOIN un ON un.i = ud.pick JOIN us ON us.unit = un.unit GROUP BY ud.it, horizon, outcome"""


@query("dependence_bootstrap_firm", dependence_sql("firm", 1602))
def _(ws):
    return rs.dependence_bootstrap(ws.outcomes, "firm", 200, 1602)


@query("dependence_bootstrap_date", dependence_sql("date", 1603))
def _(ws):
    return rs.dependence_bootstrap(ws.outcomes, "date", 200, 1603)


EVENT_BOOT = f"""
eu AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY sha256(event_id)) - 1 AS i, count(*) OVER (PARTITION BY horizon) AS n FROM ct_outcomes WHERE valid),
ed AS (SELECT u.horizon, b.it, ('0x' || substr(sha256(concat_ws('|', 1601, u.horizon, 'semiconductor_adjusted_return', 'economic_subsector_peers', b.it, u.i)), 1, 15))::BIGINT % u.n AS pick
  FROM eu u CROSS JOIN (SELECT unnest(range(0, 200)) AS it) b),
eb AS MATERIALIZED (SELECT d.it, d.horizon, o.outcome, avg(CASE o.outcome WHEN 'convergence' THEN u.convergence WHEN 'peer_catchup' THEN u.peer_catchup ELSE u.initiator_reversal END) AS statistic, count(*) AS c
  FROM ed d JOIN eu u ON u.horizon = d.horizon AND u.i = d.pick CROSS JOIN (SELECT unnest(['convergence', 'peer_catchup', 'initiator_reversal']) AS outcome) o GROUP BY ALL)"""


@query("event_bootstrap", f"""
WITH {EVENT_BOOT} SELECT CAST(it AS INTEGER) AS bootstrap_iteration, {CELL_SQL}, outcome, {r('statistic')} AS statistic, c AS sample_size, 'event' AS bootstrap_method FROM eb""")
def _(ws):
    return rs.event_bootstrap(ws.outcomes, 200, 1601)


@query("bootstrap_summary", f"""
WITH {EVENT_BOOT}
SELECT 'event' AS bootstrap_method, {CELL_SQL}, outcome, {r('avg(statistic)')} AS estimate, count(*) AS bootstrap_iterations, CAST(avg(c) AS DOUBLE) AS sample_size,
  {r('quantile_cont(statistic, 0.025)')} AS ci_lower, {r('quantile_cont(statistic, 0.975)')} AS ci_upper FROM eb GROUP BY horizon, outcome""")
def _(ws):
    return rs.bootstrap_summary(rs.event_bootstrap(ws.outcomes, 200, 1601))


def repeated_method(px: str, method: str, label: str) -> str:
    return f"""
SELECT '{method}' AS method, '{label}' AS method_label, c.horizon, c.outcome, c.m AS mean, i.lo, i.hi, i.n AS sample_size, i.its
FROM (SELECT horizon, outcome, avg(x) AS m FROM ({rn.long_k(px)}) GROUP BY 1, 2) c JOIN (
  SELECT horizon, outcome, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi, CAST(round_even(avg(n), 0) AS BIGINT) AS n, count(*) AS its
  FROM (SELECT k, horizon, outcome, avg(x) AS s, count(x) AS n FROM ({rn.long_k(px)}) GROUP BY ALL) GROUP BY 1, 2) i USING (horizon, outcome)"""


@query("method_comparison", f"""
WITH {rn.RANDOM_RUN}, {rn.PSEUDO_RUN}, {rn.NULL_RUN}, {NULL_DIST}, {unit_draws('firm', 42)},
us AS MATERIALIZED (SELECT security_id AS unit, horizon, outcome, sum(x) AS s, count(x) AS c FROM ct_long WHERE valid GROUP BY ALL),
fb AS MATERIALIZED (SELECT ud.it, horizon, outcome, sum(s) / sum(c) AS statistic FROM ud JOIN un ON un.i = ud.pick JOIN us ON us.unit = un.unit GROUP BY ALL),
m AS ({repeated_method('rp', 'random_peers', 'Random peers')} UNION ALL {repeated_method('ps', 'pseudo_events', 'Pseudo-events')}
  UNION ALL SELECT 'observed', 'Observed', horizon, outcome, o.m, f.lo, f.hi, o.n, f.its FROM (SELECT horizon, outcome, avg(x) AS m, count(x) AS n FROM ct_long WHERE valid GROUP BY 1, 2) o
    JOIN (SELECT horizon, outcome, quantile_cont(statistic, 0.025) AS lo, quantile_cont(statistic, 0.975) AS hi, count(*) AS its FROM fb GROUP BY 1, 2) f USING (horizon, outcome)
  UNION ALL SELECT 'null_simulation', 'Null simulation', horizon, outcome, avg(statistic), quantile_cont(statistic, 0.025), quantile_cont(statistic, 0.975),
    CAST(round_even(avg(n), 0) AS BIGINT), count(*) FROM nd GROUP BY horizon, outcome)
SELECT method, method_label, {CELL_SQL}, outcome, {r('mean')} AS mean, {r('lo')} AS ci_lower, {r('hi')} AS ci_upper, sample_size, its AS experiment_iterations FROM m""")
def _(ws):
    return rs.method_comparison({"observed": ws.outcomes, "random_peers": ws.random_outcomes, "pseudo_events": ws.pseudo_outcomes},
                                ws.null["distribution"], RESAMPLING)


@query("detection_metadata", """
SELECT p.date, p.security_id, 'economic_subsector_peers' AS peer_definition, p.subsector, p.volume, p.extreme_return_flag, p.peer_group,
  CASE WHEN p.extreme_return_flag THEN 'unknown' ELSE 'none' END AS corporate_action_type, CAST(NULL AS DOUBLE) AS market_cap, false AS earnings_flag, false AS news_identified_flag
FROM ct_panel p JOIN ct_relative x USING (date, security_id)""")
def _(ws):
    return rs.detection_metadata(ws.relative, ws.panel)


SUMMARY_METRICS = ("mean", "ci_lower", "ci_upper", "sample_size", "event_count", "status")
SUMMARY_SQL = "SELECT variation_type, specification, horizon, notes, " + ", ".join(
    f"max({m}) FILTER (outcome = '{o}') AS {o}_{m}" for o in OUTCOMES for m in SUMMARY_METRICS) + " FROM ({rows}) GROUP BY ALL"
SWEEPS_SQL = " UNION ALL BY NAME ".join(f"({q.replace('WITH ', 'WITH RECURSIVE ', 1)})" for q in (THRESHOLD_SQL, RETURN_SQL, UNIVERSE_SQL))


@query("specification_summary", SUMMARY_SQL.replace("{rows}", SWEEPS_SQL))
def _(ws):
    return specification_summary(union_all([threshold_rows(ws), return_rows(ws), universe_rows(ws)]))


def specification_summary(rows):
    """Long specification rows to one wide row per specification and horizon."""
    keys = ["variation_type", "specification", "horizon", "notes"]
    return rows.where(F.col("outcome").isin(*OUTCOMES)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("outcome") == o, F.col(m))).alias(f"{o}_{m}") for o in OUTCOMES for m in SUMMARY_METRICS])


PERIOD_SQL = "CASE " + " ".join(f"WHEN year(event_date) BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in PERIODS) + " ELSE 'outside_frozen_sample' END"


@query("time_period_stability", summary(f"""SELECT {PERIOD_SQL} AS "group", horizon, outcome, event_id, x FROM ct_long WHERE valid""", '"group", horizon, outcome',
                                        ["event_count", "sample_size", "mean", "ci_lower", "ci_upper"], extra=", 'time_period' AS analysis"))
def _(ws):
    return rs.time_period_stability(ws.outcomes, PERIODS)


@query("contribution_analysis", f"""
WITH f AS (SELECT o.*, m.ticker FROM ct_outcomes o JOIN ct_master m USING (security_id) WHERE valid AND horizon = 5),
g AS (SELECT 'initiator_contribution' AS analysis, ticker AS name, peer_catchup AS x FROM f UNION ALL SELECT 'peer_group_contribution', subsector, peer_catchup FROM f)
SELECT analysis, name AS "group", 5 AS horizon, 'peer_catchup' AS outcome, count(*) AS event_count, count(x) AS sample_size, {r('avg(x)')} AS mean,
  {r('sum(x) / (SELECT count(*) FROM f)')} AS contribution_to_full_sample_mean, {r('count(x) / (SELECT count(*) FROM f)')} AS event_share FROM g GROUP BY 1, 2""")
def _(ws):
    return rs.contribution_analysis(ws.outcomes, ws.master)


@query("event_dependence", f"""
WITH f AS (SELECT * FROM ct_outcomes WHERE valid AND horizon = 5), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM f),
a AS (SELECT security_id, count(*) AS c FROM f GROUP BY 1), b AS (SELECT event_date, count(*) AS c FROM f GROUP BY 1), w AS (
SELECT 'valid_five_day_events' AS metric, n AS value FROM n UNION ALL SELECT 'unique_initiators', count(*) FROM a UNION ALL SELECT 'unique_event_dates', count(*) FROM b
UNION ALL SELECT 'overlapping_window_share', avg(CASE WHEN overlapped THEN 1.0 ELSE 0.0 END) FROM f
UNION ALL SELECT 'same_day_event_share', sum(CASE WHEN c > 1 THEN c ELSE 0 END) / (SELECT n FROM n) FROM b
UNION ALL SELECT 'repeated_initiator_share', sum(CASE WHEN c > 1 THEN c ELSE 0 END) / (SELECT n FROM n) FROM a
UNION ALL SELECT 'largest_initiator_share', max(c) / (SELECT n FROM n) FROM a UNION ALL SELECT 'largest_date_share', max(c) / (SELECT n FROM n) FROM b
UNION ALL SELECT 'herfindahl_effective_firms', (SELECT n * n FROM n) / sum(c * c) FROM a UNION ALL SELECT 'herfindahl_effective_dates', (SELECT n * n FROM n) / sum(c * c) FROM b)
SELECT metric, {r('value')} AS value FROM w""")
def _(ws):
    return rs.event_dependence(ws.outcomes)
