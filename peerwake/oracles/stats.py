"""SQL text for Student-t areas, quantiles and grouped summaries."""

from __future__ import annotations

from .base import r


def two_sided_area(t: str, df: str) -> str:
    """P(|T| <= t) for integer degrees of freedom, by the finite trigonometric series."""
    th = f"atan(abs({t}) / sqrt({df}))"
    odd = (f"2 / pi() * ({th} + sin({th}) * coalesce(list_sum([exp(2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2))"
           f" * pow(cos({th}), 2 * j + 1) for j in range(0, CAST(({df} - 1) // 2 AS BIGINT))]), 0))")
    even = (f"sin({th}) * coalesce(list_sum([exp(lgamma(2 * j + 1) - 2 * j * ln(2) - 2 * lgamma(j + 1))"
            f" * pow(cos({th}), 2 * j) for j in range(0, CAST({df} // 2 AS BIGINT))]), 0)")
    return f"(CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END)"


def p_two_sided(t: str, df: str) -> str:
    return f"(1 - {two_sided_area(t, df)})"


def p_greater(t: str, df: str) -> str:
    return f"(CASE WHEN {t} >= 0 THEN (1 - {two_sided_area(t, df)}) / 2 ELSE (1 + {two_sided_area(t, df)}) / 2 END)"


def quantile_ctes(dfs: str, confidence: float = 0.95) -> str:
    """CTEs ending in tq(df, q): two-sided critical values by bisection."""
    mid = "((lo + hi) / 2)"
    return f"""
tq_df AS MATERIALIZED (SELECT DISTINCT CAST(df AS BIGINT) AS df FROM ({dfs}) WHERE df >= 1),
tq_step AS (
  SELECT df, CAST(0 AS DOUBLE) AS lo, CAST(64 AS DOUBLE) AS hi, 0 AS it FROM tq_df
  UNION ALL
  SELECT df, CASE WHEN a < {confidence} THEN mid ELSE lo END, CASE WHEN a < {confidence} THEN hi ELSE mid END, it + 1
  FROM (SELECT *, {mid} AS mid, {two_sided_area(mid, 'df')} AS a FROM tq_step WHERE it < 58)),
tq AS MATERIALIZED (SELECT df, (lo + hi) / 2 AS q FROM tq_step WHERE it = 58)"""


LABEL = "CASE WHEN {n} < 30 THEN 'small_sample_descriptive_only' ELSE '{adequate}' END"


def summary(values: str, keys: str, columns: list[str] | None = None, adequate: str = "adequate_descriptive_sample",
            where: str = "", extra: str = "", head: str = "") -> str:
    """Full statement: grouped mean summary with iid Student intervals over (keys, event_id, x)."""
    cols = columns or ["event_count", "sample_size", "mean", "median", "standard_deviation", "minimum", "maximum",
                       "proportion_positive", "ci_lower", "ci_upper", "confidence_level", "sample_label"]
    text = {
        "event_count": "event_count", "sample_size": "n AS sample_size", "mean": f"{r('m')} AS mean", "median": f"{r('med')} AS median",
        "standard_deviation": f"{r('sd')} AS standard_deviation", "minimum": f"{r('lo_x')} AS minimum", "maximum": f"{r('hi_x')} AS maximum",
        "proportion_positive": f"{r('pos')} AS proportion_positive", "ci_lower": f"{r('m - q * sd / sqrt(n)')} AS ci_lower",
        "ci_upper": f"{r('m + q * sd / sqrt(n)')} AS ci_upper", "confidence_level": "CAST(0.95 AS DOUBLE) AS confidence_level",
        "sample_label": LABEL.format(n="n", adequate=adequate) + " AS sample_label"}
    return f"""
WITH {head}vals AS MATERIALIZED ({values}),
cells AS MATERIALIZED (
  SELECT {keys}, count(DISTINCT event_id) AS event_count, count(x) AS n, avg(x) AS m, median(x) AS med, stddev_samp(x) AS sd,
         min(x) AS lo_x, max(x) AS hi_x, avg(CASE WHEN x > 0 THEN 1.0 WHEN x <= 0 THEN 0.0 END) AS pos
  FROM vals GROUP BY {keys}),
{quantile_ctes('SELECT n - 1 AS df FROM cells')}
SELECT {keys}, {', '.join(text[c] for c in cols)}{extra}
FROM cells LEFT JOIN tq ON tq.df = cells.n - 1 {where}"""


def p_normal(z: str) -> str:
    """P(|N| >= |z|) by the series of the normal area; below rounding beyond 9."""
    area = (f"sqrt(2 / pi()) * exp(-pow({z}, 2) / 2) * list_sum([exp((2 * j + 1) * ln(nullif(abs({z}), 0)) + (j + 1) * ln(2)"
            " + lgamma(j + 2) - lgamma(2 * j + 3)) for j in range(0, 200)])")
    return f"(CASE WHEN abs({z}) > 9 THEN 0 WHEN {z} IS NOT NULL THEN 1 - coalesce({area}, 0) END)"


def ols_ctes(px: str, rows: str, keys: str, names: list[str]) -> str:
    """CTEs of one regression with HC3 errors per ``keys``, for rows(keys, y, names).

    The normal equations beside a unit matrix are eliminated column by column. Ends in {px}_models(keys, n, ok, r2, adj)
    and {px}_terms(keys, term, b, se); a model needs spare rows and a spread in every column.
    """
    k, terms = len(names) + 1, "['const', " + ", ".join(f"'{n}'" for n in names) + "]"
    steps, last = [], f"{px}_e0"
    for p in range(1, k + 1):
        steps.append(f"""
{px}_e{p} AS MATERIALIZED (SELECT {keys}, a.i, a.j, CASE WHEN a.i = {p} THEN r.v / d.v ELSE a.v - c.v * r.v / d.v END AS v
  FROM {last} a JOIN {last} r USING ({keys}) JOIN {last} c USING ({keys}) JOIN {last} d USING ({keys})
  WHERE r.i = {p} AND r.j = a.j AND c.i = a.i AND c.j = {p} AND d.i = {p} AND d.j = {p})""")
        last = f"{px}_e{p}"
    return f"""
{px}_all AS MATERIALIZED (SELECT row_number() OVER () AS rid, {keys}, y, [1.0::DOUBLE, {', '.join(f'{n}::DOUBLE' for n in names)}] AS x
  FROM ({rows}) WHERE y IS NOT NULL AND {' AND '.join(f'{n} IS NOT NULL' for n in names)}),
{px}_size AS MATERIALIZED (SELECT {keys}, count(*) AS n, avg(y) AS mean, count(*) > {k} AND {' AND '.join(f'min(x[{i}]) <> max(x[{i}])' for i in range(2, k + 1))} AS ok
  FROM {px}_all GROUP BY {keys}),
{px}_used AS MATERIALIZED (SELECT a.*, mean FROM {px}_all a JOIN {px}_size USING ({keys}) WHERE ok),
{px}_e0 AS MATERIALIZED (SELECT {keys}, i, j, sum(x[i] * x[j]) AS v FROM {px}_used, range(1, {k + 1}) s(i), range(1, {k + 1}) t(j) GROUP BY {keys}, i, j
  UNION ALL SELECT {keys}, i, {k} + j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END FROM {px}_size, range(1, {k + 1}) s(i), range(1, {k + 1}) t(j) WHERE ok),{','.join(steps)},
{px}_inverse AS MATERIALIZED (SELECT {keys}, i, list(v ORDER BY j) AS part FROM {last} WHERE j > {k} GROUP BY {keys}, i),
{px}_b AS MATERIALIZED (SELECT {keys}, i, sum(part[j] * m) AS b FROM {px}_inverse JOIN (
    SELECT {keys}, j, sum(x[j] * y) AS m FROM {px}_used, range(1, {k + 1}) t(j) GROUP BY {keys}, j) USING ({keys}) GROUP BY {keys}, i),
{px}_seen AS MATERIALIZED (SELECT {keys}, rid, any_value(y) AS y, any_value(mean) AS mean, any_value(y) - sum(b * x[i]) AS e, sum(list_inner_product(part, x) * x[i]) AS h
  FROM {px}_used JOIN {px}_inverse USING ({keys}) JOIN {px}_b USING ({keys}, i) GROUP BY {keys}, rid),
{px}_models AS MATERIALIZED (SELECT {keys}, n, ok, r2, 1 - (1 - r2) * (n - 1) / (n - {k}) AS adj FROM {px}_size LEFT JOIN (
    SELECT {keys}, 1 - sum(e * e) / nullif(sum(pow(y - mean, 2)), 0) AS r2 FROM {px}_seen GROUP BY {keys}) USING ({keys})),
{px}_terms AS MATERIALIZED (SELECT {keys}, {terms}[i] AS term, any_value(b) AS b, sqrt(sum(pow(list_inner_product(part, x) * e / (1 - h), 2))) AS se
  FROM {px}_used JOIN {px}_seen USING ({keys}, rid) JOIN {px}_inverse USING ({keys}) JOIN {px}_b USING ({keys}, i) GROUP BY {keys}, i)"""


def normal_interval(b: str = "b", se: str = "se", p: str = "", digits: int = 6) -> str:
    """coefficient, standard_error, ci_lower, ci_upper, and the p-value under the name ``p``."""
    columns = {"coefficient": b, "standard_error": se, "ci_lower": f"{b} - 1.959963984540054 * {se}", "ci_upper": f"{b} + 1.959963984540054 * {se}"}
    if p:
        columns[p] = p_normal(f"({b} / nullif({se}, 0))")
    return ", ".join(f"{r(v, digits)} AS {n}" for n, v in columns.items())
