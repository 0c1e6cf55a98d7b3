"""Least squares as two aggregation passes.

Pass one sums the normal equations per model; one small system per model is solved in
an Arrow map over those sums. Pass two joins the solution back and sums squared scores
for robust standard errors. Rows are never gathered into one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import null_safe_on, sample_label, union_all, unpivot
from ..functions.student import normal_two_sided, t_critical, t_upper
from ..params import CELL, OUTCOMES
from .inference import CLUSTERS

Z975 = 1.959963984540054


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def fit(rows: DataFrame, keys: list[str], y: str, x: list[str], categories: dict[str, list[str]] | None = None,
        covariance: str = "hc3", clusters: tuple[str, ...] = (), intercept: str = "const", minimum_extra: int = 1,
        needs_variation: bool = True) -> tuple[DataFrame, DataFrame]:
    """(terms, models) of one regression per key.

    ``categories`` maps a text column to all its levels; each model drops the first level
    it observes. ``terms`` has coefficient and standard_error; ``models`` has sample size,
    fit, ranks and whether the model could be estimated.
    """
    categories = categories or {}
    names = [intercept, *x, *[f"C({c})[T.{v}]" for c, levels in categories.items() for v in levels]]
    owner = [""] * (1 + len(x)) + [c for c, levels in categories.items() for _ in levels]
    design = [F.lit(1.0), *[F.col(c).cast("double") for c in x],
              *[(F.col(c) == v).cast("double") for c, levels in categories.items() for v in levels]]
    k = len(names)
    used = rows.dropna(subset=[y, *x, *categories])
    used = used.withColumn("__y", F.col(y).cast("double")).withColumn("__x", F.array(*design))
    e = lambda i: F.col("__x")[i]
    sums = used.groupBy(*keys).agg(
        F.count("*").alias("sample_size"), F.avg("__y").alias("__ybar"),
        F.array(*[F.sum(e(i) * e(j)) for i in range(k) for j in range(i, k)]).alias("__gram"),
        F.array(*[F.sum(e(i) * F.col("__y")) for i in range(k)]).alias("__moment"),
        F.array(*[F.min(e(i)) != F.max(e(i)) for i in range(1 + len(x))]).alias("__varies"))
    numeric = len(x)
    iu = np.triu_indices(k)

    def solve(batches):
        for pdf in batches:
            out = []
            for n, gram, moment, varies in zip(pdf["sample_size"], pdf["__gram"], pdf["__moment"], pdf["__varies"]):
                full = np.zeros((k, k))
                full[iu] = np.asarray(gram, float)
                full = full + np.triu(full, 1).T
                keep, seen = list(range(1 + numeric)), set()
                for j in range(1 + numeric, k):
                    if full[j, j] > 0:
                        if owner[j] in seen:
                            keep.append(j)
                        seen.add(owner[j])
                ok = n > len(keep) - 1 + minimum_extra
                if needs_variation:
                    ok = ok and all(bool(v) for v in list(varies)[1:])
                beta, bread, rank = np.zeros(k), np.zeros((k, k)), 0
                if ok:
                    sub = full[np.ix_(keep, keep)]
                    # Scale to unit diagonal before inverting, for conditioning.
                    s = 1 / np.sqrt(np.where(np.diag(sub) > 0, np.diag(sub), 1.0))
                    scaled = sub * s[:, None] * s[None, :]
                    inverse = np.linalg.pinv(scaled, rcond=1e-12, hermitian=True) * s[:, None] * s[None, :]
                    rank = int(np.linalg.matrix_rank(scaled, tol=1e-10, hermitian=True))
                    bread[np.ix_(keep, keep)] = inverse
                    beta[keep] = inverse @ np.asarray(moment, float)[keep]
                out.append((bool(ok), beta.tolist(), [row.tolist() for row in bread], keep if ok else [], rank))
            extra = pd.DataFrame(out, columns=["estimated", "__beta", "__bread", "__keep", "rank"])
            yield pd.concat([pdf[[*keys, "sample_size", "__ybar"]].reset_index(drop=True), extra], axis=1)

    types = dict(sums.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "sample_size", "__ybar"])
    solved = sums.mapInPandas(solve, schema + ", estimated boolean, __beta array<double>, __bread array<array<double>>, "
                                              "__keep array<int>, rank int")
    scored = null_safe_on(used.select(*keys, *clusters, "__y", "__x"), solved.where("estimated"), keys, "inner")
    scored = scored.withColumn("__e", F.col("__y") - _dot(F.col("__x"), F.col("__beta")))
    scored = scored.withColumn("__px", F.transform("__bread", lambda row: _dot(row, F.col("__x"))))
    weight = F.col("__e")
    if covariance == "hc3":
        weight = F.try_divide(F.col("__e"), 1 - _dot(F.col("__px"), F.col("__x")))
    scored = scored.withColumn("__w", weight).withColumn("__u", F.transform("__px", lambda v: v * F.col("__w")))
    errors = scored.groupBy(*keys).agg(F.sum(F.col("__e") * F.col("__e")).alias("__ssr"),
                                       F.sum((F.col("__y") - F.col("__ybar")) ** 2).alias("__tss"))

    def squares(by: tuple[str, ...], tag: str) -> DataFrame:
        rows_ = scored
        if by:
            grouped = scored.groupBy(*keys, *by).agg(*[F.sum(F.col("__u")[i]).alias(f"__u{i}") for i in range(k)])
            rows_ = grouped.withColumn("__u", F.array(*[F.col(f"__u{i}") for i in range(k)]))
        return rows_.groupBy(*keys).agg(F.count("*").alias(f"g_{tag}"),
                                        F.array(*[F.sum(F.col("__u")[i] ** 2) for i in range(k)]).alias(f"v_{tag}"))

    def scaled(column: str, factor: Column) -> Column:
        return F.transform(column, lambda v: v * factor)

    model = null_safe_on(solved, errors, keys)
    n, p = F.col("sample_size"), F.size("__keep")
    if covariance == "cluster":
        parts = [((c,), c, 1) for c in clusters]
        if len(clusters) == 2:
            parts.append((clusters, "both", -1))
        variance = F.array_repeat(F.lit(0.0), k)
        for by, tag, sign in parts:
            model = null_safe_on(model, squares(by, tag), keys)
            g = F.col(f"g_{tag}")
            scale = sign * F.try_divide(g, g - 1) * F.try_divide(n - 1, n - p)
            variance = F.zip_with(variance, scaled(f"v_{tag}", scale), lambda a, b: a + b)
        model = model.withColumn("cluster_count", F.least(*[F.col(f"g_{c}") for c in clusters]) if len(clusters) > 1
                                 else F.col(f"g_{clusters[0]}"))
    else:
        model = null_safe_on(model, squares((), "all"), keys).withColumn("cluster_count", F.lit(None).cast("bigint"))
        scale = F.try_divide(n, n - F.col("rank")) if covariance == "hc1" else F.lit(1.0)
        variance = scaled("v_all", scale)
    model = model.withColumn("__var", variance)
    r2 = 1 - F.try_divide("__ssr", F.nullif("__tss", F.lit(0.0)))
    model = model.withColumn("r_squared", F.when(F.col("estimated"), r2)).withColumn(
        "adjusted_r_squared", F.when(F.col("estimated"), 1 - (1 - F.col("r_squared")) * F.try_divide(n - 1, n - F.col("rank"))))
    labels = F.array(*[F.lit(t) for t in names])
    picked = F.transform("__keep", lambda i: F.struct(
        F.element_at(labels, i + 1).alias("term"), F.element_at("__beta", i + 1).alias("coefficient"),
        F.sqrt(F.greatest(F.element_at("__var", i + 1), F.lit(0.0))).alias("standard_error")))
    terms = model.where("estimated").select(*keys, F.inline(picked))
    models = model.select(*keys, "sample_size", "estimated", "rank", "r_squared", "adjusted_r_squared", "cluster_count")
    return terms, models


def event_regressions(outcomes: DataFrame, characteristics: DataFrame, confidence: float = 0.95,
                      cluster_by: str | None = "firm") -> DataFrame:
    """Peer and initiator sums on event-time information, per cell; other columns never enter.

    Information dated after the event and negative volume or market value raise when read.
    """
    fields = ["event_id", "volume", "market_cap", "market_volatility_regime", "semiconductor_volatility_regime"]
    if "information_date" in characteristics.columns:
        fields.append("information_date")
    rows = outcomes.join(characteristics.select(*fields), "event_id", "left")
    guard = F.lit(True)
    if "information_date" in fields:
        guard = F.when(F.col("information_date") > F.col("event_date"),
                       F.raise_error(F.lit("characteristics hold information dated after the event")).cast("boolean")).otherwise(True)
    guard = F.when((F.col("volume") < 0) | (F.col("market_cap") < 0),
                   F.raise_error(F.lit("volume and market_cap must be non-negative")).cast("boolean")).otherwise(guard)
    rows = (rows.where(guard).withColumn("log1p_volume", F.log1p("volume")).withColumn("log1p_market_cap", F.log1p("market_cap"))
            .withColumn("simultaneous_event_flag", F.col("simultaneous_event_group").isNotNull().cast("double")))
    labels = ("direction", "subsector", "market_volatility_regime", "semiconductor_volatility_regime")
    # Label domains come from the taxonomy, not from the data volume.
    found = rows.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in labels]).first()
    categories = {c: list(found[c]) for c in labels}
    cars = unpivot(rows.where("valid_horizon").select(
        *CELL, "event_id", "security_id", "event_date", *labels, "initial_relative_shock", "log1p_volume", "log1p_market_cap",
        "simultaneous_event_flag", "peer_car", "initiator_car"),
        [*CELL, "event_id", "security_id", "event_date", *labels, "initial_relative_shock", "log1p_volume", "log1p_market_cap",
         "simultaneous_event_flag"], ("peer_car", "initiator_car"), "dependent_variable", "car")
    keys = [*CELL, "dependent_variable"]
    numeric = ["initial_relative_shock", "log1p_volume", "log1p_market_cap", "simultaneous_event_flag"]
    clusters = CLUSTERS[cluster_by] if cluster_by else ()
    terms, models = fit(cars, keys, "car", numeric, categories, "cluster" if cluster_by else "hc1", clusters,
                        intercept="Intercept", needs_variation=False)
    cells = outcomes.groupBy(*CELL).agg(F.count("*").alias("__all"))
    out = null_safe_on(null_safe_on(terms, models, keys, "inner"), cells, list(CELL))
    df = F.col("cluster_count") - 1 if cluster_by else F.col("sample_size") - F.col("rank")
    out = out.withColumn("degrees_of_freedom", df.cast("bigint"))
    t = F.try_divide("coefficient", F.nullif("standard_error", F.lit(0.0)))
    out = out.withColumn("__p", t_upper(F.abs(t), F.col("degrees_of_freedom"))).withColumn(
        "__q", t_critical(confidence, F.col("degrees_of_freedom")))
    return out.select(
        *keys, "term", "coefficient", "standard_error",
        (F.col("coefficient") - F.col("__q") * F.col("standard_error")).alias("ci_lower"),
        (F.col("coefficient") + F.col("__q") * F.col("standard_error")).alias("ci_upper"), (2 * F.col("__p")).alias("p_value"),
        "sample_size", (F.col("__all") - F.col("sample_size")).alias("dropped_observations"),
        F.lit(cluster_by or "none_hc1").alias("cluster_by"), "cluster_count", "degrees_of_freedom")


def with_normal_interval(df: DataFrame, p_value: str) -> DataFrame:
    b, se = F.col("coefficient"), F.col("standard_error")
    p = normal_two_sided(F.try_divide(b, F.nullif(se, F.lit(0.0))))
    return (df.withColumn("ci_lower", b - Z975 * se).withColumn("ci_upper", b + Z975 * se)
            .withColumn(p_value, F.when(~F.isnan(p), p)))


def univariate_hc3(rows: DataFrame, keys: list[str], y: str, x: str, minimum: int = 20) -> DataFrame:
    """Slope on a standardised predictor with its HC3 error, in closed form."""
    used = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    first = used.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("__mx"), F.stddev_samp(x).alias("__sx"),
                                    F.avg(y).alias("__my"), (F.min(x) != F.max(x)).alias("__varies"))
    ready = first.where((F.col("n") >= minimum) & F.col("__varies"))
    z = (F.col(x) - F.col("__mx")) / F.col("__sx")
    placed = null_safe_on(used, ready, keys, "inner").withColumn("__z", z)
    slope = placed.groupBy(*keys, "n", "__my").agg(F.sum(F.col("__z") * (F.col(y) - F.col("__my"))).alias("__zy"))
    slope = slope.withColumn("coefficient", F.col("__zy") / (F.col("n") - 1)).drop("__zy", "n", "__my")
    scored = null_safe_on(placed, slope, keys, "inner")
    m = F.col("n") - 1
    lever = 1 / F.col("n") + F.col("__z") * F.col("__z") / m
    resid = F.col(y) - F.col("__my") - F.col("coefficient") * F.col("__z")
    part = F.col("__z") / m * F.try_divide(resid, 1 - lever)
    return scored.groupBy(*keys, "coefficient").agg(F.sqrt(F.sum(part * part)).alias("standard_error"))
