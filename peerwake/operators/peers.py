"""Peer portfolios, factors and relative returns.

Equal-weight peers are never written out as pairs. A portfolio is the group's sum
and count less the security's own share, so the cost is linear in panel rows and a
group that holds a third of all securities is only a larger partial aggregate.
Explicit edges exist where the list is short by definition (top-k correlation
peers, random draws).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import trailing
from ..params import BROAD, CORRELATION, ECONOMIC, EVERYONE

# Peer definitions built from metadata: the column that names a security's group.
GROUPS = {ECONOMIC: lambda: F.col("peer_group"), BROAD: lambda: F.lit(EVERYONE)}


def memberships(panel: DataFrame, definitions=(ECONOMIC,), eligible: str = "eligible") -> DataFrame:
    """Eligible (date, security) rows with the group they belong to, per definition."""
    if not definitions or len(set(definitions)) != len(definitions):
        raise ValueError("peer definitions must be named once each")
    if CORRELATION in definitions:
        raise NotImplementedError("correlation peers are built per event date, see correlation_peers")
    unknown = [d for d in definitions if d not in GROUPS]
    if unknown:
        raise ValueError(f"unknown peer definitions: {unknown}")
    choices = F.array(*[F.struct(F.lit(d).alias("peer_definition"), GROUPS[d]().alias("peer_group")) for d in definitions])
    return (panel.where(F.col(eligible)).withColumn("__m", F.explode(choices))
            .drop("peer_group").select("*", "__m.*").drop("__m"))


def peer_portfolios(panel: DataFrame, definitions=(ECONOMIC,), eligible: str = "eligible") -> DataFrame:
    """One row per directed portfolio: its size and the weight of each peer.

    The peers of a row are all other rows with the same date, definition and group.
    """
    rows = memberships(panel, definitions, eligible).select("date", "security_id", "peer_definition", "peer_group")
    sizes = rows.groupBy("date", "peer_definition", "peer_group").agg(F.count("*").alias("members"))
    return (rows.join(sizes, ["date", "peer_definition", "peer_group"]).where("members > 1")
            .select("date", "security_id", "peer_definition", "peer_group",
                    (F.col("members") - 1).alias("portfolio_size"), (1 / (F.col("members") - 1)).alias("weight")))


def expand_edges(portfolios: DataFrame, keys: DataFrame) -> DataFrame:
    """Explicit peer rows for chosen (date, security_id, peer_definition) keys.

    Output is portfolio size times keys; meant for a few looked-up portfolios.
    """
    on = ["date", "peer_definition", "peer_group"]
    chosen = portfolios.join(keys.select("date", "security_id", "peer_definition").distinct(),
                             ["date", "security_id", "peer_definition"], "left_semi")
    others = portfolios.select(*on, F.col("security_id").alias("peer_id"))
    return (chosen.join(others, on).where("security_id <> peer_id")
            .select("date", "security_id", "peer_id", "peer_definition", "weight"))


def peer_returns(panel: DataFrame, value: str = "return", definitions=(ECONOMIC,), eligible: str = "eligible",
                 keys: tuple[str, ...] = ()) -> DataFrame:
    """Leave-one-out mean over observed peers, with the number observed.

    Weights are renormalised over observed peers; nobody observed gives a null return;
    a security alone in its group has no row.
    """
    cells = [*keys, "date", "peer_definition", "peer_group"]
    rows = memberships(panel, definitions, eligible).select(*cells, "security_id", F.col(value).alias("__own"))
    totals = rows.groupBy(*cells).agg(F.sum("__own").alias("__s"), F.count("__own").alias("__n"),
                                      F.count("*").alias("__members"))
    seen = F.col("__own").isNotNull().cast("int")
    count = F.col("__n") - seen
    total = F.coalesce("__s", F.lit(0.0)) - F.coalesce("__own", F.lit(0.0))
    return (rows.join(totals, cells).where("__members > 1")
            .select(*cells, "security_id", F.col("__own").alias("own_return"),
                    F.when(count > 0, total / count).alias("peer_return"), count.alias("peer_count")))


def weighted_peer_returns(edges: DataFrame, returns: DataFrame, value: str = "return") -> DataFrame:
    """The same portfolio return for arbitrary weights on explicit edges."""
    observed = returns.select("date", F.col("security_id").alias("peer_id"), F.col(value).alias("__x"))
    seen = F.col("__x").isNotNull()
    return (edges.join(observed, ["date", "peer_id"], "left")
            .groupBy("date", "security_id", "peer_definition")
            .agg(F.sum(F.when(seen, F.col("weight") * F.col("__x"))).alias("__num"),
                 F.sum(F.when(seen, F.col("weight"))).alias("__den"), F.count("__x").alias("peer_count"))
            .select("date", "security_id", "peer_definition",
                    F.try_divide("__num", "__den").alias("peer_return"), "peer_count"))


def sector_factor(panel: DataFrame, eligible: str = "eligible", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean return of the eligible securities on each date."""
    return (panel.where(F.col(eligible)).groupBy(*keys, "date")
            .agg(F.avg("return").alias("semiconductor_return")))


def abnormal_returns(stock: DataFrame, factor: DataFrame, stock_column: str = "return",
                     factor_column: str = "semiconductor_return", output: str = "abnormal_return",
                     keys: tuple[str, ...] = ()) -> DataFrame:
    """Stock less the dated factor; a date without a factor gives null.

    The factor has one row per date, so its size is bounded by the calendar.
    """
    dated = factor.select(*keys, "date", F.col(factor_column).alias("factor_return"))
    joined = stock.join(F.broadcast(dated), [*keys, "date"], "left")
    return joined.withColumn(output, F.col(stock_column) - F.col("factor_return")).drop("factor_return")


def relative_abnormal_returns(panel: DataFrame, value: str, definitions=(ECONOMIC,), eligible: str = "eligible",
                              keys: tuple[str, ...] = ()) -> DataFrame:
    out = peer_returns(panel, value, definitions, eligible, keys)
    return out.select(*keys, "date", "security_id", "peer_definition", "peer_group", "peer_count",
                      F.col("own_return").alias("stock_abnormal_return"),
                      F.col("peer_return").alias("peer_abnormal_return"),
                      (F.col("own_return") - F.col("peer_return")).alias("relative_abnormal_return"))


def relative_returns(adjusted: DataFrame, market: DataFrame | None = None, definitions=(ECONOMIC,)) -> DataFrame:
    """Raw relative, market-adjusted and sector-adjusted returns in one table."""
    base = peer_returns(adjusted, "return", definitions)
    sector = adjusted.select("date", "security_id", "semiconductor_adjusted_return")
    out = base.join(sector, ["date", "security_id"], "left")
    if market is None:
        out = out.withColumn("market_adjusted_return", F.lit(None).cast("double"))
    else:
        out = abnormal_returns(out, market, "own_return", "market_return", "market_adjusted_return")
    return out.select("date", "security_id", "peer_definition", F.col("own_return").alias("stock_return"), "peer_return",
                      (F.col("own_return") - F.col("peer_return")).alias("relative_return"),
                      "market_adjusted_return", "semiconductor_adjusted_return")


def one_factor_residuals(rows: DataFrame, factor: str, value: str = "return", window: int = 60,
                         minimum: int | None = None) -> DataFrame:
    """Residual on a trailing one-factor line through the last complete rows before the date."""
    need = window if minimum is None else minimum
    if not 2 <= need <= window:
        raise ValueError("min_observations must lie between 2 and the window")
    complete = rows.where(F.col(value).isNotNull() & F.col(factor).isNotNull())
    past = trailing(["security_id"], "date", window)
    fitted = complete.select(
        "date", "security_id", F.col(value).alias("stock_return"), F.col(factor).alias("__f"),
        F.min("date").over(past).alias("estimation_start"), F.max("date").over(past).alias("estimation_end"),
        F.count("*").over(past).alias("observation_count"),
        F.regr_slope(value, factor).over(past).alias("beta_factor"),
        F.regr_intercept(value, factor).over(past).alias("intercept"))
    ready = F.col("observation_count") >= need
    fitted = fitted.select(
        "date", "security_id", "estimation_start", "estimation_end", "observation_count", "intercept", "beta_factor",
        F.when(ready, F.col("stock_return") - F.col("intercept") - F.col("beta_factor") * F.col("__f"))
        .alias("factor_residual_return")).where(ready)
    return rows.select("date", "security_id", F.col(value).alias("stock_return")).join(
        fitted, ["date", "security_id"], "left")


def multi_factor_residuals(rows: DataFrame, factors: list[str], value: str = "return", window: int = 60,
                           minimum: int | None = None) -> DataFrame:
    """As above for several factors.

    Windowed cross-moments come from Spark; the k-by-k systems of a batch are solved
    together in an Arrow map over rows (no grouping).
    """
    import numpy as np

    need = window if minimum is None else minimum
    k = len(factors) + 1
    if not factors or len(set(factors)) != len(factors) or not k <= need <= window:
        raise ValueError("need unique factors and regressors < min_observations <= window")
    terms = [F.lit(1.0), *[F.col(f) for f in factors]]
    past = trailing(["security_id"], "date", window)
    complete = rows.dropna(subset=[value, *factors])
    gram = F.array(*[F.sum(a * b).over(past) for a in terms for b in terms])
    moment = F.array(*[F.sum(a * F.col(value)).over(past) for a in terms])
    prepared = complete.select("date", "security_id", F.col(value).alias("stock_return"),
                               F.array(*terms).alias("x"), gram.alias("gram"), moment.alias("moment"),
                               F.min("date").over(past).alias("estimation_start"),
                               F.max("date").over(past).alias("estimation_end"),
                               F.count("*").over(past).alias("observation_count")).where(F.col("observation_count") >= need)
    names = ["intercept", *[f"beta_{f}" for f in factors]]

    def solve(batches):
        for pdf in batches:
            if len(pdf):
                g = np.stack(pdf["gram"].to_numpy()).reshape(-1, k, k)
                beta = np.einsum("nij,nj->ni", np.linalg.pinv(g, hermitian=True), np.stack(pdf["moment"].to_numpy()))
                fit = (beta * np.stack(pdf["x"].to_numpy())).sum(axis=1)
                for i, n in enumerate(names):
                    pdf[n] = beta[:, i]
                pdf["factor_residual_return"] = pdf["stock_return"] - fit
                yield pdf[cols]

    cols = ["date", "security_id", "estimation_start", "estimation_end", "observation_count", *names,
            "factor_residual_return"]
    schema = ("date date, security_id string, estimation_start date, estimation_end date, observation_count bigint, "
              + ", ".join(f"`{n}` double" for n in names) + ", factor_residual_return double")
    solved = prepared.mapInPandas(solve, schema)
    return rows.select("date", "security_id", F.col(value).alias("stock_return")).join(
        solved, ["date", "security_id"], "left")
