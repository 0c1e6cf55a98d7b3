"""Identity, returns, eligibility and panel assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checked import once_by, once_by_date
from ..functions.exprs import joined_labels, null_if_empty, trailing, when_label
from ..params import Universe


def security_id_from_ticker(ticker: Column) -> Column:
    runs = F.regexp_replace(F.upper(ticker), "[^A-Z0-9]+", "_")
    return F.concat(F.lit("SEC_"), F.regexp_replace(runs, "^_+|_+$", ""))


def build_security_master(classification: DataFrame) -> DataFrame:
    """Classification rows with internal ids and the fields later stages expect.

    Two rows of a ticker, and two tickers that give one id, stop the run that reads them.
    """
    market = F.col("exchange_or_market")
    kind = F.when(market.rlike(r"(?i)\bADR\b"), F.lit("adr")).otherwise(F.lit("common_stock"))
    master = once_by(classification, ["ticker"], "security master").select(
        security_id_from_ticker(F.col("ticker")).alias("security_id"), "ticker", "company_name",
        "exchange_or_market", "subsector", "semiconductor_role", "universe_tier", "review_flag",
        market.alias("exchange"), kind.alias("security_type"), F.lit("Semiconductor ecosystem").alias("sector"),
        F.col("subsector").alias("sub_industry"))
    return once_by(master, ["security_id"], "security master")


def classification_view(classification: DataFrame, master: DataFrame) -> DataFrame:
    """Labels by security; a ticker that either side holds twice stops the run."""
    labels = classification.select("ticker", "company_name", "subsector", F.col("notes").alias("classification_notes"))
    ids = once_by(master.select("security_id", "ticker"), ["ticker"], "classification view")
    return (ids.join(once_by(labels, ["ticker"], "classification view"), "ticker")
            .select("security_id", "ticker", "company_name", "subsector", "classification_notes"))


def production_peer_classification(view: DataFrame) -> DataFrame:
    """The reviewed subsector is the economic peer group."""
    return view.select("security_id", "subsector", F.col("subsector").alias("peer_group"),
                       F.lit("peer group equals the reviewed subsector").alias("classification_notes"))


def simple_returns(panel: DataFrame, price: str = "adj_close") -> DataFrame:
    """Change on the previous observed row of the security; gaps are not filled."""
    prior = F.lag(price).over(Window.partitionBy("security_id").orderBy("date"))
    return panel.withColumn("return", F.try_divide(F.col(price), prior) - 1)


def market_features(panel: DataFrame, window_days: int) -> DataFrame:
    """Running history length and trailing mean dollar volume over exactly ``window_days`` rows."""
    dollar = F.col("close") * F.col("volume")
    frame = trailing(["security_id"], "date", window_days, lag=0)
    mean = F.when(F.count(dollar).over(frame) == window_days, F.avg(dollar).over(frame))
    order = Window.partitionBy("security_id").orderBy("date")
    return panel.select("*", F.row_number().over(order).cast("bigint").alias("history_days"),
                        mean.alias("average_dollar_volume"))


def date_security_grid(panel: DataFrame, master: DataFrame) -> DataFrame:
    """Every panel date for every security.

    The dates ride along as one bounded array (the calendar), so the grid is an explode
    of the master and needs neither a cross join nor a shuffle of the product.
    """
    dates = panel.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("__dates"))
    return (master.select("security_id").crossJoin(F.broadcast(dates))
            .select(F.explode("__dates").alias("date"), "security_id"))


def exclusion_reasons(p: Universe, columns) -> list[Column]:
    """Ordered rule labels as conditional columns over an evaluated grid row."""
    date = F.col("date")
    classified = F.col("is_semiconductor")
    has_data = F.col("close").isNotNull()
    adv = F.col("average_dollar_volume")
    rules: list[tuple[str, Column]] = [("missing_semiconductor_classification", ~classified)]
    if p.eligibility_start_date:
        rules.append(("before_eligibility_start_date", date < F.lit(p.eligibility_start_date).cast("date")))
    if p.eligibility_end_date:
        rules.append(("after_eligibility_end_date", date > F.lit(p.eligibility_end_date).cast("date")))
    if "universe_tier" in columns:
        rules.append(("universe_tier_not_allowed", ~F.col("universe_tier").isin(*p.allowed_universe_tiers)))
    if p.allowed_exchange_or_markets and "exchange_or_market" in columns:
        rules.append(("listing_restriction", ~F.col("exchange_or_market").isin(*p.allowed_exchange_or_markets)))
    else:
        rules.append(("non_us_listing", ~F.col("exchange").isin(*p.us_exchanges)))
    rules.append(("ineligible_security_type", ~F.col("security_type").isin(*p.eligible_security_types)))
    if not p.allow_adrs:
        rules.append(("adr_not_allowed", F.col("security_type") == "adr"))
    if not p.allow_classification_before_as_of:
        rules.append(("classification_not_available_as_of_date",
                      classified & (date < F.lit(p.classification_snapshot_date).cast("date"))))
    rules += [
        ("missing_data;no_market_data", ~has_data),
        ("insufficient_history", has_data & (F.col("history_days") < p.min_history_days)),
        ("below_minimum_price", has_data & (F.col("close") < p.min_price)),
        ("insufficient_liquidity_history", has_data & adv.isNull()),
        ("insufficient_liquidity;below_minimum_liquidity", has_data & (adv < p.min_average_dollar_volume)),
    ]
    # A null market label is "not in the list"; market rules are guarded by has_data themselves.
    listed = {"universe_tier_not_allowed", "listing_restriction", "non_us_listing", "ineligible_security_type"}
    return [when_label(F.coalesce(condition, F.lit(label in listed)), label) for label, condition in rules]


def evaluated_grid(panel: DataFrame, master: DataFrame, classification: DataFrame, window_days: int) -> DataFrame:
    """Grid rows with master labels, the classified flag and market features."""
    fields = ["security_id", "exchange", "security_type"]
    fields += [c for c in ("exchange_or_market", "universe_tier") if c in master.columns]
    known = classification.select("security_id", F.lit(True).alias("is_semiconductor"))
    labels = (master.select(*fields).join(known, "security_id", "left")
              .withColumn("is_semiconductor", F.coalesce("is_semiconductor", F.lit(False))))
    dates = panel.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("__dates"))
    grid = labels.crossJoin(F.broadcast(dates)).withColumn("date", F.explode("__dates")).drop("__dates")
    features = market_features(panel.select("date", "security_id", "close", "volume"), window_days).drop("volume")
    return grid.join(features, ["security_id", "date"], "left")


def universe_membership(panel: DataFrame, master: DataFrame, classification: DataFrame, p: Universe) -> DataFrame:
    grid = evaluated_grid(panel, master, classification, p.average_dollar_volume_window_days)
    reason = null_if_empty(joined_labels(exclusion_reasons(p, grid.columns)))
    return (grid.select("date", "security_id", reason.alias("exclusion_reason"))
            .select("date", "security_id", F.col("exclusion_reason").isNull().alias("eligible"), "exclusion_reason"))


def historical_eligibility(panel: DataFrame, master: DataFrame, classification: DataFrame,
                           base: Universe, extension: Universe) -> DataFrame:
    """Baseline and extension verdicts in one projection over one grid."""
    if base.universe_version != extension.universe_version:
        raise ValueError("baseline and extension must share a universe version")
    if (base.eligibility_start_date, base.eligibility_end_date) != (
            extension.eligibility_start_date, extension.eligibility_end_date):
        raise ValueError("baseline and extension must share eligibility dates")
    if base.average_dollar_volume_window_days != extension.average_dollar_volume_window_days:
        raise ValueError("baseline and extension must share the liquidity window")
    grid = evaluated_grid(panel, master, classification, base.average_dollar_volume_window_days)
    reasons = [null_if_empty(joined_labels(exclusion_reasons(p, grid.columns))) for p in (base, extension)]
    out = grid.select("date", "security_id", F.lit(base.universe_version).alias("universe_version"),
                      reasons[0].alias("reason"), reasons[1].alias("extension_reason"))
    if base.eligibility_start_date:
        out = out.where(F.col("date") >= F.lit(base.eligibility_start_date).cast("date"))
    if base.eligibility_end_date:
        out = out.where(F.col("date") <= F.lit(base.eligibility_end_date).cast("date"))
    return out.select("date", "security_id", "universe_version", F.col("reason").isNull().alias("eligible"), "reason",
                      F.col("extension_reason").isNull().alias("extension_eligible"), "extension_reason")


def assemble_daily_panel(prices: DataFrame, master: DataFrame, base: Universe, extension: Universe,
                         extreme_return_threshold: float = 0.50) -> DataFrame:
    """Observed rows with labels, both eligibility flags and the extreme-return flag.

    Only observed rows are kept, so the verdicts are computed on the price rows
    themselves; the full grid is needed only for the membership dataset. A second price row of a (security, date)
    and a second label row of a security stop the run.
    """
    labels = master.select("security_id", "ticker", "subsector", "universe_tier", "exchange", "exchange_or_market",
                           "security_type").withColumn("is_semiconductor", F.lit(True))
    labels = once_by(labels, ["security_id", "ticker"], "security master")
    prices = once_by_date(prices, "security_id", "date", "daily prices")
    rows = market_features(simple_returns(prices), base.average_dollar_volume_window_days)
    rows = rows.join(labels, ["security_id", "ticker"], "left")
    inside = F.lit(True)
    if base.eligibility_start_date:
        inside = inside & (F.col("date") >= F.lit(base.eligibility_start_date).cast("date"))
    if base.eligibility_end_date:
        inside = inside & (F.col("date") <= F.lit(base.eligibility_end_date).cast("date"))
    verdicts = [inside & (F.length(joined_labels(exclusion_reasons(p, rows.columns))) == 0) for p in (base, extension)]
    mapped = F.when(F.col("universe_tier").isNotNull(), F.col("universe_tier")).otherwise(
        F.raise_error(F.concat(F.lit("no metadata for "), F.col("security_id"))).cast("string"))
    return rows.select(
        "date", "security_id", "ticker", "subsector", mapped.alias("universe_tier"),
        F.lit(base.universe_version).alias("universe_version"), "adj_close", "return", "volume",
        verdicts[0].alias("eligible"), verdicts[1].alias("extension_eligible"),
        F.coalesce(F.abs("return") > extreme_return_threshold, F.lit(False)).alias("extreme_return_flag"))


def publish_membership(membership: DataFrame) -> DataFrame:
    passed = F.when(F.col("eligible") & F.col("exclusion_reason").isNull(), F.lit("passes_core_requirements"))
    return membership.select("date", "security_id", "eligible",
                             F.coalesce(passed, F.col("exclusion_reason")).alias("reason"))
