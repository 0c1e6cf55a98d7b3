"""Data-quality audits: they report, and never repair or drop a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import CONTRACTS, contract_issues, issue_rows
from ..functions.exprs import joined_labels, union_all, weekdays_between
from .panel import simple_returns

TOLERANCE = 1e-8


def _counted(name: str, n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit(f"{name}="), n.cast("string")))


# --- Contract and rule checks -------------------------------------------------------


def unknown_references(df: DataFrame, columns: list[str], master: DataFrame, dataset: str) -> DataFrame:
    """Rows whose identifiers are absent from the master, counted per column."""
    known = master.select(F.col("security_id").alias("__id")).distinct()
    parts = []
    for c in columns:
        lost = df.where(F.col(c).isNotNull()).join(known, F.col(c) == F.col("__id"), "left_anti")
        parts.append(issue_rows(lost, {("invalid_security_reference", c): F.count("*")}, dataset))
    return union_all(parts)


def daily_panel_rules(panel: DataFrame) -> DataFrame:
    """Positive prices, non-negative volume, returns equal to simple returns, first return null."""
    prior = F.lag("adjusted_close").over(Window.partitionBy("security_id").orderBy("date"))
    rows = panel.withColumn("__first", prior.isNull()).withColumn("__want", F.try_divide("adjusted_close", prior) - 1)
    got, want = F.col("return"), F.col("__want")
    off = F.abs(got - want) > 1e-12 + 1e-10 * F.abs(want)
    wrong = F.when(F.col("__first"), got.isNotNull()).otherwise(got.isNull() | off)
    return issue_rows(rows, {
        ("non_positive_price", "adjusted_close"): F.count_if(F.col("adjusted_close") <= 0),
        ("non_positive_price", "close"): F.count_if(F.col("close") <= 0),
        ("negative_volume", "volume"): F.count_if(F.col("volume") < 0),
        ("invalid_return", "return"): F.count_if(wrong)}, "daily_panel")


def peer_membership_rules(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Leave-one-out, non-negative weights that sum to one, both endpoints eligible that date."""
    name = "peer_membership"
    rows = issue_rows(edges, {("self_peer", "peer_id"): F.count_if(F.col("security_id") == F.col("peer_id")),
                              ("negative_weight", "weight"): F.count_if(F.col("weight") < 0)}, name)
    sums = edges.groupBy("date", "security_id", "peer_definition").agg(F.sum("weight").alias("w"))
    totals = issue_rows(sums, {("invalid_weight_sum", "weight"): F.count_if(F.abs(F.col("w") - 1) > TOLERANCE)}, name)
    ends = edges.select("date", F.explode(F.array("security_id", "peer_id")).alias("security_id"))
    outside = ends.join(membership.where("eligible").select("date", "security_id"), ["date", "security_id"], "left_anti")
    return union_all([rows, totals, issue_rows(outside, {("ineligible_peer_endpoint", "security_id"): F.count("*")}, name)])


def _direction_rule():
    return F.count_if(~F.col("direction").isin("positive", "negative"))


def event_rules(events: DataFrame) -> DataFrame:
    return issue_rows(events, {
        ("invalid_direction", "direction"): _direction_rule(),
        ("negative_threshold", "threshold_used"): F.count_if((F.col("relative_volatility") < 0) | (F.col("threshold_used") < 0)),
        ("non_event", "relative_return"): F.count_if(F.abs("relative_return") <= F.col("threshold_used"))}, "events")


def event_panel_rules(panel: DataFrame) -> DataFrame:
    both = F.col("initiator_return").isNotNull() & F.col("peer_return").isNotNull()
    return issue_rows(panel, {
        ("invalid_direction", "direction"): _direction_rule(),
        ("invalid_observation_flag", "valid_observation"): F.count_if(F.col("valid_observation") != both)}, "event_panel")


def event_outcome_rules(outcomes: DataFrame) -> DataFrame:
    gap = F.abs(F.col("convergence") - F.col("peer_catchup") - F.col("initiator_reversal"))
    return issue_rows(outcomes, {
        ("invalid_direction", "direction"): _direction_rule(),
        ("invalid_missing_reason", "missing_reason"): F.count_if(F.col("valid_horizon") != F.col("missing_reason").isNull()),
        ("invalid_convergence", "convergence"): F.count_if(
            F.col("valid_horizon") & (gap.isNull() | (gap > 1e-12 + 1e-12 * F.abs("convergence"))))}, "event_outcomes")


def relative_return_rules(relative: DataFrame, master: DataFrame) -> DataFrame:
    return contract_issues(relative, CONTRACTS["relative_returns"]).unionByName(
        unknown_references(relative, ["security_id"], master, "relative_returns"))


def research_data_issues(master: DataFrame, membership: DataFrame, panel: DataFrame, edges: DataFrame) -> DataFrame:
    """All issues of the core datasets and of the references between them."""
    return union_all([
        contract_issues(master, CONTRACTS["security_master"]),
        contract_issues(membership, CONTRACTS["universe_membership"]),
        unknown_references(membership, ["security_id"], master, "universe_membership"),
        contract_issues(panel, CONTRACTS["daily_panel"]), unknown_references(panel, ["security_id"], master, "daily_panel"),
        daily_panel_rules(panel), contract_issues(edges, CONTRACTS["peer_membership"]),
        unknown_references(edges, ["security_id", "peer_id"], master, "peer_membership"),
        peer_membership_rules(edges, membership)])


def classification_rules(meta: DataFrame, subsectors: list[str], tiers: list[str], eligible: DataFrame | None = None,
                         master: DataFrame | None = None, peers: DataFrame | None = None) -> DataFrame:
    """Null or blank labels, duplicate tickers, unknown subsectors and tiers, coverage and consistency."""
    name = "semiconductor_classification"
    counters = {}
    for c in meta.columns:
        counters[("missing_classification", c)] = F.count_if(F.col(c).isNull() | (F.length(F.trim(F.col(c))) == 0))
    counters[("invalid_subsector", "subsector")] = F.count_if(~F.col("subsector").isin(subsectors))
    counters[("invalid_universe_tier", "universe_tier")] = F.count_if(~F.col("universe_tier").isin(tiers))
    twins = meta.groupBy(F.upper(F.trim("ticker")).alias("t")).agg(F.count("*").alias("n")).where("n > 1")
    parts = [issue_rows(meta, counters, name), issue_rows(twins, {("duplicate_security", "ticker"): F.sum("n")}, name)]
    if eligible is not None and master is not None:
        ids = master.join(meta.select(F.upper(F.trim("ticker")).alias("ticker")), "ticker", "left_semi").select("security_id")
        bare = eligible.where("eligible").select("security_id").distinct().join(ids, "security_id", "left_anti")
        parts.append(issue_rows(bare, {("missing_classification", "eligible securities"): F.count("*")}, name))
    if peers is not None and master is not None:
        both = master.select("security_id", "subsector").join(peers.select("security_id", F.col("subsector").alias("p")), "security_id")
        parts.append(issue_rows(both, {("inconsistent_subsector", "subsector"): F.count_if(F.col("subsector") != F.col("p"))},
                                "peer_classification"))
    return union_all(parts)


# --- Coverage and quality reports ---------------------------------------------------


def _date_gaps(prices: DataFrame) -> DataFrame:
    """Distinct observed dates per security with the calendar-day gap to the one before."""
    before = F.lag("date").over(Window.partitionBy("security_id").orderBy("date"))
    return prices.where("date IS NOT NULL").select("security_id", "date").distinct().withColumn("gap", F.datediff("date", before))


def data_audit(master: DataFrame, prices: DataFrame, large_gap_days: int = 7, extreme: float = 0.50) -> DataFrame:
    cells = ("open", "high", "low", "close", "adj_close")
    facts = prices.groupBy("security_id").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.avg("volume").alias("average_volume"), F.count_if(F.col("volume") == 0).alias("zero"),
        sum((F.count_if(F.col(c) <= 0) for c in cells[1:]), F.count_if(F.col(cells[0]) <= 0)).alias("low"),
        F.count_if(F.col("adj_close").isNull()).alias("missing_adj"))
    dup = (prices.groupBy("security_id", "date").agg(F.count("*").alias("c")).where("c > 1")
           .groupBy("security_id").agg(F.sum("c").alias("dup")))
    gaps = _date_gaps(prices).groupBy("security_id").agg(
        F.count_if(F.weekday("date") < 5).alias("weekdays"), F.count_if(F.col("gap") >= large_gap_days).alias("large"),
        F.max(F.when(F.col("gap") >= large_gap_days, F.col("gap"))).alias("largest"))
    first = F.row_number().over(Window.partitionBy("security_id").orderBy("date")) > 1
    ret = F.col("return")
    moves = simple_returns(prices).withColumn("later", first).groupBy("security_id").agg(
        F.count_if(ret <= -1).alias("impossible"), F.count_if(F.abs(ret) > extreme).alias("extreme"),
        F.count_if(F.col("later") & ret.isNull()).alias("gone"))
    rows = master.select("security_id", "ticker").join(facts, "security_id", "left")
    for part in (dup, gaps, moves):
        rows = rows.join(part, "security_id", "left")
    expected = weekdays_between(F.col("first_date"), F.col("last_date"))
    missing = F.greatest(expected - F.col("weekdays"), F.lit(0))
    empty = F.col("n").isNull()
    text = joined_labels([
        _counted("duplicate_dates", F.col("dup")), _counted("missing_weekdays_or_holidays", missing),
        F.when(F.col("large") > 0, F.concat(F.lit("large_gaps="), F.col("large").cast("string"), F.lit("(max_calendar_days="),
                                            F.col("largest").cast("string"), F.lit(")"))),
        _counted("zero_volume_days", F.col("zero")), _counted("non_positive_prices", F.col("low")),
        _counted("missing_adjusted_prices", F.col("missing_adj")), _counted("impossible_returns", F.col("impossible")),
        _counted("extreme_returns", F.col("extreme")), _counted("missing_returns_after_first", F.col("gone"))], "; ")
    return rows.select("security_id", "ticker", F.coalesce("n", F.lit(0)).alias("observation_count"), "first_date", "last_date",
                       F.when(empty, 100.0).when(expected > 0, 100.0 * missing / expected).otherwise(0.0).alias("missing_percentage"),
                       "average_volume", F.when(empty, F.lit("no_data")).otherwise(text).alias("issues"))


def mapping_audit(master: DataFrame, prices: DataFrame) -> DataFrame:
    """Approved identifiers against observed ones, in both directions."""
    clean = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    seen = prices.select(clean("security_id").alias("security_id"), clean("ticker").alias("seen"), "date")
    observed = seen.where("security_id <> ''").groupBy("security_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("seen") != "", F.col("seen")))).alias("tickers"),
        F.count_if(F.col("seen") == "").alias("untitled"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    owners = (seen.where("seen <> '' AND security_id <> ''").groupBy(F.col("seen").alias("ticker"))
              .agg((F.min("security_id") != F.max("security_id")).alias("shared")))
    base = master.select(*[clean(c).alias(c) for c in ("security_id", "ticker", "yahoo_symbol")])
    for c in base.columns:
        twins = base.where(f"{c} <> ''").groupBy(c).agg((F.count("*") > 1).alias(f"dup_{c}"))
        base = base.join(twins, c, "left")
    rows = base.join(observed, "security_id", "full_outer").join(owners, "ticker", "left")
    known = F.col("yahoo_symbol").isNotNull()
    blank = lambda c: F.when(F.col(c) == "", F.lit(f"missing_{c}"))
    several = F.size("tickers") > 1
    mismatch = ~several & (F.size("tickers") == 1) & (F.col("tickers")[0] != F.col("ticker"))
    issues = joined_labels([
        blank("security_id"), blank("ticker"), blank("yahoo_symbol"),
        *[F.when(F.coalesce(f"dup_{c}", F.lit(False)), F.lit(f"duplicate_{c}")) for c in ("security_id", "ticker", "yahoo_symbol")],
        _counted("downloaded_rows_missing_ticker", F.col("untitled")),
        F.when(several, F.concat(F.lit("multiple_downloaded_tickers="), F.array_join("tickers", "|"))),
        F.when(mismatch, F.concat(F.lit("downloaded_ticker_mismatch="), F.try_element_at("tickers", F.lit(1)))),
        F.when(F.coalesce("shared", F.lit(False)), F.lit("downloaded_ticker_maps_to_multiple_security_ids")),
        F.when(F.col("first_date").isNull() & F.col("tickers").isNull(), F.lit("no_downloaded_data"))], "; ")
    main = rows.select("security_id", F.when(known, F.col("ticker")).otherwise(F.array_join("tickers", "|")).alias("ticker"),
                       F.coalesce("yahoo_symbol", F.lit("")).alias("yahoo_symbol"), F.col("tickers").isNotNull().alias("data_found"),
                       "first_date", "last_date",
                       F.when(known, issues).otherwise(F.lit("downloaded_security_not_in_master")).alias("issues"))
    lost = seen.agg(F.count_if(F.col("security_id") == "").alias("n")).where("n > 0")
    anonymous = lost.select(F.lit("").alias("security_id"), F.lit("").alias("ticker"), F.lit("").alias("yahoo_symbol"),
                            F.lit(True).alias("data_found"), F.lit(None).cast("date").alias("first_date"),
                            F.lit(None).cast("date").alias("last_date"),
                            _counted("downloaded_rows_missing_security_id", F.col("n")).alias("issues"))
    return main.unionByName(anonymous)


def coverage_audit(master: DataFrame, prices: DataFrame, factor_model_min_history: int = 252,
                   short_history_observations: int = 252, recent_ipo_years: float = 2.0) -> DataFrame:
    facts = prices.where("date IS NOT NULL").groupBy("security_id").agg(
        F.count("*").alias("n"), F.min("date").alias("first_trading_date"), F.max("date").alias("last_trading_date"))
    end = prices.agg(F.max("date").alias("__end"))
    rows = master.select("security_id", "ticker").join(facts, "security_id", "left").crossJoin(F.broadcast(end))
    n = F.coalesce("n", F.lit(0))
    years = F.coalesce(F.datediff("last_trading_date", "first_trading_date") / 365.25, F.lit(0.0))
    recent = F.coalesce(F.datediff("__end", "first_trading_date") < recent_ipo_years * 365.25, F.lit(False))
    return rows.select(
        "security_id", "ticker", "first_trading_date", "last_trading_date", n.alias("number_of_observations"),
        F.round(years, 3).alias("years_covered"), (n < factor_model_min_history).alias("insufficient_history_for_factor_models"),
        (n < short_history_observations).alias("short_history_company"), recent.alias("recent_ipo"),
        joined_labels([F.when(n == 0, F.lit("no_data")),
                       F.when(n < factor_model_min_history, F.lit("insufficient_history_for_factor_models")),
                       F.when(n < short_history_observations, F.lit("short_history_company")),
                       F.when(recent, F.lit("recent_ipo_proxy"))], "; ").alias("issues"))


def exchange_sessions(master: DataFrame, prices: DataFrame) -> DataFrame:
    """Distinct session dates per exchange with their running number."""
    labelled = prices.select("security_id", "date").join(master.select("security_id", "exchange"), "security_id", "left")
    sessions = labelled.where("date IS NOT NULL").select("exchange", "date").distinct()
    return sessions.withColumn("session", F.row_number().over(Window.partitionBy("exchange").orderBy("date")))


def trading_calendar_audit(master: DataFrame, prices: DataFrame) -> DataFrame:
    """Each security against the sessions of its own exchange within its own span.

    Sessions are numbered per exchange, so the sessions inside a span are a difference of
    two numbers and no range join is needed.
    """
    own = _date_gaps(prices).groupBy("security_id").agg(
        F.min("date").alias("first_trading_date"), F.max("date").alias("last_trading_date"), F.count("*").alias("n"),
        F.max("gap").alias("gap"))
    sessions = exchange_sessions(master, prices)
    span = prices.agg(F.min("date").alias("__first"), F.max("date").alias("__last"))
    total = sessions.groupBy("exchange").agg(F.count("*").alias("__all"))
    edge = lambda col, name: sessions.select("exchange", F.col("date").alias(col), F.col("session").alias(name))
    rows = (master.select("security_id", "ticker", "exchange").join(own, "security_id", "left")
            .join(edge("first_trading_date", "__s0"), ["exchange", "first_trading_date"], "left")
            .join(edge("last_trading_date", "__s1"), ["exchange", "last_trading_date"], "left")
            .join(total, "exchange", "left").crossJoin(F.broadcast(span)))
    n = F.coalesce("n", F.lit(0))
    local = F.coalesce(F.col("__s1") - F.col("__s0") + 1, F.coalesce("__all", F.lit(0)))
    missing = local - n
    start = F.datediff("first_trading_date", "__first")
    end = F.datediff("__last", "last_trading_date")
    return rows.select(
        "security_id", "ticker", "exchange", "first_trading_date", "last_trading_date", n.alias("observed_sessions"),
        local.cast("bigint").alias("local_exchange_sessions_in_observed_period"), missing.cast("bigint").alias("missing_local_exchange_dates"),
        F.coalesce("gap", F.lit(0)).alias("max_calendar_gap_days"), start.alias("non_overlap_start_calendar_days"),
        end.alias("non_overlap_end_calendar_days"),
        joined_labels([_counted("missing_local_exchange_dates", missing.cast("bigint")),
                       _counted("non_overlap_start_calendar_days", start),
                       _counted("non_overlap_end_calendar_days", end)], "; ").alias("issues"))


def exchange_calendar_summary(master: DataFrame, prices: DataFrame) -> DataFrame:
    span = prices.agg(F.min("date").alias("__first"), F.max("date").alias("__last"))
    facts = exchange_sessions(master, prices).groupBy("exchange").agg(
        F.min("date").alias("first_observed_session"), F.max("date").alias("last_observed_session"),
        F.count("*").alias("observed_exchange_sessions"), F.count_if(F.weekday("date") < 5).alias("__weekdays"))
    listed = master.groupBy("exchange").agg(F.count("*").alias("number_of_securities"))
    absent = weekdays_between(F.col("first_observed_session"), F.col("last_observed_session")) - F.col("__weekdays")
    return (facts.join(listed, "exchange", "left").crossJoin(F.broadcast(span))
            .select("exchange", F.coalesce("number_of_securities", F.lit(0)).alias("number_of_securities"),
                    "first_observed_session", "last_observed_session", "observed_exchange_sessions",
                    absent.alias("weekdays_without_observed_exchange_session"),
                    F.datediff("first_observed_session", "__first").alias("non_overlap_start_calendar_days"),
                    F.datediff("__last", "last_observed_session").alias("non_overlap_end_calendar_days")))


def return_quality_report(master: DataFrame, prices: DataFrame, extreme: float = 0.50) -> DataFrame:
    ret, price, inf = F.col("return"), F.col("adj_close"), F.lit(float("inf"))
    rows = simple_returns(prices)
    big = F.abs(ret) > extreme
    facts = rows.groupBy("security_id").agg(
        F.count("*").alias("n"), F.count_if(ret.isNull()).alias("missing_returns"),
        F.count_if(big).alias("extreme_daily_returns"),
        F.count_if((ret <= -1) | (F.abs(ret) == inf)).alias("impossible_returns"),
        F.count_if(price.isNull()).alias("missing_adj_close"), F.count_if(F.abs(price) == inf).alias("non_finite_adj_close"),
        F.count_if(price <= 0).alias("non_positive_adj_close"), F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.max(F.abs(ret)).alias("max_abs_return"),
        F.array_join(F.array_sort(F.collect_list(F.when(big, F.date_format("date", "yyyy-MM-dd")))), "|").alias("extreme_return_dates"))
    dup = (prices.groupBy("security_id", "date").agg(F.count("*").alias("c")).where("c > 1")
           .groupBy("security_id").agg(F.sum("c").alias("duplicate_dates")))
    names = ("duplicate_dates", "extreme_daily_returns", "impossible_returns", "missing_adj_close", "non_finite_adj_close",
             "non_positive_adj_close", "negative_volume")
    joined = master.select("security_id", "ticker").join(facts, "security_id", "left").join(dup, "security_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    later = F.greatest(zero("missing_returns") - F.when(zero("n") > 0, 1).otherwise(0), F.lit(0))
    return joined.select(
        "security_id", "ticker", zero("n").alias("number_of_observations"), zero("missing_returns").alias("missing_returns"),
        later.cast("bigint").alias("missing_returns_after_first"), *[zero(c).alias(c) for c in names], "max_abs_return",
        F.coalesce("extreme_return_dates", F.lit("")).alias("extreme_return_dates"),
        joined_labels([*[_counted(c, zero(c)) for c in names], _counted("missing_returns_after_first", later)], "; ").alias("issues"))


def historical_coverage(master: DataFrame, prices: DataFrame, factor_model_min_history: int,
                        short_public_history_days: int, ticker_change_gap_days: int) -> DataFrame:
    facts = _date_gaps(prices).groupBy("security_id").agg(
        F.min("date").alias("first_available_trading_date"), F.max("date").alias("last_available_trading_date"),
        F.count("*").alias("n"), F.bool_or(F.col("gap") > ticker_change_gap_days).alias("jump"))
    n = F.coalesce("n", F.lit(0))
    span = weekdays_between(F.col("first_available_trading_date"), F.col("last_available_trading_date"))
    return master.select("security_id").join(facts, "security_id", "left").select(
        "security_id", "first_available_trading_date", "last_available_trading_date", n.alias("number_of_observations"),
        F.coalesce(F.greatest(span - n, F.lit(0)), F.lit(0)).alias("missing_days"),
        (n < factor_model_min_history).alias("insufficient_factor_model_history"),
        (n < short_public_history_days).alias("short_public_history"), F.coalesce("jump", F.lit(False)).alias("possible_ticker_change"))


def universe_diagnostics(master: DataFrame, membership: DataFrame, as_of: str | None = None) -> dict[str, DataFrame]:
    """Totals, eligibility by subsector and tier, and exclusion counts on one date."""
    day = (membership.agg(F.max("date").alias("date")) if as_of is None
           else membership.sparkSession.range(1).select(F.lit(as_of).cast("date").alias("date")))
    current = membership.join(F.broadcast(day), "date", "left_semi")
    labelled = (master.select("security_id", "subsector", "universe_tier")
                .join(current.where("eligible").select("security_id", F.lit(1).alias("on")), "security_id", "left"))
    count = lambda by: labelled.groupBy(by).agg(F.count("*").alias("classified"), F.count("on").alias("eligible"))
    overall = labelled.agg(F.count("*").alias("total_manually_classified"), F.count("on").alias("total_eligible")).crossJoin(day)
    share = F.when(F.col("total_manually_classified") > 0, 100.0 * F.col("total_eligible") / F.col("total_manually_classified")).otherwise(0.0)
    return {
        "overall": overall.select("date", "total_manually_classified", "total_eligible", share.alias("eligibility_percentage")),
        "by_subsector": count("subsector"), "by_universe_tier": count("universe_tier"),
        "exclusion_reasons": current.where("NOT eligible AND exclusion_reason IS NOT NULL")
        .select(F.explode(F.split("exclusion_reason", ";")).alias("reason")).groupBy("reason").agg(F.count("*").alias("count")),
    }


# --- Look-ahead and consistency assertions --------------------------------------------


def strictly_before(df: DataFrame, information: str, event: str, name: str) -> DataFrame:
    """One assertion row: no information date on or after its event date."""
    late = F.count_if(F.col(information) >= F.col(event))
    return df.agg(late.alias("violations")).select(F.lit(name).alias("check_name"), "violations", (F.col("violations") == 0).alias("passed"))


def baseline_checks(events: DataFrame, outcomes: DataFrame, portfolios: DataFrame, membership: DataFrame,
                    recomputed: DataFrame, start: str, end: str) -> DataFrame:
    """The baseline assertions; ``recomputed`` has an independent volatility per event."""
    def check(name, counted: DataFrame):
        return counted.select(F.lit(name).alias("check_name"), F.col("violations").cast("bigint").alias("violations"),
                              (F.col("violations") == 0).alias("passed"))

    valid = outcomes.where("valid_horizon")
    sign = F.when(F.col("direction") == "positive", 1.0).otherwise(-1.0)
    near = lambda a, b: F.abs(a - b) <= 1e-12 + 1e-12 * F.abs(b)
    outside = portfolios.join(membership.where("eligible").select("date", "security_id"), ["date", "security_id"], "left_anti")
    sample = ~F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return union_all([
        check("no_self_peers", portfolios.agg(F.count_if(F.col("portfolio_size") < 1).alias("violations"))),
        check("point_in_time_eligible_peer_endpoints", outside.agg(F.count("*").alias("violations"))),
        check("event_dates_within_frozen_sample", events.agg(F.count_if(sample).alias("violations"))),
        check("sign_normalization_valid", valid.agg(F.count_if(
            ~near(F.col("convergence"), sign * (F.col("peer_car") - F.col("initiator_car")))).alias("violations"))),
        check("convergence_identity_valid", valid.agg(F.count_if(
            ~near(F.col("convergence"), F.col("peer_catchup") + F.col("initiator_reversal"))).alias("violations"))),
        check("strictly_trailing_event_volatility", events.join(recomputed, ["date", "security_id", "peer_definition"], "left").agg(
            F.count_if(~F.coalesce(F.abs(F.col("relative_volatility") - F.col("independent_volatility")) <= 1e-10, F.lit(False)))
            .alias("violations")))])
