import random

import pytest
from pyspark.sql import functions as F

from conftest import day
from peerwake.operators import diagnostics as dg
from peerwake.operators import mechanism as me
from peerwake.operators import resample as rs
from peerwake.operators import similarity as sm
from peerwake.operators.study import trading_calendar
from peerwake.params import ECONOMIC


def returns_of(spark, firms=4, days=35, seed=1):
    rng = random.Random(seed)
    rows = [(day(t), f"F{i}", rng.gauss(0, 0.02)) for t in range(days) for i in range(firms)]
    return spark.createDataFrame(rows, "date date, security_id string, x double")


def test_null_keeps_date_means_and_uses_no_future(spark):
    returns = returns_of(spark)
    regimes = returns.select("date").distinct().withColumn("regime", F.when(F.dayofmonth("date") % 2 == 0, F.lit("a")).otherwise(F.lit("b")))
    donors = rs.donor_dates(regimes, 5, 9)
    rows = donors.collect()
    assert len(rows) == 5 * 35 and not any(r.future_data_used for r in rows)
    assert all((r.source_date.day % 2) == (r.target_date.day % 2) for r in rows)
    sim = rs.null_returns(returns, donors, "x")
    assert sim.count() == 5 * 35 * 4
    gap = sim.groupBy("null_iteration", "date").agg(F.avg("x").alias("s")).join(returns.groupBy("date").agg(F.avg("x").alias("o")), "date")
    assert gap.agg(F.max(F.abs(F.col("s") - F.col("o")))).first()[0] < 1e-12
    assert donors.exceptAll(rs.donor_dates(regimes.repartition(3), 5, 9)).count() == 0


def test_null_keeps_dates_without_regime_and_refuses_unknown_ones(spark):
    returns = returns_of(spark, 3, 6)
    regimes = returns.select("date").distinct().withColumn("regime", F.when(F.dayofmonth("date") != 2, F.lit("a")))
    sim = rs.null_returns(returns, rs.donor_dates(regimes, 4, 1), "x")
    assert sim.count() == 4 * 6 * 3
    assert sim.where("x IS NULL").count() == sim.where("source_date IS NULL").count() == 4 * 3
    with pytest.raises(Exception, match="no row among the donors"):
        rs.null_returns(returns, rs.donor_dates(regimes.where("day(date) != 3"), 4, 1), "x").collect()


def test_random_peers_keep_their_promises(spark):
    pool = spark.createDataFrame([(day(t), f"F{i}") for t in range(3) for i in range(8)], "date date, security_id string")
    events = spark.createDataFrame([(f"e{i}", day(i % 3), f"F{i}", ECONOMIC) for i in range(6)],
                                   "event_id string, date date, security_id string, peer_definition string")
    sizes = events.select("event_id", F.lit(4).cast("bigint").alias("portfolio_size"), F.lit(0.25).alias("weight"))
    edges = rs.random_peer_edges(events, sizes, pool, 10, 3)
    assert edges.count() == 6 * 4 * 10 and rs.random_peer_rules(edges, sizes, pool).count() == 0
    whole = rs.random_peer_edges(events, sizes.withColumn("portfolio_size", F.lit(7).cast("bigint")), pool, 2, 3)
    assert whole.select("iteration", "event_id", "peer_id").distinct().count() == 6 * 7 * 2
    with pytest.raises(Exception, match="too few"):
        rs.random_peer_edges(events, sizes.withColumn("portfolio_size", F.lit(8).cast("bigint")), pool, 1, 3).collect()


def test_random_peers_of_one_date_are_independent_and_uniform(spark):
    pool = spark.createDataFrame([(day(0), f"F{i}") for i in range(9)], "date date, security_id string")
    events = spark.createDataFrame([("a", day(0), "F0", ECONOMIC), ("b", day(0), "F1", ECONOMIC), ("c", day(0), "outside", ECONOMIC)],
                                   "event_id string, date date, security_id string, peer_definition string")
    sizes = events.select("event_id", F.lit(2).cast("bigint").alias("portfolio_size"), F.lit(0.5).alias("weight"))
    rounds = 3000
    edges = rs.random_peer_edges(events, sizes, pool, rounds, 5)
    held = edges.groupBy("iteration", "event_id").agg(F.array_join(F.array_sort(F.collect_list("peer_id")), "").alias("pair"))
    for event, others in (("a", 8), ("b", 8), ("c", 9)):
        counts = [r["count"] for r in held.where(F.col("event_id") == event).groupBy("pair").count().collect()]
        cells = others * (others - 1) // 2
        expected = rounds / cells
        assert len(counts) == cells and sum((x - expected) ** 2 / expected for x in counts) < cells + 4 * (2 * cells) ** 0.5
    both = held.groupBy("iteration").pivot("event_id", ["a", "b"]).agg(F.first("pair"))
    same = both.where("a = b").count()  # 21 of 28 pairs of each are open to the other: one in 37
    assert 0.5 < same / (rounds * 21 / 28 / 28) < 1.5


def test_random_peers_permute_unequal_weights(spark):
    pool = spark.createDataFrame([(day(0), f"F{i}") for i in range(40)], "date date, security_id string")
    events = spark.createDataFrame([("a", day(0), "F0", ECONOMIC)], "event_id string, date date, security_id string, peer_definition string")
    sizes = spark.createDataFrame([("a", 3, None, [0.6, 0.3, 0.1])], "event_id string, portfolio_size long, weight double, weights array<double>")
    edges = rs.random_peer_edges(events, sizes, pool, 200, 5)
    assert rs.random_peer_rules(edges, sizes, pool).count() == 0
    assert edges.where("weight = 0.6").select("peer_id").distinct().count() > 30
    swapped = edges.withColumn("weight", F.when(F.col("weight") == 0.6, 0.5).when(F.col("weight") == 0.3, 0.4).otherwise(F.col("weight")))
    assert {(r.code, r.violations) for r in rs.random_peer_rules(swapped, sizes, pool).collect()} == {("weight_rule_changed", 200)}


def test_running_median_equals_the_window_over_all_earlier_rows(spark):
    rng = random.Random(4)
    rows = [(f"F{i}", day(t), None if rng.random() < 0.2 else rng.choice([rng.gauss(0, 1), 0.5])) for i in range(3) for t in range(60)]
    made = spark.createDataFrame([*rows, ("empty", day(0), None)], "security_id string, date date, v double").repartition(5)
    found = {(r.security_id, r.date): r.m for r in rs.with_running_median(made, "v", "m", 5).collect()}
    assert len(found) == 181 and found["empty", day(0)] is None
    for firm, date, _ in rows:
        earlier = sorted(v for f, d, v in rows if f == firm and d < date and v is not None)
        middle = (earlier[(len(earlier) - 1) // 2] + earlier[len(earlier) // 2]) / 2 if len(earlier) >= 5 else None
        assert found[firm, date] == pytest.approx(middle)


def test_pseudo_dates_match_and_keep_away(spark):
    rows = [(day(t), "F", t != 30, "s", "g", "high" if t % 2 else "normal", "up", "low") for t in range(60)]
    matching = spark.createDataFrame(rows, "date date, security_id string, eligible boolean, subsector string, peer_group string, volatility_regime string, market_regime string, liquidity_bucket string")
    events = spark.createDataFrame([("e1", day(10), "F", ECONOMIC), ("e2", day(20), "F", ECONOMIC)], "event_id string, date date, security_id string, peer_definition string")
    portfolios = matching.select("date", "security_id", F.lit(ECONOMIC).alias("peer_definition"))
    match = ("subsector", "volatility_regime", "market_regime", "liquidity_bucket")
    cands = rs.pseudo_event_candidates(events, matching, portfolios, match, 8)
    want = {day(t) for t in range(60) if t % 2 == 0 and abs(t - 10) > 8 and abs(t - 20) > 8 and t != 30}
    assert {r.date for r in cands.where("event_id = 'e1'").collect()} == want
    drawn = rs.pseudo_events(events, cands, match, 6)
    assert drawn.count() == 12 and rs.pseudo_event_rules(drawn, events, matching, match, 8).count() == 0
    none = rs.pseudo_event_candidates(events, matching, portfolios, match, 80)
    with pytest.raises(Exception, match="no matched"):
        rs.pseudo_events(events, none, match, 1).collect()


def test_correlation_peers_ignore_the_event_day(spark):
    rng = random.Random(11)
    rows = []
    for t in range(80):
        x = rng.gauss(0, 1)
        last = t == 79
        rows += [(day(t), "A", x), (day(t), "B", -x if last else x), (day(t), "C", x if last else -x)]
    returns = spark.createDataFrame(rows, "date date, security_id string, `return` double")
    events = spark.createDataFrame([("e", day(79), "A")], "event_id string, date date, security_id string")
    members = spark.createDataFrame([(day(79), s) for s in "ABC"], "date date, security_id string")
    calendar = trading_calendar(returns)
    inputs = sm.prepare(events, members, returns, calendar, ["date"], lookback=70)
    peers = sm.correlation_peers(*inputs, minimum=60, top=1).collect()
    assert [(p.peer_id, p.weight) for p in peers] == [("B", 1.0)] and peers[0].correlation == pytest.approx(1.0)
    audit = sm.correlation_audit(inputs[0], calendar, sm.correlation_peers(*inputs, minimum=60, top=1)).first()
    assert audit.no_future_information_check and audit.correlation_information_max_date == day(78)
    with pytest.raises(Exception, match="span"):
        a, b = sm.prepare(events, members, returns, calendar, ["date"], lookback=70, span=40)
        a.collect()


def test_trailing_percentile_skips_missing_values_without_losing_slots(spark):
    values = [1.0, None, 2.0, 3.0, None, 4.0, 2.5]
    panel = spark.createDataFrame([(day(i), "F", v) for i, v in enumerate(values)], "date date, security_id string, volume double")
    events = spark.createDataFrame([("e", day(6), "F"), ("n", day(4), "F")], "event_id string, date date, security_id string")
    got = {r.event_id: r for r in dg.trailing_percentile(panel, events, window=3, minimum=3).collect()}
    assert (got["e"].volume_percentile, got["e"].trailing_volume_median, got["e"].volume_history_count) == (pytest.approx(1 / 3), 3.0, 3)
    assert got["e"].volume_history_max_date == day(5)
    assert got["n"].volume_percentile is None and got["n"].trailing_volume_median == 2.0 and got["n"].volume_history_max_date == day(3)


def test_sector_state_is_lagged(spark):
    rows = [(day(i), 0.01) for i in range(30)]
    factor = lambda last: spark.createDataFrame(rows + [(day(30), last)], "date date, semiconductor_return double")
    a, b = (me.sector_state(factor(v)).where(F.col("date") == F.lit(day(30))).first() for v in (0.0, 9.0))
    assert a == b and a.SectorMomentum_1m == pytest.approx(1.01 ** 21 - 1) and a.sector_information_max_date == day(29)


def test_block_bootstrap_covers_runs_of_dates(spark):
    rows = [(f"e{i}", day(i), f"F{i % 3}", "positive", 1, "s", ECONOMIC, True, float(i), float(i), 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id string, event_date date, security_id string, direction string, horizon int, return_specification string, "
                                     "peer_definition string, valid_horizon boolean, convergence double, peer_catchup double, initiator_reversal double")
    for method in ("firm", "date"):
        got = rs.dependence_bootstrap(df, method, 30, 2, block=4).where("outcome = 'convergence'").collect()
        assert len(got) == 30 and len({round(r.statistic, 9) for r in got}) > 5
        if method == "date":
            assert {r.sample_size for r in got} == {10}
    assert rs.event_bootstrap(df, 20, 1).where("sample_size <> 10").count() == 0
    with pytest.raises(ValueError):
        rs.dependence_bootstrap(df, "week", 1)


def test_empirical_p_value_counts_ties_as_half(spark):
    rows = [("e", 1, "s", ECONOMIC, True, 0.5, 0.5, 0.0)]
    obs = spark.createDataFrame(rows, "event_id string, horizon int, return_specification string, peer_definition string, valid_horizon boolean, "
                                      "convergence double, peer_catchup double, initiator_reversal double")
    null = spark.createDataFrame([(1, "s", ECONOMIC, "convergence", v) for v in (0.1, 0.5, 0.9)],
                                 "horizon int, return_specification string, peer_definition string, outcome string, statistic double")
    got = rs.empirical_p_value(obs, null).where("outcome = 'convergence'").first()
    assert got.empirical_p_value == pytest.approx(3 / 4) and got.percentile_location == pytest.approx(50.0)


def test_null_detection_input_looks_draws_up_without_rows_for_each_iteration(spark):
    """The detector's input comes from arrays by iteration, not from the table of simulated rows, and equals what that table gives."""
    from peerwake.plans.workspace import Workspace
    ws = Workspace(spark, "/root/testdata/sf0.001")
    found = {(r.null_iteration, r.date, r.security_id): r for r in ws.null_input.collect()}
    assert "simulated" not in vars(ws)
    value = "semiconductor_adjusted_return"
    rows = ws.simulated.join(ws.panel.where("eligible").select("date", "security_id", "peer_group"), ["date", "security_id"]).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.null_iteration, r.date, r.peer_group), {})[r.security_id] = r[value]
    want = {}
    for (k, date, group), held in groups.items():
        for name, own in held.items():
            others = [x for n, x in held.items() if n != name and x is not None]
            if own is not None and others:
                want[k, date, name] = (group, len(others), own - sum(others) / len(others))
    assert want and set(found) == set(want)
    for key, (group, n, move) in want.items():
        r = found[key]
        assert (r.peer_group, r.peer_count) == (group, n) and abs(r.relative_abnormal_return - move) < 1e-9
