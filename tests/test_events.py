import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import day
from peerwake.operators import events as ev
from peerwake.operators import peers as pr
from peerwake.params import BROAD, CORRELATION, ECONOMIC, Detection

SCHEMA = ("date date, security_id string, peer_definition string, peer_group string, peer_count long, relative_abnormal_return double, "
          "subsector string, volume double, corporate_action_type string")
P = Detection(minimum_relative_move=0.05, volatility_window=5, threshold_multiplier=2.0, cooldown_period=3, minimum_peer_count=2,
              minimum_history_requirement=5, cooldown_scope="firm")


def rows_for(firm, shocks, n=12, group="g", count=3, action="none"):
    base = [0.01, -0.01, 0.02, -0.02, 0.01, -0.01, 0.02, -0.02, 0.01, -0.01, 0.02, -0.02]
    return [(day(i), firm, "d", group, count, shocks.get(i, base[i]), "s", 1.0, action) for i in range(n)]


def detect(spark, rows, p=P):
    return {(r.security_id, r.date): r for r in ev.detect_events(spark.createDataFrame(rows, SCHEMA), p).collect()}


def test_shock_is_an_event_with_trailing_volatility(spark):
    got = detect(spark, rows_for("A", {7: 0.2}))
    event = got[("A", day(7))]
    assert event.direction == "positive"
    # Rows 2..6; the shock itself is not in its own window.
    assert event.relative_volatility == pytest.approx(np.std([0.02, -0.02, 0.01, -0.01, 0.02], ddof=1))
    assert event.threshold_used == pytest.approx(max(0.05, 2 * event.relative_volatility))


def test_threshold_is_strict_and_history_required(spark):
    assert detect(spark, rows_for("A", {7: 0.05}), Detection(**{**P.__dict__, "threshold_multiplier": 0.01})) == {}
    assert detect(spark, rows_for("A", {3: 0.5})) == {}


def test_future_rows_never_change_past_events(spark):
    first = detect(spark, rows_for("A", {7: -0.3}))
    later = detect(spark, rows_for("A", {7: -0.3, 11: 9.0}))
    assert first[("A", day(7))] == later[("A", day(7))]


def test_unusable_rows_keep_their_slot(spark):
    rows = rows_for("A", {7: 0.2})
    rows[4] = (*rows[4][:8], "split")
    assert detect(spark, rows) == {}


def test_cooldown_counts_calendar_days_and_keeps_same_day(spark):
    shocks = {6: 0.9, 9: -5.0, 10: 9.0}
    got = detect(spark, rows_for("A", shocks) + rows_for("B", {6: 0.9}))
    assert {k for k in got} == {("A", day(6)), ("B", day(6)), ("A", day(10))}
    assert got[("A", day(6))].simultaneous_event_group == got[("B", day(6))].simultaneous_event_group is not None
    assert got[("A", day(10))].simultaneous_event_group is None


def greedy(cands, period, scope):
    firm, group, kept = {}, {}, set()
    for d in sorted({c[0] for c in cands}):
        today = []
        for c in (c for c in cands if c[0] == d):
            f = scope in ("firm", "both") and c[1] in firm and (d - firm[c[1]]).days <= period
            g = scope in ("peer_group", "both") and c[2:4] in group and (d - group[c[2:4]]).days <= period
            if not f and not g:
                today.append(c)
        for c in today:
            kept.add(c)
            firm[c[1]], group[c[2:4]] = d, d
    return kept


@pytest.mark.parametrize("scope", ["none", "firm", "peer_group", "both"])
def test_cooldown_equals_a_sequential_pass(spark, scope):
    rng = random.Random(7)
    cands = list({(day(rng.randrange(60)), f"F{rng.randrange(6)}", d, f"{d}{rng.randrange(2)}") for _ in range(120) for d in [rng.choice("xy")]})
    df = spark.createDataFrame(cands, "date date, security_id string, peer_definition string, peer_group string")
    got = {tuple(r) for r in ev.apply_cooldown(df, 5, scope).select(*df.columns).collect()}
    assert got == (set(cands) if scope == "none" else greedy(cands, 5, scope))


def test_both_equals_group_clock_for_one_group_per_firm(spark):
    rng = random.Random(3)
    cands = list({(day(rng.randrange(80)), f"F{i}", "x", f"g{i % 2}") for i in range(6) for _ in range(12)})
    df = spark.createDataFrame(cands, "date date, security_id string, peer_definition string, peer_group string")
    assert {tuple(r) for r in ev.apply_cooldown(df, 4, "both").select(*df.columns).collect()} == greedy(cands, 4, "both")


def panel_of(spark, rng, firms=9, days=8):
    rows = [(day(t), f"F{i}", f"g{i % 3}", bool(rng.random() < 0.85), None if rng.random() < 0.2 else rng.gauss(0, 0.02))
            for t in range(days) for i in range(firms)]
    return rows, spark.createDataFrame(rows, "date date, security_id string, peer_group string, eligible boolean, `return` double")


@pytest.mark.parametrize("definition", [ECONOMIC, BROAD])
def test_leave_one_out_equals_explicit_pairs(spark, definition):
    rows, df = panel_of(spark, random.Random(5))
    got = {(r.date, r.security_id): (r.peer_return, r.peer_count) for r in pr.peer_returns(df, definitions=(definition,)).collect()}
    want = {}
    for d, s, g, ok, _ in rows:
        peers = [r for r in rows if ok and r[3] and r[0] == d and r[1] != s and (definition == BROAD or r[2] == g)]
        seen = [r[4] for r in peers if r[4] is not None]
        if peers:
            want[(d, s)] = (sum(seen) / len(seen) if seen else None, len(seen))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][1] == want[k][1] and (got[k][0] is None) == (want[k][0] is None)
        assert want[k][0] is None or got[k][0] == pytest.approx(want[k][0], abs=1e-12)
    edges = pr.expand_edges(pr.peer_portfolios(df, (definition,)), df.withColumn("peer_definition", F.lit(definition)))
    again = {(r.date, r.security_id): r.peer_return for r in pr.weighted_peer_returns(edges, df).collect()}
    assert {k: pytest.approx(v[0], abs=1e-12) if v[0] is not None else None for k, v in want.items()} == again


def test_peer_definitions_are_checked(spark):
    _, df = panel_of(spark, random.Random(1))
    with pytest.raises(ValueError):
        pr.memberships(df, ())
    with pytest.raises(ValueError):
        pr.memberships(df, ("other",))
    with pytest.raises(NotImplementedError):
        pr.memberships(df, (CORRELATION,))


def test_factor_ignores_ineligible(spark):
    df = spark.createDataFrame([(day(0), "A", 0.01, True), (day(0), "B", 0.03, True), (day(0), "C", 0.9, False)],
                               "date date, security_id string, `return` double, eligible boolean")
    assert pr.sector_factor(df).first().semiconductor_return == pytest.approx(0.02)


def test_trailing_factor_models(spark):
    rng = np.random.default_rng(0)
    f, g = rng.normal(size=30), rng.normal(size=30)
    y = 0.01 + 2 * f - 0.5 * g
    rows = [(day(i), "A", float(y[i]) if i != 12 else None, float(f[i]), float(g[i])) for i in range(30)]
    df = spark.createDataFrame(rows, "date date, security_id string, `return` double, f double, g double")
    got = pr.multi_factor_residuals(df, ["f", "g"], window=8).orderBy("date").collect()
    fitted = [r for r in got if r.factor_residual_return is not None]
    assert len(got) == 30 and len(fitted) == 30 - 1 - 8
    assert all(abs(r.factor_residual_return) < 1e-9 and r.beta_f == pytest.approx(2) and r.beta_g == pytest.approx(-0.5) for r in fitted)
    one = df.select("date", "security_id", (0.01 + 2 * F.col("f")).alias("return"), "f")
    last = pr.one_factor_residuals(one, "f", window=3).orderBy(F.desc("date")).first()
    assert (last.intercept, last.beta_factor, last.observation_count) == (pytest.approx(0.01), pytest.approx(2), 3)
    with pytest.raises(ValueError):
        pr.multi_factor_residuals(df, ["f", "g"], window=2)


@pytest.mark.parametrize("field, bad, told", [
    (0, None, "null value"), (3, None, "null value"), (4, None, "null value"), (5, None, "null value"), (6, None, "null value"),
    (5, float("nan"), "finite"), (5, float("-inf"), "finite"), (4, -1, "negative")])
def test_detector_stops_at_unreadable_rows(spark, field, bad, told):
    rows = rows_for("A", {7: 0.2})
    rows[5] = (*rows[5][:field], bad, *rows[5][field + 1:])
    with pytest.raises(Exception, match=told):
        detect(spark, rows)


def test_detector_stops_at_repeated_rows_and_wrong_columns(spark):
    rows = rows_for("A", {7: 0.2})
    with pytest.raises(Exception, match="second row"):
        detect(spark, [*rows, rows[7]])
    df = spark.createDataFrame(rows, SCHEMA)
    for wrong in (df.drop("subsector"), df.withColumn("date", F.col("date").cast("timestamp")), df.withColumn("peer_count", F.lit("3"))):
        with pytest.raises(ValueError):
            ev.detect_events(wrong, P)
