import random

import pytest
from pyspark.sql import functions as F

from conftest import day
from peerwake.operators import diagnostics as dg
from peerwake.operators import events as ev
from peerwake.operators import reports as rp
from peerwake.operators import study as st
from peerwake.params import ECONOMIC, Study

P = Study(primary_horizons=(1, 3), descriptive_horizons=(), pre_event_days=2, post_event_days=3)
EVENT = ("event_id string, date date, security_id string, direction string, relative_return double, relative_volatility double, "
         "peer_definition string, subsector string, simultaneous_event_group string, earnings_flag boolean, peer_group string")


def event(i, d, s, direction="positive", group="g"):
    return (i, d, s, direction, 0.2, 0.02, ECONOMIC, "s", None, False, group)


def frame_of(spark, values, eligible=lambda s, t: True, group=lambda s: "g"):
    rows = [(day(t), s, x, [(ECONOMIC, group(s))] if eligible(s, t) else None) for (s, t), x in values.items()]
    return spark.createDataFrame(rows, "date date, security_id string, value double, groups array<struct<peer_definition:string,peer_group:string>>")


def run(spark, events, frame, p=P, **kw):
    ev_df = spark.createDataFrame(events, EVENT)
    panel = st.event_panel(ev_df, frame, p, "spec", **kw)
    out = {(r.event_id, r.horizon): r for r in st.event_outcomes(ev_df, panel, p).collect()}
    return {(r.event_id, r.relative_day): r for r in panel.collect()}, out


def base_values(n=10):
    values = {}
    for t in range(n):
        values[("I", t)], values[("A", t)], values[("B", t)] = (0.5 if t == 4 else -0.01), 0.02, 0.04
    return values


def test_day_zero_is_shown_and_excluded(spark):
    panel, out = run(spark, [event("e", day(4), "I")], frame_of(spark, base_values()))
    assert panel[("e", 0)].initiator_return == 0.5 and len(panel) == 6
    o = out[("e", 3)]
    assert (o.initiator_car, o.peer_car) == (pytest.approx(-0.03), pytest.approx(0.09))
    assert o.convergence == pytest.approx(o.peer_catchup + o.initiator_reversal) == pytest.approx(0.12)


@pytest.mark.parametrize("direction, sign", [("positive", 1), ("negative", -1)])
def test_sign_algebra(spark, direction, sign):
    _, out = run(spark, [event("e", day(4), "I", direction)], frame_of(spark, base_values()))
    assert out[("e", 1)].peer_catchup == pytest.approx(sign * 0.03) and out[("e", 1)].initiator_reversal == pytest.approx(sign * 0.01)


def test_membership_is_frozen_at_the_event_date(spark):
    # B leaves the group the day after the event and still counts.
    panel, _ = run(spark, [event("e", day(4), "I")], frame_of(spark, base_values(), lambda s, t: not (s == "B" and t > 4)))
    assert panel[("e", 2)].peer_return == pytest.approx(0.03)
    # B is not a member on the event date and never counts.
    panel, _ = run(spark, [event("e", day(4), "I")], frame_of(spark, base_values(), lambda s, t: not (s == "B" and t <= 4)))
    assert panel[("e", 2)].peer_return == pytest.approx(0.02)


def test_each_missing_reason(spark):
    values = base_values()
    values[("A", 6)] = None
    _, out = run(spark, [event("e", day(4), "I")], frame_of(spark, values))
    assert out[("e", 1)].valid_horizon and out[("e", 3)].missing_reason == "missing_peer_observation"
    values = base_values()
    del values[("I", 5)]
    _, out = run(spark, [event("e", day(4), "I")], frame_of(spark, values))
    assert out[("e", 1)].missing_reason == "missing_initiator_observation"
    _, out = run(spark, [event("e", day(8), "I")], frame_of(spark, base_values()))
    assert out[("e", 3)].missing_reason == "end_of_sample;missing_initiator_observation;missing_peer_observation"
    _, out = run(spark, [event("e", day(4), "I", group="other")], frame_of(spark, base_values(), group=lambda s: "other" if s == "I" else "g"))
    assert out[("e", 1)].missing_reason == "missing_event_date_peer_membership"


def test_edges_equal_groups(spark):
    rng = random.Random(2)
    values = {(f"F{i}", t): (None if rng.random() < 0.1 else rng.gauss(0, 0.1)) for i in range(5) for t in range(12)}
    frame = frame_of(spark, values)
    events = [event(f"e{t}", day(t), f"F{t % 5}") for t in (2, 5, 9)]
    grouped, _ = run(spark, events, frame)
    edges = [(e[0], e[1], f"F{i}", 0.25) for e in events for i in range(5) if f"F{i}" != e[2]]
    explicit, _ = run(spark, events, frame, edges=spark.createDataFrame(edges, "event_id string, date date, peer_id string, weight double"))
    assert grouped.keys() == explicit.keys()
    for k, r in grouped.items():
        assert r.valid_observation == explicit[k].valid_observation
        assert r.peer_return is None or r.peer_return == pytest.approx(explicit[k].peer_return, abs=1e-12)


def test_overlap_equals_interval_test(spark):
    rng = random.Random(4)
    frame = frame_of(spark, {("I", t): 0.0 for t in range(60)} | {("A", t): 0.0 for t in range(60)})
    for _ in range(3):
        starts = rng.sample(range(60), 6)
        _, out = run(spark, [event(f"e{t}", day(t), "I") for t in starts], frame)
        spans = {t: (t + 1, min(t + 3, 59)) for t in starts if t < 59}
        for t in starts:
            want = t in spans and any(u != t and spans[u][0] <= spans[t][1] and spans[t][0] <= spans[u][1] for u in spans)
            assert out[(f"e{t}", 1)].overlapping_post_event_window == want


def test_reversed_time_uses_days_before(spark):
    values = base_values()
    values[("I", 3)] = -0.03
    ev_df = spark.createDataFrame([event("e", day(4), "I")], EVENT)
    panel = st.event_panel(ev_df, frame_of(spark, values), P, "spec")
    out = {r.horizon: r for r in st.event_outcomes(ev_df, st.reverse_time(panel), P).collect()}
    assert out[1].convergence == pytest.approx(0.03 + 0.03) and out[3].missing_reason == "end_of_sample"


def test_reports_on_a_small_study(spark):
    _, out = run(spark, [event("e", day(4), "I"), event("f", day(5), "I", "negative")], frame_of(spark, base_values()))
    outcomes = spark.createDataFrame(list(out.values()), ", ".join(f"{c} string" if c in ("event_id", "security_id", "direction", "peer_definition",
        "subsector", "return_specification", "simultaneous_event_group", "missing_reason") else f"{c} date" if c == "event_date" else
        f"{c} int" if c == "horizon" else f"{c} boolean" if c in ("earnings_flag", "overlapping_post_event_window", "valid_horizon") else f"{c} double"
        for c in st.OUTCOME_COLUMNS))
    got = {(r.horizon, r.direction): r.mean_convergence for r in rp.descriptive_summary(outcomes).collect()}
    assert got[(1, "all")] == pytest.approx(0.0) and got[(1, "positive")] == pytest.approx(0.04)


def test_market_adjusted_returns_need_a_market_row_of_the_date(spark):
    from peerwake.operators import peers as pr
    rows = [(day(t), f"F{i}", 0.01 * (i + t), 0.02 * i, True, "s", "g") for t in range(2) for i in range(3)]
    panel = spark.createDataFrame(rows, "date date, security_id string, return double, semiconductor_adjusted_return double, eligible boolean, subsector string, peer_group string")
    market = spark.createDataFrame([(day(1), 0.005), (day(9), 1.0)], "date date, market_return double")
    found = {(r.date, r.security_id): r for r in pr.relative_returns(panel, market).collect()}
    assert len(found) == 6
    for (date, firm), r in found.items():
        own = 0.01 * (int(firm[1:]) + (date == day(1)))
        assert r.market_adjusted_return == (pytest.approx(own - 0.005) if date == day(1) else None)
    assert all(r.market_adjusted_return is None for r in pr.relative_returns(panel).collect())


def test_an_event_meets_its_facts_as_one_row(spark):
    ev_df = spark.createDataFrame([event("e", day(4), "I"), event("f", day(9), "A")], EVENT)
    panel = st.event_panel(ev_df, frame_of(spark, base_values()), P, "spec")
    held = spark.createDataFrame(panel.collect(), panel.schema)
    out = st.event_outcomes(ev_df, held, P)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and plan.index("Generate ") < plan.index("Join ")
    rows = {(r.event_id, r.horizon): (r.valid_horizon, r.missing_reason) for r in out.collect()}
    assert rows == {("e", 1): (True, None), ("e", 3): (True, None), ("f", 1): (False, rows[("f", 1)][1]), ("f", 3): (False, rows[("f", 3)][1])}
    assert "end_of_sample" in rows[("f", 1)][1]


def test_variants_of_one_flag_are_made_once(spark, monkeypatch):
    seen = {}

    def study(candidates, frame, *others):
        seen["rows"] = frame.count()
        return frame.groupBy("variant").agg(F.count("*").alias("n"), F.count("groups").alias("members"))

    monkeypatch.setattr(dg, "detected_outcomes", study)
    rows = [(day(t), s, "g", 0.01 * t, s != "C", True, "s", 1.0, False) for t in range(2) for s in "ABC"]
    panel = spark.createDataFrame(rows, "date date, security_id string, peer_group string, return double, eligible boolean, wide boolean, "
                                        "subsector string, volume double, extreme_return_flag boolean")
    out = dg.universe_sweep(panel, None, None, "x", None, {"core": "eligible", "all": "wide", "again": "eligible"})
    assert {r.variant: (r.n, r.members) for r in out.collect()} == {"core": (6, 4), "all": (6, 6), "again": (6, 4)}
    assert seen["rows"] == 12
