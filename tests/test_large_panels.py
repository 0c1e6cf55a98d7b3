"""What only shows in panels larger than the small test tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import day
from peerwake.functions import checkpoints, draws, exprs
from peerwake.operators import events as ev
from peerwake.operators import inference as inf
from peerwake.operators import mechanism as me
from peerwake.operators import resample as rs
from peerwake.operators import similarity as sm
from peerwake.operators import study as st
from peerwake.operators.study import trading_calendar
from peerwake.params import BROAD, CORRELATION, ECONOMIC, Study
from peerwake.plans import catalogue  # noqa: F401
from peerwake.plans import workspace as workspaces
from peerwake.plans.registry import all_queries
from peerwake.plans.workspace import RESAMPLING, Workspace


def test_events_without_a_matched_date_draw_nothing(spark):
    ws = Workspace(spark, "", keep=False)
    ws.events = spark.createDataFrame([("e1", day(10), "F", ECONOMIC), ("e2", day(20), "G", ECONOMIC)], "event_id string, date date, security_id string, peer_definition string")
    ws.pseudo_candidates = spark.createDataFrame([("e1", day(70)), ("e1", day(90))], "event_id string, date date")
    drawn = ws.pseudo.groupBy("source_event_id").agg(F.count("*").alias("n")).collect()
    assert [tuple(r) for r in drawn] == [("e1", RESAMPLING.pseudo_event_iterations)]


def correlation(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    over = math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    return sum((a - mx) * (b - my) for a, b in zip(x, y)) / over


def test_histories_are_kept_once_a_security_and_blocks_give_the_brute_force_peers(spark, monkeypatch):
    monkeypatch.setattr(sm, "INITIATORS_PER_BLOCK", 2)
    monkeypatch.setattr(sm, "CANDIDATES_PER_BLOCK", 3)
    monkeypatch.setattr(sm, "DATES_PER_BLOCK", 2)
    monkeypatch.setattr(sm, "_CELLS_AT_ONCE", 4)
    rng = random.Random(3)
    firms = [f"F{i}" for i in range(8)]
    rows = {(day(t), f): None if rng.random() < 0.1 else rng.gauss(0, 1) for t in range(90) for f in firms if rng.random() < 0.95 or t in (80, 83, 84)}
    rows |= {(d, "F7"): rows[d, "F6"] for d, f in list(rows) if f == "F6"}  # equal series: the lower id is first
    returns = spark.createDataFrame([(*k, v) for k, v in rows.items()], "date date, security_id string, `return` double")
    marks = [("a", 80, "F0"), ("b", 80, "F1"), ("c", 80, "F2"), ("d", 83, "F0"), ("e", 84, "F7")]
    events = spark.createDataFrame([(e, day(t), f) for e, t, f in marks], "event_id string, date date, security_id string")
    members = spark.createDataFrame([(day(t), f) for t in (80, 83, 84) for f in firms if (t, f) != (83, "F3")], "date date, security_id string")
    inputs = sm.prepare(events, members, returns, trading_calendar(returns), ["date"], lookback=40)
    assert not any("array" in t for side in inputs[:2] for _, t in side.dtypes) and inputs.series.count() == len(firms)
    found = {}
    for r in sm.correlation_peers(*inputs, minimum=20, top=3).collect():
        found.setdefault(r.event_id, []).append((r["rank"], r.peer_id, r.correlation))
    for event, t, firm in marks:
        both = {f: [(rows[day(s), firm], rows[day(s), f]) for s in range(t - 40, t) if rows.get((day(s), firm)) is not None and rows.get((day(s), f)) is not None]
                for f in firms if f != firm and (t, f) != (83, "F3")}
        want = sorted((-round(correlation(*zip(*v)), 10), f) for f, v in both.items() if len(v) >= 20)[:3]
        assert [p for _, p, _ in sorted(found[event])] == [f for _, f in want]
        assert [c for *_, c in sorted(found[event])] == pytest.approx([-c for c, _ in want])


def test_a_portfolio_summed_in_parts_equals_the_mean_of_the_others(spark, monkeypatch):
    monkeypatch.setattr(st, "MEMBERS_PER_PART", 2)
    rng = random.Random(5)
    values = {(day(t), f"F{i}"): rng.gauss(0, 1) for t in range(8) for i in range(7)}
    del values[day(5), "F3"]
    frame = spark.createDataFrame([(*k, v, [(ECONOMIC, "g")]) for k, v in values.items()],
                                  "date date, security_id string, value double, groups array<struct<peer_definition:string,peer_group:string>>")
    events = spark.createDataFrame([("e", day(2), "F0", "positive", ECONOMIC, "g")], "event_id string, date date, security_id string, direction string, peer_definition string, peer_group string")
    p = Study(primary_horizons=(1, 3), descriptive_horizons=(), pre_event_days=2, post_event_days=3)
    for r in st.event_panel(events, frame, p, "s", calendar=trading_calendar(frame)).collect():
        others = [values.get((r.calendar_date, f"F{i}")) for i in range(1, 7)]
        assert r.initiator_return == values[r.calendar_date, "F0"]
        assert r.peer_return == (None if None in others else pytest.approx(sum(others) / 6))


def test_resamples_travel_as_blocks_of_draws_and_equal_a_fold_over_them(spark, monkeypatch):
    monkeypatch.setattr(draws, "DRAWS_PER_BLOCK", 9 * 12)
    monkeypatch.setattr(draws, "DRAWS_PER_TASK_ROW", 9 * 5)
    rng = random.Random(7)
    rows = [(k, f"F{i % 31}", rng.choice([rng.gauss(0, 1), 2.0])) for k in ("a", "b", None) for i in range(50)] + [("a", "F3", math.inf)]
    got = inf.bootstrap_means(spark.createDataFrame(rows, "k string, firm string, x double"), ["k"], "firm", 9, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.split("FlatMapCoGroupsInArrow")[0] and "Broadcast" not in plan  # no row for each draw, no table sent to all
    sha = lambda *parts: hashlib.sha256("|".join(str(p) for p in parts if p is not None).encode()).hexdigest()
    want = {}
    for k in ("a", "b", None):
        firms = sorted({f for c, f, _ in rows if c == k}, key=sha)
        for t in range(9):
            drawn = [firms[int(sha(5, k, t, s)[:15], 16) % len(firms)] for s in range(len(firms))]
            x = [v for d in drawn for c, f, v in rows if c == k and f == d]
            want[k, t] = (pytest.approx(sum(x) / len(x)), len(x))
    assert {(r.k, r.iteration): (r.statistic, r.sample_size) for r in got.collect()} == want


def test_stage_tables_that_compress_well_are_not_sent_to_all_tasks(spark):
    rows = spark.range(checkpoints.SENT_ROWS).select("id", F.lit("a long text that compresses well" * 8).alias("text"))
    large, small = checkpoints.staged(rows, "large"), checkpoints.staged(rows.limit(10), "small")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    wide = spark.range(1 << 24).withColumnRenamed("id", "key")
    assert "Broadcast" not in plan(wide.join(large.select("id", "text"), F.col("key") == F.col("id"), "left"))
    assert "Broadcast" in plan(wide.join(small, F.col("key") == F.col("id"), "left"))
    assert "BroadcastHashJoin" in plan(wide.join(F.broadcast(large), F.col("key") == F.col("id"), "left"))


def test_settled_candidates_leave_the_rounds_of_the_joint_cooldown(spark, monkeypatch):
    rng, sizes = random.Random(11), []
    rows = {(f"F{rng.randrange(12)}", rng.choice(["g", "h", None]), day(rng.randrange(160))) for _ in range(220)}
    kept = set()
    for d in sorted({r[2] for r in rows}):
        free = [r for r in rows if r[2] == d and not any((k[0] == r[0] or k[1] == r[1]) and 0 < (d - k[2]).days <= 7 for k in kept)]
        kept |= set(free)
    stage = ev.staged
    monkeypatch.setattr(ev, "staged", lambda df, label: (lambda t: (sizes.append(t.count()), t)[1])(stage(df, label)))
    df = spark.createDataFrame([(*r, ECONOMIC, i) for i, r in enumerate(rows)], "security_id string, peer_group string, date date, peer_definition string, n int")
    got = ev.apply_cooldown(df.unionByName(df), 7, "both").collect()
    assert len(got) == 2 * len(kept) and {(r.security_id, r.peer_group, r.date) for r in got} == kept
    assert sizes[0] == len(rows) and len(sizes) > 3 and sizes[-1] < len(rows) / 4


def test_random_peers_are_drawn_in_many_tasks(spark):
    events = spark.createDataFrame([("e", day(1), "F1", ECONOMIC)], "event_id string, date date, security_id string, peer_definition string")
    sizes = spark.createDataFrame([("e", 3, 1 / 3)], "event_id string, portfolio_size long, weight double")
    pool = spark.createDataFrame([(day(1), f"F{i}") for i in range(9)], "date date, security_id string")
    edges = rs.random_peer_edges(events, sizes, pool, 5)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert edges.count() == 15 and "REPARTITION_BY_NUM" in plan


def test_paired_differences_ask_nothing_of_the_third_definition(spark, monkeypatch):
    rows = [(f"e{i}", d, 1, ok, 0.1 * i * k, 0.0, 0.0) for i in range(4) for k, (d, ok) in enumerate([(CORRELATION, True), (ECONOMIC, i != 3), (BROAD, False)], 1)]
    ws = Workspace(spark, "made", keep=False)
    ws.definition_outcomes = spark.createDataFrame(rows, "event_id string, peer_definition string, horizon int, valid_horizon boolean, convergence double, "
                                                   "peer_catchup double, initiator_reversal double")
    monkeypatch.setitem(workspaces._OPEN, (spark.sparkContext.applicationId, "made"), ws)
    found = {r.outcome: r for r in all_queries()["paired_difference"](spark, "made").collect()}
    assert found["convergence"].sample_size == 3 and found["convergence"].mean == pytest.approx(0.1)
    assert me.common_sample(ws.definition_outcomes).count() == 0


def test_portfolios_are_summed_without_a_row_for_each_day(spark):
    p = Study(primary_horizons=(1,), descriptive_horizons=(), pre_event_days=1, post_event_days=2)
    rows = spark.createDataFrame([("e", 0.5, [1.0, None, 2.0, 3.0], 0), ("e", 0.5, [2.0, 1.0, None, 3.0], 0)], "event_id string, weight double, near array<double>, __part int")
    sums = st._baskets(rows, ["event_id"], p, weighted=True)
    r = sums.first()
    assert (r["__sum"], r["__seen"], r["__members"], r["__w"]) == ([1.5, 0.5, 1.0, 3.0], [2, 1, 1, 2], 2, 1.0)
    assert "Generate" not in sums._jdf.queryExecution().executedPlan().toString()


def test_windows_are_cut_out_at_both_ends_of_a_series(spark):
    p = Study(primary_horizons=(1,), descriptive_horizons=(), pre_event_days=2, post_event_days=3)
    frame = spark.createDataFrame([(day(t), "F", None if t == 4 else float(t)) for t in (1, 2, 4, 7)] + [(day(t), "G", 0.0) for t in range(8)], "date date, security_id string, value double")
    wanted = spark.createDataFrame([(day(t), "F") for t in range(8)], "date date, security_id string")
    calendar = trading_calendar(frame)
    found = {r.date: r.near for r in st._neighbours(wanted, frame, calendar, p, ()).collect()}
    values = {1: 1.0, 2: 2.0, 7: 7.0}
    assert found == {day(t): [values.get(t + d) for d in range(-2, 4)] for t in (1, 2, 4, 7)}
    with pytest.raises(Exception, match="second row of one date"):
        st._neighbours(wanted, frame.unionByName(frame), calendar, p, ()).collect()


def test_places_are_those_of_the_feistel_network(spark):
    def places(n, k, h):
        half = max(-(-max(n - 1, 0).bit_length() // 2), 3)
        size, out = 1 << half, []
        for j in range(size * size):
            left, right = divmod(j, size)
            for r in range(4):
                mixed = (right * int(h[15 * r:15 * r + 7], 16) + int(h[15 * r + 7:15 * r + 15], 16)) % ((1 << 31) - 1) >> 12
                left, right = right, left ^ mixed % size
            out.append(left * size + right)
        return [x for x in out if x < n][:k]

    cases = [(n, k) for n in (1, 2, 5, 16, 65, 257, 1024, 1025) for k in (0, 1, 4, n) if k <= n]
    df = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(cases)] + [(len(cases), 5, None)], "id int, n long, k long")
    got = df.select("id", exprs.digest(3, F.col("id")).alias("h"), exprs.shuffled_places(F.col("n"), F.col("k"), 3, F.col("id")).alias("p"))
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        assert r.p == (places(*cases[r.id], r.h) if r.id < len(cases) else None)


def test_most_pairs_are_judged_by_their_bound(monkeypatch):
    rng = np.random.default_rng(5)
    b = rng.normal(size=(6000, 60))
    b[40:80], b[81], b[82, 3] = b[39], 0.5, np.inf  # ties, a constant and an endless series
    mb = (rng.random(b.shape) >= 0.03).astype(float)
    mb[39:80] = 1.0
    b = np.where(mb > 0, b, 0.0)
    pick = np.r_[30:90, 200:240]
    corr, n = sm.pairwise_correlation(b[pick], mb[pick], b, mb)
    corr = np.where((n >= 30) & (pick[:, None] != np.arange(len(b))), corr, np.nan)
    want = [(i, j) for i in range(len(pick)) for j in sorted(np.flatnonzero(~np.isnan(corr[i])), key=lambda j: (-round(corr[i, j], 10), j))[:10]]
    computed = []
    for name, size in (("pairwise_correlation", lambda a, b: len(a) * len(b)), ("_paired_correlation", lambda a, b: len(a))):
        monkeypatch.setattr(sm, name, lambda a, ma, b, mb, f=getattr(sm, name), size=size: (computed.append(size(a, b)), f(a, ma, b, mb))[1])
    i, j, _ = sm.best_correlations(b[pick], mb[pick], b, mb, lambda r, c: pick[r] != c, 30, 10)
    assert [(x, int(y)) for x in range(len(pick)) for y in j[i == x]] == want
    assert sum(computed) < 0.6 * len(pick) * len(b)


def test_running_medians_are_made_once_for_all_steps(spark, monkeypatch):
    stage, labels = rs.staged, []
    monkeypatch.setattr(rs, "staged", lambda df, label: (labels.append(label), stage(df, label))[1])
    panel = spark.createDataFrame([(day(t), f"F{i}", True, "s", "g", 0.01 * ((t * i) % 7), 5.0 + i, 10.0) for t in range(50) for i in range(3)],
                                  "date date, security_id string, eligible boolean, subsector string, peer_group string, return double, adj_close double, volume double")
    factor = spark.createDataFrame([(day(t), 0.01) for t in range(50)], "date date, semiconductor_return double")
    found = rs.matching_panel(panel, factor)
    assert labels == ["strata"] and "FlatMapGroupsInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 150 and found.where("volatility_regime = 'high'").count() > 0
