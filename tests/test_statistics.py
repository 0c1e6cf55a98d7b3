import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import day
from peerwake.functions import selection, student
from peerwake.functions.exprs import digest, weekdays_between
from peerwake.operators import inference as inf
from peerwake.operators import regress as rg
from peerwake.operators.similarity import pairwise_correlation


def test_student_against_tables():
    assert student.quantile(0.975, [1, 5, 20, 1000]) == pytest.approx([12.706204736, 2.570581836, 2.085963447, 1.962339081], abs=1e-8)
    assert student.upper_tail([2.570581836, -2.570581836, 0.0], [5, 5, 7]) == pytest.approx([0.025, 0.975, 0.5], abs=1e-9)
    assert student.normal_upper_tail([1.959963985]) == pytest.approx([0.025], abs=1e-9)


def test_percentiles_of_small_groups(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=101), "b": np.round(rng.normal(size=40), 1), "c": np.array([3.0]), None: rng.exponential(size=7)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, x double")
    named = {"q05": 0.05, "q50": 0.5, "q95": 0.95, "q0": 0.0, "q1": 1.0}
    got = {r.k: r for r in selection.percentiles(df, ["k"], "x", named).collect()}
    for k, vs in data.items():
        assert [got[k][n] for n in named] == pytest.approx(list(np.quantile(vs, list(named.values()))), abs=1e-12)


def test_order_statistics_at_dependent_positions(spark):
    rng = np.random.default_rng(2)
    data = {k: rng.normal(size=n) for k, n in (("a", 55), ("b", 8))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, x double")
    cut = F.floor(F.col("__n") * 0.1)
    got = {r.k: r for r in selection.order_statistics(df, ["k"], "x", {"lo": cut, "hi": F.col("__n") - 1 - cut}).collect()}
    for k, vs in data.items():
        s, g = np.sort(vs), int(len(vs) * 0.1)
        assert (got[k].lo, got[k].hi) == (pytest.approx(s[g]), pytest.approx(s[len(s) - 1 - g]))


def test_outliers_and_ties_leave_little_to_sort(spark):
    rng = np.random.default_rng(4)
    data = {"outlier": np.append(rng.uniform(size=20000), 1e9), "ties": np.append(np.full(15000, 0.5), rng.uniform(size=5000)), "same": np.full(3000, 2.0)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, __x double")
    named = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    got = {r.k: r for r in selection.percentiles(df, ["k"], "__x", named).collect()}
    for k, vs in data.items():
        assert [got[k][n] for n in named] == pytest.approx(list(np.quantile(vs, list(named.values()))), abs=1e-12)
    _, held = selection._cut(df, ["k"], {n: p * (F.col("__n") - 1) for n, p in named.items()})
    assert all(r["__lo"] == r["__hi"] or r["__c"] < 400 for r in held.collect())


def test_dense_index_is_a_permutation(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), digest(F.col("id")).alias("h"))
    rows = selection.dense_index(df, ["k"], "h", "i").collect()
    for k in range(3):
        mine = sorted((r for r in rows if r.k == k), key=lambda r: r.h)
        assert [r.i for r in mine] == list(range(len(mine))) and {r.i_total for r in mine} == {len(mine)}


def test_weekday_arithmetic(spark):
    import datetime as dt
    rng = random.Random(0)
    spans = [(dt.date(1960, 1, 1) + dt.timedelta(days=rng.randrange(30000)),) for _ in range(40)]
    spans = [(a[0], a[0] + dt.timedelta(days=rng.randrange(40))) for a in spans]
    df = spark.createDataFrame(spans, "a date, b date")
    for a, b, n in df.select("a", "b", weekdays_between(F.col("a"), F.col("b"))).collect():
        assert n == sum((a + dt.timedelta(days=i)).weekday() < 5 for i in range((b - a).days + 1))


def values_frame(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = [("c", f"e{i}", f"f{int(rng.integers(9))}", day(int(rng.integers(15))), float(rng.normal(0.1, 1))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, event_id string, security_id string, event_date date, x double")


def cluster_se(x, groups):
    e, total = x - x.mean(), 0.0
    names = sorted(set(groups))
    for g in names:
        total += e[[h == g for h in groups]].sum() ** 2
    return len(names) / (len(names) - 1) * total / len(x) ** 2


def test_clustered_mean_inference(spark):
    rows, df = values_frame(spark)
    x = np.array([r[4] for r in rows])
    firm, date = [r[2] for r in rows], [r[3] for r in rows]
    one = inf.mean_inference(df, ["k"], "firm").first()
    assert one.standard_error == pytest.approx(np.sqrt(cluster_se(x, firm))) and one.degrees_of_freedom == len(set(firm)) - 1
    assert one.ci_upper == pytest.approx(x.mean() + student.quantile(0.975, one.degrees_of_freedom) * one.standard_error)
    two = inf.mean_inference(df, ["k"], "two_way").first()
    variance = cluster_se(x, firm) + cluster_se(x, date) - cluster_se(x, list(zip(firm, date)))
    assert two.standard_error == pytest.approx(np.sqrt(variance)) and two.cluster_count == min(len(set(firm)), len(set(date)))
    lone = inf.mean_inference(df.withColumn("security_id", F.lit("f")), ["k"], "firm").first()
    assert lone.standard_error is None and lone.cluster_count == 1


def test_distribution_statistics(spark):
    rows, df = values_frame(spark, 47)
    x = np.sort([r[4] for r in rows])
    got = inf.distribution(df, ["k"]).first()
    n, m = len(x), x.mean()
    g1 = ((x - m) ** 3).mean() / ((x - m) ** 2).mean() ** 1.5
    g2 = ((x - m) ** 4).mean() / ((x - m) ** 2).mean() ** 2 - 3
    assert got.trimmed_mean == pytest.approx(x[4:-4].mean())
    assert got.skewness == pytest.approx(g1 * np.sqrt(n * (n - 1)) / (n - 2))
    assert got.excess_kurtosis == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def test_bootstrap_means_are_reproducible_and_centred(spark):
    _, df = values_frame(spark)
    a = {(r.iteration, r.statistic) for r in inf.bootstrap_means(df, ["k"], "security_id", 50, 1).collect()}
    b = {(r.iteration, r.statistic) for r in inf.bootstrap_means(df.repartition(3), ["k"], "security_id", 50, 1).collect()}
    assert {i for i, _ in a} == set(range(50)) and {(i, round(s, 12)) for i, s in a} == {(i, round(s, 12)) for i, s in b}


def ols(x, y, clusters=None, kind="hc3"):
    bread = np.linalg.pinv(x.T @ x)
    b = bread @ x.T @ y
    e = y - x @ b
    n, k = x.shape
    if kind == "hc3":
        h = np.einsum("ij,jk,ik->i", x, bread, x)
        meat = (x * (e / (1 - h))[:, None] ** 2).T @ x
        return b, np.sqrt(np.diag(bread @ meat @ bread))
    if kind == "hc1":
        return b, np.sqrt(np.diag(bread @ ((x * e[:, None] ** 2).T @ x) @ bread) * n / (n - k))
    meat = np.zeros((k, k))
    for g in set(clusters):
        s = (x * e[:, None])[[c == g for c in clusters]].sum(axis=0)
        meat += np.outer(s, s)
    gcount = len(set(clusters))
    return b, np.sqrt(np.diag(bread @ meat @ bread) * gcount / (gcount - 1) * (n - 1) / (n - k))


@pytest.mark.parametrize("kind", ["hc3", "hc1", "cluster"])
def test_least_squares_against_numpy(spark, kind):
    rng = np.random.default_rng(5)
    rows = []
    for m in ("m1", "m2"):
        for i in range(50):
            a, b = rng.normal(size=2)
            lab = "pqr"[int(rng.integers(3))] if m == "m1" else "qr"[int(rng.integers(2))]
            rows.append((m, f"f{int(rng.integers(8))}", float(a), float(b), lab, float(1 + 2 * a - b + (lab == "r") + rng.normal())))
    rows.append(("small", "f1", 1.0, 2.0, "p", 3.0))
    df = spark.createDataFrame(rows, "m string, firm string, a double, b double, lab string, y double")
    terms, models = rg.fit(df, ["m"], "y", ["a", "b"], {"lab": ["p", "q", "r"]}, kind, ("firm",) if kind == "cluster" else ())
    got = {(r.m, r.term): (r.coefficient, r.standard_error) for r in terms.collect()}
    assert {r.m: r.estimated for r in models.collect()} == {"m1": True, "m2": True, "small": False}
    for m, levels in (("m1", "qr"), ("m2", "r")):
        mine = [r for r in rows if r[0] == m]
        x = np.array([[1, r[2], r[3], *[float(r[4] == v) for v in levels]] for r in mine])
        beta, se = ols(x, np.array([r[5] for r in mine]), [r[1] for r in mine], kind)
        names = ["const", "a", "b", *[f"C(lab)[T.{v}]" for v in levels]]
        for j, name in enumerate(names):
            assert got[(m, name)] == (pytest.approx(beta[j], abs=1e-9), pytest.approx(se[j], abs=1e-9))
        assert sum(k[0] == m for k in got) == len(names)


def test_univariate_hc3_against_numpy(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=40), rng.normal(size=40)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    got = rg.univariate_hc3(df, ["k"], "y", "x").first()
    z = (x - x.mean()) / x.std(ddof=1)
    beta, se = ols(np.column_stack([np.ones(40), z]), y)
    assert (got.coefficient, got.standard_error) == (pytest.approx(beta[1]), pytest.approx(se[1]))


def test_pairwise_correlation_with_gaps():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(3, 30)), rng.normal(size=(4, 30))
    ma, mb = (rng.random((3, 30)) < 0.8).astype(float), (rng.random((4, 30)) < 0.8).astype(float)
    b[2] = 1.0
    corr, n = pairwise_correlation(a * ma, ma, b * mb, mb)
    for i in range(3):
        for j in range(4):
            both = (ma[i] * mb[j]).astype(bool)
            assert n[i, j] == both.sum()
            assert np.isnan(corr[i, j]) if j == 2 else corr[i, j] == pytest.approx(np.corrcoef(a[i, both], b[j, both])[0, 1])


def test_valid_horizons_without_a_value_are_counted(spark):
    rows = [(5, "r", "p", f"e{i}", f"s{i}", day(i), d, ok, c, None, 0.1) for i, (d, ok, c) in enumerate(
        [("positive", True, None), ("positive", True, 0.2), ("negative", True, None), ("negative", False, None)])]
    outcomes = spark.createDataFrame(rows, "horizon int, return_specification string, peer_definition string, event_id string, security_id string, "
                                           "event_date date, direction string, valid_horizon boolean, convergence double, peer_catchup double, "
                                           "initiator_reversal double")
    got = {(r.outcome, r.direction): (r.sample_size, r.missing_outcome_count) for r in inf.hypothesis_tests(outcomes).collect()}
    assert got["convergence", "all"] == (1, 2) and got["convergence", "negative"] == (0, 1)
    assert got["peer_catchup", "all"] == (0, 3) and got["initiator_reversal", "positive"] == (2, 0)
