import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import dist
from barloom.operators import ranks, stats

T = datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "got, want",
    [
        (lambda: dist.student_two_sided(2.228, 10), 0.05),
        (lambda: dist.student_two_sided(1.96, 1e7), 0.05),
        (lambda: dist.chi_square_tail(18.307, 10), 0.05),
        (lambda: dist.chi_square_tail(3.841, 1), 0.05),
        (lambda: dist.f_tail(3.326, 5, 10), 0.05),
        (lambda: dist.binomial_two_sided_half(2, 10), 0.109375),
        (lambda: dist.binomial_two_sided_half(5, 10), 1.0),
        (lambda: dist.mackinnon_p(-2.0473), 0.2662),
        (lambda: dist.mackinnon_p(-1.019), 0.7463),
        (lambda: dist.mackinnon_critical(10**9)["5%"], -2.8615),
        (lambda: dist.kpss_p(0.463), 0.05),
        (lambda: dist.kpss_p(9.0), 0.01),
        (lambda: dist.kpss_p(0.1), 0.10),
        (lambda: dist.incomplete_gamma(0.5, 0.5), 0.3173),
    ],
)
def test_tables(got, want):
    assert math.isclose(got(), want, rel_tol=1e-3)


def test_ranks_and_quantiles(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, -5.0, -1.0, -0.1, 0.0, 0.1, 0.1, 3.0, 1e9])) for _ in range(200)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, k string, v double")
    p = pd.DataFrame(rows, columns=["k", "v"])
    want = p.groupby("k", dropna=False)["v"].rank()
    for x in ranks.average_ranks(df, ["k"], {"r": "v"}).collect():
        assert (x.r is None and math.isnan(want[x.i])) or x.r == want[x.i]
    for x in ranks.quantiles(df, ["k"], "v", (0, 0.2, 0.5, 0.9, 1)).collect():
        v = p[(p.k == x.k) if x.k else p.k.isna()]["v"].dropna()
        assert x.n == len(v) and np.allclose(x.quantiles, v.quantile([0, 0.2, 0.5, 0.9, 1]))


def pairs(spark, n=80, seed=2):
    g = np.random.default_rng(seed)
    x = g.integers(-4, 5, n).astype(float)
    y = x * 0.3 + g.normal(0, 1, n)
    rows = [("s", T + timedelta(hours=i), a if i % 9 else None, b, 100.0 + i) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist()))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double, y double, close double"), pd.DataFrame(rows, columns=["s", "t", "x", "y", "c"])


def test_information(spark):
    df, p = pairs(spark)
    got = stats.information(df, ("symbol",), "x", "y").first()
    want = p.dropna()["x"].rank().corr(p.dropna()["y"].rank())
    assert math.isclose(got.ic, want) and got.n_obs == len(p.dropna())
    assert got.significant == (got.p_value < 0.05)
    assert stats.information(df, ("symbol",), "x", "y", least=1000).first().ic is None


def test_hits_and_bins(spark):
    df, p = pairs(spark, 400)
    q = p.dropna()
    hit = stats.hit_rate(df, ("symbol",), "x", "y").first()
    own = q[q.x != 0]
    assert hit.hits == (np.sign(own.x) == np.sign(own.y)).sum() and math.isclose(hit.p_value, dist.binomial_two_sided_half(hit.hits, len(own)))
    bins = pd.qcut(q.x, 5, labels=False, duplicates="drop")
    want = q.groupby(bins)["y"].mean() * 1e4
    got = {r.bin: r.mean_bps for r in stats.quantile_returns(df, ("symbol",), "x", "y").collect()}
    assert np.allclose([got[int(k)] for k in want.index], want) and len(got) == len(want)


def test_rolling_information(spark):
    df, p = pairs(spark, 60)
    q = p.dropna().reset_index(drop=True)
    got = [r.rolling_ic for r in stats.rolling_information(df, "x", "y", 10).orderBy("ts").collect()]
    for i in range(len(q)):
        if i < 9:
            assert got[i] is None
        else:
            a, b = (q[c][i - 9 : i + 1].to_numpy().argsort(kind="stable").argsort() for c in "xy")
            assert math.isclose(got[i], np.corrcoef(a, b)[0, 1], abs_tol=1e-12)


def test_rolling_information_over_stretches(spark):
    df, _ = pairs(spark, 90, 5)
    key = lambda d: {r.ts: r.rolling_ic for r in d.collect()}
    whole = key(stats.rolling_information(df, "x", "y", 12))
    assert whole == key(stats.rolling_information(df, "x", "y", 12, stretch_rows=10)) and len(whole) == 80


def ols(y, x):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    return beta, e @ e, np.linalg.inv(x.T @ x)


def adf_by_hand(y, most):
    d = np.diff(y)

    def fit(lags, first):
        rows = range(first, len(d))
        x = np.array([[1, y[t], *[d[t - k] for k in range(1, lags + 1)]] for t in rows])
        return ols(d[list(rows)], x), len(x)

    best = None
    for lags in range(most + 1):
        (_, rss, _), n = fit(lags, most)
        aic = n * (math.log(2 * math.pi) + math.log(rss / n) + 1) + 2 * (lags + 2)
        best = min(best or (math.inf, 0), (aic, lags))
    (beta, rss, inv), n = fit(best[1], best[1])
    return best[1], beta[1] / math.sqrt(rss / (n - best[1] - 2) * inv[1, 1])


@pytest.mark.parametrize("seed", range(3))
def test_dickey_fuller(spark, seed):
    g = np.random.default_rng(seed)
    y = g.normal(0, 1, 120).cumsum() + 150 if seed else np.convolve(g.normal(0, 1, 125), [1, 0.6, 0.3], "valid")[:120]
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)] + [("s", 1000, None), ("few", 1, 1.0)], "symbol string, ts int, x double")
    got = {r.symbol: r for r in stats.dickey_fuller(df, "x", max_lags=4).collect()}
    lags, tau = adf_by_hand(y, 4)
    assert got["s"].lags == lags and math.isclose(got["s"].statistic, tau, rel_tol=1e-6) and got["few"].statistic is None
    assert got["s"].n_obs == 120


def test_lags_kpss_and_arch(spark):
    g = np.random.default_rng(9)
    y = g.normal(0, 1, 200)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "symbol string, ts int, x double")
    e = y - y.mean()
    rho = np.array([e[k:] @ e[: len(e) - k] for k in range(1, 6)]) / (e @ e)
    got = stats.autocorrelation(df, "x", 5).orderBy("lag").collect()
    assert np.allclose([r.acf for r in got], rho)
    assert math.isclose(got[4].q, 200 * 202 * (rho**2 / (200 - np.arange(1, 6))).sum())
    r = np.concatenate(([1], rho))
    for k in range(1, 6):
        m = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert math.isclose(got[k - 1].pacf, np.linalg.solve(m, r[1 : k + 1])[-1], abs_tol=1e-12)
    k = stats.level_stationarity(df, "x").first()
    s = e.cumsum()
    lrv = (e @ e + 2 * sum((1 - i / (k.lags + 1)) * (e[i:] @ e[:-i]) for i in range(1, k.lags + 1))) / 200
    assert math.isclose(k.statistic, (s @ s) / 200**2 / lrv) and k.p_value == dist.kpss_p(k.statistic)
    a = stats.arch_lm(df, "x", 3).first()
    z = y**2
    x = np.column_stack([np.ones(197), z[2:-1], z[1:-2], z[:-3]])
    _, rss, _ = ols(z[3:], x)
    r2 = 1 - rss / ((z[3:] - z[3:].mean()) ** 2).sum()
    assert a.n_obs == 197 and math.isclose(a.lm, 197 * r2, rel_tol=1e-6)


def test_selection(spark):
    m = spark.createDataFrame([("a", "b", 0.9, 1), ("a", "c", 0.1, 1), ("b", "c", -0.8, 1)], "feature_a string, feature_b string, corr double, n_obs int")
    assert stats.greedy_selection(m, {"a": 0.1, "b": -0.2, "c": 0.05}) == (["b"], ["a", "c"])
    assert stats.greedy_selection(m, {"a": 0.3, "b": -0.2, "c": 0.05}) == (["a", "c"], ["b"])
    f = spark.createDataFrame([("a", 0.1, 1000, 0.01, 0.9, None), ("b", None, 1000, 0.5, 0.9, "a")], "feature string, ic double, n_obs int, adf_p double, sign_consistency double, redundant_with string")
    rows = stats.selection(f).collect()
    assert [r.feature for r in rows] == ["a", "b"] and rows[0].passed and rows[1].reject_reasons == "weak IC; weak t; non-stationary; redundant with a"


def test_transitions_and_stability(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([0.0, 0.0, 1.0, None, 0.0])], "symbol string, ts int, g double")
    assert {(r.before, r.after): (r.n, r.pct) for r in stats.transitions(df, "g").collect()} == {(0, 0): (1, 50), (0, 1): (1, 50), (1, 0): (1, 100)}
    b = spark.createDataFrame([("s", 0.1, True), ("s", 0.2, False), ("s", -0.1, False), ("s", 0.3, True)], "symbol string, ic double, significant boolean")
    r = stats.stability(b, ("symbol",)).first()
    assert (r.n_periods, r.sign_consistency, r.pct_significant, r.is_stable) == (4, 0.75, 0.5, True)


def test_kpss_takes_all_lags_it_asks_for(spark):
    n, batch = 250_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "100000")
    try:
        k = stats.level_stationarity(spark.range(n).selectExpr("'s' as symbol", "id as ts", "sin(id / 40000.0D) as x"), "x").first()
    finally:
        spark.conf.set(batch, before)
    y = np.sin(np.arange(n) / 40000)
    e = y - y.mean()
    p = [e[i:] @ e[: n - i] for i in range(1, 400)]
    cover = int(n ** (2 / 9))
    s0, s1 = (e @ e / 2 + sum(p[:cover])) / (n / 2), sum(i * v for i, v in enumerate(p[:cover], 1)) / (n / 2)
    lags = int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))
    lrv = (e @ e + 2 * sum((1 - i / (lags + 1)) * p[i - 1] for i in range(1, lags + 1))) / n
    assert k.lags == lags > 256 and math.isclose(k.statistic, (e.cumsum() @ e.cumsum()) / n**2 / lrv, rel_tol=1e-6)


def test_redundant_with_names_the_kept_one(spark):
    m = spark.createDataFrame([("a", "b", 0.1, 1), ("a", "c", 0.2, 1), ("b", "c", -0.9, 1), ("d", "b", 0.75, 1), ("d", "a", 0.8, 1)], "feature_a string, feature_b string, corr double, n_obs int")
    sizes = {"c": 0.05, "a": 0.3, "b": -0.2, "d": 0.01}
    assert stats.redundancies(m, sizes) == {"a": None, "b": None, "c": "b", "d": "a"}
    assert stats.greedy_selection(m, sizes) == (["a", "b"], ["c", "d"])


def test_no_lags_given_means_all_that_the_longest_series_calls_for(spark):
    from barloom.operators.stats import _all_lags

    assert _all_lags(90_000) == 66 and _all_lags(1_000_000) == 120 and _all_lags(20) == 7
    r = np.random.default_rng(7)
    rows = [(s, datetime(2024, 1, 1) + timedelta(hours=i), float(v)) for s, n in (("a", 150), ("b", 60)) for i, v in enumerate(r.normal(size=n).cumsum())]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    key = lambda d: {row.symbol: (row.n_obs, row.lags, round(row.statistic, 8)) for row in d.collect()}
    open_ = key(stats.dickey_fuller(df, "x", max_lags=None))
    assert open_ == {s: key(stats.dickey_fuller(df.where(f"symbol = '{s}'"), "x", max_lags=_all_lags(n)))[s] for s, n in (("a", 150), ("b", 60))}


def test_ranks_of_hot_and_few_values(spark):
    """Ties of a third of the rows and values that share a bin; the placement works on values, not on rows."""
    from barloom.operators.ranks import average_ranks

    r = np.random.default_rng(5)
    x = [float(v) for v in r.choice([-1.0, 1.0, 0.0, -0.0, 1e-300, 100.00001, 100.00002, -5e300], 400)] + [None, 7.0, 7.0000000001]
    df = spark.createDataFrame([("g" if i % 3 else None, i, v) for i, v in enumerate(x)], "g string, i int, x double")
    out = average_ranks(df, ["g"], {"r": "x"})
    for g in ("g", None):
        own = pd.Series({i: v for i, v in enumerate(x) if ("g" if i % 3 else None) == g}, dtype=float)
        got = {row.i: row.r for row in out.where(F.col("g").eqNullSafe(F.lit(g))).collect()}
        assert all((got[i] is None) if w != w else got[i] == w for i, w in own.rank().items())


def test_pearson_by_matrices_equals_each_pair(spark):
    r = np.random.default_rng(11)
    x = pd.DataFrame(r.normal(1e6, 1.0, (200, 4)), columns=list("abcd"))
    x.loc[r.random(200) < 0.2, "b"] = np.nan
    x.loc[:180, "c"] = np.nan
    x["e"], x["f"] = 3.0, np.nan
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in row) for row in x.itertuples(index=False)], ", ".join(f"{c} double" for c in x))
    got = {(row.feature_a, row.feature_b): row for row in stats.correlations(df, list(x), "pearson").collect()}
    assert len(got) == 15
    for (a, b), row in got.items():
        both = x[[a, b]].dropna()
        want = both[a].corr(both[b]) if len(both) >= 30 else None
        assert row.n_obs == len(both) and (row.corr is None if want is None or want != want else math.isclose(row.corr, want, abs_tol=1e-8))


def test_univariate_gate_and_peak(spark):
    df = spark.createDataFrame([("a", 1, 0.01, True), ("a", 4, -0.5, False), ("b", 1, 0.3, False), ("b", 4, -0.3, False), ("c", 1, None, None)], "feature string, horizon int, ic double, significant boolean")
    assert {r.feature: (r.passed, r.peak_horizon) for r in stats.gate(df, ["feature"]).collect()} == {"a": (False, 4), "b": (False, 1), "c": (False, 1)}
    assert {r.feature: r.peak_horizon for r in stats.decay_peak(df, ["feature"], prefer_significant=True).collect()} == {"a": 1, "b": 1, "c": 1}
