"""Statistics of features against forward returns, and of series: rank correlations, hit rates, unit roots, lags.

Groups are reduced to a few sums on the executors; tail probabilities and small solves are then done on those rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import dist
from barloom.functions.semantics import whole
from barloom.operators.ranks import average_ranks, quantiles
from barloom.operators.scan import by_stretch, folded, scanned
from barloom.sources.tables import written


@F.pandas_udf(T.DoubleType())
def spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if r != r else dist.spearman_p(r, int(k)) for r, k in zip(rho.astype(float), n)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _binomial_p(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([dist.binomial_two_sided_half(int(a), int(b)) if b else None for a, b in zip(k, n)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if a != a else dist.chi_square_tail(a, d) for a, d in zip(x, dof)], dtype=float)


def long(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, feature, value): one row a feature."""
    return df.unpivot(list(keep), list(features), "feature", "value")


def information(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 30) -> DataFrame:
    """(by, ic, n_obs, p_value, significant, stars): rank correlation of x and y over rows where both are there; null
    below `least` rows. significant: p below 0.05; stars at .05, .01 and .001."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = average_ranks(pairs, by, {"_rx": "_x", "_ry": "_y"})
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_obs"), F.corr("_rx", "_ry").alias("_c"))
    out = out.withColumn("ic", F.when((F.col("n_obs") >= least) & ~F.isnan("_c"), F.col("_c"))).drop("_c")
    out = out.withColumn("p_value", spearman_p("ic", "n_obs"))
    stars = F.when(F.col("p_value") < 0.001, "***").when(F.col("p_value") < 0.01, "**").when(F.col("p_value") < 0.05, "*").otherwise("")
    return out.withColumns({"significant": F.coalesce(F.col("p_value") < 0.05, F.lit(False)), "stars": stars})


def decay_peak(ics: DataFrame, by: Sequence[str], horizon: str = "horizon", prefer_significant: bool = False) -> DataFrame:
    """(by, peak_horizon, peak_ic): the horizon with the greatest |ic|, null as 0, the least horizon of equal ones; with
    prefer_significant among the significant ones, if there are any."""
    size = F.coalesce(F.abs("ic"), F.lit(0.0))
    if prefer_significant:
        size = F.struct(F.coalesce("significant", F.lit(False)), size)
    return ics.groupBy(*by).agg(F.max_by(horizon, F.struct(size, -F.col(horizon))).alias("peak_horizon"), F.max_by("ic", F.struct(size, -F.col(horizon))).alias("peak_ic"))


def gate(ics: DataFrame, by: Sequence[str], least: float = 0.02, horizon: str = "horizon") -> DataFrame:
    """(by, passed, peak_horizon, peak_ic): passed if at any horizon the ic is significant and above `least` in size."""
    strong = F.coalesce((F.abs("ic") > least) & F.col("significant"), F.lit(False))
    return ics.groupBy(*by).agg(F.max(strong).alias("passed")).join(decay_peak(ics, by, horizon), list(by))


def t_statistic(ic: Column, n: Column) -> Column:
    """ic * sqrt(n - 2) / sqrt(1 - ic^2); null below 3 rows or for |ic| of 1."""
    return F.when((n >= 3) & (F.abs(ic) < 1), ic * F.sqrt(n - 2) / F.sqrt(1 - ic * ic))


def hit_rate(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 30) -> DataFrame:
    """(by, n_obs, hits, hit_rate, p_value): share of rows, both values there and not 0, whose signs agree."""
    pairs = df.where((F.col(x) != 0) & (F.col(y) != 0))
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_obs"), F.count_if(F.signum(x) == F.signum(y)).alias("hits"))
    enough = F.col("n_obs") >= least
    return out.withColumns({"hit_rate": F.when(enough, F.col("hits") / F.col("n_obs")), "p_value": F.when(enough, _binomial_p("hits", "n_obs"))})


def quantile_returns(df: DataFrame, by: Sequence[str], x: str, y: str, bins: int = 5) -> DataFrame:
    """(by, bin, n, mean_bps): mean of y in basis points by quantile bin of x; bins are closed to the right, the lowest
    value belongs to the first, equal edges are one. Groups with fewer than 30 rows a bin are absent."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    edges = quantiles(pairs, by, "_x", [i / bins for i in range(bins + 1)]).where(F.col("n") >= bins * 30)
    edges = edges.withColumn("_e", F.array_sort(F.array_distinct("quantiles"))).select(*by, F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 2, F.lit(0))).alias("_inner"))
    same = F.expr(" and ".join(f"p.`{k}` <=> e.`{k}`" for k in by) or "true")
    joined = pairs.alias("p").join(edges.alias("e"), same)
    return (
        joined.select(*[F.col(f"p.{k}") for k in by], F.size(F.filter("_inner", lambda v: v < F.col("_x"))).alias("bin"), "_y")
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"), (F.avg("_y") * 10_000).alias("mean_bps"))
    )


def monotonicity(means: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, rho, p_value, is_monotonic) of the bins of `quantile_returns` and their means."""
    ics = information(means, by, "bin", "mean_bps", least=2)
    return ics.select(*by, F.col("ic").alias("rho"), "p_value", F.coalesce((F.abs("ic") > 0.8) & (F.col("p_value") < 0.05), F.lit(False)).alias("is_monotonic"))


def _slid(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Rank correlations of all windows of n. The differences of both ranks are kept as the window slides: one comparison
    of each side with the value that leaves it and one with the value that comes."""
    out = np.empty(len(a) - n + 1)
    rings = [v[:n].copy() for v in (a, b)]
    ranks_ = np.empty((2, n))
    for rank, ring in zip(ranks_, rings):
        rank[ring.argsort(kind="stable")] = np.arange(n)
    gap = ranks_[0] - ranks_[1]
    out[0] = gap @ gap
    ra, rb = rings
    left_a, left_b, come_a, come_b = (np.empty(n, bool) for _ in range(4))
    minus_a, minus_b, plus_a, plus_b = (m.view(np.int8) for m in (left_a, left_b, come_a, come_b))
    step = np.empty(n, np.int8)
    at = 0
    for i, (x, y) in enumerate(zip(a[n:].tolist(), b[n:].tolist()), 1):
        # The value that leaves came first, so equal ones ranked above it; the one that comes ranks above its equals.
        np.greater_equal(ra, ra[at], out=left_a)
        np.greater_equal(rb, rb[at], out=left_b)
        ra[at], rb[at] = x, y
        np.greater(ra, x, out=come_a)
        np.greater(rb, y, out=come_b)
        np.subtract(plus_a, minus_a, out=step)
        step -= plus_b
        step += minus_b
        gap += step
        gap[at] = np.count_nonzero(come_b) - np.count_nonzero(come_a)
        out[i] = gap @ gap
        at = at + 1 if at + 1 < n else 0
    return 1 - out * (6 / (n * (n * n - 1.0)))


def rolling_information(df: DataFrame, x: str, y: str, n: int, out: str = "rolling_ic", keys: Sequence[str] = ("symbol",), order: str = "ts", stretch_rows: int | None = None) -> DataFrame:
    """Rows where both values are there, with the rank correlation of the last n of them; ranks are ordinal, of equal
    values the earlier is the lower. With stretch_rows a series is cut into stretches that run in parallel."""

    def step(block: dict[str, np.ndarray], state: dict) -> dict[str, np.ndarray]:
        a = np.concatenate((state.get("a", np.zeros(0)), block[x]))
        b = np.concatenate((state.get("b", np.zeros(0)), block[y]))
        size = len(block[x])
        result = np.full(size, np.nan)
        if len(a) >= n:
            rho = _slid(a, b, n)
            result[size - len(rho) :] = rho
        state["a"], state["b"] = a[len(a) - min(len(a), n - 1) :], b[len(b) - min(len(b), n - 1) :]
        return {out: result}

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if stretch_rows is None:
        return scanned(rows, keys, order, step, {out: "double"})
    return by_stretch(rows, keys, order, stretch_rows, n - 1, lambda d, k: scanned(d, k, order, step, {out: "double"}))


def rolling_summary(rolled: DataFrame, by: Sequence[str], c: str = "rolling_ic") -> DataFrame:
    return rolled.groupBy(*by).agg(
        F.avg(c).alias("mean_ic"), F.stddev_samp(c).alias("std_ic"), F.try_divide(F.avg(c), F.stddev_samp(c)).alias("ic_ir"),
        F.avg((F.col(c) > 0).cast("double")).alias("pct_positive"), F.avg((F.abs(c) > 0.05).cast("double")).alias("pct_above_5"),
    )


def _all_lags(n: int) -> int:
    """The lags to be tried on n rows when none are given."""
    return min(math.ceil(12 * (n / 100) ** 0.25), max(0, n // 2 - 3))


def dickey_fuller(df: DataFrame, x: str, keys: Sequence[str] = ("symbol",), order: str = "ts", max_lags: int | None = 24, least: int = 30) -> DataFrame:
    """(keys, n_obs, lags, statistic, p_value, critical_1, critical_5, is_stationary) of the augmented unit-root test
    with a constant; null values are left out, neighbours of theirs are successive.

    The lag is that of least AIC over the rows all lags share; the regression is then over all rows it has. max_lags
    None takes 12 * (n / 100)^(1/4) of each series, rounded up; the longest series is counted for this first. All
    regressions come from one matrix of products that the executors sum, and the first rows, which have fewer lags; so
    nothing but the number of lags squared leaves a series.
    """
    rows_ = df.where(F.col(x).isNotNull()).select(*keys, order, F.col(x).cast("double").alias("_y"))
    if max_lags is None:
        longest = rows_.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        most = _all_lags(longest)
    else:
        most = max_lags
    m = most + 3

    def step(block: dict[str, np.ndarray], state: dict) -> np.ndarray:
        y = block["_y"]
        if "base" not in state:
            state["base"] = y[0]
        kept, seen = state.get("kept", np.zeros(0)), state.get("seen", 0)
        out = np.zeros(1 + most + 1 + m * m)
        out[0] = len(y)
        head = (y - state["base"])[: max(0, most + 1 - seen)]
        out[1 + seen : 1 + seen + len(head)] = head
        levels = np.concatenate((kept, y - state["base"]))
        change = np.diff(levels)
        first = max(len(kept), 1, most + 1 - (seen - len(kept)))  # the first row with all lags
        rows = np.arange(first, len(levels))
        if len(rows):
            table = np.empty((len(rows), m))
            table[:, 0], table[:, 1], table[:, 2] = 1, levels[rows - 1], change[rows - 1]
            for k in range(1, most + 1):
                table[:, 2 + k] = change[rows - 1 - k]
            out[2 + most :] = (table.T @ table).ravel()
        state["kept"], state["seen"] = levels[-(most + 2) :], seen + len(y)
        return out

    sums = folded(rows_, keys, order, step, 2 + most + m * m)

    @F.pandas_udf("n_obs long, lags long, statistic double, p_value double, critical_1 double, critical_5 double")
    def solve(all_: pd.Series) -> pd.DataFrame:
        out = []
        for sums in all_:
            sums = np.asarray(sums)
            n = int(round(sums[0]))
            head = np.diff(sums[1 : 1 + min(n, most + 1)])
            above = np.zeros((most + 1, m, m))  # of rows that have at least so many lags
            above[most] = sums[2 + most :].reshape(m, m)
            for a in reversed(range(most)):
                above[a] = above[a + 1]
                if a < len(head):
                    row = np.zeros(m)
                    row[:3] = 1, sums[1 + a], head[a]
                    row[3 : 3 + a] = head[:a][::-1]
                    above[a] += np.outer(row, row)
            top = min(most, max(0, n // 2 - 3)) if max_lags is not None else _all_lags(n)
            if n < max(least, 4):
                out.append((n, None, None, None, None, None))
                continue

            def fit(g: np.ndarray, lags: int) -> tuple[float, np.ndarray, np.ndarray, float]:
                use = [0, 1, *range(3, 3 + lags)]
                a, b = g[np.ix_(use, use)], g[use, 2]
                inverse = np.linalg.pinv(a)
                beta = inverse @ b
                return float(g[2, 2] - beta @ b), beta, inverse, g[0, 0]

            best = None
            for lags in range(top + 1):
                rss, _, _, rows = fit(above[top], lags)
                aic = rows * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / rows) + 1) + 2 * (lags + 2)
                best = min(best or (math.inf, 0), (aic, lags))
            lags = best[1]
            rss, beta, inverse, rows = fit(above[lags], lags)
            tau = float(beta[1] / math.sqrt(max(rss, 0) / (rows - lags - 2) * inverse[1, 1])) if rss > 0 else float("nan")
            critical = dist.mackinnon_critical(int(rows))
            out.append((n, lags, tau, dist.mackinnon_p(tau) if tau == tau else None, critical["1%"], critical["5%"]))
        return pd.DataFrame(out, columns=["n_obs", "lags", "statistic", "p_value", "critical_1", "critical_5"])

    found = sums.select(*keys, solve("sums").alias("r")).select(*keys, "r.*")
    return found.withColumn("is_stationary", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def lag_products(df: DataFrame, x: str, most: int, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, n, mean, products): sums of products of deviations from the mean, `most` lags apart at most, lag 0 first."""
    mean = df.groupBy(*keys).agg(F.avg(x).alias("_m"))
    same = F.expr(" and ".join(f"a.`{k}` <=> b.`{k}`" for k in keys))
    own = df.where(F.col(x).isNotNull()).alias("a").join(mean.alias("b"), same).select(*[F.col(f"a.{k}") for k in keys], f"a.{order}", (F.col(f"a.{x}") - F.col("b._m")).alias("_e"), F.col("b._m").alias("_m"))

    def step(block: dict[str, np.ndarray], state: dict) -> np.ndarray:
        kept = state.get("kept", np.zeros(0))
        e = np.concatenate((kept, block["_e"]))
        n, size = len(block["_e"]), len(kept)
        out = np.zeros(most + 4)
        out[0], out[1] = n, 0.0 if "mean" in state else block["_m"][0]
        state["mean"] = True
        for k in range(most + 1):
            first = max(size, k)
            if first < len(e):
                out[2 + k] = e[first:] @ e[first - k : len(e) - k]
        run = state.get("run", 0.0) + np.cumsum(block["_e"])
        out[most + 3] = run @ run  # squares of partial sums
        state["run"] = run[-1]
        state["kept"] = e[max(0, len(e) - most) :]
        return out

    sums = folded(own, keys, order, step, most + 4)
    return sums.select(*keys, F.col("sums")[0].cast("bigint").alias("n"), F.col("sums")[1].alias("mean"), F.slice("sums", 3, most + 1).alias("products"), F.col("sums")[most + 3].alias("partial_squares"))


def autocorrelation(df: DataFrame, x: str, lags: int = 20, keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """(keys, lag, acf, pacf, q, p_value, outside): autocorrelations, partial ones (Levinson-Durbin), Ljung-Box Q up to
    each lag with its p, and whether the autocorrelation lies beyond 1.96 / sqrt(n)."""
    found = lag_products(df, x, lags, keys, order)

    @F.pandas_udf("array<double>")
    def partial(products: pd.Series) -> pd.Series:
        out = []
        for p in products:
            r = np.array(p) / p[0] if p[0] else np.full(len(p), np.nan)
            phi, values, v = np.zeros(0), [], 1.0
            for k in range(1, len(r)):
                a = (r[k] - phi @ r[k - 1 : 0 : -1]) / v if v else np.nan
                phi = np.concatenate((phi - a * phi[::-1], [a]))
                v *= 1 - a * a
                values.append(float(a))
            out.append(values)
        return pd.Series(out)

    n = F.col("n").cast("double")
    rho = F.transform(F.slice("products", 2, lags), lambda p: F.try_divide(p, F.col("products")[0]))
    one = found.select(*keys, n.alias("n"), F.arrays_zip(rho.alias("acf"), partial("products").alias("pacf")).alias("z"))
    each = one.select(*keys, "n", F.posexplode("z").alias("k", "z")).select(*keys, "n", (F.col("k") + 1).alias("lag"), "z.acf", "z.pacf")
    w = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("n") * (F.col("n") + 2) * F.sum(F.try_divide(F.col("acf") * F.col("acf"), F.col("n") - F.col("lag"))).over(w)
    return each.withColumn("q", q).select(*keys, "lag", "acf", "pacf", "q", _chi2_p("q", "lag").alias("p_value"), (F.abs("acf") > 1.96 / F.sqrt("n")).alias("outside"))


def _bandwidth(n: int, p: Sequence[float]) -> int | None:
    """The plug-in number of lags of Hobijn, Franses and Ooms of n rows, from their first products; None if they vanish."""
    cover = int(n ** (2 / 9))
    s0 = p[0] / n + sum(p[i] / (n / 2) for i in range(1, cover + 1))
    s1 = sum(i * p[i] / (n / 2) for i in range(1, cover + 1))
    return min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 and p[0] else None


def level_stationarity(df: DataFrame, x: str, keys: Sequence[str] = ("symbol",), order: str = "ts", most: int = 256) -> DataFrame:
    """(keys, n_obs, lags, statistic, p_value): KPSS around a constant, with the plug-in number of lags of Hobijn,
    Franses and Ooms.

    The products of the first `most` lags, a row a series, are written to the shared folder once; if any series asks for
    more lags, as many as it asks for are computed.
    """
    found = written(lag_products(df, x, most, keys, order), "products")

    @F.pandas_udf("long")
    def asked(n_: pd.Series, products: pd.Series) -> pd.Series:
        return pd.Series([_bandwidth(n, p) or 0 for n, p in zip(n_, products)], dtype="int64")

    needed = found.agg(F.max(asked("n", "products"))).first()[0]
    if needed is not None and needed > most:
        found = lag_products(df, x, needed, keys, order)

    @F.pandas_udf("lags long, statistic double, p_value double")
    def solve(n_: pd.Series, products: pd.Series, squares: pd.Series) -> pd.DataFrame:
        out = []
        for n, p, s in zip(n_, products, squares):
            p = np.array(p)
            lags = _bandwidth(n, p)
            if lags is None:
                out.append((None, None, None))
                continue
            variance = (p[0] + 2 * sum(p[i] * (1 - i / (lags + 1)) for i in range(1, lags + 1))) / n
            eta = s / n**2 / variance
            out.append((lags, eta, dist.kpss_p(eta)))
        return pd.DataFrame(out, columns=["lags", "statistic", "p_value"])

    return found.select(*keys, F.col("n").alias("n_obs"), solve("n", "products", "partial_squares").alias("r")).select(*keys, "n_obs", "r.*")


def verdict(adf_p: Column, kpss_p: Column, alpha: float = 0.05) -> Column:
    """What both tests say together: stationary, non-stationary, or one of the two only."""
    a, k = adf_p < alpha, kpss_p >= alpha
    return F.when(a & k, "stationary").when(~a & ~k, "non-stationary").when(a, "difference-stationary").otherwise("trend-stationary")


def arch_lm(df: DataFrame, x: str, lags: int = 10, keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """(keys, n_obs, lm, lm_p, f, f_p): squared values regressed on their last `lags`."""
    m = lags + 2

    def step(block: dict[str, np.ndarray], state: dict) -> np.ndarray:
        s = np.concatenate((state.get("kept", np.zeros(0)), block["_s"]))
        state["kept"] = s[-lags:]
        first = max(len(s) - len(block["_s"]), lags)
        if first >= len(s):
            return np.zeros(m * m)
        rows = np.arange(first, len(s))
        table = np.column_stack([np.ones(len(rows)), s[rows], *[s[rows - k] for k in range(1, lags + 1)]])
        return (table.T @ table).ravel()

    sums = folded(df.where(F.col(x).isNotNull()).select(*keys, order, (F.col(x) * F.col(x)).cast("double").alias("_s")), keys, order, step, m * m)

    @F.pandas_udf("n_obs long, lm double, lm_p double, f double, f_p double")
    def solve(all_: pd.Series) -> pd.DataFrame:
        out = []
        for sums in all_:
            g = np.array(sums).reshape(m, m)
            n, use = g[0, 0], [0, *range(2, m)]
            if n <= lags + 1:
                out.append((int(n), None, None, None, None))
                continue
            beta = np.linalg.pinv(g[np.ix_(use, use)], hermitian=True) @ g[use, 1]
            total = g[1, 1] - g[0, 1] ** 2 / n
            r2 = 1 - (g[1, 1] - beta @ g[use, 1]) / total if total > 0 else 0.0
            f = (r2 / lags) / ((1 - r2) / (n - lags - 1))
            out.append((int(n), n * r2, dist.chi_square_tail(n * r2, lags), f, dist.f_tail(f, lags, n - lags - 1)))
        return pd.DataFrame(out, columns=["n_obs", "lm", "lm_p", "f", "f_p"])

    return sums.select(*keys, solve("sums").alias("r")).select(*keys, "r.*")


def correlations(df: DataFrame, features: Sequence[str], method: str = "spearman", least: int = 30) -> DataFrame:
    """(feature_a, feature_b, corr, n_obs) for each pair a before b in the order given, over rows where both are there;
    null below `least` rows. pearson: four matrices of sums a task, nothing is exploded. spearman: ranks of a pair depend
    on where both are there, so rows are exploded by pairs of features: for a few dozen features."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    if method == "pearson":
        return _pearson(df, features, pairs, least)
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("x is not null and y is not null")
    by = ("feature_a", "feature_b")
    if method == "spearman":
        return information(rows, by, "x", "y", least).select(*by, F.col("ic").alias("corr"), "n_obs")
    raise ValueError(f"unknown method {method!r}")


def _pearson(df: DataFrame, features: Sequence[str], pairs: Sequence[tuple[str, str]], least: int) -> DataFrame:
    """`correlations` from sums over the rows where both are there: n, x, y, xx, yy and xy, for all pairs by products of
    whole matrices. Values are taken from the features' means, so that the sums keep their digits."""
    k = len(features)
    means = df.agg(*[F.avg(F.col(f).cast("double")) for f in features]).first()
    centre = np.array([0.0 if m is None or m != m else m for m in means])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns]) - centre
            there = ~np.isnan(x)
            x, own = np.where(there, x, 0.0), there.astype(float)
            total += np.stack((own.T @ own, x.T @ own, (x * x).T @ own, x.T @ x))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())], ["i", "v"])

    cells = df.select(*[F.col(f).cast("double") for f in features]).mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    named = df.sparkSession.createDataFrame(
        [(a, b, c, (m * k + i) * k + j) for a, b in pairs for i, j in [(features.index(a), features.index(b))] for c, m, i, j in (("n", 0, i, j), ("x", 1, i, j), ("y", 1, j, i), ("xx", 2, i, j), ("yy", 2, j, i), ("xy", 3, i, j))],
        "feature_a string, feature_b string, c string, i int",
    )
    wide = named.join(cells, "i").groupBy("feature_a", "feature_b").pivot("c", ["n", "x", "y", "xx", "yy", "xy"]).agg(F.first("v"))
    c = F.col
    corr = F.try_divide(c("n") * c("xy") - c("x") * c("y"), F.sqrt((c("n") * c("xx") - c("x") * c("x")) * (c("n") * c("yy") - c("y") * c("y"))))
    return wide.select("feature_a", "feature_b", F.when((c("n") >= least) & ~F.isnan(corr), corr).alias("corr"), c("n").cast("bigint").alias("n_obs"))


def redundant(matrix: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs whose correlation is above the threshold in size."""
    return matrix.where(F.abs("corr") > threshold)


def redundancies(matrix: DataFrame, sizes: dict[str, float], threshold: float = 0.7) -> dict[str, str | None]:
    """Each feature, by falling size of its IC, in the order given for equal ones: None if it is kept, or that one of
    those kept before which it correlates with most, above the threshold. The matrix of a few features is brought to
    the driver."""
    corr = {frozenset((r.feature_a, r.feature_b)): abs(r.corr) for r in matrix.where("corr is not null").collect()}
    out: dict[str, str | None] = {}
    for f in sorted(sizes, key=lambda f: -abs(sizes[f])):
        near = {k: c for k, of in out.items() if of is None and (c := corr.get(frozenset((f, k)), 0.0)) > threshold}
        out[f] = max(near, key=lambda k: near[k]) if near else None
    return out


def greedy_selection(matrix: DataFrame, sizes: dict[str, float], threshold: float = 0.7) -> tuple[list[str], list[str]]:
    """(kept, dropped): features by falling size of their IC; each is kept unless it correlates above the threshold with
    one kept before, as `redundancies` says."""
    found = redundancies(matrix, sizes, threshold)
    return [f for f, of in found.items() if of is None], [f for f in sizes if found[f] is not None]


def walk_forward(df: DataFrame, feature: str, horizon: int, period: int = 6048, keys: Sequence[str] = ("symbol",), order: str = "ts", price: str = "close", least: int = 30) -> DataFrame:
    """(keys, block, ic, n_obs, p_value, significant ...) of successive blocks of `period` rows with a price. Forward
    returns are taken before rows are cut into blocks; blocks with fewer than `least` pairs are absent."""
    rows = df.where(F.col(price).isNotNull())
    w = whole(keys, order)
    rows = rows.withColumns({"_f": F.ln(F.try_divide(F.lead(price, horizon).over(w), F.col(price))), "block": F.floor((F.row_number().over(w) - 1) / period)})
    return information(rows, (*keys, "block"), feature, "_f", least).where("ic is not null")


def stability(blocks: DataFrame, by: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """(by, n_periods, mean_ic, std_ic, sign_consistency, pct_significant, is_stable) of `walk_forward` blocks."""
    mean = blocks.groupBy(*by).agg(F.avg("ic").alias("_m"))
    same = F.expr(" and ".join(f"a.`{k}` <=> b.`{k}`" for k in by))
    both = blocks.alias("a").join(mean.alias("b"), same)
    out = both.groupBy(*[F.col(f"a.{k}").alias(k) for k in by]).agg(
        F.count("ic").alias("n_periods"),
        F.avg("ic").alias("mean_ic"),
        F.stddev_samp("ic").alias("std_ic"),
        F.avg(F.when(F.col("_m") == 0, 0.5).otherwise((F.signum("ic") == F.signum("_m")).cast("double"))).alias("sign_consistency"),
        F.avg(F.col("significant").cast("double")).alias("pct_significant"),
    )
    return out.withColumn("is_stable", F.col("sign_consistency") >= threshold)


def event_decay(df: DataFrame, feature: str, log_return: str, thresholds: DataFrame, horizons: Sequence[int], lookback: int, keys: Sequence[str] = ("symbol",), order: str = "ts", least: int = 10) -> DataFrame:
    """(keys, threshold, horizon, n_events, mean_signed_bps, t_stat, pct_positive): rows whose feature over its rolling
    deviation lies beyond a threshold, and the sums of the next returns, signed against it. Measures are null below
    `least` events. thresholds: a small table, checked and sent to all executors."""
    from barloom.operators.backtest import crossed
    from barloom.operators.series import Series

    s = Series(df, tuple(keys), order).over_std("_z", feature, lookback)
    for h in horizons:
        s = s.forward_sum(f"_h{h}", h, log_return)
    rows = s.df.where("_z is not null").unpivot([*keys, "_z"], [f"_h{h}" for h in horizons], "_h", "_f").where("_f is not null")
    events = crossed(rows, thresholds).where(F.abs("_z") > F.col("threshold"))
    r = -F.signum("_z") * F.col("_f") * 10_000
    out = events.groupBy(*keys, "threshold", F.substring("_h", 3, 9).cast("int").alias("horizon")).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"), F.avg((r > 0).cast("double")).alias("_p")
    )
    enough = lambda c: F.when(F.col("n_events") >= least, c)
    return out.select(*keys, "threshold", "horizon", "n_events", enough(F.col("_m")).alias("mean_signed_bps"), enough(F.try_divide(F.col("_m"), F.col("_s") / F.sqrt("n_events"))).alias("t_stat"), enough(F.col("_p")).alias("pct_positive"))


def transitions(df: DataFrame, regime: str, keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """(keys, before, after, n, pct): moves between successive rows' regimes, in percent of those from the first one."""
    moves = df.where(F.col(regime).isNotNull()).withColumn("before", F.lag(regime).over(whole(keys, order))).where("before is not null")
    counts = moves.groupBy(*keys, "before", F.col(regime).alias("after")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*keys, "before")))


def quartile_regimes(df: DataFrame, x: str, out: str = "regime", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """`df` with `low`, `medium` or `high` by the whole series' quartiles (strictly beyond), which looks ahead."""
    q = quantiles(df, keys, x, (0.25, 0.75)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("quantiles")[0].alias("_a"), F.col("quantiles")[1].alias("_b"))
    joined = df.join(q, F.expr(" and ".join(f"`{k}` <=> _k{i}" for i, k in enumerate(keys))), "left")
    name = F.when(F.col(x) > F.col("_b"), "high").when(F.col(x) < F.col("_a"), "low").when(F.col(x).isNotNull(), "medium")
    return joined.withColumn(out, name).drop("_a", "_b", *[f"_k{i}" for i in range(len(keys))])


def lambda_calibration(df: DataFrame, trends: Sequence[str], keys: Sequence[str] = ("symbol",), order: str = "ts", price: str = "close") -> DataFrame:
    """(keys, trend_a, trend_b, slope_corr, std_gap, last_gap) of neighbouring trends: rank correlation of their slopes,
    deviation of their difference, and the last value of the second against the price."""
    w = whole(keys, order)
    cells = [
        F.struct(F.lit(a).alias("trend_a"), F.lit(b).alias("trend_b"), (F.col(a) - F.lag(a).over(w)).alias("x"), (F.col(b) - F.lag(b).over(w)).alias("y"), (F.col(a) - F.col(b)).alias("gap"), (F.col(b) - F.col(price)).alias("off"))
        for a, b in zip(trends, trends[1:])
    ]
    rows = df.select(*keys, order, F.array(*cells).alias("c")).select(*keys, order, F.inline("c"))
    by = (*keys, "trend_a", "trend_b")
    gaps = rows.groupBy(*by).agg(F.stddev_samp("gap").alias("std_gap"), F.max_by("off", order).alias("last_gap"))
    return information(rows, by, "x", "y").select(*by, F.col("ic").alias("slope_corr")).join(gaps, list(by))


def univariate_summary(adf: DataFrame, peaks: DataFrame, rolling: DataFrame, hits: DataFrame, mono: DataFrame, by: Sequence[str] = ("feature",), ic_threshold: float = 0.05) -> DataFrame:
    """One row a feature from the results of the single tests, with passed and reject_reason: non-stationary first, then
    a peak IC below the threshold."""
    one = adf.select(*by, F.col("p_value").alias("adf_p"), "is_stationary")
    for other in (peaks.select(*by, "peak_horizon", "peak_ic"), rolling.select(*by, "mean_ic", "std_ic", "ic_ir"), hits.select(*by, "hit_rate"), mono.select(*by, "rho", "is_monotonic")):
        one = one.join(other, list(by), "left")
    weak = F.coalesce(F.abs("peak_ic") < ic_threshold, F.lit(True))
    reason = F.when(~F.col("is_stationary"), "non-stationary").when(weak, "weak IC").otherwise("")
    return one.withColumn("reject_reason", reason).withColumn("passed", F.col("reject_reason") == "")


def selection(features: DataFrame, ic_threshold: float = 0.03, t_threshold: float = 2.0, adf_threshold: float = 0.05, sign_threshold: float = 0.7) -> DataFrame:
    """features: feature, ic, n_obs, adf_p, sign_consistency, redundant_with (null if kept). Adds t_stat, five passes_*
    columns, passed and reject_reasons, ordered by |ic| falling, null as 0."""
    t = t_statistic(F.col("ic"), F.col("n_obs"))
    truth = lambda c: F.coalesce(c, F.lit(False))
    out = features.withColumn("t_stat", t).withColumns({
        "passes_ic": truth(F.abs("ic") > ic_threshold),
        "passes_t_stat": truth(F.abs("t_stat") > t_threshold),
        "passes_stationarity": truth(F.col("adf_p") < adf_threshold),
        "passes_stability": truth(F.col("sign_consistency") >= sign_threshold),
        "passes_redundancy": F.col("redundant_with").isNull(),
    })
    why = (("passes_ic", "weak IC"), ("passes_t_stat", "weak t"), ("passes_stationarity", "non-stationary"), ("passes_stability", "unstable sign"))
    reasons = F.concat_ws("; ", *[F.when(~F.col(c), F.lit(text)) for c, text in why], F.when(F.col("redundant_with").isNotNull(), F.concat(F.lit("redundant with "), "redundant_with")))
    return out.withColumn("reject_reasons", reasons).withColumn("passed", F.col("reject_reasons") == "").orderBy(F.coalesce(F.abs("ic"), F.lit(0.0)).desc(), "feature")
