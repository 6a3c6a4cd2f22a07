"""SQL for queries that need recursion, solves or integrals in SQL. Nothing here takes a result of the engine's own code,
but for the weights of the grid of trends, which double precision can't solve for."""

from __future__ import annotations

from statistics import NormalDist

from barloom.operators.trend import endpoint_weights
from barloom.plans import research
from barloom.plans.research import LR, W, H, chain, over, r, roll

QUERIES: dict = {}
SQL: dict[str, str] = {}
FEATURES = research._FEATURES_SQL
HOURLY = f"with recursive {H}"


# -- trends: the banded system by elimination, row by row


def weights(name: str, lam: float, n: int) -> str:
    """CTEs that solve for the last row of the inverse of I + lam K'K; `name` has it as one list w."""
    inner = lambda i: f"(case when {i} <= {n - 3} then 1 else 0 end)"
    mid = lambda i: f"(case when {i} >= 1 and {i} <= {n - 2} then 1 else 0 end)"
    diagonal = lambda i: f"(1 + {lam!r}::double * ({inner(i)} + 4 * {mid(i)} + (case when {i} >= 2 then 1 else 0 end)))"
    one = lambda i: f"({lam!r}::double * -2 * ({inner(i)} + {mid(i)}))"
    two = lambda i: f"({lam!r}::double * {inner(i)})"
    return f"""{name}_l(i, d, e, f, d1, f1) as (
  select 0, {diagonal(0)}, {one(0)} / {diagonal(0)}, {two(0)} / {diagonal(0)}, 0::double, 0::double
  union all select i, d, ({one("i")} - e0 * f0 * d0) / d, {two("i")} / d, d0, f0 from (
    select i + 1 as i, {diagonal("(i + 1)")} - e * e * d - f1 * f1 * d1 as d, e as e0, f as f0, d as d0 from {name}_l where i < {n - 1})),
{name}_x(i, x, x1) as (
  select i, 1 / d, 0::double from {name}_l where i = {n - 1}
  union all select l.i, -(l.e * x.x + l.f * x.x1), x.x from {name}_x x join {name}_l l on l.i = x.i - 1),
{name} as (select list(x order by i)::double[] as w from {name}_x)"""


def filtered(w: str, n: int, out: str, prices: str = "ps") -> str:
    return f"case when len({prices}) = {n} then {prices}[-1] + list_dot_product(list_transform({prices}, lambda p: p - {prices}[-1]), (select w from {w})) end as {out}"


_TRENDS = f"{HOURLY}, {weights('w4', 1e4, 60)}, {weights('w6', 1e6, 60)}, a as (select *, list(close) over {over(60)} as ps from h), b as (select *, {filtered('w4', 60, 't1')}, {filtered('w6', 60, 't2')} from a)"
SQL["hp_causal"] = SQL["hp_causal_stretched"] = _TRENDS + " select symbol, ts, round(t1, 4) as t1, round(t2, 4) as t2 from b"
SQL["lambda_sens"] = _TRENDS + f", c as (select *, t1 - lag(t1) over {W} as s1, t2 - lag(t2) over {W} as s2 from b) select symbol, ts, round(abs(s1 - s2) / sqrt(2), 4) as ls from c"

_GRID = {"hp_1m": 1e6, "hp_10m": 1e7, "hp_100m": 1e8, "hp_1b": 1e9, "hp_3_9b": 3.9e9, "hp_100b": 1e11}
_GRID_SQL = (
    "select symbol, ts, "
    + ", ".join(f"round(case when len(ps) = 500 then ps[-1] + list_dot_product(list_transform(ps, lambda p: p - ps[-1]), {list(endpoint_weights(lam, 500))}::double[]) end, 6) as {out}" for out, lam in _GRID.items())
    + f" from (select symbol, ts, list(close) over {over(500)} as ps from h)"
)
MINUTES = """h as (select 'ALL' as symbol, date_trunc('minute', e.ts) as ts, first(e.value order by e.ts, e.event_id) as open, max(e.value) as high,
  min(e.value) as low, last(e.value order by e.ts, e.event_id) as close, count(e.value)::double as volume from events e where e.value is not null group by 1, 2)"""
SQL["hp_grid_cache"] = f"with {H} {_GRID_SQL}"
SQL["hp_minutes"] = f"with {MINUTES} {_GRID_SQL}"

_LAM = "14400::double"
SQL["hp_two_sided"] = f"""{HOURLY}, n as materialized (select symbol, ts, close as y, row_number() over {W} - 1 as i, count(*) over (partition by symbol) as n from h),
g as materialized (select *, 1 + {_LAM} * ((i <= n - 3)::int + 4 * (i >= 1 and i <= n - 2)::int + (i >= 2)::int) as dg, {_LAM} * -2 * ((i <= n - 3)::int + (i >= 1 and i <= n - 2)::int) as o1, {_LAM} * (i <= n - 3)::int as o2 from n),
l(symbol, i, d, e, f, z, d1, f1, z1) as (
  select symbol, i, dg, o1 / dg, o2 / dg, y, 0::double, 0::double, 0::double from g where i = 0
  union all select symbol, i, d, (o1 - e0 * f0 * d0) / d, o2 / d, z, d0, f0, z0 from (
    select g.symbol, g.i, g.o1, g.o2, g.dg - l.e * l.e * l.d - l.f1 * l.f1 * l.d1 as d, g.y - l.e * l.z - l.f1 * l.z1 as z, l.e as e0, l.f as f0, l.d as d0, l.z as z0 from l join g on g.symbol = l.symbol and g.i = l.i + 1)),
lm as materialized (select * from l),
x(symbol, i, x, x1) as (
  select symbol, i, z / d, 0::double from lm where i = (select max(i) from lm m where m.symbol = lm.symbol)
  union all select l.symbol, l.i, l.z / l.d - l.e * x.x - l.f * x.x1, x.x from x join lm l on l.symbol = x.symbol and l.i = x.i - 1),
t as (select n.symbol, ts, x as trend, y - x as cycle from x join n on n.symbol = x.symbol and n.i = x.i),
u as (select *, (cycle - {roll('avg', 'cycle', 50)}) / nullif({roll('stddev_samp', 'cycle', 50)}, 0) as cycle_z from t)
select symbol, ts, round(trend, 6) as trend, round(cycle, 6) as cycle, round(cycle_z, 6) as cycle_z from u"""


# -- the machines, a row at a time


def machine(source: str, x: str, sigma: str, hold: str, lookback: int, confirm: int | None, keys: tuple[str, ...] = ("symbol",), name: str = "mc") -> str:
    """CTEs; `name` has the keys, ts and sig. confirm None: entries where a row newly lies beyond a threshold."""
    by = ", ".join(keys)
    ahead = f"(partition by {by} order by ts rows between {lookback - 1} preceding and current row)"
    mine = " and ".join(f"m.{k} = s.{k}" for k in keys)
    fresh = "side <> 0 and side <> prev" if confirm is None else f"run > {confirm}"
    return f"""{name}_a as (select *, case when count({x}) over {ahead} >= {lookback} then stddev_samp({x}) over {ahead} end as spread from {source}),
{name}_b as (select *, coalesce({x} is not null and spread is not null and spread <> 0, false) as can, case when {x} > {sigma} * spread then 1 when {x} < -{sigma} * spread then -1 else 0 end as raw from {name}_a),
{name}_c as (select *, case when can then raw else 0 end as side, row_number() over (partition by {by} order by ts) as k from {name}_b),
{name}_m as materialized (select {by}, ts, k, can, side, {hold} as hold, coalesce(last_value(case when can then side end ignore nulls) over (partition by {by} order by ts rows between unbounded preceding and 1 preceding), 0) as prev from {name}_c),
{name}_s({by}, k, pos, opened, run, runside) as (
  select {by}, 0::bigint, 0, 0::bigint, 0, 0 from {name}_m group by {by}
  union all select {by}, k, case when pos0 <> 0 and ends then 0 when pos0 <> 0 then pos0 when {fresh} then -side else 0 end,
    case when pos0 = 0 then k else opened end, case when pos0 <> 0 then 0 else run end, case when pos0 <> 0 then 0 else side end
  from (select {", ".join(f"m.{k}" for k in keys)}, m.k, m.side, m.prev, s.pos as pos0, s.opened, m.side = s.pos or (m.can and m.k - s.opened >= m.hold) as ends,
      case when m.side = 0 then 0 when m.side = s.runside then s.run + 1 else 1 end as run from {name}_s s join {name}_m m on {mine} and m.k = s.k + 1)),
{name} as (select {", ".join(f"m.{k}" for k in keys)}, m.ts, s.pos::double as sig from {name}_s s join {name}_m m on {mine} and m.k = s.k)"""


SQL["crossing_signal"] = f"{FEATURES}, {machine('f', 'td', '1.0', '24', 100, None)} select symbol, ts, sig from mc"
SQL["threshold_signal"] = f"{FEATURES}, {machine('f', 'td', '1.0', '24', 100, 1)} select symbol, ts, sig from mc"
SQL["stream_signals"] = f"with recursive v as (select event_type as symbol, ts, value from events), {machine('v', 'value', '1.5', '10', 50, None)} select symbol, ts, sig as signal from mc"


def tested(source: str, by: tuple[str, ...], signal: str = "signal") -> str:
    """CTEs of a backtest of `source` by keys; `pk` has every row."""
    w = f"(partition by {', '.join(by)} order by ts)"
    upto = f"(partition by {', '.join(by)} order by ts rows between unbounded preceding and current row)"
    return f"""c as (select *, coalesce(lag({signal}) over {w}, 0) as position, coalesce(close / nullif(lag(close) over {w}, 0) - 1, 0) as ret from {source}),
e as (select *, coalesce(position - lag(position) over {w}, 0) as trade from c),
n as (select *, position * ret - abs(trade) * 0.00009 as net_return from e),
q as (select *, product(1 + net_return) over {upto} as equity from n),
pk as (select *, max(equity) over {upto} as peak from q)"""


_VP = f"""vp0 as (select *, list(rv) filter (where rv is not null) over {over(100)} as vs from f),
vp as (select *, case when len(vs) >= 100 and rv is not null then (len(list_filter(vs, lambda x: x < rv)) + (len(list_filter(vs, lambda x: x = rv)) + 1) / 2.0) / len(vs) * 100 end as vp from vp0),
gr as (select symbol, ts, close, td, vp, sigma, hold from vp, (values (0.5::double, 12), (0.5, 24), (1.0, 12), (1.0, 24)) t(sigma, hold))"""
_KEYS = ("symbol", "sigma", "hold", "floor")
SQL["signal_grid"] = f"""{FEATURES}, {_VP}, {machine('gr', 'td', 'sigma', 'hold', 100, None, ('symbol', 'sigma', 'hold'))},
fl as (select gr.*, floor, case when coalesce(vp < floor, true) then 0 else sig end::double as signal from gr join mc using (symbol, sigma, hold, ts), (values (0.0::double), (50.0)) t(floor)), {tested('fl', _KEYS)}
select {", ".join(_KEYS)}, {research._METRICS} from pk group by all"""

_MF = f"""{HOURLY}, {weights('w4', 1e4, 50)}, a0 as (select *, list(close) over {over(50)} as ps, greatest(high - low, abs(high - lag(close) over {W}), abs(low - lag(close) over {W})) as tr from h),
a1 as (select *, {filtered('w4', 50, 'trend')}, {roll('avg', 'tr', 20)} as atr from a0),
a2 as (select *, -({roll('avg', 'trend', 10)} - {roll('avg', 'trend', 30)}) / nullif(atr, 0) as x1, -(trend - {roll('avg', 'trend', 30)}) / nullif(atr, 0) as x2,
  {roll('avg', 'trend', 10)} - {roll('avg', 'trend', 30)} as sp, abs(trend - lag(trend, 20) over {W}) / nullif(atr, 0) as st from a1),
a3 as (select *, case when sp > 0 then -1.0::double when sp is not null then 1.0::double end as x3, list(st) filter (where st is not null) over {over(100)} as vs from a2),
a4 as (select *, case when len(vs) >= 30 then len(list_filter(vs, lambda v: v <= vs[-1])) / len(vs)::double * 100 end as x4 from a3),
a5 as (select *, {", ".join(f"(x{i} - {roll('avg', f'x{i}', 100, 30)}) / nullif({roll('stddev_samp', f'x{i}', 100, 30)}, 0) as n{i}" for i in range(1, 5))} from a4),
a6 as (select symbol, ts, close, ({" + ".join(f"coalesce(n{i}, 0) * 0.25" for i in range(1, 5))}) / nullif({" + ".join(f"(n{i} is not null)::int * 0.25" for i in range(1, 5))}, 0) as combined from a5),
mf as (select *, case when combined > 0.3 then 1.0 when combined < -0.3 then -1.0 else 0 end::double as signal from a6)"""
SQL["multi_factor"] = _MF + " select symbol, ts, round(combined, 6) as combined, signal from mf"
SQL["multi_factor_backtest"] = f"""{_MF}, {tested('mf', ('symbol',))} select symbol, count(net_return) as n_obs, round(avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt(6048), 6) as sharpe,
  round(log10(nullif(1 + (pow(1 + avg(net_return), 6048) - 1), 0)), 6) as annual_log, round(min(equity / peak - 1), 6) as max_drawdown, count(*) filter (where trade <> 0) as n_trades from pk group by 1"""


# -- rolling rank correlation: ordinal ranks of each window


def rolling_rank(source: str, x: str, y: str, n: int, by: str = "symbol") -> str:
    place = lambda c: f"list_transform(list_sort(list_transform({c}, lambda v, i: struct_pack(v := v, i := i))), lambda s: s.i)"
    return f"""rr as (select *, list({x}) over (partition by {by} order by ts rows between {n - 1} preceding and current row) as xs, list({y}) over (partition by {by} order by ts rows between {n - 1} preceding and current row) as ys from {source} where {x} is not null and {y} is not null),
ro as (select * exclude (xs, ys), case when len(xs) = {n} then list_transform(list_sort(list_transform({place('xs')}, lambda v, i: struct_pack(v := v, i := i))), lambda s: s.i) end as rx, case when len(xs) = {n} then list_transform(list_sort(list_transform({place('ys')}, lambda v, i: struct_pack(v := v, i := i))), lambda s: s.i) end as ry from rr),
rc as (select * exclude (rx, ry), 1 - 6 * list_sum(list_transform(list_zip(rx, ry), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / ({n}::double * ({n}::double * {n} - 1)) as rolling_ic from ro)"""


_SUMMARY = "round(avg(rolling_ic), 6) as mean_ic, round(stddev_samp(rolling_ic), 6) as std_ic, round(avg(rolling_ic) / stddev_samp(rolling_ic), 6) as ic_ir, round(avg((rolling_ic > 0)::int), 6) as pct_positive, round(avg((abs(rolling_ic) > 0.05)::int), 6) as pct_above_5"
SQL["rolling_ic"] = f"{FEATURES}, {rolling_rank('f', 'td', 'f4', 200)} select symbol, {_SUMMARY} from rc group by 1"
SQL["rolling_ic_minutes"] = f"with {MINUTES}, f as (select symbol, ts, round(ln(close) - lag(ln(close), 24) over {W}, 12) as mom, round(ln(lead(close, 24) over {W} / close), 12) as f24 from h), {rolling_rank('f', 'mom', 'f24', 1000)} select symbol, ts, round(rolling_ic, 9) as rolling_ic from rc"

# -- streams


SQL["stream_sliding"] = """with e as (select event_type as symbol, ts as t, value as v, event_id, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as w from events where value is not null)
select symbol, w as ts, round(first(v order by t, event_id), 6) as open, round(max(v), 6) as high, round(min(v), 6) as low, round(last(v order by t, event_id), 6) as close, count(v)::double as volume from e group by 1, 2"""
SQL["stream_sessions"] = """with m as (select max(ts) - interval 2 hour as mark from events),
g as (select user_id as key, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 day then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by key order by ts rows between unbounded preceding and current row) as run from g),
x as (select key, min(ts) as start, max(ts) + interval 1 day as "end", count(*) as n from s group by key, run)
select key, start, "end", n from x, m where "end" <= mark"""

# -- tail probabilities by Simpson's rule


def _simpson(f: str, upto: str, n: int = 4000) -> str:
    """The integral of f, a function of u, from 0 to `upto`."""
    weight = f"(case when i = 0 or i = {n} then 1 when i % 2 = 1 then 4 else 2 end)"
    return f"({upto}) / {3 * n} * list_sum(list_transform(range(0, {n + 1}), lambda i: {weight} * ({f.replace('{u}', f'(({upto}) * i / {n}.0::double)')})))"


def normal_cdf(z: str) -> str:
    return f"(0.5 + {_simpson('exp(-0.5 * {u} * {u})', f'greatest(least({z}, 9), -9)::double')} / sqrt(2 * pi()))"


def _ratio(f: str, upto: str, all_: str, n: int) -> str:
    return f"{_simpson(f, upto, n)} / ({_simpson(f, all_, n)})"


def spearman_p(rho: str, n: str) -> str:
    """Two-sided, by Student's t: with t = sqrt(dof) tan(u) the density is cos(u) to the dof - 1."""
    return f"case when abs({rho}) >= 1 then 0 else greatest(1 - {_ratio(f'pow(cos({{u}}), {n} - 3)', f'atan(abs({rho}) / sqrt((1 + {rho}) * (1 - {rho})))', 'pi() / 2', 20000)}, 0) end"


def chi2_p(x: str, dof: str) -> str:
    """With x the square of u the density is u to the dof - 1 times exp(-u^2 / 2)."""
    return f"greatest(1 - {_ratio(f'pow({{u}}, {dof} - 1) * exp(-0.5 * {{u}} * {{u}})', f'least(sqrt({x}), 40)', '40::double', 8000)}, 0)"


def f_p(x: str, d1: str, d2: str) -> str:
    return f"{_ratio(f'pow(sin({{u}}), {d2} - 1) * pow(cos({{u}}), {d1} - 1)', f'asin(sqrt({d2} / ({d2} + {d1} * {x})))', 'pi() / 2', 20000)}"


SQL["ic_significance"] = f"""{research._LONG_SQL}, p as (select *, {spearman_p('ic', 'n_obs')} as p from i)
select feature, horizon, n_obs, round(ic, 5) as ic, round(p, 4) as p_value, p < 0.05 as significant, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end as stars from p"""

# Normal quantiles that the best of 72 trials is expected at.
_BEST = (1 - 0.5772156649) * NormalDist().inv_cdf(1 - 1 / 72) + 0.5772156649 * NormalDist().inv_cdf(1 - 1 / (72 * 2.718281828459045))
SQL["metrics_deflated"] = f"""{research._BT_SQL}, m as (select symbol, count(net_return) as n_obs, round(avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt(6048), 4) as sharpe, skewness(net_return) filter (where net_return <> 0) as skew,
  kurtosis(net_return) filter (where net_return <> 0) as kurtosis, avg((net_return > 0)::int) as pct_positive, count(*) filter (where trade <> 0) as trade_bars from q group by 1),
v as (select *, (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / (n_obs - 1) as v from m)
select symbol, n_obs, sharpe, round(skew, 4) as skew, round(kurtosis, 4) as kurtosis, round(pct_positive, 6) as pct_positive, trade_bars,
  round({normal_cdf(f'((sharpe - {_BEST!r}) / sqrt(case when v <= 0 then 1.0 / (n_obs - 1) else v end))')}, 4) as dsr from v"""

# -- regressions by sweeping a matrix of products


def swept(source: str, m: int, pivots: str, name: str, keys: str) -> str:
    """CTEs that sweep the m x m list g of `source` (keys, g, and what `pivots` needs) by the pivots, numbered from 1 by
    the step: `name` has keys, step and the list after each."""
    at = lambda i, j: f"g[({i}) * {m} + ({j}) + 1]"
    cell = f"""case when i = p and j = p then 1 / {at('p', 'p')} when i = p then {at('p', 'j')} / {at('p', 'p')} when j = p then -{at('i', 'p')} / {at('p', 'p')}
      else {at('i', 'j')} - {at('i', 'p')} * {at('p', 'j')} / {at('p', 'p')} end"""
    cell = cell.replace("case when i = p", "case when (x // M) = p", 1)
    for a, b in (("i = p", "(x // M) = p"), ("j = p", "(x % M) = p"), ("(i) *", "(x // M) *"), ("(j) +", "(x % M) +")):
        cell = cell.replace(a, b)
    return f"""{name}({keys}, step, last, g) as (select {keys}, 0, last, g from {source}
  union all select {keys}, step + 1, last, list_transform(range(0, {m * m}), lambda x: {cell.replace('M', str(m))}) from (select *, {pivots} as p from {name} where step < last))"""


def _products(source: str, keys: str, m: int) -> str:
    """keys and the matrix of summed products of the list v."""
    return f"""select {keys}, list(s order by i) as g from (select {keys}, i, sum(v[i // {m} + 1] * v[i % {m} + 1]) as s from {source}, range(0, {m * m}) t(i) group by {keys}, i) group by {keys}"""


_LONGS = lambda *fs: " union all ".join(f"select symbol, ts, '{x}' as feature, {x} as y from f" for x in fs)
_TAU = "({0} + {1} * tau + {2} * tau * tau + {3} * tau * tau * tau)"
_ADF_P = normal_cdf(f"(case when tau <= -1.61 then {_TAU.format(2.1659, 1.4412, 0.038269, 0)} else {_TAU.format(1.7339, 0.93202, -0.12745, -0.010368)} end)")
_ADF_P = f"case when tau > 2.74 then 1 when tau < -18.83 then 0 else {_ADF_P} end"


def adf(*features: str) -> str:
    """CTEs; `ad` has the test of each symbol and feature by at most 24 lags (of series of 54 rows at least)."""
    k = "symbol, feature"
    return f"""ad_l as materialized (select {k}, y, row_number() over (partition by {k} order by ts) as k, count(*) over (partition by {k}) as n from ({_LONGS(*features)}) where y is not null),
ad_d as (select *, y - lag(y) over (partition by {k} order by k) as dy, lag(y) over (partition by {k} order by k) as y1 from ad_l),
ad_w as materialized (select *, list_reverse(list(dy) over (partition by {k} order by k rows between 24 preceding and current row)) as w from ad_d),
ad_v as (select {k}, list_concat([1.0, y1, dy], w[2:25]) as v from ad_w where k >= 26),
ad_g as (select *, 26 as last from ({_products('ad_v', k, 27)})),
{swept('ad_g', 27, 'case when step < 2 then step else step + 1 end', 'ad_s', k)},
ad_r as (select {k}, count(*) as rows from ad_v group by all),
ad_b as (select {k}, arg_min(step - 2, rows * (ln(2 * pi()) + ln(g[2 * 27 + 3] / rows) + 1) + 2 * step) as lags from ad_s join ad_r using ({k}) where step >= 2 group by all),
ad_v2 as (select {k}, lags, list_concat([1.0, y1, dy], list_transform(range(1, 25), lambda j: case when j <= lags then w[j + 1] else 0 end)) as v from ad_w join ad_b using ({k}) where k >= lags + 2),
ad_g2 as (select *, lags + 2 as last from ({_products('ad_v2', 'symbol, feature, lags', 27)})),
{swept('ad_g2', 27, 'case when step < 2 then step else step + 1 end', 'ad_s2', 'symbol, feature, lags')},
ad_t as (select {k}, lags, g[27 + 3] / sqrt(g[2 * 27 + 3] / (rows - lags - 2) * g[27 + 2]) as tau, rows from ad_s2 join (select {k}, count(*) as rows from ad_v2 group by all) using ({k}) where step = last),
ad as (select {k}, n as n_obs, lags, tau, rows, {_ADF_P} as p from ad_t join (select distinct {k}, n from ad_l) using ({k}))"""


SQL["adf"] = f"""{FEATURES}, {adf('mom', 'td', 'rv', 'close', 'lr')}
select symbol, feature, n_obs, lags, round(tau, 4) as statistic, round(p, 6) as p_value, round(-3.43035 - 6.5393 / rows - 16.786 / rows ** 2 - 79.433 / rows ** 3, 6) as critical_1,
  round(-2.86154 - 2.8903 / rows - 4.234 / rows ** 2 - 40.040 / rows ** 3, 6) as critical_5, p < 0.05 as is_stationary from ad"""

_KPSS = f"""kp_l as (select symbol, feature, ts, y - avg(y) over (partition by symbol, feature) as e, count(*) over (partition by symbol, feature) as n from ({_LONGS('close', 'lr')}) where y is not null),
kp_e as (select symbol, feature, any_value(n) as n, list(e order by ts) as e from kp_l group by all),
kp_c as (select *, floor(pow(n, 2.0 / 9))::int as cover, list_transform(range(0, least(n, 400)), lambda h: list_sum(list_transform(range(1, (n - h + 1)::bigint), lambda i: e[i] * e[i + h]))) as p from kp_e),
kp_b as (select *, list_sum(list_transform(range(1, cover + 1), lambda i: i * p[i + 1] / (n / 2))) as s1, p[1] / n + list_sum(list_transform(range(1, cover + 1), lambda i: p[i + 1] / (n / 2))) as s0 from kp_c),
kp_g as (select *, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3))::int, n - 1) as lags from kp_b),
kp_s as (select symbol, feature, sum(c * c) as s from (select symbol, feature, sum(e) over (partition by symbol, feature order by ts rows between unbounded preceding and current row) as c from kp_l) group by all),
kp as (select symbol, feature, n, lags, s / n ** 2 / ((p[1] + 2 * coalesce(list_sum(list_transform(range(1, lags + 1), lambda i: p[i + 1] * (1 - i / (lags + 1.0)))), 0)) / n) as eta from kp_g join kp_s using (symbol, feature)),
kp_p as (select *, case when eta <= 0.347 then 0.10 when eta <= 0.463 then 0.10 - 0.05 * (eta - 0.347) / 0.116 when eta <= 0.574 then 0.05 - 0.025 * (eta - 0.463) / 0.111
  when eta <= 0.739 then 0.025 - 0.015 * (eta - 0.574) / 0.165 else 0.01 end as p from kp)"""
SQL["kpss"] = f"""{FEATURES}, {adf('close', 'lr')}, {_KPSS}
select symbol, feature, kp_p.n as n_obs, kp_p.lags, round(eta, 6) as statistic, round(kp_p.p, 6) as p_value, round(ad.p, 6) as adf_p,
  case when ad.p < 0.05 and kp_p.p >= 0.05 then 'stationary' when ad.p >= 0.05 and kp_p.p < 0.05 then 'non-stationary' when ad.p < 0.05 then 'difference-stationary' else 'trend-stationary' end as verdict
from kp_p join ad using (symbol, feature)"""

SQL["arch_lm"] = f"""{FEATURES}, a as (select symbol, lr * lr * 1e4 as s, row_number() over {W} as k, list(lr * lr * 1e4) over (partition by symbol order by ts rows between 10 preceding and current row) as w from f where lr is not null),
v as (select symbol, list_concat([1.0], list_reverse(w)) as v from a where k > 10),
g as (select *, 11 as last from ({_products('v', 'symbol', 12)})), {swept('g', 12, 'case when step = 0 then 0 else step + 1 end', 's', 'symbol')},
b as (select symbol, g[1 * 12 + 2] as total from s where step = 1), n as (select symbol, count(*) as n from v group by 1),
x as (select symbol, n, 1 - g[1 * 12 + 2] / total as r2 from s join b using (symbol) join n using (symbol) where step = 11),
y as (select *, n * r2 as lm, (r2 / 10) / ((1 - r2) / (n - 11)) as f from x)
select symbol, n as n_obs, round(lm, 4) as lm, round({chi2_p('lm', '10')}, 6) as lm_p, round(f, 4) as f, round({f_p('f', '10', '(n - 11)')}, 6) as f_p from y"""

SQL["acf_tests"] = f"""{FEATURES}, x as (select symbol, list(e order by ts) as e, any_value(n) as n from (select symbol, ts, lr - avg(lr) over (partition by symbol) as e, count(*) over (partition by symbol) as n from f where lr is not null) group by 1),
p as (select symbol, n, list_transform(range(0, 21), lambda h: list_sum(list_transform(range(1, (n - h + 1)::bigint), lambda i: e[i] * e[i + h]))) as p from x),
rr as (select symbol, n, list_transform(p, lambda v: v / p[1]) as r from p),
lv(symbol, n, r, k, phi, v, a) as (select symbol, n, r, 0, []::double[], 1::double, 0::double from rr
  union all select symbol, n, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - a * phi[k + 1 - j]), a), v * (1 - a * a), a
  from (select symbol, n, r, k, phi, v, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])), 0)) / v as a from lv where k < 20)),
q as (select symbol, k as lag, r[k + 1] as acf, a as pacf, n, n * (n + 2) * list_sum(list_transform(range(1, k + 1), lambda j: r[j + 1] * r[j + 1] / (n - j))) as q from lv where k > 0)
select symbol, lag, round(acf, 6) as acf, round(pacf, 6) as pacf, round(q, 4) as q, round({chi2_p('q', 'lag')}, 6) as p_value, abs(acf) > 1.96 / sqrt(n) as outside from q"""

SQL["lambda_calibration"] = f"""{HOURLY}, {weights('w1', 1e4, 60)}, {weights('w2', 1e5, 60)}, {weights('w3', 1e6, 60)}, a as (select *, list(close) over {over(60)} as ps from h),
t as (select *, {filtered('w1', 60, 't1')}, {filtered('w2', 60, 't2')}, {filtered('w3', 60, 't3')} from a),
s as (select symbol, ts, 't1' as trend_a, 't2' as trend_b, t1 - lag(t1) over {W} as x, t2 - lag(t2) over {W} as y, t1 - t2 as gap, t2 - close as off from t
  union all select symbol, ts, 't2', 't3', t2 - lag(t2) over {W}, t3 - lag(t3) over {W}, t2 - t3, t3 - close from t),
k as (select symbol, trend_a, rank() over (partition by symbol, trend_a order by x) as rx, rank() over (partition by symbol, trend_a order by y) as ry from s where x is not null and y is not null),
c as (select symbol, trend_a, corr(rx, ry) as c from k group by all)
select symbol, trend_a, trend_b, round(any_value(c), 4) as slope_corr, round(stddev_samp(gap), 4) as std_gap, round(arg_max(off, ts), 4) as last_gap from s join c using (symbol, trend_a) group by all"""

_PEAK = """pk0 as (select feature, arg_max(horizon, abs(ic)) as peak_horizon, arg_max(ic, abs(ic)) as peak_ic from i group by 1),
atp as (select l.feature, l.x, l.y from l join pk0 on pk0.feature = l.feature and pk0.peak_horizon = l.horizon)"""
_STEADY = "sf as (select feature, max(p) as adf_p, bool_and(p < 0.05) as is_stationary from ad group by 1)"
_BY = lambda x: f"select symbol, ts, '{x}' as feature, {x} as x, f1, f4, f24 from f"
SQL["univariate"] = f"""{research._LONG_SQL}, {_PEAK}, {adf('mom', 'td', 'rv')}, {_STEADY},
fl as (select symbol, ts, u.feature, symbol || '/' || u.feature as sf, x, case peak_horizon when 1 then f1 when 4 then f4 else f24 end as y from ({" union all ".join(map(_BY, ("mom", "td", "rv")))}) u join pk0 on pk0.feature = u.feature),
{rolling_rank('fl', 'x', 'y', 200, 'sf')}, ro2 as (select feature, avg(rolling_ic) as mean_ic, stddev_samp(rolling_ic) as std_ic from rc group by 1),
ht as (select feature, count(*) filter (where sign(x) = sign(y)) / count(*)::double as hit_rate from atp where x <> 0 and y <> 0 group by 1),
qt as (select feature, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) as e from atp group by 1 having count(*) >= 150),
mt as (select atp.feature, len(list_filter(list_distinct(e), lambda v: v < x)) as bin, avg(y) as m from atp join qt on qt.feature = atp.feature group by 1, 2),
mo as (select feature, corr(bin, rk) as rho, count(*) as n from (select *, rank() over (partition by feature order by m) as rk from mt) group by 1)
select pk0.feature, round(adf_p, 6) as adf_p, is_stationary, peak_horizon, round(peak_ic, 6) as peak_ic, round(mean_ic, 6) as mean_ic, round(std_ic, 6) as std_ic, round(mean_ic / std_ic, 6) as ic_ir, round(hit_rate, 6) as hit_rate, round(rho, 6) as rho,
  abs(rho) > 0.8 and ({spearman_p('rho', 'n')}) < 0.05 as is_monotonic, case when not is_stationary then 'non-stationary' when abs(peak_ic) < 0.05 then 'weak IC' else '' end as reject_reason, is_stationary and abs(peak_ic) >= 0.05 as passed
from pk0 join sf on sf.feature = pk0.feature join ro2 on ro2.feature = pk0.feature join ht on ht.feature = pk0.feature join mo on mo.feature = pk0.feature"""

# -- written times: a pattern for each form; the zone of the session doesn't matter

_CLOCK = r"(?:(?:\s*T\s*|\s+)(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([ap]\.?m\.?))?|(\d{2})(\d{2})(\d{2}))(?:\s*([A-Za-z]{1,5}))?(?:\s*([+-])(\d{2})(?::?(\d{2}))?)?)?"
_PARTS = "'h', 'mi', 's', 'f', 'half', 'h2', 'mi2', 's2', 'abbr', 'sign', 'oh', 'om'"
_FORMS = (
    (r"(\d{4})([-/.])(\d{1,2})([-/.])(\d{1,2})", "'a', 'sep', 'b', 'sep2', 'c'", "g.sep = g.sep2", "g.a", "g.b", "g.c"),
    (r"(\d{4})(\d{2})(\d{2})", "'a', 'b', 'c'", "true", "g.a", "g.b", "g.c"),
    (r"(\d{1,2})([-/.])(\d{1,2})([-/.])(\d{4}|\d{2})", "'a', 'sep', 'b', 'sep2', 'c'", "g.sep = g.sep2", "case when len(g.c) = 2 then '20' else '' end || g.c", "case day_order when 'dmy' then g.b else g.a end", "case day_order when 'dmy' then g.a else g.b end"),
    (r"(\d{1,2})[- ]([A-Za-z]{3,9})[- ](\d{4}|\d{2})", "'a', 'b', 'c'", "true", "case when len(g.c) = 2 then '20' else '' end || g.c", "MONTH", "g.a"),
    (r"([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})", "'b', 'a', 'c'", "true", "g.c", "MONTH", "g.a"),
)
_MONTH = "((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(g.b[1:3])) + 2) // 3)::varchar"
# The abbreviations of the zones in the table, in minutes.
_ABBREVIATIONS = """zn(zone, name, minutes) as (values ('America/New_York', 'EST', -300), ('America/New_York', 'EDT', -240), ('America/Chicago', 'CST', -360), ('America/Chicago', 'CDT', -300), ('Europe/London', 'GMT', 0),
  ('Europe/London', 'BST', 60), ('Europe/Berlin', 'CET', 60), ('Europe/Berlin', 'CEST', 120), ('Europe/Athens', 'EET', 120), ('Europe/Athens', 'EEST', 180), ('Asia/Tokyo', 'JST', 540), ('Asia/Kolkata', 'IST', 330),
  ('Australia/Sydney', 'AEST', 600), ('Australia/Sydney', 'AEDT', 660))"""
_FORM = lambda p, names, test, y, m, d: (
    rf"select stamp_id, zone, g, {y} as y, {m} as mo, {d} as d from (select *, regexp_extract(t, '(?i)^{p}{_CLOCK}$', [{names}, {_PARTS}]) as g from x where regexp_matches(t, '(?i)^{p}{_CLOCK}$')) where {test}".replace("MONTH", _MONTH)
)
SQL["p3_found"] = rf"""with {_ABBREVIATIONS},
x as (select stamp_id, coalesce(tz, 'UTC') as zone, day_order, trim(coalesce(datetime, trim(date, e' \t') || ' ' || trim(time, e' \t'), date), e' \t\r\n') as t from stamps),
f as ({" union all ".join(_FORM(*f) for f in _FORMS)}),
n as (select stamp_id, zone, try_cast(printf('%04d-%02d-%02d', y::int, mo::int, d::int) as date) as day, coalesce(nullif(g.h, ''), nullif(g.h2, ''), '0')::int as h, coalesce(nullif(g.mi, ''), nullif(g.mi2, ''), '0')::int as mi,
  coalesce(nullif(g.s, ''), nullif(g.s2, ''), '0')::int as s, rpad(g.f[1:6], 6, '0')::int as us, lower(g.half[1:1]) as half, upper(g.abbr) as abbr, g.sign as sign, coalesce(nullif(g.oh, ''), '0')::int as oh, coalesce(nullif(g.om, ''), '0')::int as om from f),
k as (select stamp_id, n.zone, day + to_seconds((case when half = '' then h when half = 'p' then h % 12 + 12 else h % 12 end) * 3600 + mi * 60 + s) as local, us, case when sign <> '' then case when sign = '+' then 1 else -1 end * (oh * 60 + om) when abbr in ('Z', 'UTC') then 0
    when abbr <> '' then coalesce(zn.minutes, case when abbr = 'GMT' then 0 end) end as minutes, abbr, sign from n left join zn on zn.zone = n.zone and zn.name = abbr
  where day is not null and mi < 60 and s < 60 and (half = '' and h < 24 or half <> '' and h between 1 and 12) and oh < 24 and om < 60 and (sign = '' or abbr in ('', 'UTC', 'GMT', 'Z'))),
u as (select stamp_id, us, case when minutes is not null then epoch_us(local) - minutes::bigint * 60000000 when abbr = '' then epoch_us(list_min(list_filter(list_transform([-60, -30, 0, 30, 60], lambda m: timezone(k.zone, local) + to_minutes(m::bigint)), lambda z: timezone(k.zone, z) = local))) end as begun from k)
select stamp_id, begun + us as utc_us from u where begun is not null
union all select stamp_id, t::bigint * case len(t) when 10 then 1000000 when 13 then 1000 else 1 end from x where regexp_full_match(t, '[0-9]+') and len(t) in (10, 13, 16)"""

# -- drifting files

_NUMBERS = ("open", "high", "low", "close", "volume", "dividends", "stock_splits")
_KIND = "case when t = 'VARCHAR' then 'string' when t in ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') then case when regexp_matches(raw, '[.eE]') then 'double' else 'long' end else lower(t) end"
_VALUES = f"""r as (select record_id, file_no, provider, loaded_at, record_json as j from file_records),
k as (select *, unnest(json_keys(j)) as key, generate_subscripts(json_keys(j), 1) as pos from r),
v as (select *, trim(lower(key)) as name, json_type(j, '$."' || key || '"') as t, json_extract_string(j, '$."' || key || '"') as txt, json_extract(j, '$."' || key || '"')::varchar as raw from k),
n as (select v.*, {_KIND} as kind, coalesce(a.field, v.name) as field from v left join (select trim(lower(alias)) as alias, max(field) as field from field_aliases group by 1) a on a.alias = v.name),
o as (select record_id, file_no, field, arg_min(kind, (kind = 'null', pos)) as kind, arg_min(txt, (kind = 'null', pos)) as txt from n group by all)"""
_TIME = """case kind when 'string' then coalesce(case when regexp_matches(trim(txt), '(Z|[+-][0-9]{2}:?[0-9]{2})$') then timezone('UTC', try_cast(txt as timestamptz)) end, try_cast(txt as timestamp))
  when 'long' then make_timestamp((txt::hugeint * case when len(txt) <= 11 then 1000000 when len(txt) <= 14 then 1000 else 1 end)::bigint) end"""
SQL["p6_table"] = f"""with {_VALUES}, w as (select r.record_id, r.file_no, {", ".join(f"any_value(try_cast(trim(txt) as double)) filter (where field = '{f}') as {f}" for f in _NUMBERS)}, any_value({_TIME}) filter (where field = 'datetime') as datetime,
  {", ".join(f"any_value(kind) filter (where field = '{f}') as {f}_as" for f in (*_NUMBERS, "datetime"))},
  {", ".join(f"any_value(case when kind = '{k}' then {v} end) filter (where field = '{f}') as {f}_{k}" for f in (*_NUMBERS, "datetime") for k, v in (("string", "txt"), ("double", "txt::double"), ("long", "txt::bigint")))},
  {", ".join(f"any_value(case when kind in ('boolean', 'object', 'array') then txt end) filter (where field = '{f}') as {f}_other" for f in (*_NUMBERS, "datetime"))},
  coalesce(string_agg(field || '=' || coalesce(txt, 'null'), ';' order by field || '=' || coalesce(txt, 'null')) filter (where field not in {(*_NUMBERS, "datetime")!r} or (txt is not null and case when field = 'datetime' then {_TIME} is null else try_cast(trim(txt) as double) is null end)), '') as rest
  from r left join o on o.record_id = r.record_id group by r.record_id, r.file_no)
select * from w"""
SQL["p6_alternatives"] = f"""with {_VALUES}, f as (select provider, file_no, row_number() over (partition by provider order by min(loaded_at), file_no) as seq from file_records group by 1, 2),
s as (select n.provider, field as path, kind, min(seq) as seq, arg_min(n.file_no, seq) as file_no from n join f on f.provider is not distinct from n.provider and f.file_no = n.file_no group by all)
select file_no, path, kind from s where seq > 1"""

# -- distances of loads

_CELLS = " union all ".join(
    [f"select load_no, {i} as no, '{c}' as column_name, {v}::double as num, null::varchar as txt from bars" for i, (c, v) in enumerate((("bar_id", "bar_id"), ("ts", "epoch_us(ts)"), *((p, p) for p in ("open", "high", "low", "close", "volume")), ("ingested_at", "epoch_us(ingested_at)")))]
    + [f"select load_no, {i + 20}, '{c}', null, {c} from bars" for i, c in enumerate(("provider", "symbol", "src_ref"))]
)
SQL["p1_distances"] = f"""with u as materialized ({_CELLS}),
l as (select load_no, max(baseline_load) as base from loads where load_no is not null group by 1 having max(baseline_load) is not null),
s as (select u.load_no as base, column_name, list(num order by num) as v from u where num is not null and u.load_no in (select base from l) group by all),
q as (select base, column_name, list_transform(range(0, 11), lambda i: v[((len(v) - 1) * i // 10) + 1]) as q from s),
b as (select base, column_name, q[1] as least, list_distinct(list_filter(q, lambda e, i: i > 1 and e = q[i - 1])) as shared, q[2:11] as upto from q),
c as (select l.load_no, l.base, u.column_name, num, txt, 1 as x, 0 as y from u join l on l.load_no = u.load_no union all select l.load_no, l.base, u.column_name, num, txt, 0, 1 from u join l on l.base = u.load_no),
d as (select c.load_no, c.base, c.column_name, x, y, txt, case when num is not null then coalesce(len(list_filter(upto, lambda e: e < num)) + len(list_filter(shared, lambda e: e <= num)) + (num >= least)::int, 0) end as bin
  from c left join b on b.base = c.base and b.column_name = c.column_name),
g as (select load_no, base, column_name, bin, txt, sum(x)::double as x, sum(y)::double as y from d group by all),
t as (select load_no, base, column_name, sum(x) as rows, sum(y) as base_rows, coalesce(sum(x) filter (where bin is not null or txt is not null), 0) as n, coalesce(sum(y) filter (where bin is not null or txt is not null), 0) as m, count(*) filter (where bin is not null or txt is not null) as w from g group by all),
h as (select load_no, column_name, sum(((x + 0.5) / (n + w / 2) - (y + 0.5) / (m + w / 2)) * ln(((x + 0.5) / (n + w / 2)) / ((y + 0.5) / (m + w / 2)))) as psi,
  sum((x * sqrt(m / nullif(n, 0)) - y * sqrt(n / nullif(m, 0))) ** 2 / (x + y)) as chi2 from g join t using (load_no, base, column_name) where bin is not null or txt is not null group by all)
select t.load_no, base as baseline_load, t.column_name, n::bigint as n_values, case when base_rows > 0 then m::bigint end as base_values, case when base_rows > 0 then w end as n_cells, case when base_rows > 0 then round(psi, 6) end as psi, case when base_rows > 0 then round(chi2, 6) end as chi2
from t left join h on h.load_no = t.load_no and h.column_name = t.column_name where rows > 0"""

# -- named checks and the selection of features

_GAPS = research._SLOTS
SQL["quality_checks"] = f"""{_GAPS}, q as (select *, close / nullif(lag(close) over {W}, 0) - 1 as ret, lag(ts) over {W} > ts as back from h), z as (select symbol, avg(ret) as m, stddev_samp(ret) as s from q group by 1),
o as (select q.symbol, 0 as timezone, count(*) - count(distinct ts) as duplicates, count(*) filter (where back) as monotonic,
  count(*) filter (where high < open or high < close or high < low) + count(*) filter (where low > open or low > close or low > high) as ohlc_integrity, count(*) filter (where abs(ret - m) > 10 * s) as extreme_spikes from q join z using (symbol) group by 1),
g as (select symbol, count(*) as missing_bars from (select symbol, ts from x anti join h using (symbol, ts)) where isodow(ts) <= 5 group by 1),
a as (select o.*, coalesce(missing_bars, 0) as missing_bars from o left join g using (symbol)),
p as (unpivot a on timezone, duplicates, monotonic, ohlc_integrity, missing_bars, extreme_spikes into name check_name value n_details)
select symbol, check_name, n_details = 0 or check_name = 'extreme_spikes' as is_valid, n_details::bigint as n_details from p"""

_F4 = " union all ".join(f"select symbol, ts, '{x}' as feature, {x} as x, f4 as y, close from f" for x in ("mom", "td", "rv"))
_NUL = "case when {} then '{}' end"
SQL["feature_selection"] = f"""{research._MATRIX_SQL}, u as ({_F4}), l as (select * from u where x is not null and y is not null),
k as (select *, rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0 as rx, rank() over (partition by feature order by y) + (count(*) over (partition by feature, y) - 1) / 2.0 as ry from l),
i as (select feature, corr(rx, ry) as ic, count(*) as n_obs from k group by 1),
o as (select feature, row_number() over (order by abs(ic) desc, case feature when 'mom' then 1 when 'td' then 2 else 3 end) as k from i),
mm as (select feature_a as a, feature_b as b, abs(corr) as c from m union all select feature_b, feature_a, abs(corr) from m),
gr(k, kept, feature, of) as (select 1::bigint, [feature], feature, null::varchar from o where k = 1
  union all select k, case when of is null then list_append(kept, feature) else kept end, feature, of from (
    select o.k, gr.kept, o.feature, (select arg_max(mm.b, mm.c) from mm where mm.a = o.feature and list_contains(gr.kept, mm.b) and mm.c > 0.7) as of from gr join o on o.k = gr.k + 1)),
{adf('mom', 'td', 'rv')}, {_STEADY},
wb as (select symbol, feature, (row_number() over (partition by symbol, feature order by ts) - 1) // 120 as block, x, y from u where close is not null),
wk as (select *, rank() over (partition by symbol, feature, block order by x) + (count(*) over (partition by symbol, feature, block, x) - 1) / 2.0 as rx, rank() over (partition by symbol, feature, block order by y) + (count(*) over (partition by symbol, feature, block, y) - 1) / 2.0 as ry from wb where x is not null and y is not null),
wi as (select symbol, feature, block, corr(rx, ry) as ic from wk group by 1, 2, 3 having count(*) >= 30),
wm as (select feature, avg(ic) as m from wi group by 1), ws as (select wi.feature, avg(case when m = 0 then 0.5 else (sign(ic) = sign(m))::int end) as sign_consistency from wi join wm on wm.feature = wi.feature group by 1),
ft as (select i.feature, ic, n_obs, adf_p, sign_consistency, of as redundant_with, case when n_obs >= 3 and abs(ic) < 1 then ic * sqrt(n_obs - 2) / sqrt(1 - ic * ic) end as t_stat from i join sf using (feature) join ws using (feature) join gr using (feature)),
fp as (select *, abs(ic) > 0.03 as passes_ic, abs(t_stat) > 2 as passes_t_stat, adf_p < 0.05 as passes_stationarity, sign_consistency >= 0.7 as passes_stability, redundant_with is null as passes_redundancy from ft),
fr as (select *, concat_ws('; ', {_NUL.format('not passes_ic', 'weak IC')}, {_NUL.format('not passes_t_stat', 'weak t')}, {_NUL.format('not passes_stationarity', 'non-stationary')}, {_NUL.format('not passes_stability', 'unstable sign')}, 'redundant with ' || redundant_with) as reject_reasons from fp)
select feature, round(ic, 5) as ic, n_obs, round(adf_p, 6) as adf_p, round(sign_consistency, 6) as sign_consistency, redundant_with, round(t_stat, 3) as t_stat, passes_ic, passes_t_stat, passes_stationarity, passes_stability, passes_redundancy, reject_reasons, reject_reasons = '' as passed from fr"""

# -- the pipeline

_GAINED = f"{research._LONG_SQL}, p as (select *, {spearman_p('ic', 'n_obs')} as p from i)"
SQL["ic_gate"] = f"{_GAINED} select feature, bool_or(abs(ic) > 0.02 and p < 0.05) as passed, arg_max(horizon, abs(ic)) as peak_horizon, round(arg_max(ic, abs(ic)), 5) as peak_ic from p group by 1"
SQL["ic_peak_significant"] = f"{_GAINED} select feature, arg_max(horizon, (p < 0.05, abs(ic))) as peak_horizon, round(arg_max(ic, (p < 0.05, abs(ic))), 5) as peak_ic from p group by 1"

_LABELS = {"1M": "hp_1m", "10M": "hp_10m", "100M": "hp_100m", "1B": "hp_1b", "3_9B": "hp_3_9b", "100B": "hp_100b"}
_MEAN = lambda n: f"(case when count(trend) over (partition by lam order by ts rows between {n - 1} preceding and current row) >= {n} then avg(trend) over (partition by lam order by ts rows between {n - 1} preceding and current row) end) as m{n}"
SQL["trend_grid_72"] = f"""with {MINUTES}, t as ({_GRID_SQL.replace("select symbol, ts, ", "select symbol, ts, close, ", 1).replace("(select symbol, ts, list", "(select symbol, ts, close, list").replace(", 6) as", ", 12) as")}),
u as ({" union all ".join(f"select ts, close, '{label}' as lam, {c} as trend from t" for label, c in _LABELS.items())}),
m as (select *, {", ".join(map(_MEAN, (24, 48, 72, 120, 168, 240, 480)))} from u),
g as (select lam, t1, t2, ts, close, case t1 when 24 then m24 when 48 then m48 else m72 end - case t2 when 120 then m120 when 168 then m168 when 240 then m240 else m480 end as sp from m, (values (24), (48), (72)) a(t1), (values (120), (168), (240), (480)) b(t2)),
b as (select *, case when sp > 0 then 1.0::double when sp is not null then -1.0::double end as signal from g), {tested('b', ('lam', 't1', 't2'))}
select lam, t1, t2, {research._METRICS.replace("round(round(min(equity / peak - 1), 6), 4) as max_drawdown,", "")} from pk group by all having count(signal) >= 100"""

# As above, of 8 trials.
_BEST_8 = (1 - 0.5772156649) * NormalDist().inv_cdf(1 - 1 / 8) + 0.5772156649 * NormalDist().inv_cdf(1 - 1 / (8 * 2.718281828459045))
_SLICE = (*_KEYS, "part")
SQL["crossing_oos"] = f"""{FEATURES}, {_VP}, {machine('gr', 'td', 'sigma', 'hold', 100, None, ('symbol', 'sigma', 'hold'))},
fl as (select gr.*, floor, case when coalesce(vp < floor, true) then 0 else sig end::double as signal, case when ts <= timestamp '2024-01-20 23:59:59' then 'is' else 'oos' end as part from gr join mc using (symbol, sigma, hold, ts), (values (0.0::double), (50.0)) t(floor)), {tested('fl', _SLICE)},
i as (select {", ".join(_KEYS)}, count(*) as n_obs, round(avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt(6048), 4) as sharpe, floor(sum(abs(trade)) / 2) as n_trades, count(*) filter (where net_return <> 0) as k,
  skewness(net_return) filter (where net_return <> 0) as g, kurtosis(net_return) filter (where net_return <> 0) as q from pk where part = 'is' group by all),
v as (select *, (1 - case when k > 2 then g else 0 end * sharpe + (case when k > 3 then q else 0 end - 1) / 4 * sharpe * sharpe) / (n_obs - 1) as v from i),
s as (select *, round({normal_cdf(f'((sharpe - {_BEST_8!r}) / sqrt(case when v <= 0 then 1.0 / (n_obs - 1) else v end))')}, 4) as dsr from v),
best as (select {", ".join(_KEYS)} from s qualify row_number() over (partition by symbol order by n_trades >= 10 desc, dsr desc nulls last, sharpe desc nulls last, sigma, hold, floor) = 1),
x as (select pk.*, name, position * ret - abs(trade) * bps / 10000 as net from pk join best using ({", ".join(_KEYS)}), (values ('low', 0.9::double), ('mid', 1.5), ('high', 2.0)) c(name, bps) where part = 'oos')
select {", ".join(_KEYS)}, name, count(*) as n_obs, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(6048), 4) as sharpe from x group by all"""

SQL["feature_catalog"] = """select * from (values ('hp_trend_level', 'Trend', false), ('hp_trend_slope', 'Trend', true), ('hp_trend_curvature', 'Trend', true), ('ma_spread_on_trend', 'Trend', null), ('ma_crossover_signal', 'Trend', null),
  ('ma_crossover_age', 'Trend', false), ('trend_deviation_from_ma', 'Mean Reversion', null), ('distance_from_ma_20_raw', 'Mean Reversion', true), ('ma_spread_raw_5020', 'Trend', null), ('lambda_sensitivity_score', 'Diagnostic', true),
  ('vol_regime', 'Diagnostic', true)) t(name, category, expected_stationary)"""

_WALKED = """wb as (select symbol, feature, (row_number() over (partition by symbol, feature order by ts) - 1) // 120 as block, x, y from u where close is not null),
wk as (select *, rank() over (partition by symbol, feature, block order by x) + (count(*) over (partition by symbol, feature, block, x) - 1) / 2.0 as rx, rank() over (partition by symbol, feature, block order by y) + (count(*) over (partition by symbol, feature, block, y) - 1) / 2.0 as ry from wb where x is not null and y is not null),
wi as (select symbol, feature, block, corr(rx, ry) as ic from wk group by 1, 2, 3 having count(*) >= 30), wm as (select feature, avg(ic) as m from wi group by 1)"""
SQL["stability_features"] = f"""{FEATURES}, u as ({_F4}), {_WALKED} select wi.feature, count(*) as n_periods, round(avg(ic), 6) as mean_ic, round(stddev_samp(ic), 6) as std_ic, round(avg(case when m = 0 then 0.5 else (sign(ic) = sign(m))::int end), 6) as sign_consistency,
  avg(case when m = 0 then 0.5 else (sign(ic) = sign(m))::int end) >= 0.7 as is_stable from wi join wm on wm.feature = wi.feature group by 1"""
