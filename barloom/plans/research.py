"""Research queries on bars made from the test tables, each with its SQL where SQL can say the same.

Hourly bars come from events (a series for each event type), daily ones from line items (a series for each return flag).
Lookbacks are short enough for those series.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import machines, quality, signals, stats
from barloom.operators.scan import by_stretch
from barloom.operators.series import Series
from barloom.operators.trend import causal_trends, two_sided_trend
from barloom.sources import bars as src
from barloom.sources.tables import table, written

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY = ("symbol", "ts")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def hourly(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return src.bars(e, F.col("event_type"), F.col("ts"), F.col("value"), [F.col("event_id")], "hour")


def daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem")
    price = F.try_divide("l_extendedprice", "l_quantity")
    return src.bars(e, F.col("l_returnflag"), F.col("l_shipdate"), price, [F.col("l_orderkey"), F.col("l_linenumber")], "day")


def shown(df: DataFrame, *columns: str, keys: tuple[str, ...] = KEY, places: int = 6) -> DataFrame:
    """Keys and rounded columns; doubles of different engines agree to about 14 digits, not to the last."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *[F.round(c, places).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


# -- pieces of SQL

H = """h as (select e.event_type as symbol, date_trunc('hour', e.ts) as ts, first(e.value order by e.ts, e.event_id) as open, max(e.value) as high,
  min(e.value) as low, last(e.value order by e.ts, e.event_id) as close, count(e.value)::double as volume from events e where e.value is not null group by 1, 2)"""
D = """h as (select l_returnflag as symbol, date_trunc('day', l_shipdate) as ts, first(v order by l_shipdate, l_orderkey, l_linenumber) as open, max(v) as high,
  min(v) as low, last(v order by l_shipdate, l_orderkey, l_linenumber) as close, count(v)::double as volume
  from (select *, l_extendedprice / l_quantity as v from lineitem) where v is not null group by 1, 2)"""
W = "(partition by symbol order by ts)"
LR = "ln(close) - lag(ln(close)) over " + W


def over(n: int) -> str:
    return f"(partition by symbol order by ts rows between {n - 1} preceding and current row)"


def roll(f: str, x: str, n: int, least: int | None = None) -> str:
    return f"(case when count({x}) over {over(n)} >= {least or n} then {f}({x}) over {over(n)} end)"


def chain(*steps: str, bars: str = H, last: str) -> str:
    """With the bars as h, then a, b, c ... each selecting from the one before as `prev`."""
    out, prev = [bars], "h"
    for name, step in zip("abcdefg", steps):
        out.append(f"{name} as (select *, {step} from {prev})")
        prev = name
    return "with recursive " + ",\n".join(out) + f"\nselect {last} from {prev}"


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


# -- bars and their quality


@query(chain(last="symbol, ts, " + r("open", "high", "low", "close") + ", volume"))
def bars_hourly(spark, d):
    return shown(hourly(spark, d), "open", "high", "low", "close", "volume")


@query(chain(bars=D, last="symbol, ts, " + r("open", "high", "low", "close") + ", volume"))
def bars_daily(spark, d):
    return shown(daily(spark, d), "open", "high", "low", "close", "volume")


_SLOTS = f"""with {H}, m as (select symbol, min(ts) as a, max(ts) as b from h group by 1 having min(ts) < max(ts)),
s as (select symbol, unnest(generate_series(a, b, interval 1 hour)) as ts from m),
x as (select * from s where isodow(ts) <= 5 or (isodow(ts) = 7 and hour(ts) >= 22))"""


@query(f"{_SLOTS} select symbol, ts from x anti join h using (symbol, ts)")
def missing_bars(spark, d):
    return quality.missing_bars(hourly(spark, d))


@query(
    f"""{_SLOTS}, g as (select symbol, count(*) as expected_bars, count(*) filter (where not exists (select 1 from h where h.symbol = x.symbol and h.ts = x.ts)) as missing_bars from x group by 1),
q as (select *, close / nullif(lag(close) over {W}, 0) - 1 as ret from h), z as (select symbol, avg(ret) as m, stddev_samp(ret) as s from q group by 1),
c as (select q.symbol, count(*) as n_bars, count(*) filter (where high < open or high < close or high < low) + count(*) filter (where low > open or low > close or low > high) as ohlc_violations,
  count(*) filter (where high < low) as negative_spreads, count(*) filter (where volume = 0) as zero_volume_bars, count(*) filter (where abs(ret - m) > 3 * s) as outliers,
  round(avg(close), 6) as mean_close, round(stddev_samp(ret), 6) as std_return from q join z using (symbol) group by 1),
p as (select *, missing_bars * 100.0 / expected_bars as missing_pct from c join g using (symbol))
select symbol, n_bars, ohlc_violations, negative_spreads, zero_volume_bars, outliers, mean_close, std_return, missing_bars, expected_bars,
  round(greatest(0, 100 - least(5.0 * ohlc_violations, 30) - least(10.0 * negative_spreads, 30) - least(0.5 * missing_pct, 20) - least(0.1 * outliers, 10) - least(0.05 * zero_volume_bars, 10)), 1) as score from p"""
)
def quality_report(spark, d):
    q = quality.quality_report(hourly(spark, d), sigmas=3.0)
    cols = ["symbol", "n_bars", "ohlc_violations", "negative_spreads", "zero_volume_bars", "outliers", "missing_bars", "expected_bars"]
    return q.select(*cols, F.round("mean_close", 6).alias("mean_close"), F.round("std_return", 6).alias("std_return"), F.round("quality_score", 1).alias("score"))


@query()
def quality_checks(spark, d):
    return quality.checks(hourly(spark, d), "ts")


@query(
    f"""with {H}, m as (select symbol, min(ts) as a, max(ts) as b from h group by 1), s as (select symbol, unnest(generate_series(a, b, interval 1 hour)) as ts from m),
j as (select s.symbol, s.ts, open, high, low, close, volume, last_value(close ignore nulls) over (partition by s.symbol order by s.ts) as c from s left join h on h.symbol = s.symbol and h.ts = s.ts)
select symbol, ts, round(coalesce(open, c), 6) as open, round(coalesce(high, c), 6) as high, round(coalesce(low, c), 6) as low, round(c, 6) as close, coalesce(volume, 0) as volume from j"""
)
def fill_gaps(spark, d):
    h = hourly(spark, d)
    span = h.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("ts"))
    return shown(src.fill_gaps(grid.join(h, ["symbol", "ts"], "left")), "open", "high", "low", "close", "volume")


@query("select event_type, date_trunc('hour', ts) as ts, event_id, value from events qualify row_number() over (partition by event_type, date_trunc('hour', ts) order by event_id) = 1")
def dedupe_first(spark, d):
    e = table(spark, d, "events").select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")
    return src.first_of(e, ("event_type", "ts"), "event_id")


# -- window features


@query(chain(f"{LR} as lr, close / lag(close) over {W} - 1 as sr", last="symbol, ts, " + r("lr", "sr")))
def returns(spark, d):
    return shown(Series(hourly(spark, d)).log_return("lr").simple_return("sr").df, "lr", "sr")


@query(chain(f"{LR} as lr", f"{roll('stddev_samp', 'lr', 20)} as rv, (lr - {roll('avg', 'lr', 20)}) / nullif({roll('stddev_samp', 'lr', 20)}, 0) as z", last="symbol, ts, " + r("rv", "z")))
def rolling_vol_z(spark, d):
    return shown(Series(hourly(spark, d)).log_return("lr").volatility("rv", "lr").zscore("z", "lr").df, "rv", "z")


@query(SQL["rolling_vol_z"])
def rolling_vol_z_stretched(spark, d):
    """The same over stretches of 300 rows of each series."""
    make = lambda df, keys: Series(df, keys).log_return("lr").volatility("rv", "lr").zscore("z", "lr").df
    return shown(by_stretch(hourly(spark, d), ("symbol",), "ts", 300, 20, make), "rv", "z")


@query(
    chain(
        f"ln(close) - lag(ln(close), 10) over {W} as mom, close - lag(close) over {W} as c",
        "case when c is not null then greatest(c, 0) end as g, case when c is not null then greatest(-c, 0) end as l",
        f"{roll('avg', 'g', 14)} as ag, {roll('avg', 'l', 14)} as al",
        "case when al = 0 and ag > 0 then 100 else 100 - 100 / (1 + ag / nullif(al, 0)) end as rsi",
        last="symbol, ts, " + r("mom", "rsi"),
    )
)
def momentum_rsi(spark, d):
    return shown(Series(hourly(spark, d)).momentum("mom").rsi("rsi", "close").df, "mom", "rsi")


_TR = f"greatest(high - low, abs(high - lag(close) over {W}), abs(low - lag(close) over {W})) as tr"
_ATR = roll("avg", "tr", 20)


@query(chain(f"{_TR}, high - low as rng, (close - low) / nullif(high - low, 0) as pos", f"{_ATR} as atr", last="symbol, ts, " + r("tr", "rng", "pos", "atr")))
def atr_range(spark, d):
    return shown(Series(hourly(spark, d)).true_range("tr").bar_range("rng").close_position("pos").atr("atr").df, "tr", "rng", "pos", "atr")


@query(chain(f"close - {roll('avg', 'close', 20)} as dv", f"dv / nullif({roll('stddev_samp', 'dv', 20)}, 0) as dist", last="symbol, ts, " + r("dist")))
def dist_ma(spark, d):
    return shown(Series(hourly(spark, d)).distance_from_ma("dist", "close").df, "dist")


@query(chain(f"{roll('avg', 'close', 10)} as e_mid", "e_mid * 1.02 as e_upper, e_mid * 0.98 as e_lower", last="symbol, ts, " + r("e_mid", "e_upper", "e_lower")))
def ma_env(spark, d):
    return shown(Series(hourly(spark, d)).envelope("e", "close", 10, 2.0).df, "e_mid", "e_upper", "e_lower")


_SPREAD = f"{roll('avg', 'close', 5)} - {roll('avg', 'close', 20)} as sp"


@query(chain(_SPREAD, "case when sp > 0 then 1.0::double when sp is not null then -1.0::double end as xo", last="symbol, ts, xo"))
def crossover_signal(spark, d):
    return shown(Series(hourly(spark, d)).crossover("xo", "close", 5, 20).df, "xo")


@query(
    "with recursive "
    + H
    + f""", a as (select *, {_SPREAD} from h), b as (select *, sign(sp) as g from a where sp is not null),
c as (select *, case when g is distinct from lag(g) over {W} then 1 else 0 end as chg from b), e as (select *, sum(chg) over {W} as isl from c),
f as (select symbol, ts, row_number() over (partition by symbol, isl order by ts) - 1 as age from e)
select h.symbol, h.ts, f.age from h left join f on f.symbol = h.symbol and f.ts = h.ts"""
)
def crossover_age(spark, d):
    return shown(Series(hourly(spark, d)).crossover_age("age", "close", 5, 20).df, "age")


@query(chain(_TR, f"{_ATR} as atr", f"(close - {roll('avg', 'close', 30)}) / nullif(atr, 0) as td, ({roll('avg', 'close', 10)} - {roll('avg', 'close', 40)}) / nullif(atr, 0) as ms", last="symbol, ts, " + r("td", "ms")))
def trend_dev(spark, d):
    return shown(Series(hourly(spark, d)).atr("atr").deviation_from_ma("td", "close", 30, "atr").ma_spread("ms", "close", 10, 40, "atr").df, "td", "ms")


@query(chain(f"close - lag(close) over {W} as sl, close - 2 * lag(close) over {W} + lag(close, 2) over {W} as cv", last="symbol, ts, " + r("sl", "cv")))
def slope_curv(spark, d):
    return shown(Series(hourly(spark, d)).slope("sl", "close").curvature("cv", "close").df, "sl", "cv")


_REGIME = [
    f"{LR} as lr",
    f"{roll('stddev_samp', 'lr', 20)} as rv",
    f"case when count(rv) over {over(100)} >= 100 then quantile_cont(rv, 0.33) over {over(100)} end as q1, case when count(rv) over {over(100)} >= 100 then quantile_cont(rv, 0.67) over {over(100)} end as q2",
    "case when rv is null or q1 is null then null when rv < q1 then 0.0::double when rv >= q2 then 2.0::double else 1.0::double end as regime",
]


@query(chain(*_REGIME, last="symbol, ts, regime"))
def vol_regime(spark, d):
    return shown(Series(hourly(spark, d)).log_return("lr").vol_regime("regime", "lr", 20, 100).df, "regime")


@query(
    chain(
        f"{LR} as lr",
        f"{roll('stddev_samp', 'lr', 20)} as rv",
        f"list(rv) filter (where rv is not null) over {over(100)} as vs",
        "case when len(vs) >= 100 and rv is not null then (len(list_filter(vs, lambda x: x < rv)) + (len(list_filter(vs, lambda x: x = rv)) + 1) / 2.0) / len(vs) * 100 end as pct",
        last="symbol, ts, " + r("pct"),
    )
)
def vol_pctile(spark, d):
    return shown(Series(hourly(spark, d)).log_return("lr").vol_percentile("pct", "lr", 20, 100).df, "pct")


@query(chain(f"(close - {roll('avg', 'close', 200, 30)}) / nullif({roll('stddev_samp', 'close', 200, 30)}, 0) as zn", last="symbol, ts, " + r("zn")))
def zscore_norm(spark, d):
    return shown(Series(hourly(spark, d)).normalised({"zn": "close"}, "zscore", 200, 30).df, "zn")


def _rank_sql(x: str, n: int, least: int, out: str, scale: str = "") -> list[str]:
    return [
        f"list({x}) filter (where {x} is not null) over {over(n)} as vs",
        f"case when len(vs) >= {least} then len(list_filter(vs, lambda v: v <= vs[-1])) / len(vs)::double {scale} end as {out}",
    ]


@query(chain("case when volume > 3 then close end as x", *_rank_sql("x", 100, 30, "rk"), last="symbol, ts, " + r("rk")))
def rank_norm(spark, d):
    h = hourly(spark, d).withColumn("x", F.when(F.col("volume") > 3, F.col("close")))
    return shown(Series(h).rank("rk", "x", 100, 30).df, "rk")


@query(chain(_TR, f"{_ATR} as atr", f"abs(close - lag(close, 20) over {W}) / nullif(atr, 0) as x", *_rank_sql("x", 100, 30, "ts_", "* 100"), last="symbol, ts, " + r("ts_")))
def trend_strength(spark, d):
    return shown(Series(hourly(spark, d)).atr("atr").trend_strength("ts_", "close", "atr", 20, 100, 30).df, "ts_")


@query(
    chain(
        f"close - lag(close) over {W} as sl",
        f"last_value(sign(sl) ignore nulls) over {over(48)} as g, count(sl) over {over(48)} as n, count(*) filter (where sl > 0) over {over(48)} as up, count(*) filter (where sl < 0) over {over(48)} as dn",
        "case when n >= 10 then case when g > 0 then up / n::double when g < 0 then dn / n::double end end as tc",
        last="symbol, ts, " + r("tc"),
    )
)
def trend_consistency(spark, d):
    return shown(Series(hourly(spark, d)).slope("sl", "close").trend_consistency("tc", "sl").df, "tc")


@query(chain(_TR, f"{_ATR} as atr", f"avg((high - low) / nullif(atr, 0)) over {over(20)} as hs", last="symbol, ts, " + r("hs")))
def hl_spread(spark, d):
    return shown(Series(hourly(spark, d)).atr("atr").spread_ratio("hs", "atr").df, "hs")


@query(chain(f"{LR} as lr", f"{roll('stddev_samp', 'lr', 20)} as rv", f"(rv - {roll('avg', 'rv', 100, 30)}) / nullif({roll('stddev_samp', 'rv', 100, 30)}, 0) as vz", last="symbol, ts, " + r("vz")))
def vol_zscore(spark, d):
    return shown(Series(hourly(spark, d)).log_return("lr").vol_zscore("vz", "lr", 20, 100, 30).df, "vz")


@query(chain(f"close / nullif({roll('stddev_samp', 'close', 100, 50)}, 0) as sn", last="symbol, ts, " + r("sn")))
def std_norm(spark, d):
    return shown(Series(hourly(spark, d)).over_std("sn", "close", 100).df, "sn")


@query()
def hp_causal(spark, d):
    return shown(causal_trends(hourly(spark, d), "close", {"t1": 1e4, "t2": 1e6}, 60), "t1", "t2", places=4)


@query()
def hp_causal_stretched(spark, d):
    return shown(causal_trends(hourly(spark, d), "close", {"t1": 1e4, "t2": 1e6}, 60, stretch_rows=200), "t1", "t2", places=4)


@query()
def lambda_sens(spark, d):
    return shown(Series(causal_trends(hourly(spark, d), "close", {"t1": 1e4, "t2": 1e6}, 60)).disagreement("ls", ["t1", "t2"]).df, "ls", places=4)


@query()
def hp_two_sided(spark, d):
    s = Series(two_sided_trend(hourly(spark, d), "close")).zscore("cycle_z", "cycle", 50)
    return shown(s.df, "trend", "cycle", "cycle_z")


@query()
def hp_grid_cache(spark, d):
    """All six smoothing parameters of the research grid over a window of 500."""
    lambdas = {"hp_1m": 1e6, "hp_10m": 1e7, "hp_100m": 1e8, "hp_1b": 1e9, "hp_3_9b": 3.9e9, "hp_100b": 1e11}
    return shown(causal_trends(hourly(spark, d), "close", lambdas, 500), *lambdas)


@query(
    f"""with recursive {H}, n as (select symbol, ts, close, row_number() over {W} as k from h),
e as (select symbol, ts, k, close as em from n where k = 1 union all select n.symbol, n.ts, n.k, e.em + (n.close - e.em) * 2.0 / 11 from e join n on n.symbol = e.symbol and n.k = e.k + 1)
select symbol, ts, round(em, 6) as em from e"""
)
def ema(spark, d):
    return shown(Series(hourly(spark, d)).ema("em", "close", 10).df, "em")


_FWD = f"ln(lead(close, 4) over {W} / close) as f4"


@query(
    chain(
        f"{LR} as lr, {_FWD}",
        f"case when count(lr) over (partition by symbol order by ts rows between 1 following and 4 following) = 4 then sum(lr) over (partition by symbol order by ts rows between 1 following and 4 following) end as s4,"
        f"case when count(lr) over (partition by symbol order by ts rows between 4 following and 7 following) = 4 then sum(lr) over (partition by symbol order by ts rows between 4 following and 7 following) end as p4",
        last="symbol, ts, " + r("f4", "s4", "p4"),
    )
)
def fwd_returns(spark, d):
    return shown(Series(hourly(spark, d)).log_return("lr").forward_return("f4", 4).forward_sum("s4", 4, "lr").forward_sum("p4", 4, "lr", True).df, "f4", "s4", "p4")


# -- statistics

_FEATURES = ("mom", "td", "rv")


def _features(spark, d, horizons=(1, 4, 24)) -> DataFrame:
    s = Series(hourly(spark, d)).log_return("lr").momentum("mom").atr("atr").deviation_from_ma("td", "close", 30, "atr").volatility("rv", "lr")
    for h in horizons:
        s = s.forward_return(f"f{h}", h)
    return s.df


_FEATURES_SQL = f"""with recursive {H}, f0 as (select *, {LR} as lr, ln(close) - lag(ln(close), 10) over {W} as mom, {_TR}, close - {roll('avg', 'close', 30)} as dv,
  ln(lead(close, 1) over {W} / close) as f1, ln(lead(close, 4) over {W} / close) as f4, ln(lead(close, 24) over {W} / close) as f24 from h),
f as (select *, dv / nullif({_ATR}, 0) as td, {roll('stddev_samp', 'lr', 20)} as rv from f0)"""
_LONG_SQL = (
    _FEATURES_SQL
    + """, l as (select feature, horizon, x, y from (
  """
    + "\n  union all ".join(f"select '{x}' as feature, {n} as horizon, {x} as x, f{n} as y from f" for x in _FEATURES for n in (1, 4, 24))
    + """) where x is not null and y is not null),
k as (select *, rank() over (partition by feature, horizon order by x) + (count(*) over (partition by feature, horizon, x) - 1) / 2.0 as rx,
  rank() over (partition by feature, horizon order by y) + (count(*) over (partition by feature, horizon, y) - 1) / 2.0 as ry from l),
i as (select feature, horizon, corr(rx, ry) as ic, count(*) as n_obs from k group by 1, 2)"""
)


def _pairs(spark, d) -> DataFrame:
    """(symbol, feature, value, horizon, fwd)."""
    return _paired(_features(spark, d))


def _paired(features: DataFrame) -> DataFrame:
    one = features.unpivot(["symbol", "ts", "f1", "f4", "f24"], list(_FEATURES), "feature", "value")
    two = one.unpivot(["symbol", "ts", "feature", "value"], ["f1", "f4", "f24"], "h", "fwd")
    return two.withColumn("horizon", F.substring("h", 2, 9).cast("int"))


@query(_LONG_SQL + " select feature, horizon, round(ic, 6) as ic, n_obs from i")
def ic_horizons(spark, d):
    return stats.information(_pairs(spark, d), ("feature", "horizon"), "value", "fwd").select("feature", "horizon", F.round("ic", 6).alias("ic"), "n_obs")


@query()
def ic_significance(spark, d):
    i = stats.information(_pairs(spark, d), ("feature", "horizon"), "value", "fwd")
    return shown(i.withColumns({"ic": F.round("ic", 5), "p_value": F.round("p_value", 4)}), "n_obs", "ic", "p_value", "significant", "stars", keys=("feature", "horizon"))


@query(_LONG_SQL + " select feature, arg_max(horizon, abs(ic)) as peak_horizon, round(arg_max(ic, abs(ic)), 6) as peak_ic from i group by 1")
def ic_decay(spark, d):
    ics = stats.information(_pairs(spark, d), ("feature", "horizon"), "value", "fwd")
    return stats.decay_peak(ics, ("feature",)).withColumn("peak_ic", F.round("peak_ic", 6))


@query(_LONG_SQL + " select feature, horizon, count(*) as n_obs, count(*) filter (where sign(x) = sign(y)) as hits, round(count(*) filter (where sign(x) = sign(y)) / count(*)::double, 6) as hit_rate from l where x <> 0 and y <> 0 group by 1, 2")
def hit_rate(spark, d):
    return stats.hit_rate(_pairs(spark, d), ("feature", "horizon"), "value", "fwd").select("feature", "horizon", "n_obs", "hits", F.round("hit_rate", 6).alias("hit_rate"))


_QUANTILE_SQL = (
    _LONG_SQL
    + """, q as (select feature, horizon, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) as e, count(*) as n from l group by 1, 2 having count(*) >= 150),
m as (select l.feature, l.horizon, len(list_filter(list_distinct(e), lambda v: v < x)) as bin, count(*) as n, avg(y) * 10000 as mean_bps from l join q using (feature, horizon) group by 1, 2, 3)"""
)


@query(_QUANTILE_SQL + " select feature, horizon, bin, n, round(mean_bps, 4) as mean_bps from m")
def quantile_returns(spark, d):
    q = stats.quantile_returns(_pairs(spark, d), ("feature", "horizon"), "value", "fwd")
    return q.select("feature", "horizon", F.col("bin").cast("bigint").alias("bin"), "n", F.round("mean_bps", 4).alias("mean_bps"))


@query(_QUANTILE_SQL + ", z as (select *, rank() over (partition by feature, horizon order by mean_bps) as rk from m) select feature, horizon, round(corr(bin, rk), 6) as rho from z group by 1, 2")
def quantile_monotonicity(spark, d):
    q = stats.quantile_returns(_pairs(spark, d), ("feature", "horizon"), "value", "fwd")
    return stats.monotonicity(q, ("feature", "horizon")).select("feature", "horizon", F.round("rho", 6).alias("rho"))


_REGIME_CHAIN = _FEATURES_SQL + f""", g1 as (select *, case when count(rv) over {over(100)} >= 100 then quantile_cont(rv, 0.33) over {over(100)} end as q1,
  case when count(rv) over {over(100)} >= 100 then quantile_cont(rv, 0.67) over {over(100)} end as q2 from f),
g as (select *, case when rv is null or q1 is null then null when rv < q1 then 0.0::double when rv >= q2 then 2.0::double else 1.0::double end as regime from g1)"""


@query(
    _REGIME_CHAIN
    + """, p as (select regime, td as x, f4 as y from g where regime is not null and td is not null and f4 is not null),
k as (select *, rank() over (partition by regime order by x) + (count(*) over (partition by regime, x) - 1) / 2.0 as rx, rank() over (partition by regime order by y) + (count(*) over (partition by regime, y) - 1) / 2.0 as ry from p)
select regime, round(corr(rx, ry), 6) as ic, count(*) as n_obs from k group by 1"""
)
def regime_ic(spark, d):
    s = Series(_features(spark, d)).vol_regime("regime", "lr", 20, 100).df.where("regime is not null")
    return stats.information(s, ("regime",), "td", "f4").select("regime", F.round("ic", 6).alias("ic"), "n_obs")


@query(_REGIME_CHAIN + " select regime, count(f4) as n, round(avg(f4) * 10000, 4) as mean_bps, round(stddev_samp(f4) / sqrt(count(f4)) * 10000, 4) as se_bps from g where regime is not null and f4 is not null group by 1")
def regime_returns(spark, d):
    s = Series(_features(spark, d)).vol_regime("regime", "lr", 20, 100).df.where("regime is not null and f4 is not null")
    return s.groupBy("regime").agg(F.count("f4").alias("n"), F.round(F.avg("f4") * 10_000, 4).alias("mean_bps"), F.round(F.stddev_samp("f4") / F.sqrt(F.count("f4")) * 10_000, 4).alias("se_bps"))


@query(
    _REGIME_CHAIN
    + """, m as (select symbol, lag(regime) over (partition by symbol order by ts) as before, regime as after from g where regime is not null),
c as (select symbol, before, after, count(*) as n from m where before is not null group by all)
select symbol, before, after, n, round(n * 100.0 / sum(n) over (partition by symbol, before), 6) as pct from c"""
)
def transition_matrix(spark, d):
    s = Series(_features(spark, d)).vol_regime("regime", "lr", 20, 100).df
    return stats.transitions(s, "regime").withColumn("pct", F.round("pct", 6))


@query(
    _FEATURES_SQL
    + """, q as (select symbol, quantile_cont(rv, 0.25) as a, quantile_cont(rv, 0.75) as b from f where rv is not null group by 1),
g as (select f.symbol, case when rv > b then 'high' when rv < a then 'low' when rv is not null then 'medium' end as regime, lr from f join q using (symbol))
select symbol, regime, count(*) as n, round(avg(lr), 6) as mean, round(stddev_samp(lr), 6) as std, round(min(lr), 6) as least, round(max(lr), 6) as most from g where regime is not null group by 1, 2"""
)
def quartile_regimes(spark, d):
    g = stats.quartile_regimes(_features(spark, d), "rv").where("regime is not null")
    f = lambda c, n: F.round(c, 6).alias(n)
    return g.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"), f(F.avg("lr"), "mean"), f(F.stddev_samp("lr"), "std"), f(F.min("lr"), "least"), f(F.max("lr"), "most"))


def _corr_sql(a: str, b: str) -> str:
    return f"""select '{a}' as feature_a, '{b}' as feature_b, corr(rx, ry) as corr, count(*) as n_obs from (
  select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry
  from (select {a} as x, {b} as y from f where {a} is not null and {b} is not null))"""


_MATRIX_SQL = _FEATURES_SQL + ", m as (" + " union all ".join(_corr_sql(a, b) for a, b in (("mom", "td"), ("mom", "rv"), ("mom", "lr"), ("td", "rv"), ("td", "lr"), ("rv", "lr"))) + ")"


@query(_MATRIX_SQL + " select feature_a, feature_b, round(corr, 6) as corr, n_obs from m")
def corr_matrix(spark, d):
    return shown(stats.correlations(_features(spark, d), (*_FEATURES, "lr")), "corr", "n_obs", keys=("feature_a", "feature_b"))


@query(_FEATURES_SQL + " select 'mom' as feature_a, 'td' as feature_b, round(corr(mom, td), 6) as corr, count(*) filter (where mom is not null and td is not null) as n_obs from f")
def corr_pearson(spark, d):
    return shown(stats.correlations(_features(spark, d), ("mom", "td"), "pearson"), "corr", "n_obs", keys=("feature_a", "feature_b"))


@query(_MATRIX_SQL + " select feature_a, feature_b, round(corr, 6) as corr, n_obs from m where abs(corr) > 0.5")
def redundant_pairs(spark, d):
    return shown(stats.redundant(stats.correlations(_features(spark, d), (*_FEATURES, "lr")), 0.5), "corr", "n_obs", keys=("feature_a", "feature_b"))


_WALK_SQL = (
    _FEATURES_SQL
    + f""", w as (select symbol, (row_number() over {W} - 1) // 120 as block, td as x, f4 as y from f),
v as (select * from w where x is not null and y is not null),
k as (select *, rank() over (partition by symbol, block order by x) + (count(*) over (partition by symbol, block, x) - 1) / 2.0 as rx, rank() over (partition by symbol, block order by y) + (count(*) over (partition by symbol, block, y) - 1) / 2.0 as ry from v),
i as (select symbol, block, corr(rx, ry) as ic, count(*) as n_obs from k group by 1, 2 having count(*) >= 30)"""
)


@query(_WALK_SQL + " select symbol, block, round(ic, 6) as ic, n_obs from i")
def walk_forward(spark, d):
    return shown(stats.walk_forward(_features(spark, d), "td", 4, 120), "ic", "n_obs", keys=("symbol", "block"))


@query(
    _WALK_SQL
    + """, a as (select symbol, avg(ic) as m from i group by 1) select symbol, count(*) as n_periods, round(avg(ic), 6) as mean_ic, round(stddev_samp(ic), 6) as std_ic,
  round(avg(case when sign(ic) = sign(m) then 1.0 else 0.0 end), 6) as sign_consistency from i join a using (symbol) group by 1"""
)
def stability(spark, d):
    s = stats.stability(stats.walk_forward(_features(spark, d), "td", 4, 120), ("symbol",))
    return shown(s, "n_periods", "mean_ic", "std_ic", "sign_consistency", keys=("symbol",))


@query(
    _FEATURES_SQL
    + f""", z as (select *, td / nullif({roll('stddev_samp', 'td', 100, 50)}, 0) as z from f),
s as (select symbol, z, horizon, v from (select symbol, z, 4 as horizon, case when count(lr) over (partition by symbol order by ts rows between 1 following and 4 following) = 4 then sum(lr) over (partition by symbol order by ts rows between 1 following and 4 following) end as v from z
  union all select symbol, z, 12, case when count(lr) over (partition by symbol order by ts rows between 1 following and 12 following) = 12 then sum(lr) over (partition by symbol order by ts rows between 1 following and 12 following) end from z) where z is not null and v is not null),
e as (select symbol, t.threshold, horizon, -sign(z) * v * 10000 as b from s join (values (1.0::double), (1.5::double)) t(threshold) on abs(z) > t.threshold)
select symbol, threshold, horizon, count(*) as n_events, case when count(*) >= 10 then round(avg(b), 4) end as mean_signed_bps, case when count(*) >= 10 then round(avg(case when b > 0 then 1.0 else 0.0 end), 6) end as pct_positive from e group by 1, 2, 3"""
)
def event_decay(spark, d):
    t = spark.createDataFrame([(1.0,), (1.5,)], "threshold double")
    e = stats.event_decay(_features(spark, d), "td", "lr", t, (4, 12), 100)
    return e.select("symbol", "threshold", "horizon", "n_events", F.round("mean_signed_bps", 4).alias("mean_signed_bps"), F.round("pct_positive", 6).alias("pct_positive"))


@query(
    _FEATURES_SQL
    + """, x as (select symbol, ts, lr - avg(lr) over (partition by symbol) as e, count(lr) over (partition by symbol) as n from f where lr is not null),
y as (select *, row_number() over (partition by symbol order by ts) as k from x), v as (select symbol, sum(e * e) as v, any_value(n) as n from y group by 1),
c as (select a.symbol, g.lag as lag, sum(a.e * b.e) as p from y a join range(1, 6) g(lag) on true join y b on b.symbol = a.symbol and b.k = a.k - g.lag group by 1, 2)
select c.symbol, c.lag, round(p / v, 6) as acf, round(n * (n + 2) * sum((p / v) * (p / v) / (n - lag)) over (partition by c.symbol order by lag), 5) as q from c join v using (symbol)"""
)
def acf_ljung(spark, d):
    a = stats.autocorrelation(_features(spark, d), "lr", 5)
    return a.select("symbol", F.col("lag").cast("bigint").alias("lag"), F.round("acf", 6).alias("acf"), F.round("q", 5).alias("q"))


@query()
def acf_tests(spark, d):
    a = stats.autocorrelation(_features(spark, d), "lr", 20).withColumn("q", F.round("q", 4))
    return shown(a, "acf", "pacf", "q", "p_value", "outside", keys=("symbol", "lag"))


@query()
def adf(spark, d):
    a = stats.dickey_fuller(stats.long(_features(spark, d), (*_FEATURES, "close", "lr"), KEY), "value", ("symbol", "feature")).withColumn("statistic", F.round("statistic", 4))
    return shown(a, "n_obs", "lags", "statistic", "p_value", "critical_1", "critical_5", "is_stationary", keys=("symbol", "feature"))


@query()
def kpss(spark, d):
    long = stats.long(_features(spark, d), ("close", "lr"), KEY)
    both = stats.level_stationarity(long, "value", ("symbol", "feature")).join(stats.dickey_fuller(long, "value", ("symbol", "feature")).select("symbol", "feature", F.col("p_value").alias("adf_p")), ["symbol", "feature"])
    return shown(both.withColumn("verdict", stats.verdict(F.col("adf_p"), F.col("p_value"))), "n_obs", "lags", "statistic", "p_value", "adf_p", "verdict", keys=("symbol", "feature"))


@query()
def arch_lm(spark, d):
    a = stats.arch_lm(_features(spark, d), "lr").withColumns({"lm": F.round("lm", 4), "f": F.round("f", 4)})
    return shown(a, "n_obs", "lm", "lm_p", "f", "f_p", keys=("symbol",))


@query()
def rolling_ic(spark, d):
    rolled = stats.rolling_information(_features(spark, d), "td", "f4", 200)
    return shown(stats.rolling_summary(rolled, ("symbol",)), "mean_ic", "std_ic", "ic_ir", "pct_positive", "pct_above_5", keys=("symbol",))


def _stationary(features: DataFrame) -> DataFrame:
    """(feature, p_value, is_stationary): a feature is as stationary as its least stationary series."""
    each = stats.dickey_fuller(stats.long(features, _FEATURES, KEY), "value", ("symbol", "feature"))
    return each.groupBy("feature").agg(F.max("p_value").alias("p_value"), F.min("is_stationary").alias("is_stationary"))


@query()
def univariate(spark, d):
    features = written(_features(spark, d), "features")
    pairs = _paired(features)
    peaks = written(stats.decay_peak(stats.information(pairs, ("feature", "horizon"), "value", "fwd"), ("feature",)), "peaks")
    at_peak = written(pairs.join(peaks.select("feature", F.col("peak_horizon").alias("horizon")), ["feature", "horizon"]), "pairs")
    rolled = stats.rolling_summary(stats.rolling_information(at_peak, "value", "fwd", 200, keys=("feature", "symbol")), ("feature",))
    adf_ = _stationary(features)
    mono = stats.monotonicity(stats.quantile_returns(at_peak, ("feature",), "value", "fwd"), ("feature",))
    found = stats.univariate_summary(adf_, peaks, rolled, stats.hit_rate(at_peak, ("feature",), "value", "fwd"), mono)
    return shown(found, *[c for c in found.columns if c != "feature"], keys=("feature",))


@query()
def stability_features(spark, d):
    """How steady the sign of every feature's ic is over blocks of 120 rows of each series."""
    long = stats.long(_features(spark, d), _FEATURES, ("symbol", "ts", "close"))
    s = stats.stability(stats.walk_forward(long, "value", 4, 120, ("symbol", "feature")), ("feature",))
    return shown(s, "n_periods", "mean_ic", "std_ic", "sign_consistency", "is_stable", keys=("feature",))


@query()
def feature_selection(spark, d):
    f = written(_features(spark, d), "features")
    ics = written(stats.information(_paired(f).where("horizon = 4"), ("feature",), "value", "fwd").select("feature", "ic", "n_obs"), "ics")
    sizes = {row.feature: row.ic or 0.0 for row in ics.collect()}
    matrix = stats.correlations(f, _FEATURES)
    lost = spark.createDataFrame([(x, of) for x, of in stats.redundancies(matrix, sizes).items() if of is not None], "feature string, redundant_with string")
    adf_ = _stationary(f).select("feature", F.col("p_value").alias("adf_p"))
    blocks = stats.long(f.withColumn("f", F.col("f4")), _FEATURES, ("symbol", "ts", "close"))
    steady = stats.stability(stats.walk_forward(blocks, "value", 4, 120, ("symbol", "feature")), ("feature",)).select("feature", "sign_consistency")
    found = stats.selection(ics.join(adf_, "feature", "left").join(steady, "feature", "left").join(lost, "feature", "left"))
    return shown(found.withColumns({"ic": F.round("ic", 5), "t_stat": F.round("t_stat", 3)}), *[c for c in found.columns if c != "feature"], keys=("feature",))


@query()
def lambda_calibration(spark, d):
    t = causal_trends(hourly(spark, d), "close", {"t1": 1e4, "t2": 1e5, "t3": 1e6}, 60)
    return shown(stats.lambda_calibration(t, ("t1", "t2", "t3")), "slope_corr", "std_gap", "last_gap", keys=("symbol", "trend_a", "trend_b"), places=4)


@query(f"with {D} select symbol, count(close) as n, round(avg(close), 6) as mean, round(stddev_samp(close), 6) as std, round(min(close), 6) as least, round(quantile_cont(close, 0.25), 6) as q25, round(median(close), 6) as q50, round(quantile_cont(close, 0.75), 6) as q75, round(max(close), 6) as most from h group by 1")
def describe(spark, d):
    p = lambda q, n: F.round(F.percentile("close", q), 6).alias(n)
    return daily(spark, d).groupBy("symbol").agg(F.count("close").alias("n"), F.round(F.avg("close"), 6).alias("mean"), F.round(F.stddev_samp("close"), 6).alias("std"), F.round(F.min("close"), 6).alias("least"), p(0.25, "q25"), p(0.5, "q50"), p(0.75, "q75"), F.round(F.max("close"), 6).alias("most"))


# -- signals and backtests


@query(
    _FEATURES_SQL
    + """, s as (select symbol, ts, (coalesce(mom, 0) * 0.5 / 0.9 + coalesce(td, 0) * -0.3 / 0.9 + coalesce(rv, 0) * 0.1 / 0.9)
  / nullif(case when mom is not null then 0.5 / 0.9 else 0 end + case when td is not null then -0.3 / 0.9 else 0 end + case when rv is not null then 0.1 / 0.9 else 0 end, 0) as lin,
  sign(coalesce(sign(mom), 0) + coalesce(sign(td), 0) + coalesce(sign(rv), 0))::double as vote from f)
select symbol, ts, round(lin, 6) as lin, vote from s"""
)
def combine_features(spark, d):
    f = _features(spark, d)
    return shown(f.withColumns({"lin": signals.linear(_FEATURES, {"mom": 0.5, "td": -0.3, "rv": 0.1}), "vote": signals.vote(_FEATURES)}), "lin", "vote")


@query(_FEATURES_SQL + " select symbol, ts, case when td > 0.3 then 1.0 when td < -0.3 then -1.0 else 0.0 end::double as pb, round(case when td is not null then greatest(least(td, 1), -1) else 0 end, 6) as pp, coalesce(sign(td), 0)::double as pv from f")
def positions(spark, d):
    f = _features(spark, d)
    c = {n: signals.position(F.col("td"), m) for n, m in (("pb", "binary_threshold"), ("pp", "proportional"), ("pv", "ensemble_vote"))}
    return shown(f.withColumns(c), "pb", "pp", "pv")


_GATES_SQL = _REGIME_CHAIN + f""", x as (select *, {roll('avg', 'close', 5)} - {roll('avg', 'close', 20)} as sp from g),
xo as (select *, case when sp > 0 then 1.0::double when sp is not null then -1.0::double end as s from x)"""


@query(
    _GATES_SQL
    + """ select symbol, ts, case when regime = 1 then s else 0 end::double as gated, case when coalesce((s = 1 and td >= -1.5) or (s = -1 and td <= 1.5), false) then 0 else s end::double as exhausted,
  case when rv >= 0.9 then s else 0 end::double as floored, case when rv < 0.8 then sign(td)::double when rv >= 1.0 then coalesce(s, 0) else 0 end as switched from xo"""
)
def gates(spark, d):
    s = Series(_features(spark, d)).vol_regime("regime", "lr", 20, 100).crossover("s", "close", 5, 20).df
    c = F.col
    return shown(
        s.withColumns({
            "gated": machines.regime_gate(c("s"), c("regime")),
            "exhausted": machines.exhaustion_filter(c("s"), c("td")),
            "floored": machines.vol_floor(c("s"), c("rv"), 0.9),
            "switched": machines.regime_switch(c("rv"), F.signum("td"), c("s"), 0.8, 1.0),
        }),
        "gated", "exhausted", "floored", "switched",
    )


@query(
    _FEATURES_SQL
    + """, p as (select symbol, ts, case when td > 0.5 then 1.0 when td < -0.5 then -1.0 else 0.0 end::double as s, coalesce(mom > 0, false) as ok from f),
n as (select *, case when s <> 0 and coalesce(lag(s) over (partition by symbol order by ts), 0) = 0 then 1 else 0 end as nw from p),
u as (select *, sum(nw) over (partition by symbol order by ts) as run from n),
b as (select *, bool_or(s <> 0 and not ok) over (partition by symbol, run order by ts rows between unbounded preceding and current row) as bl from u)
select symbol, ts, case when s <> 0 and bl then 0 else s end::double as kept from b"""
)
def entry_filter(spark, d):
    f = _features(spark, d).withColumns({"s": signals.position(F.col("td"), "binary_threshold", 0.5), "ok": F.col("mom") > 0})
    return shown(machines.entry_filter(f, "s", "ok", "kept"), "kept")


@query()
def threshold_signal(spark, d):
    return shown(machines.threshold_signals(_features(spark, d), "td", "sig", 1.0, 24, 1, 100), "sig")


@query()
def crossing_signal(spark, d):
    return shown(machines.threshold_signals(_features(spark, d), "td", "sig", 1.0, 24, lookback=100, crossing=True), "sig")


_BT_SQL = f"""with recursive {H}, a as (select *, {_SPREAD} from h), b as (select *, case when sp > 0 then 1.0::double when sp is not null then -1.0::double end as signal from a),
c as (select *, coalesce(lag(signal) over {W}, 0) as position, coalesce(close / nullif(lag(close) over {W}, 0) - 1, 0) as ret from b),
e as (select *, coalesce(position - lag(position) over {W}, 0) as trade from c),
n as (select *, position * ret as gross_return, abs(trade) * 0.00009 as cost, position * ret - abs(trade) * 0.00009 as net_return from e),
q as (select *, product(1 + net_return) over (partition by symbol order by ts rows between unbounded preceding and current row) as equity from n)"""


def _run(spark, d) -> DataFrame:
    s = Series(hourly(spark, d)).crossover("signal", "close", 5, 20).df
    return bt.backtest(s, "signal", bt.FxCost(0.7, 0.2))


@query(_BT_SQL + " select symbol, ts, position, trade, round(gross_return, 6) as gross_return, round(cost, 8) as cost, round(net_return, 6) as net_return, round(ln(abs(equity) + 1e-12), 5) as log_equity from q")
def backtest(spark, d):
    b = _run(spark, d)
    return b.select(*KEY, "position", "trade", F.round("gross_return", 6).alias("gross_return"), F.round("cost", 8).alias("cost"), F.round("net_return", 6).alias("net_return"), F.round(F.ln(F.abs("equity") + 1e-12), 5).alias("log_equity"))


_METRICS = """count(net_return) as n_obs, round(avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt(6048), 4) as sharpe, round(avg(net_return) * 6048, 2) as annual_return,
  round(round(min(equity / peak - 1), 6), 4) as max_drawdown, floor(sum(abs(trade)) / 2)::bigint as n_trades"""

def _measured(m: DataFrame, *by: str) -> DataFrame:
    return m.select(*by, "n_obs", "sharpe", F.round("annual_return", 2).alias("annual_return"), F.round("max_drawdown", 4).alias("max_drawdown"), "n_trades")


@query(_BT_SQL + f", p as (select *, max(equity) over (partition by symbol order by ts rows between unbounded preceding and current row) as peak from q) select symbol, {_METRICS} from p group by 1")
def metrics(spark, d):
    return _measured(bt.metrics(_run(spark, d), ("symbol",)), "symbol")


@query()
def metrics_deflated(spark, d):
    m = bt.metrics(_run(spark, d), ("symbol",), n_trials=72)
    return m.select("symbol", "n_obs", "sharpe", F.round("skew", 4).alias("skew"), F.round("kurtosis", 4).alias("kurtosis"), F.round("pct_positive", 6).alias("pct_positive"), "trade_bars", "dsr")


def _grid_run(spark, d, keys=("symbol", "t1", "t2")) -> DataFrame:
    grid = spark.createDataFrame([(a, b) for a in (5, 10) for b in (20, 40)], "t1 int, t2 int")
    h = hourly(spark, d)
    s = Series(h)
    for n in (5, 10, 20, 40):
        s = s.sma(f"m{n}", "close", n)
    rows = bt.crossed(s.df, grid)
    pick = lambda c, ns: F.coalesce(*[F.when(F.col(c) == n, F.col(f"m{n}")) for n in ns])
    gap = pick("t1", (5, 10)) - pick("t2", (20, 40))
    return bt.backtest(rows.withColumn("signal", F.when(gap > 0, 1.0).when(gap.isNotNull(), -1.0)), "signal", bt.FxCost(0.7, 0.2), keys)


_GRID_SQL = f"""with recursive {H}, m as (select *, {", ".join(f"{roll('avg', 'close', n)} as m{n}" for n in (5, 10, 20, 40))} from h),
g as (select m.*, t1, t2, (case t1 when 5 then m5 else m10 end) - (case t2 when 20 then m20 else m40 end) as sp from m, (values (5, 20), (5, 40), (10, 20), (10, 40)) v(t1, t2)),
b as (select *, case when sp > 0 then 1.0::double when sp is not null then -1.0::double end as signal from g),
c as (select *, coalesce(lag(signal) over w, 0) as position, coalesce(close / nullif(lag(close) over w, 0) - 1, 0) as ret from b window w as (partition by symbol, t1, t2 order by ts)),
e as (select *, coalesce(position - lag(position) over (partition by symbol, t1, t2 order by ts), 0) as trade from c),
n as (select *, position * ret - abs(trade) * 0.00009 as net_return from e),
q as (select *, product(1 + net_return) over (partition by symbol, t1, t2 order by ts rows between unbounded preceding and current row) as equity from n),
p as (select *, max(equity) over (partition by symbol, t1, t2 order by ts rows between unbounded preceding and current row) as peak from q),
r as (select symbol, t1, t2, {_METRICS} from p group by 1, 2, 3)"""


def _grid(spark, d) -> DataFrame:
    return _measured(bt.metrics(_grid_run(spark, d), ("symbol", "t1", "t2")), "symbol", "t1", "t2")


@query(_GRID_SQL + " select * from r")
def grid_search(spark, d):
    return _grid(spark, d)


@query(_GRID_SQL + " select t1, t2, grouping_id(t1, t2) as level, count(*) as n, count(*) filter (where sharpe > 0) as positive, round(median(sharpe), 5) as median_sharpe, round(median(n_trades), 5) as median_trades from r group by grouping sets ((t1, t2), (t1), (t2), ())")
def grid_rollup(spark, d):
    g = _grid(spark, d)
    return g.groupingSets([[F.col("t1"), F.col("t2")], [F.col("t1")], [F.col("t2")], []], "t1", "t2").agg(
        F.grouping_id("t1", "t2").alias("level"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("sharpe") > 0).alias("positive"), F.round(F.median("sharpe"), 5).alias("median_sharpe"), F.round(F.median("n_trades"), 5).alias("median_trades")
    )


@query(_GRID_SQL + " select * from r order by sharpe desc, symbol, t1, t2 limit 5")
def topk_grid(spark, d):
    return _grid(spark, d).orderBy(F.col("sharpe").desc(), "symbol", "t1", "t2").limit(5)


@query(_GRID_SQL + " select * from r qualify row_number() over (partition by symbol order by sharpe desc, t1, t2) <= 2")
def topk_per_group(spark, d):
    w = Window.partitionBy("symbol").orderBy(F.col("sharpe").desc(), "t1", "t2")
    return _grid(spark, d).withColumn("_n", F.row_number().over(w)).where("_n <= 2").drop("_n")


@query(_GRID_SQL + " select symbol, round(median(sharpe) filter (where t2 = 20), 5) as t2_20, round(median(sharpe) filter (where t2 = 40), 5) as t2_40 from r group by 1")
def grid_pivot(spark, d):
    p = _grid(spark, d).groupBy("symbol").pivot("t2", [20, 40]).agg(F.round(F.median("sharpe"), 5))
    return p.withColumnsRenamed({"20": "t2_20", "40": "t2_40"})


def _daily_run(spark, d) -> DataFrame:
    return Series(daily(spark, d)).crossover("signal", "close", 5, 20).df


def _sliced_sql(slice_: str, measure: str) -> str:
    """Signals over the whole history, then rows of a slice as a series of their own."""
    return f"""with recursive {D}, a as (select *, {_SPREAD} from h), b0 as (select *, case when sp > 0 then 1.0::double when sp is not null then -1.0::double end as signal, {slice_} as part from a),
b as (select * from b0 where part is not null),
c as (select *, coalesce(lag(signal) over w, 0) as position, coalesce(close / nullif(lag(close) over w, 0) - 1, 0) as ret from b window w as (partition by symbol, part order by ts)),
e as (select *, coalesce(position - lag(position) over (partition by symbol, part order by ts), 0) as trade from c),
n as (select *, position * ret - abs(trade) * 0.00009 as net_return from e),
q as (select *, product(1 + net_return) over (partition by symbol, part order by ts rows between unbounded preceding and current row) as equity from n),
p as (select *, max(equity) over (partition by symbol, part order by ts rows between unbounded preceding and current row) as peak from q)
select symbol, part, {measure} from p group by 1, 2"""


_PLAIN = _METRICS.replace("round(round(min(equity / peak - 1), 6), 4) as max_drawdown,", "")


def _slices(spark, d, part) -> DataFrame:
    rows = _daily_run(spark, d).withColumn("part", part).where("part is not null")
    m = bt.metrics(bt.backtest(rows, "signal", bt.FxCost(0.7, 0.2), ("symbol", "part")), ("symbol", "part"))
    return m.select("symbol", "part", "n_obs", "sharpe", F.round("annual_return", 2).alias("annual_return"), "n_trades")


@query(_sliced_sql("case when ts <= timestamp '1998-12-31 23:59:59' then 'is' when ts >= timestamp '1999-01-01' then 'oos' end", _PLAIN))
def is_oos(spark, d):
    return _slices(spark, d, F.when(F.col("ts") <= F.lit("1998-12-31 23:59:59").cast("timestamp_ntz"), "is").when(F.col("ts") >= F.lit("1999-01-01").cast("timestamp_ntz"), "oos"))


@query(_sliced_sql("year(ts)::int", _PLAIN))
def yearly(spark, d):
    return _slices(spark, d, F.year("ts"))


@query(f"with {D}, n as (select *, row_number() over {W} as k, count(*) over (partition by symbol) as n from h) select symbol, ts, case when k >= floor(n * 0.8) + 1 then 'test' when k >= floor(n * 0.8) + 1 - 24 then 'gap' else 'train' end as part from n")
def train_test(spark, d):
    return bt.split(daily(spark, d), 0.2, 24).select("symbol", "ts", "part")


_RATES = [("A", "1995-01-01", 0.5, -1.2), ("A", "1998-06-15", 0.3, -0.9), ("N", "1997-01-01", -0.35, 0.15), ("R", "1994-01-01", 0.1, -0.8), ("R", "1996-02-29", 0.2, -1.0)]
_RATES_SQL = "t(symbol, date, long_bps, short_bps) as (values " + ", ".join(f"('{a}', date '{b}', {c}::double, {e}::double)" for a, b, c, e in _RATES) + ")"


@query(
    f"""with recursive {D}, {_RATES_SQL}, a as (select *, {_SPREAD} from h), b as (select symbol, ts, case when sp > 0 then 1.0::double when sp < 0 then -1.0::double else 0 end as position from a),
f as (select symbol, arg_min(long_bps, date) as l0, arg_min(short_bps, date) as s0 from t group by 1),
j as (select b.*, coalesce(t.long_bps, f.l0) as long_bps, coalesce(t.short_bps, f.s0) as short_bps from b asof left join t on t.symbol = b.symbol and t.date <= b.ts left join f on f.symbol = b.symbol)
select symbol, ts, long_bps, short_bps, coalesce(case when position > 0 then long_bps when position < 0 then short_bps end * abs(position), 0)::double as swap_bps from j"""
)
def swap_asof(spark, d):
    rates = spark.createDataFrame(_RATES, "symbol string, date string, long_bps double, short_bps double").withColumn("date", F.col("date").cast("date"))
    s = Series(daily(spark, d)).ma_spread("sp", "close", 5, 20).put(position=F.coalesce(F.signum("sp"), F.lit(0.0))).df
    return bt.swap_pnl(bt.as_of(s, rates, ("long_bps", "short_bps"))).select(*KEY, "long_bps", "short_bps", "swap_bps")


@query(
    """select o_orderkey, (o_orderkey % 15)::int as days, 2 * (select count(*) from range(0, o_orderkey % 15) g(i) where isodow(o_orderdate::date + i::int) = 3) as extra,
  round(0.5::double * ((o_orderkey % 15) + 2 * (select count(*) from range(0, o_orderkey % 15) g(i) where isodow(o_orderdate::date + i::int) = 3)), 6) as cost from orders"""
)
def triple_roll(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("start"), (F.col("o_orderkey") % 15).cast("int").alias("days"))
    return o.select("o_orderkey", "days", bt.triple_roll_days(F.col("start"), F.col("days")).cast("bigint").alias("extra"), F.round(bt.swap_cost(F.lit(0.5), F.lit(1.0), F.col("days"), F.col("start")), 6).alias("cost"))


@query(
    _GRID_SQL
    + """, best as (select symbol, t1, t2 from r qualify row_number() over (partition by symbol order by sharpe desc, t1, t2) = 1),
s(name, bps) as (values ('low', 0.9::double), ('mid', 1.5::double), ('high', 2.0::double)),
k as (select p.symbol, p.t1, p.t2, s.name, p.position * p.ret - abs(p.trade) * s.bps / 10000 as net from p join best using (symbol, t1, t2), s)
select symbol, t1, t2, name, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(6048), 4) as sharpe from k group by all"""
)
def cost_scenarios(spark, d):
    """The best combination of each series, tested again under three cost scenarios, 78 % spread and 22 % slippage."""
    run = _grid_run(spark, d)
    w = Window.partitionBy("symbol").orderBy(F.col("sharpe").desc(), "t1", "t2")
    best = _measured(bt.metrics(run, ("symbol", "t1", "t2")), "symbol", "t1", "t2").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("symbol", "t1", "t2")
    kept = run.join(best, ["symbol", "t1", "t2"], "left_semi")
    out = None
    for name, bps in (("low", 0.9), ("mid", 1.5), ("high", 2.0)):
        cost = bt.FxCost(bps * 0.78, bps * 0.22)
        one = kept.withColumn("net_return", F.col("gross_return") - cost.compute(F.col("trade"))).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    r = F.col("net_return")
    return out.groupBy("symbol", "t1", "t2", "name").agg(F.round(F.try_divide(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(6048)), 4).alias("sharpe"))


_OOS_SQL = f"""with recursive {D}, m as (select *, {", ".join(f"{roll('avg', 'close', n)} as m{n}" for n in (5, 10, 20, 40))} from h),
g as (select m.*, t1, t2, (case t1 when 5 then m5 else m10 end) - (case t2 when 20 then m20 else m40 end) as sp, case when ts <= timestamp '1998-12-31 23:59:59' then 'is' else 'oos' end as part from m, (values (5, 20), (5, 40), (10, 20), (10, 40)) v(t1, t2)),
b as (select *, case when sp > 0 then 1.0::double when sp is not null then -1.0::double end as signal from g),
c as (select *, coalesce(lag(signal) over w, 0) as position, coalesce(close / nullif(lag(close) over w, 0) - 1, 0) as ret from b window w as (partition by symbol, t1, t2, part order by ts)),
e as (select *, coalesce(position - lag(position) over (partition by symbol, t1, t2, part order by ts), 0) as trade from c),
i as (select symbol, t1, t2, avg(position * ret - abs(trade) * 0.00009) / nullif(stddev_samp(position * ret - abs(trade) * 0.00009), 0) as s, floor(sum(abs(trade)) / 2) as n_trades from e where part = 'is' group by 1, 2, 3),
best as (select * from i where n_trades >= 30 qualify row_number() over (partition by symbol order by s desc, t1, t2) = 1),
s(name, bps) as (values ('low', 0.9::double), ('mid', 1.5::double), ('high', 2.0::double)),
k as (select e.symbol, e.t1, e.t2, s.name, e.position * e.ret - abs(e.trade) * s.bps / 10000 as net from e join best using (symbol, t1, t2), s where part = 'oos')
select symbol, t1, t2, name, count(*) as n_obs, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(6048), 4) as sharpe from k group by all"""


@query(_OOS_SQL)
def selected_oos(spark, d):
    """Of each series the best combination with enough trades in sample, tested out of sample under three cost scenarios.
    Signals are made over the whole history; each slice is then a series of its own."""
    grid = spark.createDataFrame([(a, b) for a in (5, 10) for b in (20, 40)], "t1 int, t2 int")
    s = Series(daily(spark, d))
    for n in (5, 10, 20, 40):
        s = s.sma(f"m{n}", "close", n)
    gap = F.when(F.col("t1") == 5, F.col("m5")).otherwise(F.col("m10")) - F.when(F.col("t2") == 20, F.col("m20")).otherwise(F.col("m40"))
    part = F.when(F.col("ts") <= F.lit("1998-12-31 23:59:59").cast("timestamp_ntz"), "is").otherwise("oos")
    rows = bt.crossed(s.df, grid).withColumns({"signal": F.when(gap > 0, 1.0).when(gap.isNotNull(), -1.0), "part": part})
    by = ("symbol", "t1", "t2", "part")
    run = bt.backtest(rows, "signal", bt.FxCost(0.7, 0.2), by)
    inside = bt.metrics(run.where("part = 'is'"), by, by, n_trials=4).where("n_trades >= 30")
    w = Window.partitionBy("symbol").orderBy(F.col("sharpe").desc(), "t1", "t2")
    best = inside.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("symbol", "t1", "t2")
    outside = run.where("part = 'oos'").join(best, ["symbol", "t1", "t2"], "left_semi")
    scenarios = spark.createDataFrame([("low", 0.9), ("mid", 1.5), ("high", 2.0)], "name string, bps double")
    net = F.col("gross_return") - F.abs("trade") * F.col("bps") / 10_000
    each = bt.crossed(outside, scenarios).withColumn("net", net)
    return each.groupBy("symbol", "t1", "t2", "name").agg(F.count(F.lit(1)).alias("n_obs"), F.round(F.try_divide(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.lit(6048)), 4).alias("sharpe"))


@query()
def signal_grid(spark, d):
    """Crossing signals over thresholds and holds, volatility floors on them, and their measures."""
    f = Series(_features(spark, d)).vol_percentile("vp", "lr", 20, 100).df
    grid = spark.createDataFrame([(s, h) for s in (0.5, 1.0) for h in (12, 24)], "sigma double, hold int")
    rows = bt.crossed(f.select(*KEY, "close", "td", "vp"), grid)
    keys = ("symbol", "sigma", "hold")
    signalled = machines.threshold_signals(rows, "td", "raw", F.col("sigma"), F.col("hold"), lookback=100, crossing=True, keys=keys)
    floors = spark.createDataFrame([(0.0,), (50.0,)], "floor double")
    floored = bt.crossed(signalled, floors).withColumn("signal", machines.vol_floor(F.col("raw"), F.col("vp"), F.col("floor")))
    by = (*keys, "floor")
    return _measured(bt.metrics(bt.backtest(floored, "signal", bt.FxCost(0.7, 0.2), by), by, by, n_trials=8), *by)


@query()
def multi_factor(spark, d):
    config = bt.MultiFactorConfig(hp_lambda=1e4, hp_window=50, ma_short=10, ma_long=30, norm_window=100)
    return bt.multi_factor(hourly(spark, d), config).select(*KEY, F.round("combined", 6).alias("combined"), "signal")


@query()
def multi_factor_backtest(spark, d):
    config = bt.MultiFactorConfig(hp_lambda=1e4, hp_window=50, ma_short=10, ma_long=30, norm_window=100)
    m = bt.multi_factor_backtest(hourly(spark, d), config)
    # Compounded 6,048 times, a return has too few digits in common: its logarithm is shown.
    return m.select("symbol", "n_obs", F.round("sharpe", 6).alias("sharpe"), F.round(F.log10(1 + F.col("annual_return")), 6).alias("annual_log"), F.round("max_drawdown", 6).alias("max_drawdown"), "n_trades")


# -- long series


def minutes(spark: SparkSession, d: str) -> DataFrame:
    """One series of minute bars of all events: tens of thousands of bars from 100,000 events."""
    e = table(spark, d, "events")
    return src.bars(e, F.lit("ALL"), F.col("ts"), F.col("value"), [F.col("event_id")], "minute")


@query()
def hp_minutes(spark, d):
    """Six one-sided trends over a window of 500 rows of a long series."""
    lambdas = {"hp_1m": 1e6, "hp_10m": 1e7, "hp_100m": 1e8, "hp_1b": 1e9, "hp_3_9b": 3.9e9, "hp_100b": 1e11}
    return shown(causal_trends(minutes(spark, d), "close", lambdas, 500), *lambdas)


@query()
def rolling_ic_minutes(spark, d):
    """Rank correlation over the last 1,000 rows of a long series."""
    s = Series(minutes(spark, d)).momentum("mom", period=24).forward_return("f24", 24)
    s = s.put(mom=F.round("mom", 12), f24=F.round("f24", 12))  # equal values stay equal in any engine
    return stats.rolling_information(s.df, "mom", "f24", 1000).select(*KEY, F.round("rolling_ic", 9).alias("rolling_ic"))


# -- comparisons of results


def _yearly_sql() -> str:
    return "with y as (" + SQL["yearly"] + ")"


@query(
    f"""{_yearly_sql()} select symbol, case when part <= 1998 then 'is' else 'oos' end as period, count(*) as years, count(*) filter (where sharpe > 0) as positive,
  round(median(sharpe), 5) as median_sharpe, arg_max(part, sharpe) as best_year, arg_min(part, sharpe) as worst_year from y group by 1, 2"""
)
def yearly_rollup(spark, d):
    y = yearly(spark, d).withColumn("period", F.when(F.col("part") <= 1998, "is").otherwise("oos"))
    return y.groupBy("symbol", "period").agg(
        F.count(F.lit(1)).alias("years"), F.count_if(F.col("sharpe") > 0).alias("positive"), F.round(F.median("sharpe"), 5).alias("median_sharpe"), F.max_by("part", "sharpe").alias("best_year"), F.min_by("part", "sharpe").alias("worst_year")
    )


@query(_GRID_SQL + " select a.symbol, a.t1, a.sharpe as sharpe_20, b.sharpe as sharpe_40, round(b.sharpe - a.sharpe, 4) as delta, b.n_trades - a.n_trades as trades_delta from r a join r b on a.symbol = b.symbol and a.t1 = b.t1 and a.t2 = 20 and b.t2 = 40")
def grid_deltas(spark, d):
    """Two result tables side by side on their parameters, with differences."""
    g = _grid(spark, d)
    a = g.where("t2 = 20").select("symbol", "t1", F.col("sharpe").alias("sharpe_20"), F.col("n_trades").alias("_n"))
    b = g.where("t2 = 40").select("symbol", "t1", F.col("sharpe").alias("sharpe_40"), "n_trades")
    return a.join(b, ["symbol", "t1"]).select("symbol", "t1", "sharpe_20", "sharpe_40", F.round(F.col("sharpe_40") - F.col("sharpe_20"), 4).alias("delta"), (F.col("n_trades") - F.col("_n")).alias("trades_delta"))


@query(
    f"""with {H}, a as (select ts, close as a from h where symbol = 'click'), b as (select ts, close as b from h where symbol = 'view')
select 'inner' as kind, count(*) as n, round(sum(a - b), 4) as gap from a join b using (ts) union all select 'full', count(*), round(sum(coalesce(a, 0) - coalesce(b, 0)), 4) from a full join b using (ts)
union all select 'left', count(*), round(sum(a - coalesce(b, 0)), 4) from a left join b using (ts) union all select 'anti', count(*), round(sum(a), 4) from a anti join b using (ts) union all select 'semi', count(*), round(sum(a), 4) from a semi join b using (ts)"""
)
def alignments(spark, d):
    """Series aligned on time: inner, full outer, left, anti and semi."""
    h = hourly(spark, d)
    a = h.where("symbol = 'click'").select("ts", F.col("close").alias("a"))
    b = h.where("symbol = 'view'").select("ts", F.col("close").alias("b"))
    out = None
    for kind, how in (("inner", "inner"), ("full", "full"), ("left", "left"), ("anti", "left_anti"), ("semi", "left_semi")):
        j = a.join(b, "ts", how)
        gap = F.coalesce("a", F.lit(0.0)) - (F.coalesce("b", F.lit(0.0)) if how in ("inner", "full", "left") else F.lit(0.0))
        one = j.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(gap), 4).alias("gap")).select(F.lit(kind).alias("kind"), "n", "gap")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""with {H}, a as (select ts from h where symbol = 'click'), b as (select ts from h where symbol = 'view')
select 'union' as kind, count(*) as n from (select ts from a union select ts from b) union all select 'union_all', count(*) from (select ts from a union all select ts from b)
union all select 'intersect', count(*) from (select ts from a intersect select ts from b) union all select 'except', count(*) from (select ts from a except select ts from b)"""
)
def set_operations(spark, d):
    h = hourly(spark, d)
    a, b = (h.where(F.col("symbol") == s).select("ts") for s in ("click", "view"))
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(a.union(b).distinct(), "union").union(one(a.union(b), "union_all")).union(one(a.intersect(b), "intersect")).union(one(a.subtract(b), "except"))


@query(_FEATURES_SQL + f", e as (select *, {roll('avg', 'close', 5)} - {roll('avg', 'close', 20)} as sp from f) select symbol, ts, coalesce(abs(td) > 0.5, false) as strong, coalesce(sign(td) = sign(sp), false) as aligned, td is not null and sp is not null as both_there from e")
def entry_quality(spark, d):
    s = Series(_features(spark, d)).ma_spread("sp", "close", 5, 20).df
    truth = lambda c: F.coalesce(c, F.lit(False))
    return s.select(*KEY, truth(F.abs("td") > 0.5).alias("strong"), truth(F.signum("td") == F.signum("sp")).alias("aligned"), (F.col("td").isNotNull() & F.col("sp").isNotNull()).alias("both_there"))


@query(f"with {H} select symbol, count(*) filter (where ts <= timestamp '2024-01-20') as before, count(*) filter (where ts >= timestamp '2024-01-21') as after, count(*) as n from h group by 1")
def midnight_cut(spark, d):
    """A cut at midnight of a day and a start on the next leave the day's other bars in neither slice."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return hourly(spark, d).groupBy("symbol").agg(F.count_if(F.col("ts") <= at("2024-01-20")).alias("before"), F.count_if(F.col("ts") >= at("2024-01-21")).alias("after"), F.count(F.lit(1)).alias("n"))


@query(_BT_SQL + " select symbol, sum(abs(trade)) as turnover, round(sum(cost) * 10000, 4) as cost_bps, round(sum(cost) * 10000 / count(*) * 24, 6) as cost_bps_a_day, round(sum(net_return) filter (where net_return > 0) / nullif(-sum(net_return) filter (where net_return < 0), 0), 4) as profit_factor from q group by 1")
def turnover(spark, d):
    r = F.col("net_return")
    return _run(spark, d).groupBy("symbol").agg(
        F.sum(F.abs("trade")).alias("turnover"), F.round(F.sum("cost") * 10_000, 4).alias("cost_bps"), F.round(F.sum("cost") * 10_000 / F.count(F.lit(1)) * 24, 6).alias("cost_bps_a_day"),
        F.round(F.try_divide(F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))), 4).alias("profit_factor"),
    )


_VARIANT_SQL = (
    _REGIME_CHAIN.replace("with recursive ", "with recursive ", 1)
    + f""", a0 as (select *, {roll('avg', 'close', 5)} - {roll('avg', 'close', 20)} as sp from g), a as (select *, case when sp > 0 then 1.0::double when sp is not null then -1.0::double end as s from a0),
v as (select symbol, ts, close, v.variant, case v.variant when 'base' then s when 'reversed' then -s else case when regime = 1 then -s else 0 end end as signal from a, (values ('base'), ('reversed'), ('gated')) v(variant)),
c as (select *, coalesce(lag(signal) over w, 0) as position, coalesce(close / nullif(lag(close) over w, 0) - 1, 0) as ret from v window w as (partition by symbol, variant order by ts)),
e as (select *, coalesce(position - lag(position) over (partition by symbol, variant order by ts), 0) as trade from c),
n as (select *, position * ret - abs(trade) * 0.00009 as net_return from e),
m as (select symbol, variant, round(avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt(6048), 4) as sharpe, floor(sum(abs(trade)) / 2)::bigint as n_trades from n group by 1, 2),
b as (select symbol, sharpe as base from m where variant = 'base')"""
)


@query(_VARIANT_SQL + " select m.symbol, variant, sharpe, n_trades, n_trades < 30 as underpowered, coalesce(sharpe < 0.5 * base, false) as collapsed from m join b on m.symbol = b.symbol")
def variants(spark, d):
    """One combination as it is, reversed, and reversed and gated by regime, against the first."""
    s = Series(_features(spark, d)).vol_regime("regime", "lr", 20, 100).crossover("s", "close", 5, 20).df
    grid = spark.createDataFrame([("base",), ("reversed",), ("gated",)], "variant string")
    signal = F.when(F.col("variant") == "base", F.col("s")).when(F.col("variant") == "reversed", -F.col("s")).otherwise(machines.regime_gate(-F.col("s"), F.col("regime")))
    by = ("symbol", "variant")
    m = bt.metrics(bt.backtest(bt.crossed(s.select(*KEY, "close", "s", "regime"), grid).withColumn("signal", signal), "signal", bt.FxCost(0.7, 0.2), by), by, by)
    base = m.where("variant = 'base'").select("symbol", F.col("sharpe").alias("base"))
    return m.join(base, "symbol").select("symbol", "variant", "sharpe", "n_trades", (F.col("n_trades") < 30).alias("underpowered"), F.coalesce(F.col("sharpe") < 0.5 * F.col("base"), F.lit(False)).alias("collapsed"))


@query(_GRID_SQL + " select t1, t2, grouping_id(t1, t2) as level, count(*) as n, round(max(sharpe), 4) as best from r group by cube (t1, t2)")
def grid_cube(spark, d):
    return _grid(spark, d).cube("t1", "t2").agg(F.grouping_id("t1", "t2").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.max("sharpe"), 4).alias("best"))


# -- the research pipeline as one call


@dataclass(frozen=True)
class Pipeline:
    """The settings of a research run over bars: the grid has len(lambdas) * len(fast) * len(slow) combinations."""

    lambdas: Mapping[str, float] = field(default_factory=lambda: {"1M": 1e6, "10M": 1e7, "100M": 1e8, "1B": 1e9, "3_9B": 3.9e9, "100B": 1e11})
    window: int = 500
    fast: tuple[int, ...] = (24, 48, 72)
    slow: tuple[int, ...] = (120, 168, 240, 480)
    horizons: tuple[int, ...] = (1, 4, 24)
    reference: str = "3_9B"
    cost: bt.FxCost = bt.FxCost(0.7, 0.2)
    vol_window: int = 20
    regime_window: int = 252


def trend_grid(trends: DataFrame, config: Pipeline) -> DataFrame:
    """(symbol, lam, t1, t2 and the measures) of crossovers on every trend, for combinations with 100 signals at least.

    trends: KEY, close and a column for each lambda. Trends are unpivoted, each mean computed once a trend, and the
    combinations of means crossed in by a checked broadcast.
    """
    rows = trends.unpivot([*KEY, "close"], list(config.lambdas), "lam", "trend")
    s = Series(rows, ("symbol", "lam"))
    spans = sorted({*config.fast, *config.slow})
    for n in spans:
        s = s.sma(f"m{n}", "trend", n)
    pairs = trends.sparkSession.createDataFrame([(a, b) for a in config.fast for b in config.slow], "t1 int, t2 int")
    mean = lambda c, own: F.coalesce(*[F.when(F.col(c) == n, F.col(f"m{n}")) for n in own])
    gap = mean("t1", config.fast) - mean("t2", config.slow)
    by = ("symbol", "lam", "t1", "t2")
    signal = F.when(gap > 0, 1.0).when(gap.isNotNull(), -1.0)
    signalled = bt.crossed(s.df, pairs).select(*by, "ts", "close", signal.alias("signal"))
    n_trials = len(config.lambdas) * len(config.fast) * len(config.slow)
    enough = signalled.groupBy(*by).agg(F.count("signal").alias("n_signals")).where("n_signals >= 100")
    run = bt.backtest(signalled, "signal", config.cost, by)
    return bt.metrics(run, by, by, n_trials=n_trials).join(enough, list(by))


def research(bars: DataFrame, config: Pipeline = Pipeline()) -> dict[str, DataFrame]:
    """The five steps over bars (symbol, ts and prices): `calibration` of neighbouring trends, `stationarity`, `ic` with its
    `gate`, the `grid`, and `regimes` (ic in each volatility regime). Trends and features are written once."""
    trends = written(causal_trends(bars, "close", dict(config.lambdas), config.window), "trends")
    s = Series(trends).log_return("lr").momentum("mom").atr("atr").volatility("rv", "lr", config.vol_window).vol_regime("regime", "lr", config.vol_window, config.regime_window)
    own = f"`{config.reference}`"
    s = s.put(level=F.col(own)).slope("slope", "level").curvature("curvature", "level").ma_spread("spread", "level", config.fast[0], config.slow[0], "atr").deviation_from_ma("deviation", "level", config.slow[0], "atr")
    for h in config.horizons:
        s = s.forward_return(f"f{h}", h)
    names = ("mom", "rv", "level", "slope", "curvature", "spread", "deviation")
    features = written(s.df.select(*KEY, "close", "regime", *names, *[f"f{h}" for h in config.horizons]), "features")
    long = stats.long(features, names, (*KEY, "regime", *[f"f{h}" for h in config.horizons]))
    pairs = long.unpivot([*KEY, "regime", "feature", "value"], [f"f{h}" for h in config.horizons], "h", "fwd").withColumn("horizon", F.substring("h", 2, 9).cast("int"))
    ics = written(stats.information(pairs, ("feature", "horizon"), "value", "fwd"), "ics")
    return {
        "calibration": stats.lambda_calibration(trends, list(config.lambdas)),
        "stationarity": stats.dickey_fuller(stats.long(features, names, KEY), "value", ("symbol", "feature")),
        "ic": ics,
        "gate": stats.gate(ics, ("feature",)),
        "grid": trend_grid(trends, config),
        "regimes": stats.information(pairs.where("regime is not null"), ("regime", "feature", "horizon"), "value", "fwd"),
    }


def report(results: Mapping[str, DataFrame], folder: str) -> None:
    """Each result as JSON, a row a line, in a folder of its own."""
    for name, df in results.items():
        src.write_results(df, f"{folder}/{name}", "json")


@query()
def trend_grid_72(spark, d):
    """All 72 combinations of the research grid over one-sided trends of a long series."""
    config = Pipeline()
    trends = written(causal_trends(minutes(spark, d), "close", dict(config.lambdas), config.window), "trends")
    return _measured(trend_grid(trends, config), "lam", "t1", "t2").drop("max_drawdown")


@query()
def ic_gate(spark, d):
    """Features with an ic above 0.02 that is significant, and where each is greatest."""
    g = stats.gate(stats.information(_pairs(spark, d), ("feature", "horizon"), "value", "fwd"), ("feature",))
    return shown(g, "passed", "peak_horizon", "peak_ic", keys=("feature",), places=5)


@query()
def ic_peak_significant(spark, d):
    """The greatest ic of each feature among its significant horizons, or among all if it has none."""
    p = stats.decay_peak(stats.information(_pairs(spark, d), ("feature", "horizon"), "value", "fwd"), ("feature",), prefer_significant=True)
    return shown(p, "peak_horizon", "peak_ic", keys=("feature",), places=5)


def _counted(spark, d, least: int) -> DataFrame:
    g = bt.high_count(_grid(spark, d), ("symbol", "t1", "t2"), least)
    return g.select(F.lit(least).alias("least"), "symbol", "t1", "t2", "sharpe", "n_trades", "enough", F.col("place").cast("bigint").alias("place"))


@query(
    " union all ".join(
        f"select * from ({_GRID_SQL}, w as (select {least} as least, symbol, t1, t2, sharpe, n_trades, max(n_trades) over () >= {least} as enough from r), wp as (select *, row_number() over (order by case when enough then sharpe else n_trades end desc nulls last, symbol, t1, t2) as place from w where n_trades >= {least} or not enough) select * from wp where enough or place <= 10)"
        for least in (30, 100_000)
    )
)
def grid_high_count(spark, d):
    """Combinations with many trades, by Sharpe ratio; and where none has as many as asked, the ten with most."""
    return _counted(spark, d, 30).unionByName(_counted(spark, d, 100_000))


@query()
def crossing_oos(spark, d):
    """Crossing entries over thresholds, holds and floors: of each series the best in sample by deflated, then plain Sharpe
    ratio, of those with enough trades if there are any, tested out of sample under three cost scenarios."""
    f = Series(_features(spark, d)).vol_percentile("vp", "lr", 20, 100).df
    grid = spark.createDataFrame([(s, h) for s in (0.5, 1.0) for h in (12, 24)], "sigma double, hold int")
    keys = ("symbol", "sigma", "hold")
    signalled = machines.threshold_signals(bt.crossed(f.select(*KEY, "close", "td", "vp"), grid), "td", "raw", F.col("sigma"), F.col("hold"), lookback=100, crossing=True, keys=keys)
    floors = spark.createDataFrame([(0.0,), (50.0,)], "floor double")
    part = F.when(F.col("ts") <= F.lit("2024-01-20 23:59:59").cast("timestamp_ntz"), "is").otherwise("oos")
    rows = bt.crossed(signalled, floors).withColumns({"signal": machines.vol_floor(F.col("raw"), F.col("vp"), F.col("floor")), "part": part})
    combination = (*keys, "floor")
    by = (*combination, "part")
    run = written(bt.backtest(rows.select(*by, "ts", "close", "signal"), "signal", bt.FxCost(0.7, 0.2), by), "crossing")
    inside = bt.metrics(run.where("part = 'is'"), by, by, n_trials=8)
    w = Window.partitionBy("symbol").orderBy((F.col("n_trades") >= 10).desc(), F.col("dsr").desc_nulls_last(), F.col("sharpe").desc_nulls_last(), "sigma", "hold", "floor")
    best = inside.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*combination)
    outside = run.where("part = 'oos'").join(best, list(combination), "left_semi")
    scenarios = spark.createDataFrame([("low", 0.9), ("mid", 1.5), ("high", 2.0)], "name string, bps double")
    each = bt.crossed(outside, scenarios).withColumn("net", F.col("gross_return") - F.abs("trade") * F.col("bps") / 10_000)
    return each.groupBy(*combination, "name").agg(F.count(F.lit(1)).alias("n_obs"), F.round(F.try_divide(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.lit(6048)), 4).alias("sharpe"))
