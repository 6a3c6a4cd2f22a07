"""The queries of the general data problems over their whole tables, and SQL for those that SQL can say."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import difference, drift, gridfill, instants, profile, rejects, spikes
from barloom.sources.tables import table, written

PRICES = ("open", "high", "low", "close")
COLUMNS = ("bar_id", "provider", "symbol", "ts", *PRICES, "volume", "src_ref", "ingested_at")
SRC_REF = r"^[A-Z]{2}[0-9]{6}-[0-9]{4}\z"


def _profiled(spark: SparkSession, d: str, columns: tuple[str, ...]) -> DataFrame:
    # A row for each load and column, read for the load itself and as a baseline: written, so that bars are counted once.
    profiles = written(profile.profile(table(spark, d, "bars"), "load_no", columns, {"src_ref": SRC_REF}), "profile")
    return profile.compared(profiles, table(spark, d, "loads").select(F.col("load_no").alias("load"), F.col("baseline_load").alias("baseline")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The columns of loads that break the limits."""
    c = F.col
    present = c("n_rows") - c("n_nulls")
    many_nulls = c("n_nulls") * 100 > c("n_rows") * 5
    few = c("n_distinct") * 10 < c("base_distinct")
    mean, base = c("mean_positive"), c("base_mean_positive")
    limits = {
        "nulls": {n: many_nulls for n in (*PRICES, "volume", "src_ref")},
        "zeros": {"volume": c("n_zeros") * 100 > c("n_rows") * 5},
        "range": {"volume": c("n_negative") > 0},
        "pattern": {"src_ref": c("n_unmatched") * 100 > present * 2},
        "distinct": {"volume": few, "src_ref": few},
        "shift": {"volume": (mean > base * 4) | (mean * 4 < base)},
    }
    return profile.issues(_profiled(spark, d, COLUMNS), limits).withColumnRenamed("load", "load_no")


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """The whole profile of every column of every load, beside its baseline's distribution."""
    r = lambda c: F.round(c, 6).alias(c)
    return _profiled(spark, d, COLUMNS).select(
        F.col("load").alias("load_no"), "column_name", "n_rows", "n_nulls", "n_zeros", "n_negative", "n_distinct", r("min_num"), r("max_num"),
        F.round(F.when(F.col("column_name").isin(*PRICES, "volume"), F.col("mean_num")), 6).alias("mean_num"), "min_txt", "max_txt", "n_unmatched", r("psi"), r("chi2"),
    )


def p1_distances(spark: SparkSession, d: str) -> DataFrame:
    """How far every column of every load is from its baseline: texts by their values, numbers and times by the baseline's quantiles."""
    named = table(spark, d, "loads").select(F.col("load_no").alias("load"), F.col("baseline_load").alias("baseline"))
    found = profile.distances(table(spark, d, "bars"), "load_no", COLUMNS, named)
    return found.withColumns({"psi": F.round("psi", 6), "chi2": F.round("chi2", 6)}).withColumnsRenamed({"load": "load_no", "baseline": "baseline_load"})


P1_FOUND_SQL = r"""
with s as (
  select load_no, count(*) as n, count(open) as c_open, count(high) as c_high, count(low) as c_low, count(close) as c_close,
    count(volume) as c_volume, count(src_ref) as c_src_ref, count(*) filter (where volume = 0) as zeros, count(*) filter (where volume < 0) as neg,
    count(*) filter (where src_ref is not null and not regexp_full_match(src_ref, '[A-Z]{2}[0-9]{6}-[0-9]{4}')) as bad,
    count(distinct volume) as d_volume, count(distinct src_ref) as d_src_ref, avg(volume) filter (where volume > 0) as mean
  from bars group by load_no),
j as (select s.*, b.d_volume as bd_volume, b.d_src_ref as bd_src_ref, b.mean as b_mean
  from s left join loads l on l.load_no = s.load_no left join s b on b.load_no = l.baseline_load)
select load_no, 'open' as column_name, 'nulls' as issue from j where (n - c_open) * 100 > n * 5
union all select load_no, 'high', 'nulls' from j where (n - c_high) * 100 > n * 5
union all select load_no, 'low', 'nulls' from j where (n - c_low) * 100 > n * 5
union all select load_no, 'close', 'nulls' from j where (n - c_close) * 100 > n * 5
union all select load_no, 'volume', 'nulls' from j where (n - c_volume) * 100 > n * 5
union all select load_no, 'src_ref', 'nulls' from j where (n - c_src_ref) * 100 > n * 5
union all select load_no, 'volume', 'zeros' from j where zeros * 100 > n * 5
union all select load_no, 'volume', 'range' from j where neg > 0
union all select load_no, 'src_ref', 'pattern' from j where bad * 100 > c_src_ref * 2
union all select load_no, 'volume', 'distinct' from j where d_volume * 10 < bd_volume
union all select load_no, 'src_ref', 'distinct' from j where d_src_ref * 10 < bd_src_ref
union all select load_no, 'volume', 'shift' from j where mean > b_mean * 4 or mean * 4 < b_mean
"""

_NUMBERS = ("bar_id::double", "epoch_us(ts)::double", *PRICES, "volume", "epoch_us(ingested_at)::double")
_BIN = "case when num = 0 then 0 when num > 0 then least(greatest(floor(ln(num) / ln(2)), -1000), 1000) + 2000 when num < 0 then -(least(greatest(floor(ln(-num) / ln(2)), -1000), 1000) + 2000) else length(txt) end"
P1_PROFILE_SQL = (
    "with u as ("
    + " union all ".join(f"select load_no, '{re.sub(r'^epoch_us.(.*).::double|::double$', r'\1', c)}' as column_name, {c} as num, null::varchar as txt from bars" for c in _NUMBERS)
    + " union all "
    + " union all ".join(f"select load_no, '{c}', null, {c} from bars" for c in ("provider", "symbol", "src_ref"))
    + f"""),
p as (select load_no, column_name, count(*) as n_rows, count(*) filter (where num is null and txt is null) as n_nulls, count(*) filter (where num = 0) as n_zeros, count(*) filter (where num < 0) as n_negative,
  count(distinct num) + count(distinct txt) as n_distinct, min(num) as min_num, max(num) as max_num, case when column_name in ('open', 'high', 'low', 'close', 'volume') then avg(num) end as mean_num,
  min(txt) as min_txt, max(txt) as max_txt, count(*) filter (where column_name = 'src_ref' and txt is not null and not regexp_full_match(txt, '[A-Z]{{2}}[0-9]{{6}}-[0-9]{{4}}')) as n_unmatched from u group by 1, 2),
h as (select load_no, column_name, {_BIN} as bin, count(*)::double as n from u where num is not null or txt is not null group by 1, 2, 3),
l as (select load_no, max(baseline_load) as base from loads group by 1 having max(baseline_load) is not null),
k as (select l.load_no, h.column_name, h.bin from l join h on h.load_no = l.load_no or h.load_no = l.base group by all),
t as (select load_no, column_name, sum(n) as n from h group by 1, 2),
j as (select k.load_no, k.column_name, coalesce(a.n, 0) as x, coalesce(b.n, 0) as y, coalesce(ta.n, 0) as n, coalesce(tb.n, 0) as m, count(*) over (partition by k.load_no, k.column_name) as w
  from k join l on l.load_no = k.load_no left join h a on a.load_no = k.load_no and a.column_name = k.column_name and a.bin = k.bin left join h b on b.load_no = l.base and b.column_name = k.column_name and b.bin = k.bin
  left join t ta on ta.load_no = k.load_no and ta.column_name = k.column_name left join t tb on tb.load_no = l.base and tb.column_name = k.column_name),
s as (select load_no, column_name, sum(((x + 0.5) / (n + w * 0.5) - (y + 0.5) / (m + w * 0.5)) * ln(((x + 0.5) / (n + w * 0.5)) / ((y + 0.5) / (m + w * 0.5)))) as psi,
  sum((x * sqrt(m / nullif(n, 0)) - y * sqrt(n / nullif(m, 0))) ** 2 / (x + y)) as chi2 from j group by 1, 2)
select p.load_no, p.column_name, n_rows, n_nulls, n_zeros, n_negative, n_distinct, round(min_num, 6) as min_num, round(max_num, 6) as max_num, round(mean_num, 6) as mean_num, min_txt, max_txt, n_unmatched,
  round(psi, 6) as psi, round(chi2, 6) as chi2 from p left join s on s.load_no = p.load_no and s.column_name = p.column_name
"""
)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines that don't load, with one reason each."""
    return rejects.parsed(table(spark, d, "raw_lines")).select("line_id", "reason").where("reason is not null")


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    """The lines that load, typed."""
    return rejects.parsed(table(spark, d, "raw_lines")).where("reason is null").drop("reason")


_FIELD = r"""[ \t\r]*("([^"]|"")*"|[^"@]*)[ \t\r]*"""
_P2_SQL = r"""
with l as (
  select line_id, file_name, layout, delim, case when line_no = 1 then ltrim(line, chr(65279)) else line end as line
  from raw_lines where not (layout = 'headed' and line_no = 1)),
q as (
  select *, case delim when ',' then regexp_full_match(line, '(?s)FCOMMA(,FCOMMA)*') else regexp_full_match(line, '(?s)FSEMI(;FSEMI)*') end as closed,
    case delim when ',' then regexp_extract_all(',' || line, '(?s),(FCOMMA)', 1) else regexp_extract_all(';' || line, '(?s);(FSEMI)', 1) end as cut
  from l),
f as (
  select *, list_transform(cut, lambda x: trim(regexp_replace(trim(x, concat(' ', chr(9), chr(13))), '^"(.*)"$', '\1'), concat(' ', chr(9), chr(13)))) as v from q),
t as (
  select *, case when layout = 'broker' then
      case when regexp_full_match(v[1], '[0-9]{4}\.[0-9]{2}\.[0-9]{2}') and regexp_full_match(v[2], '([01][0-9]|2[0-3]):[0-5][0-9]') then try_cast(replace(v[1], '.', '-') as date) is not null else false end
    else regexp_full_match(v[1], '[0-9]{4}-[0-9]{2}-[0-9]{2} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?') and try_cast(v[1][1:10] as date) is not null end as timed,
    case when layout = 'broker' then v[3:7] else v[2:8] end as nums
  from f),
r as (
  select *, case when not closed then 'quoting' when len(v) <> case layout when 'broker' then 7 else 9 end then 'column_count'
    when not timed then 'bad_datetime'
    when not coalesce(list_bool_and(list_transform(nums, lambda x, i: regexp_full_match(x, '[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') or (x = '' and i = 5))), false) then 'bad_value' end as reason
  from t)
""".replace("FCOMMA", _FIELD.replace("@", ",").replace("(", "(?:", 2)).replace("FSEMI", _FIELD.replace("@", ";").replace("(", "(?:", 2))

P2_FOUND_SQL = _P2_SQL + "select line_id, reason from r where reason is not null"
P2_ROWS_SQL = (
    _P2_SQL
    + r"""select line_id, file_name, layout, case when layout = 'broker' then strptime(v[1] || ' ' || v[2], '%Y.%m.%d %H:%M')
  else v[1][1:19]::timestamp - case when length(v[1]) > 20 then to_minutes((v[1][20:20] || '1')::int * (v[1][21:22]::int * 60 + v[1][24:25]::int)) else to_minutes(0) end end as datetime,
  """
    + ", ".join(f"try_cast(ltrim(nums[{i + 1}], '+') as double) as {c}" for i, c in enumerate(("open", "high", "low", "close", "volume", "dividends", "stock_splits")))
    + " from r where reason is null"
)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The one instant of each stamp that means a time."""
    return instants.normalised(table(spark, d, "stamps"), "symbol", "stamp_id").select(F.col("id").alias("stamp_id"), "utc_us")


def p3_path(spark: SparkSession, d: str) -> DataFrame:
    """Every stamp read without its order of day and month, and with both instants of a time that occurs twice: where
    several are left, the ones on the least path over the record order of the symbol."""
    open_ = table(spark, d, "stamps").withColumn("day_order", F.lit(None).cast("string"))
    return instants.normalised(open_, "symbol", "stamp_id", both=True).select(F.col("id").alias("stamp_id"), "utc_us", "form")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The empty slots of each listing's grid."""
    grid = gridfill.on_grid(table(spark, d, "bars"), table(spark, d, "listings"), "close", max_gap_minutes=240)
    return grid.where("missing").select("provider", "symbol", "slot")


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole regular series, missing slots marked and filled over gaps of up to four hours."""
    grid = gridfill.on_grid(table(spark, d, "bars"), table(spark, d, "listings"), "close", max_gap_minutes=240)
    return grid.withColumn("value", F.round("value", 6))


_SLOTS_SQL = """
with g as (
  select provider, symbol, step_minutes, trading_session, unnest(generate_series(window_start, window_end - interval 1 microsecond, to_minutes(step_minutes))) as slot from listings),
s as (
  select provider, symbol, slot, slot + to_minutes(step_minutes) as upto from g
  where trading_session is distinct from 'fx' or isodow(slot) <= 5 or (isodow(slot) = 7 and hour(slot) >= 22))
"""
P4_FOUND_SQL = (
    _SLOTS_SQL
    + """
select s.provider, s.symbol, epoch_us(s.slot) // 1000000 as slot from s
where not exists (select 1 from bars b where b.provider = s.provider and b.symbol = s.symbol and b.close is not null and b.ts >= s.slot and b.ts < s.upto)
"""
)
P4_GRID_SQL = (
    _SLOTS_SQL
    + """,
b as (select provider, symbol, ts, min(close) as low, max(close) as high from bars where close is not null group by all),
a as (select s.*, b.ts as t0, b.high as v0 from s asof left join b on b.provider = s.provider and b.symbol = s.symbol and b.ts < s.slot),
n as (select a.*, b.ts as t1, b.low as v1 from a asof left join b on b.provider = a.provider and b.symbol = a.symbol and b.ts >= a.slot)
select provider, symbol, epoch_us(slot) // 1000000 as slot, not coalesce(t1 < upto, false) as missing,
  round(case when t1 = slot then v1 when epoch_us(t1) - epoch_us(t0) <= 14400000000
    then v0 + (v1 - v0) * ((epoch_us(slot) - epoch_us(t0))::double / (epoch_us(t1) - epoch_us(t0))) end, 6) as value
from n
"""
)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The bars whose prices cannot be true."""
    return spikes.implausible(table(spark, d, "bars"))


def p5_hampel(spark: SparkSession, d: str) -> DataFrame:
    """The same with the deviation of each window as the scale, 20 times."""
    return spikes.hampel(table(spark, d, "bars"), times=20.0)


P5_FOUND_SQL = """
with k as (select * from bars qualify row_number() over (partition by provider, symbol, ts order by bar_id) = 1),
s as (
  select bar_id, provider, symbol, open, high, low, close,
    median(close) over w11 as m, abs(close - lag(close) over w) as change,
    row_number() over w - row_number() over (partition by provider, symbol, close order by ts) as run
  from k where close is not null
  window w as (partition by provider, symbol order by ts), w11 as (partition by provider, symbol order by ts rows between 5 preceding and 5 following)),
c as (select provider, symbol, median(change) as med from s group by all),
r as (select s.*, c.med, count(*) over (partition by s.provider, s.symbol, s.close, s.run) as len from s join c on c.provider = s.provider and c.symbol = s.symbol),
f as (select bar_id, case
  when least(open, high, low, close) <= 0 or high < open or high < close or high < low or low > open or low > close then 'impossible'
  when abs(high - m) > 27 * med or abs(low - m) > 27 * med or abs(close - m) > 27 * med then 'spike'
  when len >= 8 then 'stuck' end as kind from r)
select bar_id, kind from f where kind is not null
"""


P5_HAMPEL_SQL = """
with k as (select * from bars qualify row_number() over (partition by provider, symbol, ts order by bar_id) = 1),
s as (
  select bar_id, provider, symbol, open, high, low, close, list(close) over w11 as cs,
    row_number() over w - row_number() over (partition by provider, symbol, close order by ts) as run
  from k where close is not null
  window w as (partition by provider, symbol order by ts), w11 as (partition by provider, symbol order by ts rows between 5 preceding and 5 following)),
m as (select *, list_median(cs) as m, count(*) over (partition by provider, symbol, close, run) as len from s),
d as (select *, 20 * 1.4826::double * list_median(list_transform(cs, lambda c: abs(c - m))) as lim from m),
f as (select bar_id, case
  when least(open, high, low, close) <= 0 or high < open or high < close or high < low or low > open or low > close then 'impossible'
  when lim > 0 and (abs(high - m) > lim or abs(low - m) > lim or abs(close - m) > lim) then 'spike' when len >= 8 then 'stuck' end as kind from d)
select bar_id, kind from f where kind is not null
"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a field from a provider's file to its next."""
    return drift.changes(table(spark, d, "file_records"), table(spark, d, "field_aliases"))


P6_NUMBERS = ("open", "high", "low", "close", "volume", "dividends", "stock_splits")


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """All records as one table, with the kind each value was written in and the value in the branch of its kind."""
    found = drift.consolidated(table(spark, d, "file_records"), table(spark, d, "field_aliases"), P6_NUMBERS, ("datetime",))
    branches = [F.col(f"{f}_branch.{k}").alias(f"{f}_{k}") for f in (*P6_NUMBERS, "datetime") for k in ("string", "double", "long", "other")]
    rest = F.array_join(F.array_sort(F.transform(F.map_entries("rest"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ";")
    return found.select("record_id", "file_no", *P6_NUMBERS, F.col("datetime").cast("timestamp_ntz").alias("datetime"), *[f"{f}_as" for f in (*P6_NUMBERS, "datetime")], *branches, rest.alias("rest"))


def p6_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of value that a path of a provider's files holds for the first time."""
    return drift.alternatives(table(spark, d, "file_records"), table(spark, d, "field_aliases"))


P6_FOUND_SQL = """
with r as (select file_no, provider, loaded_at, record_json as j from file_records),
k as (select file_no, provider, loaded_at, j, unnest(json_keys(j)) as raw from r),
v as (select file_no, provider, loaded_at, trim(lower(raw)) as name, json_type(j, '$."' || raw || '"') as t, json_extract(j, '$."' || raw || '"')::varchar as txt from k),
n as (select v.*, coalesce(a.field, v.name) as field from v left join field_aliases a on a.alias = v.name),
f as (select provider, file_no, min(loaded_at) as at, row_number() over (partition by provider order by min(loaded_at), file_no) as seq,
  lead(file_no) over (partition by provider order by min(loaded_at), file_no) as next_file from file_records group by provider, file_no),
h as (select n.provider, n.file_no, field, list_sort(list(distinct name)) as names,
  case when bool_or(t = 'VARCHAR') then 'string' when bool_or(t in ('DOUBLE', 'BIGINT', 'UBIGINT') and regexp_matches(txt, '[.eE]')) then 'double'
    when bool_or(t in ('DOUBLE', 'BIGINT', 'UBIGINT')) then 'long' end as own from n group by all),
w as (select h.*, f.seq, f.next_file, last_value(own ignore nulls) over (partition by h.provider, field order by seq) as type
  from h join f on f.provider = h.provider and f.file_no = h.file_no),
x as (select *, lag(seq) over p = seq - 1 as follows, lead(seq) over p = seq + 1 as goes_on, lag(names) over p as names0, lag(type) over p as type0
  from w window p as (partition by provider, field order by seq))
select file_no, field, 'added' as change_kind from x where seq > 1 and follows is distinct from true
union all select next_file, field, 'removed' from x where next_file is not null and goes_on is distinct from true
union all select file_no, field, 'renamed' from x where follows and names <> names0
union all select file_no, field, 'type_changed' from x where follows and type <> type0
"""

BAR_FIELDS = ("datetime", "open", "high", "low", "close", "volume", "dividends")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Bars in one archive only, and fields that differ."""
    return difference.differences(table(spark, d, "archive_a"), table(spark, d, "archive_b"), "bar_no", BAR_FIELDS, version="loaded_at", tolerance=1e-6)


P7_FOUND_SQL = (
    """
with a as (select * from archive_a qualify row_number() over (partition by bar_no order by loaded_at desc) = 1),
b as (select * from archive_b qualify row_number() over (partition by bar_no order by loaded_at desc) = 1),
j as (select a.bar_no as k, a, b from a join b on a.bar_no = b.bar_no)
select bar_no, 'only_a' as difference from a where bar_no not in (select bar_no from b)
union all select bar_no, 'only_b' from b where bar_no not in (select bar_no from a)
union all select k, 'datetime' from j where a.datetime is distinct from b.datetime
"""
    + "".join(
        f"union all select k, '{f}' from j where ((a.{f} is null) <> (b.{f} is null) or abs(a.{f} - b.{f}) > 1e-6)\n"
        for f in BAR_FIELDS[1:]
    )
)

QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p1_distances, p2_found, p2_rows, p3_found, p3_path, p4_found, p4_grid, p5_found, p5_hampel, p6_found, p6_table, p6_alternatives, p7_found)}
SQL = {
    "p1_found": P1_FOUND_SQL,
    "p1_profile": P1_PROFILE_SQL,
    "p2_found": P2_FOUND_SQL,
    "p2_rows": P2_ROWS_SQL,
    "p4_found": P4_FOUND_SQL,
    "p4_grid": P4_GRID_SQL,
    "p5_found": P5_FOUND_SQL,
    "p5_hampel": P5_HAMPEL_SQL,
    "p6_found": P6_FOUND_SQL,
    "p7_found": P7_FOUND_SQL,
}
