"""Queries of the window and indicator operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from equilake.functions import scalars as fs
from equilake.operators import indicators as ind
from equilake.operators import recurrence as rec
from equilake.operators.latest import latest_row, top_n_per_key
from equilake.operators.ranks import with_average_rank
from equilake.plans import factors
from equilake.queries.registry import query, r2, r4, r6, s2, s4, s6

_W = "over (partition by symbol order by trade_date"


@query("w1_sma", f"""
select symbol, trade_date,
  case when count(*) {_W}) >= 20 then {s6(f'avg(close) {_W} rows between 19 preceding and current row)')} end as sma20,
  case when count(*) {_W}) >= 200 then {s6(f'avg(close) {_W} rows between 199 preceding and current row)')} end as sma200
from {{daily_prices}}""")
def w1_sma(wh):
    df = ind.with_sma(wh.daily_prices, "close", {"sma20": 20, "sma200": 200})
    return df.select("symbol", "trade_date", r6("sma20"), r6("sma200"))


@query("w2_rolling_extremes", f"""
select symbol, trade_date,
  case when count(*) {_W}) >= 20 then max(close) {_W} rows between 19 preceding and current row) end as max20,
  case when count(*) {_W}) >= 20 then min(close) {_W} rows between 19 preceding and current row) end as min20
from {{daily_prices}}""")
def w2_rolling_extremes(wh):
    return wh.daily_prices.select(
        "symbol", "trade_date", ind.rolling(F.max, "close", 20).alias("max20"), ind.rolling(F.min, "close", 20).alias("min20"))


# A recurrence in SQL: walk the bars by number.
_NUM = f"select symbol, trade_date, close, high, low, row_number() {_W}) as i, lag(close) {_W}) as pc from {{daily_prices}}"


def _ema_cte(n: int, source: str = "num", value: str = "close") -> str:
    k = 2.0 / (n + 1)
    return f"""
select symbol, cast({n} as bigint) as i, avg({value}) as e from {{{source}}} where i <= {n} group by symbol having count(*) = {n}
union all
select b.symbol, b.i, {k!r} * b.{value} + (1 - {k!r}) * r.e from {{ema{n}}} r join {{{source}}} b on b.symbol = r.symbol and b.i = r.i + 1"""


@query("w3_ema", f"""
select n.symbol, n.trade_date, {s6('a.e', 'ema12')}, {s6('b.e', 'ema26')}
from {{num}} n left join {{ema12}} a on n.symbol = a.symbol and n.i = a.i left join {{ema26}} b on n.symbol = b.symbol and n.i = b.i
""", {"num": _NUM, "ema12": _ema_cte(12), "ema26": _ema_cte(26)}, recursive=True)
def w3_ema(wh):
    specs = [rec.Recurrence("ema12", "ema", n=12), rec.Recurrence("ema26", "ema", n=26)]
    return rec.with_recurrences(wh.daily_prices, specs).select("symbol", "trade_date", r6("ema12"), r6("ema26"))


_MACD = {
    "num": _NUM, "ema12": _ema_cte(12), "ema26": _ema_cte(26),
    "line": """select n.symbol, n.trade_date, a.e - b.e as v, n.i - 25 as i from {num} n
               join {ema12} a on n.symbol = a.symbol and n.i = a.i join {ema26} b on n.symbol = b.symbol and n.i = b.i""",
    "ema9": _ema_cte(9, "line", "v"),
}


@query("w4_macd", f"""
select n.symbol, n.trade_date, {s6('l.v', 'macd_line')}, {s6('s.e', 'macd_signal')}, {s6('l.v - s.e', 'macd_hist')}
from {{num}} n left join {{line}} l on n.symbol = l.symbol and n.i = l.i + 25
left join {{ema9}} s on n.symbol = s.symbol and n.i = s.i + 25""", _MACD, recursive=True)
def w4_macd(wh):
    df = rec.with_recurrences(wh.daily_prices, [rec.Recurrence("macd", "macd")])
    return df.select("symbol", "trade_date", r6("macd_line"), r6("macd_signal"), r6("macd_hist"))


_RSI = {
    "num": _NUM,
    "gl": "select symbol, trade_date, i, greatest(close - pc, 0) as g, greatest(pc - close, 0) as l from {num} where i > 1",
    "wilder": """
select symbol, cast(15 as bigint) as i, avg(g) as g, avg(l) as l from {gl} where i <= 15 group by symbol having count(*) = 14
union all
select b.symbol, b.i, (r.g * 13 + b.g) / 14, (r.l * 13 + b.l) / 14 from {wilder} r join {gl} b on b.symbol = r.symbol and b.i = r.i + 1""",
}


@query("w5_rsi", f"""
select n.symbol, n.trade_date,
  {s6("case when w.l = 0 then case when w.g > 0 then 100 else 50 end else 100 - 100 / (1 + w.g / nullif(w.l, 0)) end", 'rsi_screen')},
  {s6("case when w.l = 0 then 100 else 100 - 100 / (1 + w.g / nullif(w.l, 0)) end", 'rsi_engine')}
from {{num}} n left join {{wilder}} w on n.symbol = w.symbol and n.i = w.i""", _RSI, recursive=True)
def w5_rsi(wh):
    specs = [rec.Recurrence("rsi_screen", "rsi"), rec.Recurrence("rsi_engine", "rsi", family="engine")]
    return rec.with_recurrences(wh.daily_prices, specs).select("symbol", "trade_date", r6("rsi_screen"), r6("rsi_engine"))


_RSI_SQL = "case when l = 0 then 100 else 100 - 100 / (1 + g / nullif(l, 0)) end"


@query("w5_rsi_finite", f"""
select symbol, trade_date, case when c = 14 then {s6(_RSI_SQL)} end as rsi from (
  select symbol, trade_date, avg(greatest(d, 0)) {_W} rows between 13 preceding and current row) as g,
         avg(greatest(-d, 0)) {_W} rows between 13 preceding and current row) as l,
         count(d) {_W} rows between 13 preceding and current row) as c
  from (select symbol, trade_date, close - lag(close) {_W}) as d from {{daily_prices}}) x) y""")
def w5_rsi_finite(wh):
    return ind.with_finite_rsi(wh.daily_prices).select("symbol", "trade_date", r6("rsi"))


_ATR = {
    "num": _NUM,
    "tr": "select symbol, i, trade_date, case when pc is null then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end as tr from {num}",
    "atr14": """
select symbol, cast(14 as bigint) as i, avg(tr) as a from {tr} where i <= 14 group by symbol having count(*) = 14
union all
select b.symbol, b.i, (r.a * 13 + b.tr) / 14 from {atr14} r join {tr} b on b.symbol = r.symbol and b.i = r.i + 1""",
}


@query("w6_atr", f"""
select t.symbol, t.trade_date, {s6('a.a', 'atr14')} from {{tr}} t left join {{atr14}} a on t.symbol = a.symbol and t.i = a.i""",
       _ATR, recursive=True)
def w6_atr(wh):
    return rec.with_recurrences(wh.daily_prices, [rec.Recurrence("atr14", "atr")]).select("symbol", "trade_date", r6("atr14"))


@query("w6_true_range", f"select symbol, trade_date, {s6('tr', 'true_range')} from {{tr}}", {"num": _NUM, "tr": _ATR["tr"]})
def w6_true_range(wh):
    return ind.with_true_range(wh.daily_prices).select("symbol", "trade_date", r6("true_range"))


@query("w7_bollinger", f"""
select symbol, trade_date, case when c = 20 then {s6('m')} end as middle, case when c = 20 then {s6('m + 2 * sd')} end as upper,
       case when c = 20 then {s6('m - 2 * sd')} end as lower from (
  select symbol, trade_date, count(close) {_W} rows between 19 preceding and current row) as c,
         avg(close) {_W} rows between 19 preceding and current row) as m,
         stddev_pop(close) {_W} rows between 19 preceding and current row) as sd from {{daily_prices}}) x""")
def w7_bollinger(wh):
    return ind.with_bollinger(wh.daily_prices, "close").select("symbol", "trade_date", r6("middle"), r6("upper"), r6("lower"))


@query("w8_donchian", f"""
select symbol, trade_date, case when n >= 20 then u end as upper20, case when n >= 20 then l end as lower20,
       case when n >= 20 then {s6('(u + l) / 2')} end as middle20, case when n >= 21 then pu end as prior_upper20,
       case when n >= 21 then pl end as prior_lower20 from (
  select symbol, trade_date, count(*) {_W}) as n, max(high) {_W} rows between 19 preceding and current row) as u,
         min(low) {_W} rows between 19 preceding and current row) as l, max(high) {_W} rows between 20 preceding and 1 preceding) as pu,
         min(low) {_W} rows between 20 preceding and 1 preceding) as pl from {{daily_prices}}) x""")
def w8_donchian(wh):
    df = ind.with_donchian(ind.with_donchian(wh.daily_prices, 20), 20, shift=1, prefix="prior_")
    return df.select(
        "symbol", "trade_date", F.col("channel_upper").alias("upper20"), F.col("channel_lower").alias("lower20"),
        r6("channel_middle", "middle20"), F.col("prior_upper").alias("prior_upper20"), F.col("prior_lower").alias("prior_lower20"))


@query("w9_max_drawdown", f"""
select symbol, case when dd * 100 < -1e-9 then {s6('dd * 100')} else 0.0 end as max_drawdown_pct,
       case when dd * 100 < -1e-9 then pd end as peak_date, case when dd * 100 < -1e-9 then trade_date end as trough_date
from (select *, row_number() over (partition by symbol order by dd, trade_date) as rn,
             min(trade_date) over (partition by symbol, pk) as pd
      from (select symbol, trade_date, pk, (close - pk) / nullif(pk, 0) as dd
            from (select symbol, trade_date, close, max(close) {_W}) as pk from {{daily_prices}}) a) b) c where rn = 1""")
def w9_max_drawdown(wh):
    return ind.max_drawdown(wh.daily_prices, "close").withColumn("max_drawdown_pct", r6("max_drawdown_pct"))


@query("w10_trailing_return", f"""
select symbol, trade_date, case when p > 0 then {s6('(close / nullif(p, 0) - 1) * 100')} end as return_126
from (select symbol, trade_date, close, lag(close, 126) {_W}) as p from {{daily_prices}}) x""")
def w10_trailing_return(wh):
    return wh.daily_prices.select("symbol", "trade_date", r6(ind.trailing_return("close", 126), "return_126"))


@query("w11_previous_close", f"""
select symbol, max(trade_date) as price_date, max(case when rn = 1 then close end) as latest_close, max(case when rn = 2 then close end) as prev_close,
       {s6("(max(case when rn = 1 then close end) / nullif(max(case when rn = 2 then close end), 0) - 1) * 100", 'day_change_pct')}
from (select symbol, trade_date, close, row_number() over (partition by symbol order by trade_date desc) as rn from {{daily_prices}}) x
where rn <= 2 group by symbol""")
def w11_previous_close(wh):
    df = ind.previous_close(wh.daily_prices)
    return df.withColumn("day_change_pct", r6(fs.pct_change("latest_close", "prev_close")))


@query("w12_crosses", f"""
select symbol, up_date, down_date,
       case when up_date is not null and (down_date is null or up_date >= down_date) then up_date else down_date end as cross_date,
       case when up_date is not null and (down_date is null or up_date >= down_date) then 'up' when down_date is not null then 'down' end as cross_direction
from (select symbol, max(case when age <= 60 and pf <= ps and f > s then trade_date end) as up_date,
             max(case when age <= 60 and pf >= ps and f < s then trade_date end) as down_date
      from (select symbol, trade_date, f, s, lag(f) {_W}) as pf, lag(s) {_W}) as ps, row_number() over (partition by symbol order by trade_date desc) as age
            from (select symbol, trade_date,
                    case when count(*) {_W}) >= 20 then avg(close) {_W} rows between 19 preceding and current row) end as f,
                    case when count(*) {_W}) >= 50 then avg(close) {_W} rows between 49 preceding and current row) end as s
                  from {{daily_prices}}) a) b group by symbol) c""")
def w12_crosses(wh):
    df = ind.with_sma(wh.daily_prices, "close", {"sma20": 20, "sma50": 50})
    return ind.last_crosses(df, "sma20", "sma50", 60, rounding=ind.SMA_ROUNDING)


@query("w13_zone_days", f"""
select symbol, trade_date, case when r < 30 then 'oversold' else 'overbought' end as zone from (
  select n.symbol, n.trade_date, row_number() over (partition by n.symbol order by n.trade_date desc) as age,
         case when w.l = 0 then case when w.g > 0 then 100 else 50 end else 100 - 100 / (1 + w.g / nullif(w.l, 0)) end as r
  from {{num}} n left join {{wilder}} w on n.symbol = w.symbol and n.i = w.i) x
where age <= 60 and (r < 30 or r > 70)""", _RSI, recursive=True)
def w13_zone_days(wh):
    from equilake.plans.research import zone_days

    df = rec.with_recurrences(wh.daily_prices, [rec.Recurrence("rsi14", "rsi")])
    return zone_days(df)


@query("w14_volume_spikes", f"""
select symbol, trade_date, volume, {s6('volume / m', 'multiple')} from (
  select symbol, trade_date, volume, avg(cast(volume as double)) {_W} rows between 19 preceding and current row) as m,
         row_number() {_W}) as i, row_number() over (partition by symbol order by trade_date desc) as age from {{daily_prices}}) x
where age <= 30 and i > 20 and m <> 0 and volume > 2 * m""")
def w14_volume_spikes(wh):
    return ind.volume_spikes(wh.daily_prices).withColumn("multiple", r6("multiple"))


@query("w15_fill", f"""
select symbol, trade_date, coalesce(last_value(adj_close ignore nulls) {_W} rows between unbounded preceding and current row),
       first_value(adj_close ignore nulls) {_W} rows between unbounded preceding and unbounded following)) as filled from {{daily_prices}}""")
def w15_fill(wh):
    return wh.daily_prices.select("symbol", "trade_date", ind.filled(F.col("adj_close")).alias("filled"))


@query("w17_percentile_vs_history", f"""
select symbol, case when count(v) >= 3 then {s6("sum(case when v < lastv and d < lastd then 1 else 0 end) * 100.0 / (count(v) - 1)")} end as pe_percentile,
       cast(count(v) as bigint) as points
from (select symbol, fiscal_date as d, pe_ratio as v,
             max(case when pe_ratio is not null then fiscal_date end) over (partition by symbol) as lastd,
             max_by(pe_ratio, case when pe_ratio is not null then fiscal_date end) over (partition by symbol) as lastv
      from (select *, row_number() over (partition by symbol order by fiscal_date desc) as rn from {{financial_ratios}} where period = 'FY') a
      where rn <= 10) b group by symbol""")
def w17_percentile_vs_history(wh):
    from equilake.plans.research import percentile_vs_history

    return percentile_vs_history(wh.financial_ratios, "pe_ratio").select(
        "symbol", r6("percentile", "pe_percentile"), F.col("points").cast("bigint").alias("points"))


@query("w18_trend", f"""
select symbol, {s2('min_by(revenue, fiscal_date)', 'first_value')}, {s2('max_by(revenue, fiscal_date)', 'last_value')},
       {s2('max_by(revenue, fiscal_date) - min_by(revenue, fiscal_date)', 'change')},
       case when max_by(revenue, fiscal_date) > min_by(revenue, fiscal_date) then 'up'
            when max_by(revenue, fiscal_date) < min_by(revenue, fiscal_date) then 'down' else 'flat' end as direction,
       cast(count(*) as bigint) as points
from (select *, row_number() over (partition by symbol order by fiscal_date desc) as rn from {{income_statement}} where period = 'FY') x
where rn <= 6 and revenue is not null group by symbol having count(*) >= 2""")
def w18_trend(wh):
    from equilake.plans.research import trend

    rows = top_n_per_key(wh.income_statement.filter("period = 'FY'"), ["symbol"], [F.desc("fiscal_date")], 6)
    t = rows.groupBy("symbol").agg(trend("revenue").alias("t")).filter("t is not null")
    return t.select(
        "symbol", r2("t.first", "first_value"), r2("t.last", "last_value"), r2("t.change", "change"), "t.direction",
        F.col("t.n").cast("bigint").alias("points"))


@query("w19_latest_row", """
select symbol, model_type, as_of, snapshot_id from (
  select *, row_number() over (partition by symbol, model_type order by created_at desc) as rn from {valuation_snapshots}) x where rn = 1""")
def w19_latest_row(wh):
    return latest_row(wh.valuation_snapshots, ["symbol", "model_type"], ["created_at"]).select("symbol", "model_type", "as_of", "snapshot_id")


_PX = f"select symbol, trade_date, coalesce(adj_close, close) as px, row_number() {_W}) as i from {{daily_prices}}"


@query("w20_momentum", f"""
select symbol, trade_date, {s6(f'lag(px, 21) {_W}) / nullif(lag(px, 252) {_W}), 0) - 1', 'momentum_12_1')},
       {s6(f'lag(px, 21) {_W}) / nullif(lag(px, 126) {_W}), 0) - 1', 'momentum_6_1')} from {{px}}""", {"px": _PX})
def w20_momentum(wh):
    df = ind.with_price_factors(factors.price_series(wh.daily_prices))
    return df.select("symbol", "trade_date", r6("momentum_12_1"), r6("momentum_6_1"))


@query("w21_reversal", f"""
select symbol, trade_date, {s6(f'-(px / nullif(lag(px, 21) {_W}), 0) - 1)', 'reversal_1m')} from {{px}}""", {"px": _PX})
def w21_reversal(wh):
    return ind.with_price_factors(factors.price_series(wh.daily_prices)).select("symbol", "trade_date", r6("reversal_1m"))


@query("w22_realized_vol", f"""
select a.symbol, a.trade_date, {s6("sqrt(252) * stddev_samp(ln(b.px / p.px))", 'realized_vol_3m')}
from {{px}} a join {{px}} b on a.symbol = b.symbol and b.i between a.i - 62 and a.i
join {{px}} p on p.symbol = b.symbol and p.i = b.i - 1 where a.i >= 64 group by a.symbol, a.trade_date""", {"px": _PX})
def w22_realized_vol(wh):
    df = ind.with_price_factors(factors.price_series(wh.daily_prices)).filter("realized_vol_3m is not null")
    return df.select("symbol", "trade_date", r6("realized_vol_3m"))


@query("w24_average_rank", """
select symbol, fiscal_date, rank() over (partition by fiscal_date order by pe_ratio)
       + (count(*) over (partition by fiscal_date, pe_ratio) - 1) / 2.0 as pe_rank,
       rank() over (partition by fiscal_date order by num) + (count(*) over (partition by fiscal_date, num) - 1) / 2.0 as num_rank
from (select r.symbol, r.fiscal_date, r.pe_ratio, cast(e.num_analysts_eps as double) as num from {financial_ratios} r
      join {analyst_estimates} e on r.symbol = e.symbol and r.period = e.period and r.fiscal_date = e.fiscal_date
      where r.period = 'FY' and r.pe_ratio is not null) x""")
def w24_average_rank(wh):
    est = wh.analyst_estimates.select("symbol", "period", "fiscal_date", F.col("num_analysts_eps").cast("double").alias("num"))
    df = wh.financial_ratios.filter("period = 'FY' and pe_ratio is not null").join(est, ["symbol", "period", "fiscal_date"])
    df = df.select("symbol", "fiscal_date", "pe_ratio", "num")
    df = with_average_rank(with_average_rank(df, ["fiscal_date"], "pe_ratio", "pe_rank"), ["fiscal_date"], "num", "num_rank")
    return df.select("symbol", "fiscal_date", "pe_rank", "num_rank")
