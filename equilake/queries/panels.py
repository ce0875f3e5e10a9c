"""Queries of the as-of joins, factor panels and factor statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from equilake.operators.asof import asof_price, asof_price_open
from equilake.operators.ranks import group_median, rank_correlation, with_quantile_bucket
from equilake.plans import factors
from equilake.queries.registry import BASE, query, r6, s6
from equilake.sources.bars import price_series, rebalance_dates, scan_bars

_UP = "select * from {daily_prices} where symbol in (select symbol from {universe})"
_RD = """select cast(last_day(m) as date) as d from (
  select a, b, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), interval 1 month)) as m
  from (select min(trade_date) as a, max(trade_date) as b from {up}) s) t where last_day(m) between a and b"""
_TG = "select u.symbol, r.d from {universe} u cross join {rd} r"
_PX = """select symbol, trade_date, coalesce(adj_close, close) as px,
  row_number() over (partition by symbol order by trade_date) as i from {up}"""
_PF = """select symbol, trade_date, i, px, lag(px, 21) over w / nullif(lag(px, 252) over w, 0) - 1 as mom
  from {px} window w as (partition by symbol order by trade_date)"""
_MOM = "select t.symbol, t.d, b.mom as factor from {tg} t asof left join {pf} b on t.symbol = b.symbol and t.d >= b.trade_date"
_KNOWN = """select r.symbol, r.fiscal_date, r.return_on_equity as v, cast(i.known_at as date) as kd from {financial_ratios} r
  join {income_statement} i on r.symbol = i.symbol and r.period = i.period and r.fiscal_date = i.fiscal_date where r.period = 'FY'"""
_ROE = """select t.symbol, t.d, max_by(k.v, k.fiscal_date) as factor from {tg} t
  left join {known} k on t.symbol = k.symbol and k.kd <= t.d group by t.symbol, t.d"""
_HZ = "select * from (values ('1w', 7), ('1m', 30), ('3m', 91), ('6m', 182)) v(horizon, days)"
_UPV = "select symbol, trade_date, coalesce(adj_close, close) as px from {up} where coalesce(adj_close, close) is not null"
_SYM = "select s.symbol, r.d from (select distinct symbol from {up}) s cross join {rd} r"
_FWD = """select x.symbol, x.d, x.horizon, case when x.d - x.d0 <= 3 and x.td - b.trade_date <= 3 then b.px / nullif(x.p0, 0) - 1 end as r
from (select y.symbol, y.d, y.horizon, y.td, a.px as p0, a.trade_date as d0
      from (select s.symbol, s.d, h.horizon, s.d + cast(h.days as integer) as td from {sym} s cross join {hz} h) y
      asof left join {upv} a on y.symbol = a.symbol and y.d >= a.trade_date) x
asof left join {upv} b on x.symbol = b.symbol and x.td >= b.trade_date"""
_BASE = {"up": _UP, "rd": _RD, "tg": _TG}
_MOMENTUM = {**_BASE, "px": _PX, "pf": _PF, "fac": _MOM}
_FUND = {**_BASE, "known": _KNOWN, "fac": _ROE}
_RET = {"hz": _HZ, "upv": _UPV, "sym": _SYM, "fwd": _FWD}
_RANKED = """select d, horizon, rank() over (partition by d, horizon order by factor) + (count(*) over (partition by d, horizon, factor) - 1) / 2.0 as rf,
  rank() over (partition by d, horizon order by r) + (count(*) over (partition by d, horizon, r) - 1) / 2.0 as rr from
  (select f.d, w.horizon, f.factor, w.r from {fac} f join {fwd} w on f.symbol = w.symbol and f.d = w.d where f.factor is not null and w.r is not null) p"""
_ICS = """select d, horizon, n, (sxy - n * m * m) / sqrt((sxx - n * m * m) * (syy - n * m * m)) as ic from (
  select d, horizon, cast(count(*) as bigint) as n, (count(*) + 1) / 2.0 as m, sum(rf * rr) as sxy, sum(rf * rf) as sxx, sum(rr * rr) as syy
  from {ranked} group by d, horizon) q where n >= 5 and sxx - n * m * m > 0 and syy - n * m * m > 0"""
_QB = """select d, factor, r, ntile(5) over (partition by d order by factor, md5(symbol), symbol) as bucket from (
  select f.d, f.symbol, f.factor, w.r, count(*) over (partition by f.d) as n from {fac} f join {fwd} w on f.symbol = w.symbol and f.d = w.d
  where w.horizon = '1m' and f.factor is not null and w.r is not null) p where n >= 5"""
_QR = """select bucket, avg(m) as mean_return, cast(sum(c) as bigint) as c from
  (select d, bucket, avg(r) as m, count(*) as c from {qb} group by d, bucket) x group by bucket"""
_STATS = {"ranked": _RANKED, "ics": _ICS}
_QUANT = {"qb": _QB, "qr": _QR}


@query("f14_rebalance_dates", "select d as rebalance_date, 'monthly' as freq from {rd} union all "
       "select cast(d as date), 'weekly' from (select unnest(generate_series(a, b, interval 1 day)) as d from "
       "(select min(trade_date) as a, max(trade_date) as b from {up}) s) x where dayofweek(d) = 5", {"up": _UP, "rd": _RD})
def f14_rebalance_dates(wh):
    px = factors.universe_prices(wh)
    monthly = rebalance_dates(px).withColumn("freq", F.lit("monthly"))
    return monthly.unionByName(rebalance_dates(px, "weekly").withColumn("freq", F.lit("weekly")))


@query("i15_scan_bars", """
select symbol, trade_date, coalesce(open * f, c) as open, coalesce(high * f, c) as high, coalesce(low * f, c) as low, c as close, volume from (
  select *, case when adj_close is not null and close <> 0 then adj_close / close else 1 end as f, coalesce(case when close <> 0 then adj_close end, close) as c
  from {daily_prices} where close is not null and trade_date between date '1996-01-01' and date '1999-12-31') x""")
def i15_scan_bars(wh):
    return scan_bars(wh.daily_prices, dt.date(1996, 1, 1), dt.date(1999, 12, 31))


@query("i16_price_series", """select symbol, trade_date, coalesce(adj_close, close) as px,
  cast(row_number() over (partition by symbol order by trade_date) as bigint) as bar_idx from {daily_prices}""")
def i16_price_series(wh):
    return price_series(wh.daily_prices).withColumn("bar_idx", F.col("bar_idx").cast("bigint"))


@query("j1_asof_price", """
select symbol, d as target_date, case when d - td <= 3 then td end as asof_date, case when d - td <= 3 then px end as value from (
  select t.symbol, t.d, b.trade_date as td, b.px from {tg} t asof left join {upv} b on t.symbol = b.symbol and t.d >= b.trade_date) x""",
       {**_BASE, "upv": _UPV})
def j1_asof_price(wh):
    px = factors.universe_prices(wh)
    targets = factors.universe_dates(wh.universe, rebalance_dates(px)).withColumnRenamed("rebalance_date", "target_date")
    return asof_price(targets, px)


@query("j1_asof_price_ledger", """
select symbol, d as target_date, case when d - td <= 3 then td end as asof_date, case when d - td <= 3 then close end as value from (
  select t.symbol, t.d, b.trade_date as td, b.close from {tg} t asof left join {daily_prices} b on t.symbol = b.symbol and t.d >= b.trade_date) x""",
       {"tg": "select distinct symbol, opened_at as d from {decision_base}"})
def j1_asof_price_ledger(wh):
    targets = wh.decision_base.select("symbol", F.col("opened_at").alias("target_date"))
    return asof_price(targets, wh.daily_prices, variant="ledger")


@query("j2_asof_price_open", """
select t.symbol, t.d as target_date, coalesce(nullif(b.close, 0), l.close) as value from {tg} t
asof left join {daily_prices} b on t.symbol = b.symbol and t.d >= b.trade_date
left join (select symbol, max_by(close, trade_date) as close from {daily_prices} group by symbol) l on t.symbol = l.symbol""",
       {"tg": "select distinct symbol, opened_at as d from {decision_base}"})
def j2_asof_price_open(wh):
    return asof_price_open(wh.decision_base.select("symbol", F.col("opened_at").alias("target_date")), wh.daily_prices)


@query("j3_pit_factor", f"select symbol, d as rebalance_date, {s6('factor', 'factor')} from {{fac}}", _FUND, share=BASE)
def j3_pit_factor(wh):
    dates = rebalance_dates(factors.universe_prices(wh))
    targets = factors.universe_dates(wh.universe, dates)
    found = factors.pit_factor(wh.financial_ratios, wh.income_statement, targets, "return_on_equity")
    return found.select("symbol", "rebalance_date", r6("factor"))


@query("j4_universe_dates", "select symbol, d as rebalance_date from {tg}", _BASE)
def j4_universe_dates(wh):
    return factors.universe_dates(wh.universe, rebalance_dates(factors.universe_prices(wh)))


@query("w23_forward_returns", f"select d as rebalance_date, symbol, horizon, {s6('r', 'fwd_return')} from {{fwd}}", {**_BASE, **_RET})
def w23_forward_returns(wh):
    px = factors.universe_prices(wh)
    return factors.forward_returns(px, rebalance_dates(px)).withColumn("fwd_return", r6("fwd_return"))


@query("r7_factor_panel_momentum", f"select d as rebalance_date, symbol, {s6('factor', 'factor')} from {{fac}}", _MOMENTUM)
def r7_factor_panel_momentum(wh):
    dates = rebalance_dates(factors.universe_prices(wh))
    return factors.factor_panel(wh, "momentum_12_1", dates).withColumn("factor", r6("factor"))


@query("r7_factor_panel_roe", f"select d as rebalance_date, symbol, {s6('factor', 'factor')} from {{fac}}", _FUND, share=BASE)
def r7_factor_panel_roe(wh):
    dates = rebalance_dates(factors.universe_prices(wh))
    return factors.factor_panel(wh, "roe", dates).withColumn("factor", r6("factor"))


@query("r8_ic_series_momentum", f"select d as rebalance_date, horizon, n, {s6('ic', 'ic')} from {{ics}}", {**_MOMENTUM, **_RET, **_STATS})
def r8_ic_series_momentum(wh):
    return factors.run_signal(wh, "momentum_12_1").ics.withColumn("ic", r6("ic"))


@query("r8_ic_series_roe", f"select d as rebalance_date, horizon, n, {s6('ic', 'ic')} from {{ics}}", {**_FUND, **_RET, **_STATS}, share=BASE)
def r8_ic_series_roe(wh):
    return factors.run_signal(wh, "roe").ics.withColumn("ic", r6("ic"))


@query("a8_ic_summary", f"""
select horizon, {s6('avg(ic)', 'mean_ic')}, {s6('stddev_samp(ic)', 'ic_std')}, {s6('avg(ic) / nullif(stddev_samp(ic), 0)', 'ic_ir')},
       {s6('avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*))', 't_stat')}, {s6('sum(case when ic > 0 then 1 else 0 end) * 1.0 / count(*)', 'hit_rate')},
       cast(count(*) as bigint) as n_dates from {{ics}} where horizon = '1m' group by horizon""", {**_MOMENTUM, **_RET, **_STATS})
def a8_ic_summary(wh):
    df = factors.run_signal(wh, "momentum_12_1").summary
    return df.select("horizon", *[r6(c) for c in ("mean_ic", "ic_std", "ic_ir", "t_stat", "hit_rate")], "n_dates")


@query("a9_quantile_returns", f"select bucket, {s6('mean_return', 'mean_return')}, c as count from {{qr}}", {**_MOMENTUM, **_RET, **_QUANT})
def a9_quantile_returns(wh):
    df = factors.run_signal(wh, "momentum_12_1").quantiles
    return df.select("bucket", r6("mean_return"), F.col("count").cast("bigint").alias("count"))


@query("a9_quantile_spread", f"""
select {s6('max(case when bucket = 5 then mean_return end) - max(case when bucket = 1 then mean_return end)', 'long_short_spread')},
       {s6('max(case when bucket = 5 then mean_return end) - max(case when bucket = 1 then mean_return end)', 'long_short_spread_aligned')},
       {s6('corr(bucket, rk)', 'monotonicity')} from (select *, rank() over (order by mean_return) as rk from {{qr}}) x""",
       {**_MOMENTUM, **_RET, **_QUANT})
def a9_quantile_spread(wh):
    df = factors.run_signal(wh, "momentum_12_1").spread
    return df.select(r6("long_short_spread"), r6("long_short_spread_aligned"), r6("monotonicity"))


@query("a10_ic_decay", f"""
select h.horizon, h.days, {s6('avg(ic)', 'mean_ic')}, {s6('avg(ic) / nullif(stddev_samp(ic), 0)', 'ic_ir')}, cast(count(ic) as bigint) as n_dates
from {{hz}} h left join {{ics}} i on h.horizon = i.horizon group by h.horizon, h.days""", {**_MOMENTUM, **_RET, **_STATS})
def a10_ic_decay(wh):
    df = factors.run_signal(wh, "momentum_12_1").decay
    return df.select("horizon", "days", r6("mean_ic"), r6("ic_ir"), "n_dates")


@query("a11_coverage", f"""
select 'fundamental' as kind, n_rebalance_dates, n_dates_with_ic, {s6('avg_ranked', 'avg_ranked')}, min_ranked, max_ranked, universe_size,
       distinct_observations, distinct_observations * 1.0 / universe_size < 3 as quasi_static
from (select cast(count(*) as bigint) as n_rebalance_dates, avg(c) as avg_ranked, cast(min(c) as bigint) as min_ranked, cast(max(c) as bigint) as max_ranked
      from (select r.d, count(p.d) as c from {{rd}} r left join
              (select f.d from {{fac}} f join {{fwd}} w on f.symbol = w.symbol and f.d = w.d where w.horizon = '1m' and f.factor is not null and w.r is not null) p
            on r.d = p.d group by r.d) q) a,
     (select cast(count(*) as bigint) as n_dates_with_ic from {{ics}} where horizon = '1m') b,
     (select cast(count(*) as bigint) as universe_size, cast(sum(c) as bigint) as distinct_observations
      from (select symbol, count(distinct factor) as c from {{fac}} group by symbol) z) c""", {**_FUND, **_RET, **_STATS}, share=BASE)
def a11_coverage(wh):
    df = factors.run_signal(wh, "roe").coverage
    return df.select("kind", "n_rebalance_dates", "n_dates_with_ic", r6("avg_ranked"), "min_ranked", "max_ranked", "universe_size", "distinct_observations", "quasi_static")


_COVERED = """select * from (select avg(c) as avg_ranked, min(c) as min_ranked, max(c) as max_ranked, count(*) as n_rebalance_dates from (select r.d, count(p.d) as c from {rd} r left join
      (select f.d from {fac} f join {fwd} w on f.symbol = w.symbol and f.d = w.d where w.horizon = '1m' and f.factor is not null and w.r is not null) p on r.d = p.d group by r.d) q) a,
  (select count(*) as universe_size, sum(c) as distinct_observations from (select symbol, count(distinct factor) as c from {fac} group by symbol) z) c, (select count(*) as n_dates from {ics} where horizon = '1m') i"""
_SIX = {"mean_ic": "avg(ic)", "ic_std": "stddev_samp(ic)", "ic_ir": "avg(ic) / nullif(stddev_samp(ic), 0)", "t_stat": "avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*))", "hit_rate": "sum(case when ic > 0 then 1 else 0 end) * 1.0 / count(*)", "n_dates": "count(*)"}
_ENDS = "max(case when bucket = 5 then mean_return end) - max(case when bucket = 1 then mean_return end)"
_WIDE = ("avg_ranked", "min_ranked", "max_ranked", "n_rebalance_dates", "universe_size", "distinct_observations")


@query("r9_run_signal", " union all ".join([
    *[f"select 'summary' as section, '{k}' as item, {s6(v, 'value')} from {{ics}} where horizon = '1m' having count(*) > 0" for k, v in _SIX.items()],
    *[f"select 'quantile', cast(bucket as varchar) || ' {k}', {s6(k)} from {{qr}}" for k in ("mean_return", "c")],
    f"select 'spread', 'raw', {s6(_ENDS)} from {{qr}}", f"select 'spread', 'aligned', {s6(_ENDS)} from {{qr}}",
    f"select 'spread', 'monotonicity', {s6('corr(bucket, rk)')} from (select *, rank() over (order by mean_return) as rk from {{qr}}) x",
    f"select 'decay', h.horizon || ' mean_ic', {s6('avg(ic)')} from {{hz}} h left join {{ics}} i on h.horizon = i.horizon group by h.horizon",
    "select 'decay', h.horizon || ' n_dates', cast(count(ic) as double) from {hz} h left join {ics} i on h.horizon = i.horizon group by h.horizon",
    *[f"select 'coverage', '{k}', {s6(k)} from {{cov}}" for k in _WIDE],
    "select 'warning', w, cast(null as double) from (select unnest([case when distinct_observations * 1.0 / universe_size < 3 then 'quasi-static factor: few distinct filings, t-stat overstated' end, "
    "case when n_dates < 6 then 'only ' || cast(n_dates as varchar) || ' usable dates' end, case when avg_ranked < 10 then 'thin cross-section' end]) as w from {cov}) x where w is not null"]),
       {**_FUND, **_RET, **_STATS, **_QUANT, "cov": _COVERED}, share=BASE)
def r9_run_signal(wh):
    """Every number and warning of the report: summary, buckets, spread, decay, coverage."""
    run = factors.run_signal(wh, "roe")

    def long_form(df, section, items):
        pairs = F.array(*[F.struct(name.alias("item"), r6(value.cast("double"), "value").alias("value")) for name, value in items])
        return df.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select("section", "p.item", "p.value")

    named = lambda *names: [(F.lit(n), F.col(n)) for n in names]
    label = lambda c, n: F.concat_ws(" ", F.col(c).cast("string"), F.lit(n))
    parts = [
        long_form(run.summary, "summary", named(*_SIX)), long_form(run.quantiles, "quantile", [(label("bucket", "mean_return"), F.col("mean_return")), (label("bucket", "c"), F.col("count"))]),
        long_form(run.spread, "spread", [(F.lit("raw"), F.col("long_short_spread")), (F.lit("aligned"), F.col("long_short_spread_aligned")), (F.lit("monotonicity"), F.col("monotonicity"))]),
        long_form(run.decay, "decay", [(label("horizon", "mean_ic"), F.col("mean_ic")), (label("horizon", "n_dates"), F.col("n_dates"))]),
        long_form(run.coverage, "coverage", named(*_WIDE)),
        run.coverage.select(F.lit("warning").alias("section"), F.explode("warnings").alias("item"), F.lit(None).cast("double").alias("value"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("u2_custom_factor", f"""
select t.d as rebalance_date, t.symbol, {s6('b.close / nullif(b.high, 0)', 'factor')} from {{tg}} t
asof left join {{up}} b on t.symbol = b.symbol and t.d >= b.trade_date""", _BASE)
def u2_custom_factor(wh):
    from equilake.operators.asof import asof_value

    def close_to_high(warehouse, targets):
        points = targets.select("symbol", F.col("rebalance_date").alias("target_date"))
        found = asof_value(points, factors.universe_prices(warehouse), F.try_divide("close", "high"), tolerance_days=None, skip_null=False)
        return found.select("symbol", F.col("target_date").alias("rebalance_date"), F.col("value").alias("factor"))

    factors.register_factor("close_to_high", "price", close_to_high, 1, "close over the day's high")
    return factors.factor_panel(wh, "close_to_high", rebalance_dates(factors.universe_prices(wh))).withColumn("factor", r6("factor"))


# Hot ties: half of the rows carry one value, so bucket edges fall inside tie groups.
@query("a9_quantile_ties", """
select fiscal_date, symbol, cast(ntile(4) over (partition by fiscal_date order by v, md5(symbol), symbol) as int) as bucket from (
  select fiscal_date, symbol, greatest(return_on_equity, 0.0) * 0 + case when return_on_equity > 0.01 then return_on_equity else 0 end as v,
         count(*) over (partition by fiscal_date) as n from {financial_ratios} where period = 'FY' and return_on_equity is not null) x where n >= 4""")
def a9_quantile_ties(wh):
    v = F.when(F.col("return_on_equity") > 0.01, F.col("return_on_equity")).otherwise(F.lit(0.0))
    df = wh.financial_ratios.filter("period = 'FY' and return_on_equity is not null").select("fiscal_date", "symbol", v.alias("v"))
    return with_quantile_bucket(df, ["fiscal_date"], "v", "symbol", 4).select("fiscal_date", "symbol", "bucket")


@query("a2_group_median", f"""
select period, fiscal_date, {s6('median(net_margin)', 'median_margin')} from {{financial_ratios}} group by period, fiscal_date""")
def a2_group_median(wh):
    return group_median(wh.financial_ratios, ["period", "fiscal_date"], "net_margin", "median_margin").withColumn("median_margin", r6("median_margin"))


@query("r8_rank_correlation", f"""
select fiscal_date, {s6('corr(a, b)', 'rho')}, cast(count(*) as bigint) as n from (
  select fiscal_date, rank() over (partition by fiscal_date order by pe_ratio) + (count(*) over (partition by fiscal_date, pe_ratio) - 1) / 2.0 as a,
         rank() over (partition by fiscal_date order by net_margin) + (count(*) over (partition by fiscal_date, net_margin) - 1) / 2.0 as b
  from {{financial_ratios}} where period = 'FY' and pe_ratio is not null and net_margin is not null) x group by fiscal_date having count(*) > 1""")
def r8_rank_correlation(wh):
    df = wh.financial_ratios.filter("period = 'FY'")
    return rank_correlation(df, ["fiscal_date"], "pe_ratio", "net_margin", "rho").filter("n > 1").withColumn("rho", r6("rho"))


