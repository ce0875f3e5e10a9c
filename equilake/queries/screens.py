"""Queries of filters, screens, symbol state, set differences and lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from equilake.functions import predicates as p
from equilake.functions import scalars as fs
from equilake.operators import freshness, latest
from equilake.operators.screen import diff_runs, fundamental_screen, run_screen, technical_flags
from equilake.operators.state import combine_year, latest_close, latest_holdings, symbol_state
from equilake.operators.upsert import membership_diff
from equilake.plans.valuation import peer_median
from equilake.queries.registry import BASE, query, r2, r6, s2, s6

_STATE = """
select u.symbol, p.sector, p.industry, p.country, p.beta,
  coalesce(cast(json_extract_string(p.raw, '$.mktCap') as double), cast(json_extract_string(p.raw, '$.marketCap') as double)) as market_cap,
  r.pe_ratio as pe, r.peg_ratio as peg, r.price_to_book as pb, r.price_to_sales as ps, r.ev_to_ebitda as ev_ebitda, r.current_ratio, r.debt_to_equity as debt_equity,
  r.return_on_equity as roe, r.return_on_assets as roa, r.return_on_invested_capital as roic, r.gross_margin, r.operating_margin, r.net_margin, r.fcf_yield,
  r.earnings_yield, c.close
from {universe} u left join {profiles} p on u.symbol = p.symbol
left join (select *, row_number() over (partition by symbol order by fiscal_date desc) as rn from {financial_ratios} where period = 'FY') r on u.symbol = r.symbol and r.rn = 1
left join (select symbol, max_by(close, trade_date) as close from {daily_prices} group by symbol) c on u.symbol = c.symbol"""
_S = {"state": _STATE}


def _state(wh):
    return symbol_state(wh.universe, wh.profiles, wh.financial_ratios, wh.daily_prices)


@query("j5_symbol_state", "select * from {state}", _S, share=BASE)
def j5_symbol_state(wh):
    return _state(wh)


@query("p1_screen_value", "select symbol from {state} where pe < 60 and roe > 0.005 and (sector in ('Technology', 'Energy', 'Healthcare') or beta >= 1)", _S, share=BASE)
def p1_screen_value(wh):
    pred = p.cmp(p.fld("pe"), "<", 60) & p.cmp(p.fld("roe"), ">", 0.005) & (
        p.is_in(p.fld("sector"), ["Technology", "Energy", "Healthcare"]) | p.cmp(p.fld("beta"), ">=", 1))
    return fundamental_screen(_state(wh), pred).select("symbol")


@query("p1_screen_missing", """
select symbol from {state} where not coalesce(pe < 60, false) and (sector is null or sector not in ('Utilities', 'Energy')) and not coalesce(beta > 1.2, false)""", _S, share=BASE)
def p1_screen_missing(wh):
    pred = ~p.cmp(p.fld("pe"), "<", 60) & p.not_in(p.fld("sector"), ["Utilities", "Energy"]) & ~p.cmp(p.fld("beta"), ">", 1.2)
    return fundamental_screen(_state(wh), pred).select("symbol")


@query("p1_screen_chain", "select symbol from {state} where 20 < pe and pe < 90 and contains(sector, 'Financial') and pb <= ps * 3 and beta <> 0", _S, share=BASE)
def p1_screen_chain(wh):
    pred = p.chain(20, "<", p.fld("pe"), "<", 90) & p.is_in("Financial", p.fld("sector")) & p.cmp(
        p.field("pb"), "<=", p.field("ps") * 3) & p.truthy("beta")
    return fundamental_screen(_state(wh), pred).select("symbol")


_AGE = """select *, row_number() over (partition by symbol order by trade_date desc) as age, count(*) over (partition by symbol) as n from {daily_prices}"""


def _flags(wh, predicates, **names):
    df = technical_flags(wh.daily_prices, predicates)
    cols = [c for c in df.columns if c not in ("symbol", "passes")]
    return df.select("symbol", *[F.col(c).alias(n) for c, n in zip(cols, names)])


@query("p3_above_below_sma", """
select symbol, max(n) >= 200 and max(case when age = 1 then close end) > avg(case when age <= 200 then close end) as above,
       max(n) >= 50 and max(case when age = 1 then close end) < avg(case when age <= 50 then close end) as below from {b} group by symbol""", {"b": _AGE})
def p3_above_below_sma(wh):
    return _flags(wh, [("above_sma", [200]), ("below_sma", [50])], above=1, below=1)


@query("p6_near_52w", """
select symbol, max(n) >= 252 and max(case when age = 1 then close end) >= max(case when age <= 252 then close end) * 0.95 as high,
       max(n) >= 252 and max(case when age = 1 then close end) <= min(case when age <= 252 then close end) * 1.10 as low from {b} group by symbol""", {"b": _AGE})
def p6_near_52w(wh):
    return _flags(wh, [("near_52w_high", [5]), ("near_52w_low", [10])], high=1, low=1)


@query("p7_volume_spike", """
select symbol, max(n) >= 21 and max(case when age = 1 then volume end) > 1.5 * avg(case when age <= 20 then volume end) as spike from {b} group by symbol""", {"b": _AGE})
def p7_volume_spike(wh):
    return _flags(wh, [("volume_spike", [20, 1.5])], spike=1)


def _recurrent():
    from equilake.queries.windows import _MACD, _RSI

    return {
        **_MACD, "gl": _RSI["gl"], "wilder": _RSI["wilder"],
        "rs": """select n.symbol, row_number() over (partition by n.symbol order by n.trade_date desc) as age,
                 case when w.l = 0 then case when w.g > 0 then 100 else 50 end else 100 - 100 / (1 + w.g / nullif(w.l, 0)) end as r
                 from {num} n left join {wilder} w on n.symbol = w.symbol and n.i = w.i""",
        "cr": """select symbol, age, case when pl <= ps and v > s then 1 when pl >= ps and v < s then -1 else 0 end as x from (
                 select n.symbol, l.v, s.e as s, lag(l.v) over (partition by n.symbol order by n.trade_date) as pl,
                   lag(s.e) over (partition by n.symbol order by n.trade_date) as ps, row_number() over (partition by n.symbol order by n.trade_date desc) as age
                 from {num} n left join {line} l on n.symbol = l.symbol and n.i = l.i + 25 left join {ema9} s on n.symbol = s.symbol and n.i = s.i + 25) q""",
    }


@query("p4_rsi_zones", """
select symbol, coalesce(max(case when age <= 30 and r < 30 then 1 else 0 end) = 1, false) as oversold,
       coalesce(max(case when age <= 30 and r > 70 then 1 else 0 end) = 1, false) as overbought from {rs} group by symbol""", _recurrent(), recursive=True)
def p4_rsi_zones(wh):
    return _flags(wh, [("rsi_oversold", [30]), ("rsi_overbought", [30])], oversold=1, overbought=1)


@query("p5_macd_crosses", """
select symbol, max(case when age <= 5 and x = 1 then 1 else 0 end) = 1 as golden, max(case when age <= 5 and x = -1 then 1 else 0 end) = 1 as death
from {cr} group by symbol""", _recurrent(), recursive=True)
def p5_macd_crosses(wh):
    return _flags(wh, [("macd_golden_cross", [5]), ("macd_death_cross", [5])], golden=1, death=1)


@query("p8_technical_screen", """
select symbol from {b} group by symbol having max(n) >= 252 and max(case when age = 1 then close end) > avg(case when age <= 50 then close end)
  and max(case when age = 1 then close end) >= max(case when age <= 252 then close end) * 0.9""", {"b": _AGE})
def p8_technical_screen(wh):
    return technical_flags(wh.daily_prices, [("above_sma", [50]), ("near_52w_high", [10])]).filter("passes").select("symbol")


@query("p9_run_screen", """
select s.symbol from {state} s join (select symbol from {b} group by symbol
  having max(n) >= 200 and max(case when age = 1 then close end) > avg(case when age <= 200 then close end)) t on s.symbol = t.symbol where s.roe > 0""",
       {"state": _STATE, "b": _AGE}, share=BASE)
def p9_run_screen(wh):
    return run_screen(wh, p.cmp(p.fld("roe"), ">", 0), [("above_sma", [200])])


@query("p9_flagship_screen", f"""
select s.symbol, s.sector, {s6('s.pe', 'pe')}, {s6('m.pe', 'sector_pe')}, s.close from {{state}} s
join (select symbol from {{b}} group by symbol having max(n) >= 252 and max(case when age = 1 then close end) > avg(case when age <= 200 then close end)
      and max(case when age = 1 then close end) >= max(case when age <= 252 then close end) * 0.95) t on s.symbol = t.symbol
join (select p.sector, median(r.pe) as pe from {{profiles}} p join (
        select symbol, max_by(pe_ratio, fiscal_date) as pe from {{financial_ratios}} where period = 'FY' and pe_ratio is not null group by symbol) r
      on p.symbol = r.symbol where p.sector is not null group by p.sector) m on s.sector = m.sector
where s.pe <= m.pe""", {"state": _STATE, "b": _AGE}, share=BASE)
def p9_flagship_screen(wh):
    technical = run_screen(wh, None, [("above_sma", [200]), ("near_52w_high", [5])])
    medians = peer_median(wh.profiles, wh.financial_ratios, "pe_ratio").withColumnRenamed("median", "sector_pe")
    df = _state(wh).join(technical, "symbol", "left_semi").join(medians, "sector")
    return df.filter(p.cmp(p.field("pe"), "<=", F.col("sector_pe"))).select("symbol", "sector", r6("pe"), r6("sector_pe"), "close")


# ----- lists ----------------------------------------------------------------------------------


@query("p10_filter_rows", "select ib_exec_id, symbol, trade_date, quantity from {trades} where account_id = 'C7' and side = 'SELL' and trade_date >= date '1999-01-01'")
def p10_filter_rows(wh):
    df = latest.filter_rows(wh.trades, account_id="C7", side="SELL", symbol=None, since=("trade_date", dt.date(1999, 1, 1)))
    return df.select("ib_exec_id", "symbol", "trade_date", "quantity")


@query("p11_select_fields", """
select symbol, fiscal_date, cast(json_extract_string(raw, '$.netInterestIncome') as bigint) as net_interest_income from {income_statement}""")
def p11_select_fields(wh):
    df = latest.select_fields(wh.income_statement, symbol="symbol", fiscal_date="fiscal_date", net_interest_income="raw:$.netInterestIncome")
    return df.withColumn("net_interest_income", F.col("net_interest_income").cast("bigint"))


@query("p13_get_by_id", "select decision_id, symbol, side, opened_at from {decision_base} where decision_id = 'D1000'")
def p13_get_by_id(wh):
    return latest.get_by_id(wh.decision_base, "decision_id", "D1000").select("decision_id", "symbol", "side", "opened_at")


@query("l1_newest", "select ib_exec_id, account_id, symbol, trade_date from {trades} order by trade_date desc, ib_exec_id limit 50")
def l1_newest(wh):
    return latest.newest(wh.trades, [F.desc("trade_date"), F.asc("ib_exec_id")], 50).select("ib_exec_id", "account_id", "symbol", "trade_date")


@query("l2_top_n_per_key", """
select symbol, period, fiscal_date, cast(rn as int) as rn from (
  select *, row_number() over (partition by symbol order by fiscal_date desc, period) as rn from {income_statement}) x where rn <= 5""")
def l2_top_n_per_key(wh):
    return latest.top_n_per_key(wh.income_statement, ["symbol"], [F.desc("fiscal_date"), F.asc("period")], 5, rank="rn").select(
        "symbol", "period", "fiscal_date", F.col("rn").cast("int").alias("rn"))


@query("l5_sorted_symbols", "select distinct symbol from {trades} order by symbol")
def l5_sorted_symbols(wh):
    return latest.sorted_symbols(wh.trades)


# ----- state joins ----------------------------------------------------------------------------

_ANNUAL = "select symbol, year(fiscal_date) as year, {cols} from (select *, row_number() over (partition by symbol order by fiscal_date desc) as rn from {{{table}}} where period = 'FY') x where rn <= 2"


@query("j7_combine_year", f"""
select coalesce(i.symbol, b.symbol, c.symbol) as symbol, cast(coalesce(i.year, b.year, c.year) as int) as year, {s2('revenue', 'revenue')}, {s2('total_assets', 'total_assets')},
       {s2('free_cash_flow', 'free_cash_flow')}, {s6('net_income / nullif(eps_diluted, 0)', 'shares')}
from {{i}} i full join {{b}} b on i.symbol = b.symbol and i.year = b.year
full join {{c}} c on coalesce(i.symbol, b.symbol) = c.symbol and coalesce(i.year, b.year) = c.year""", {
    "i": _ANNUAL.format(cols="revenue, net_income, eps_diluted", table="income_statement"),
    "b": _ANNUAL.format(cols="total_assets", table="balance_sheet"), "c": _ANNUAL.format(cols="free_cash_flow", table="cash_flow")}, share=BASE)
def j7_combine_year(wh):
    df = combine_year(wh.income_statement, wh.balance_sheet, wh.cash_flow)
    return df.select("symbol", "year", r2("revenue"), r2("total_assets"), r2("free_cash_flow"), r6("shares"))


@query("j8_latest_holdings", f"""
select account_id, symbol, as_of_date, quantity, {s2('market_value', 'market_value')} from (
  select *, row_number() over (partition by account_id, symbol order by as_of_date desc) as rn from {{holdings}}) x where rn = 1""")
def j8_latest_holdings(wh):
    return latest_holdings(wh.holdings).select("account_id", "symbol", "as_of_date", "quantity", r2("market_value"))


@query("j8_holdings_on_date", "select account_id, symbol, quantity from {holdings} where as_of_date = date '1999-12-31'")
def j8_holdings_on_date(wh):
    return latest_holdings(wh.holdings, as_of=dt.date(1999, 12, 31)).select("account_id", "symbol", "quantity")


@query("j11_sector_etf", """
select symbol, case sector when 'Technology' then 'XLK' when 'Financial Services' then 'XLF' when 'Healthcare' then 'XLV' when 'Energy' then 'XLE'
  when 'Consumer Cyclical' then 'XLY' when 'Consumer Defensive' then 'XLP' when 'Industrials' then 'XLI' when 'Communication Services' then 'XLC'
  when 'Utilities' then 'XLU' when 'Real Estate' then 'XLRE' when 'Basic Materials' then 'XLB' else 'SPY' end as etf from {profiles}""")
def j11_sector_etf(wh):
    return wh.profiles.select("symbol", fs.sector_fund(F.concat(F.lit(" "), F.upper("sector"))).alias("etf"))


@query("j5_latest_close", "select symbol, max_by(close, trade_date) as close from {daily_prices} group by symbol")
def j5_latest_close(wh):
    return latest_close(wh.daily_prices)


# ----- freshness and sets ---------------------------------------------------------------------

NOW = dt.datetime(2001, 11, 5, tzinfo=dt.timezone.utc)
_SCOPES = " union all ".join(
    f"select '{s}' as scope, u.symbol, l.latest, case when l.latest is null then 'missing' when l.latest >= timestamp '2001-11-05' - interval {n} day then 'fresh' else 'stale' end as state "
    f"from {{universe}} u left join (select symbol, cast(max({c}) as timestamp) as latest from {{{t}}} group by symbol) l on u.symbol = l.symbol"
    for s, (t, c, n) in freshness.SCOPES.items())


@query("a1_freshness_states", "select scope, symbol, cast(latest as date) as latest, state from {st}", {"st": _SCOPES}, share=BASE)
def a1_freshness_states(wh):
    return freshness.freshness_states(wh, NOW).withColumn("latest", F.to_date("latest"))


@query("a1_freshness_report", """
select scope, cast(count(*) as bigint) as total, cast(sum(case when state = 'fresh' then 1 else 0 end) as bigint) as fresh,
  cast(sum(case when state = 'stale' then 1 else 0 end) as bigint) as stale, cast(sum(case when state = 'missing' then 1 else 0 end) as bigint) as missing
from {st} group by scope""", {"st": _SCOPES}, share=BASE)
def a1_freshness_report(wh):
    return freshness.freshness_report(freshness.freshness_states(wh, NOW))


@query("j13_needs_refresh", "select symbol from {st} where scope = 'quote' and state <> 'fresh'", {"st": _SCOPES})
def j13_needs_refresh(wh):
    return freshness.needs_refresh(freshness.freshness_states(wh, NOW, ("quote",)), "quote")


@query("o3_union_scopes", "select distinct symbol from {st} where state <> 'fresh' and scope in ('quote', 'profile', 'transcript')", {"st": _SCOPES})
def o3_union_scopes(wh):
    return freshness.needs_refresh(freshness.freshness_states(wh, NOW, ("quote", "profile", "transcript")))


@query("o4_skipped_fresh", "select distinct symbol from {trades} where symbol not in (select symbol from {st} where scope = 'quote' and state <> 'fresh')", {"st": _SCOPES})
def o4_skipped_fresh(wh):
    return freshness.skipped_fresh(wh.trades, freshness.freshness_states(wh, NOW, ("quote",)), "quote")


_RUNS = """select 'a' as run_id, symbol from {state} where roe > 0.01 union all select 'b', symbol from {state} where pe < 60"""


@query("o1_diff_runs", """
select coalesce(a.symbol, b.symbol) as symbol, case when a.symbol is null then 'added' when b.symbol is null then 'removed' else 'kept' end as status
from (select symbol from {runs} where run_id = 'a') a full join (select symbol from {runs} where run_id = 'b') b on a.symbol = b.symbol""",
       {"state": _STATE, "runs": _RUNS}, share=BASE)
def o1_diff_runs(wh):
    state = _state(wh)
    runs = state.filter("roe > 0.01").select(F.lit("a").alias("run_id"), "symbol").unionByName(
        state.filter("pe < 60").select(F.lit("b").alias("run_id"), "symbol"))
    return diff_runs(runs, "a", "b")


@query("o2_universe_diff", """
select coalesce(a.symbol, b.symbol) as symbol, case when a.symbol is null then 'added' when b.symbol is null then 'removed' else 'kept' end as status
from {universe} a full join (select distinct symbol from {news_items}) b on a.symbol = b.symbol""")
def o2_universe_diff(wh):
    return membership_diff(wh.universe, wh.news_items)


# ----- scalars --------------------------------------------------------------------------------


@query("f2_guarded_ratios", f"""
select symbol, period, fiscal_date, {s6('net_income / nullif(revenue, 0)', 'margin')}, {s6('operating_income / nullif(abs(net_income), 0) * 100', 'pct_of_income')},
       {s6('(revenue / nullif(gross_profit, 0) - 1) * 100', 'change')} from {{income_statement}}""")
def f2_guarded_ratios(wh):
    return wh.income_statement.select(
        "symbol", "period", "fiscal_date", r6(fs.safe_div("net_income", "revenue"), "margin"), r6(fs.pct("operating_income", "net_income"), "pct_of_income"),
        r6(fs.pct_change("revenue", "gross_profit"), "change"))


@query("f3_market_cap", """
select symbol, coalesce(cast(json_extract_string(raw, '$.mktCap') as double), cast(json_extract_string(raw, '$.marketCap') as double)) as market_cap,
       cast(json_extract_string(raw, '$.price') as double) as price from {profiles}""")
def f3_market_cap(wh):
    return wh.profiles.select("symbol", fs.market_cap("raw").alias("market_cap"), fs.raw_value("raw", "price").alias("price"))


@query("f4_stock_type", "select symbol, case when industry = 'Banks - Regional' then 'bank' else 'general' end as stock_type from {profiles}")
def f4_stock_type(wh):
    return wh.profiles.select("symbol", fs.stock_type("sector", "industry").alias("stock_type"))


@query("f5_net_revenue", f"""
select i.symbol, i.period, i.fiscal_date, {s2("case when p.industry = 'Banks - Regional' then i.revenue - cast(json_extract_string(i.raw, '$.interestExpense') as double) else i.revenue end", 'net_revenue')}
from {{income_statement}} i join {{profiles}} p on i.symbol = p.symbol""")
def f5_net_revenue(wh):
    kinds = wh.profiles.select("symbol", fs.stock_type("sector", "industry").alias("kind"))
    return wh.income_statement.join(kinds, "symbol").select("symbol", "period", "fiscal_date", r2(fs.net_revenue("revenue", "raw", "kind"), "net_revenue"))


@query("f12_peg_label", """
select symbol, fiscal_date, case when peg_ratio < 0.5 then 'deeply_undervalued' when peg_ratio < 1 then 'undervalued' when peg_ratio < 1.5 then 'fairly_priced'
  when peg_ratio is not null then 'overvalued' end as label from {financial_ratios} where period = 'FY'""")
def f12_peg_label(wh):
    return wh.financial_ratios.filter("period = 'FY'").select("symbol", "fiscal_date", fs.peg_label("peg_ratio").alias("label"))


@query("f13_spec_hash", "select distinct sector, sha256(concat(trim(sector), '|', 'above_sma[200]')) as spec_hash from {profiles} where sector is not null")
def f13_spec_hash(wh):
    sectors = wh.profiles.filter("sector is not null").select("sector").distinct()
    return sectors.select("sector", fs.spec_hash(F.concat(F.lit(" "), "sector", F.lit(" ")), F.lit("above_sma[200] ")).alias("spec_hash"))


@query("f15_excerpt", "select symbol, year, quarter, nullif(substr(content, 1, 2000), '') as excerpt from {transcripts}")
def f15_excerpt(wh):
    return wh.transcripts.select("symbol", "year", "quarter", fs.excerpt("content").alias("excerpt"))


@query("f1_coercions", """
select e.event_id, try_cast(x as double) as as_double, cast(trunc(try_cast(x as double)) as bigint) as as_long, try_cast(substr(d, 1, 10) as date) as as_date,
  try_cast(t as timestamp) as as_timestamp from (
  select event_id, case when event_type = 'error' then 'n/a' when event_type = 'view' then '' when event_id % 5 = 1 then concat(cast(event_id as varchar), '.75') when event_id % 5 = 2 then concat('-', cast(event_id as varchar), '.0')
      when event_id % 5 = 3 then concat(cast(event_id as varchar), 'e2') else cast(event_id as varchar) end as x,
    case when event_type = 'error' then 'soon' else cast(cast(ts as date) as varchar) end as d,
    case when event_type = 'error' then 'soon' when event_id % 2 = 0 then cast(cast(ts as date) as varchar) else concat(cast(cast(ts as date) as varchar), ' 12:34:56') end as t from {events}) e""")
def f1_coercions(wh):
    number, day = F.col("event_id").cast("string"), F.to_date("ts").cast("string")
    error, turn = F.col("event_type") == "error", F.col("event_id") % 5
    text = F.when(error, "n/a").when(F.col("event_type") == "view", "").when(turn == 1, F.concat(number, F.lit(".75"))).when(turn == 2, F.concat(F.lit("-"), number, F.lit(".0")))
    text = text.when(turn == 3, F.concat(number, F.lit("e2"))).otherwise(number)
    time = F.when(error, "soon").when(F.col("event_id") % 2 == 0, day).otherwise(F.concat(day, F.lit(" 12:34:56")))
    df = wh.events.select("event_id", text.alias("x"), F.when(error, "soon").otherwise(day).alias("d"), time.alias("t"))
    return df.select("event_id", fs.as_double("x").alias("as_double"), fs.as_long("x").alias("as_long"), fs.as_date("d").alias("as_date"), fs.as_timestamp("t").alias("as_timestamp"))
