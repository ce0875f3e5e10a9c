"""The warehouse tables, derived from a TPC-H-like star schema.

Every table is one SELECT in the common subset of Spark SQL and ANSI SQL; ``{name}`` refers to
another table of this module or to a source table. Money enters as integer cents so that sums do
not depend on the order of rows, and every division has a ``nullif`` denominator.

At scale these SELECTs are what a nightly job would materialise (see ``Warehouse.materialize``):
all heavy steps are two-phase aggregations over ``lineitem`` keyed by (supplier, date), and the
windows that follow see at most one row per symbol and calendar day.
"""

from __future__ import annotations

import string

SOURCE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _sym(key: str) -> str:
    return f"concat('S', lpad(cast({key} as string), 10, '0'))"


def _cents(col: str) -> str:
    return f"cast(floor({col} * 100 + 0.5) as bigint)"


_SECTORS = (
    "Technology", "Financial Services", "Healthcare", "Energy", "Consumer Cyclical",
    "Consumer Defensive", "Industrials", "Communication Services", "Utilities",
    "Real Estate", "Basic Materials",
)
_SECTOR_ETFS = ("XLK", "XLF", "XLV", "XLE", "XLY", "XLP", "XLI", "XLC", "XLU", "XLRE", "XLB")

_SECTOR_CASE = (
    "case when s_acctbal < 0 then null "
    + " ".join(f"when s_nationkey % 11 = {i} then '{s}'" for i, s in enumerate(_SECTORS))
    + " end"
)
_ETF_CASE = (
    "case " + " ".join(f"when sector = '{s}' then '{e}'" for s, e in zip(_SECTORS, _SECTOR_ETFS)) + " end"
)

TABLES: dict[str, str] = {}

# ----- prices ---------------------------------------------------------------------------------

TABLES["px_daily"] = f"""
select {_sym('l_suppkey')} as symbol, l_suppkey as k, cast(l_shipdate as date) as d,
       sum({_cents('l_extendedprice')}) as c, sum(cast(l_quantity as bigint)) as q
from {{lineitem}} group by l_suppkey, cast(l_shipdate as date)
"""

TABLES["px_walk"] = """
select symbol, k, d, q, m, lag(m) over (partition by symbol order by d) as pm
from (select symbol, k, d, q,
             cast(sum(c % 2001 - 1000) over (partition by symbol order by d) + 100000 as bigint) as m
      from {px_daily}) w
"""

TABLES["daily_prices"] = """
select symbol, d as trade_date,
       cast(coalesce(pm, m) as double) / 1000 as open,
       cast(greatest(m, coalesce(pm, m)) + 10 * (q % 50) as double) / 1000 as high,
       cast(least(m, coalesce(pm, m)) - 10 * (q % 37) as double) / 1000 as low,
       cast(m as double) / 1000 as close,
       case when k % 10 = 0 and month(d) = 1 then cast(null as double)
            when k % 4 = 0 and d < date '1998-01-01' then cast(m as double) / 2000
            else cast(m as double) / 1000 end as adj_close,
       cast(q as bigint) as volume,
       cast(d as timestamp) as known_at
from {px_walk}
"""

# Market and sector series: one row per calendar day each.
TABLES["etf_prices"] = f"""
select symbol, d as trade_date,
       cast(coalesce(pm, m) as double) / 1000 as open,
       cast(greatest(m, coalesce(pm, m)) + 100 as double) / 1000 as high,
       cast(least(m, coalesce(pm, m)) - 100 as double) / 1000 as low,
       cast(m as double) / 1000 as close, cast(m as double) / 1000 as adj_close,
       cast(q as bigint) as volume, cast(d as timestamp) as known_at
from (select symbol, d, q, m, lag(m) over (partition by symbol order by d) as pm
      from (select symbol, d, q,
                   cast(sum(c % 2001 - 1000) over (partition by symbol order by d) + 200000 as bigint) as m
            from (select 'SPY' as symbol, d, sum(c) as c, sum(q) as q from {{px_daily}} group by d
                  union all
                  select symbol, d, sum(c) as c, sum(q) as q
                  from (select {_ETF_CASE} as symbol, b.d, b.c, b.q
                        from {{px_daily}} b join {{profile_base}} p on b.k = p.k
                        where p.sector is not null) s
                  group by symbol, d) u) w) v
"""

TABLES["all_prices"] = """
select * from {daily_prices} union all select * from {etf_prices}
"""

# Last close per fiscal year and quarter.
TABLES["px_period"] = """
select symbol, k, y, 'FY' as period, max_by(m, d) as m from
  (select symbol, k, year(d) as y, d, m from {px_walk}) a group by symbol, k, y
union all
select symbol, k, y, concat('Q', cast(qtr as string)) as period, max_by(m, d) as m from
  (select symbol, k, year(d) as y, quarter(d) as qtr, d, m from {px_walk}) b group by symbol, k, y, qtr
"""

# ----- reference data -------------------------------------------------------------------------

TABLES["profile_base"] = f"""
select s_suppkey as k, {_sym('s_suppkey')} as symbol, s_name as name, s_acctbal as bal, s_nationkey as nk,
       {_SECTOR_CASE} as sector
from {{supplier}}
"""

TABLES["universe"] = """
select symbol, 'watchlist' as source, timestamp '2001-12-01 00:00:00' as added_at
from {profile_base} where bal >= 500
"""

TABLES["securities"] = """
select symbol, bal >= 0 as is_active, timestamp '1995-01-01 00:00:00' as first_seen_at
from {profile_base} where bal < 9000
"""

TABLES["raw_profiles"] = """
select p.symbol,
       concat('{{"companyName":"', p.name, '","sector":',
              case when p.sector is null then 'null' else concat('"', p.sector, '"') end,
              ',"industry":"', case when p.sector = 'Financial Services' and p.k % 2 = 0
                                    then 'Banks - Regional' else concat('Industry ', cast(p.k % 40 as string)) end,
              '","exchangeShortName":', case when p.k % 5 = 0 then '""' else '"NYSE"' end,
              ',"exchange":"New York","currency":"USD","country":"', n.n_name,
              '","beta":', case when p.k % 17 = 0 then 'null' else cast((50 + p.k % 20 * 10) as string) end,
              ',"ipoDate":"199', cast(p.k % 10 as string), '-03-01","isEtf":false,"isFund":false,"isAdr":',
              case when p.k % 6 = 0 then 'true' else 'false' end,
              ',"isActivelyTrading":', case when p.bal >= 0 then 'true' else 'false' end,
              ',"', case when p.k % 3 = 0 then 'marketCap' else 'mktCap' end, '":',
              cast(x.m * (20000 + 200 * (p.k % 7)) as string),
              case when p.k % 9 = 0 then '' else concat(',"price":', cast(x.m as string)) end,
              '}}') as raw
from {profile_base} p join {nation} n on p.nk = n.n_nationkey
left join (select k, max_by(m, d) as m from {px_walk} group by k) x on p.k = x.k
"""

TABLES["profiles"] = """
select p.symbol, p.name as company_name, p.sector,
       case when p.sector = 'Financial Services' and p.k % 2 = 0 then 'Banks - Regional'
            else concat('Industry ', cast(p.k % 40 as string)) end as industry,
       'NYSE' as exchange, 'USD' as currency, n.n_name as country,
       case when p.k % 17 = 0 then cast(null as double) else cast(50 + p.k % 20 * 10 as double) / 100 end as beta,
       cast(concat('199', cast(p.k % 10 as string), '-03-01') as date) as ipo_date,
       false as is_etf, false as is_fund, p.k % 6 = 0 as is_adr, p.bal >= 0 as is_actively_trading,
       concat('{{"', case when p.k % 3 = 0 then 'marketCap' else 'mktCap' end, '":',
              cast(x.m * (20000 + 200 * (p.k % 7)) as string),
              case when p.k % 9 = 0 then '' else concat(',"price":', cast(x.m as string)) end, '}}') as raw,
       case when p.k % 8 = 0 then timestamp '2001-09-30 00:00:00' else timestamp '2001-12-15 00:00:00' end as known_at
from {profile_base} p join {nation} n on p.nk = n.n_nationkey
left join (select k, max_by(m, d) as m from {px_walk} group by k) x on p.k = x.k
"""

# ----- statements -----------------------------------------------------------------------------

TABLES["fin_quarter"] = f"""
select l_suppkey as k, year(l_shipdate) as y, quarter(l_shipdate) as qtr,
       sum({_cents('l_extendedprice')}) as rev,
       sum({_cents('l_extendedprice')} * ({_cents('l_discount')} + {_cents('l_tax')} - 8)) as ni,
       sum(case when l_returnflag = 'R' then {_cents('l_extendedprice')} else 0 end) as r,
       sum(case when l_returnflag = 'A' then {_cents('l_extendedprice')} else 0 end) as a,
       sum(case when l_returnflag = 'N' then {_cents('l_extendedprice')} else 0 end) as n,
       sum(case when l_linestatus = 'O' then {_cents('l_extendedprice')} else 0 end) as o
from {{lineitem}} group by l_suppkey, year(l_shipdate), quarter(l_shipdate)
"""

TABLES["fin"] = f"""
select {_sym('k')} as symbol, k, y, period, fiscal_date, cast(rev as bigint) as rev, cast(ni as bigint) as ni,
       cast(r as bigint) as r, cast(a as bigint) as a, cast(n as bigint) as n, cast(o as bigint) as o,
       20000 + 200 * (k % 7) + 20 * (y - 1995) * ((k % 3) - 1) as shares,
       cast(fiscal_date + cast(case when (k + y) % 11 = 0 then 400 else 40 + k % 50 end as int) as timestamp) as known_at
from (select k, y, 'FY' as period, make_date(y, 12, 31) as fiscal_date,
             sum(rev) as rev, sum(ni) as ni, sum(r) as r, sum(a) as a, sum(n) as n, sum(o) as o
      from {{fin_quarter}} group by k, y
      union all
      select k, y, concat('Q', cast(qtr as string)) as period,
             last_day(make_date(y, cast(qtr * 3 as int), 1)) as fiscal_date, rev, ni, r, a, n, o
      from {{fin_quarter}}) f
"""

TABLES["income_statement"] = """
select symbol, period, fiscal_date, cast(y as int) as calendar_year, 'USD' as reported_currency,
       cast(rev as double) / 100 as revenue,
       cast(60 * rev + 10 * r as double) / 10000 as cost_of_revenue,
       cast(40 * rev - 10 * r as double) / 10000 as gross_profit,
       cast(20 * rev - 10 * r as double) / 10000 as operating_income,
       cast(ni as double) / 10000 as net_income,
       cast(ni as double) / 10000 / nullif(shares - 100, 0) as eps,
       case when k % 29 = 0 then cast(null as double)
            else cast(ni as double) / 10000 / nullif(shares, 0) end as eps_diluted,
       concat('{{"interestExpense":', cast(cast(floor(a / 400) as bigint) as string),
              case when k % 4 = 0 then '' else concat(',"interestIncome":', cast(cast(floor(n / 100) as bigint) as string)) end,
              ',"netInterestIncome":', cast(cast(floor((4 * n - a) / 400) as bigint) as string),
              ',"operatingExpenses":', cast(cast(floor(r / 100) as bigint) as string), '}}') as raw,
       known_at
from {fin}
"""

TABLES["balance_sheet"] = """
select symbol, period, fiscal_date, cast(y as int) as calendar_year, 'USD' as reported_currency,
       cast((300 + (k + y) % 9) * rev as double) / 10000 as total_assets,
       cast(rev + r as double) / 100 as total_liabilities,
       cast(2 * rev - r as double) / 100 as total_equity,
       cast(4 * o as double) / 1000 as cash_and_equivalents,
       cast(3 * a as double) / 1000 as short_term_debt,
       cast(r as double) / 100 as long_term_debt,
       case when k % 19 = 0 then cast(null as double) else cast(2 * rev - r as double) / 200 end as retained_earnings,
       cast(o as double) / 100 as current_assets,
       cast(n as double) / 100 as current_liabilities,
       '{{}}' as raw, known_at
from {fin}
"""

TABLES["cash_flow"] = """
select symbol, period, fiscal_date, cast(y as int) as calendar_year, 'USD' as reported_currency,
       cast(ni + 5 * rev as double) / 10000 as operating_cash_flow,
       cast(-5 * a as double) / 10000 as investing_cash_flow,
       cast(-1 * n as double) / 10000 as financing_cash_flow,
       cast(-5 * a as double) / 10000 as capital_expenditure,
       case when (k + y) % 23 = 0 then cast(null as double)
            else cast(ni + 5 * rev - 5 * a as double) / 10000 end as free_cash_flow,
       cast(null as double) as dividends_paid,
       '{{}}' as raw, known_at
from {fin}
"""

TABLES["ratio_base"] = """
select f.*, cast(p.m as double) / 1000 as px, cast(f.ni as double) / 10000 / nullif(f.shares, 0) as eps_,
       cast(p.m as double) / 1000 * f.shares as mcap,
       cast(2 * f.rev - f.r as double) / 100 as equity,
       cast(3 * f.a as double) / 1000 + cast(f.r as double) / 100 as debt,
       cast(4 * f.o as double) / 1000 as cash_,
       cast(20 * f.rev - 10 * f.r as double) / 10000 as opinc,
       cast(5 * f.a as double) / 10000 as capex_
from {fin} f left join {px_period} p on f.k = p.k and f.y = p.y and f.period = p.period
"""

TABLES["financial_ratios"] = """
select symbol, period, fiscal_date,
       case when (k + y) % 31 = 0 then cast(null as double) else px / nullif(eps_, 0) end as pe_ratio,
       px / nullif(eps_, 0) / cast(k % 20 + 5 as double) as peg_ratio,
       mcap / nullif(equity, 0) as price_to_book,
       mcap / nullif(cast(rev as double) / 100, 0) as price_to_sales,
       (mcap + debt - cash_) / nullif(opinc + capex_, 0) as ev_to_ebitda,
       (mcap + debt - cash_) / nullif(cast(rev as double) / 100, 0) as ev_to_sales,
       cast(o as double) / nullif(cast(n as double), 0) as current_ratio,
       debt / nullif(equity, 0) as debt_to_equity,
       cast(ni as double) / 10000 / nullif(equity, 0) as return_on_equity,
       cast(ni as double) / 10000 / nullif(cast((300 + (k + y) % 9) * rev as double) / 10000, 0) as return_on_assets,
       opinc / nullif(equity + debt, 0) as return_on_invested_capital,
       cast(40 * rev - 10 * r as double) / nullif(cast(100 * rev as double), 0) as gross_margin,
       cast(20 * rev - 10 * r as double) / nullif(cast(100 * rev as double), 0) as operating_margin,
       cast(ni as double) / nullif(cast(100 * rev as double), 0) as net_margin,
       cast(ni + 5 * rev - 5 * a as double) / 10000 / nullif(mcap, 0) as fcf_yield,
       eps_ / nullif(px, 0) as earnings_yield,
       cast(null as double) as payout_ratio,
       '{{}}' as raw, timestamp '2001-12-31 00:00:00' as known_at
from {ratio_base}
"""

TABLES["analyst_estimates"] = """
select symbol, fiscal_date, period,
       cast(rev as double) * (95 + k % 7) / 10000 as revenue_avg,
       cast(rev as double) * (90 + k % 7) / 10000 as revenue_low,
       cast(rev as double) * (100 + k % 7) / 10000 as revenue_high,
       case when (k + y) % 9 = 0 then cast(null as double)
            else cast(ni as double) / 10000 / nullif(shares, 0) * (90 + 5 * (k % 5)) / 100 end as eps_avg,
       cast(ni as double) / 10000 / nullif(shares, 0) * (85 + 5 * (k % 5)) / 100 as eps_low,
       cast(ni as double) / 10000 / nullif(shares, 0) * (95 + 5 * (k % 5)) / 100 as eps_high,
       cast(25 * rev as double) / 10000 as ebitda_avg,
       cast(ni as double) / 10000 as net_income_avg,
       cast(2 + k % 9 as int) as num_analysts_revenue, cast(3 + k % 5 as int) as num_analysts_eps,
       '{{}}' as raw, cast(fiscal_date - 30 as timestamp) as known_at
from {fin}
"""

# ----- portfolio ------------------------------------------------------------------------------

TABLES["trades"] = f"""
select concat('C', cast(o.o_custkey % 50 as string)) as account_id,
       concat(cast(l_suppkey as string), '-', cast(cast(l_shipdate as date) as string), '-',
              cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string)) as ib_exec_id,
       cast(l_orderkey as string) as trade_id, {_sym('l_suppkey')} as symbol, l_suppkey as conid,
       'STK' as asset_category, cast(l_shipdate as date) as trade_date,
       cast(cast(l_shipdate as date) as string) as executed_at,
       case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side,
       case when l_returnflag = 'R' then -l_quantity else l_quantity end as quantity,
       l_extendedprice / nullif(l_quantity, 0) as price,
       -cast(1 + l_linenumber % 3 as double) as commission,
       {_cents('l_extendedprice')} as cents, 'USD' as currency, 'statement' as source
from {{lineitem}} l join {{orders}} o on l.l_orderkey = o.o_orderkey
"""

TABLES["trade_marks"] = """
select t.account_id, t.symbol, t.conid as k, t.trade_date as d, t.quantity, w.m, t.cents
from {trades} t join {px_walk} w on t.conid = w.k and t.trade_date = w.d
"""

TABLES["position_years"] = """
select account_id, symbol, k, y,
       sum(dq) over (partition by account_id, symbol order by y) as qty,
       sum(bm) over (partition by account_id, symbol order by y) as cost_m,
       sum(bq) over (partition by account_id, symbol order by y) as cost_q
from (select account_id, symbol, k, year(d) as y, sum(cast(quantity as bigint)) as dq,
             sum(case when quantity > 0 then m * cast(quantity as bigint) else 0 end) as bm,
             sum(case when quantity > 0 then cast(quantity as bigint) else 0 end) as bq
      from {trade_marks} group by account_id, symbol, k, year(d)) g
"""

TABLES["holdings"] = """
select h.account_id, h.symbol, make_date(h.y, 12, 31) as as_of_date,
       case when h.k % 25 = 0 then 'OPT' else 'STK' end as asset_category,
       cast(h.qty as double) as quantity,
       cast(p.m as double) / 1000 as mark_price,
       cast(h.qty as double) * cast(p.m as double) / 1000 * case when h.k % 25 = 0 then 100 else 1 end as market_value,
       cast(h.cost_m as double) / 1000 / nullif(cast(h.cost_q as double), 0) as avg_cost,
       case when h.k % 3 = 0 then cast(null as double)
            else cast(h.cost_m as double) / 1000 / nullif(cast(h.cost_q as double), 0) * cast(h.qty as double)
                 * case when h.k % 25 = 0 then 100 else 1 end end as cost_basis_total,
       case when h.k % 5 = 0 then cast(null as double)
            else (cast(p.m as double) / 1000 - cast(h.cost_m as double) / 1000 / nullif(cast(h.cost_q as double), 0))
                 * cast(h.qty as double) * case when h.k % 25 = 0 then 100 else 1 end end as unrealized_pnl,
       case when h.qty < 0 then 'Short' else 'Long' end as side,
       case when h.k % 10 = 7 then 'EUR' else 'USD' end as currency, 'statement' as source
from {position_years} h left join {px_period} p on h.k = p.k and h.y = p.y and p.period = 'FY'
union all
select account_id, 'CASH' as symbol, make_date(year(d), 12, 31) as as_of_date, 'CASH' as asset_category,
       cast(sum(cents) as double) / 1000 as quantity, cast(1 as double) as mark_price,
       cast(sum(cents) as double) / 1000 as market_value, cast(null as double) as avg_cost,
       cast(null as double) as cost_basis_total, cast(null as double) as unrealized_pnl,
       'Long' as side, 'USD' as currency, 'statement' as source
from {trade_marks} group by account_id, year(d)
"""

# One pass over the trades for everything that holdings need of them; stored by the queries that read it along several paths.
TABLES["account_years"] = """
select account_id, k, year(d) as y, sum(cast(quantity as bigint)) as dq,
       sum(case when quantity > 0 then m * cast(quantity as bigint) else 0 end) as bm,
       sum(case when quantity > 0 then cast(quantity as bigint) else 0 end) as bq, sum(cents) as cents
from {trade_marks} group by account_id, k, year(d)
"""

# The newest row of each (account, symbol) of ``holdings``, from totals instead of running sums whose earlier years nobody reads.
TABLES["current_holdings"] = f"""
select h.account_id, {_sym('h.k')} as symbol, make_date(h.y, 12, 31) as as_of_date,
       case when h.k % 25 = 0 then 'OPT' else 'STK' end as asset_category,
       cast(h.qty as double) as quantity,
       cast(p.m as double) / 1000 as mark_price,
       cast(h.qty as double) * cast(p.m as double) / 1000 * case when h.k % 25 = 0 then 100 else 1 end as market_value,
       cast(h.cost_m as double) / 1000 / nullif(cast(h.cost_q as double), 0) as avg_cost,
       case when h.k % 3 = 0 then cast(null as double)
            else cast(h.cost_m as double) / 1000 / nullif(cast(h.cost_q as double), 0) * cast(h.qty as double)
                 * case when h.k % 25 = 0 then 100 else 1 end end as cost_basis_total,
       case when h.k % 5 = 0 then cast(null as double)
            else (cast(p.m as double) / 1000 - cast(h.cost_m as double) / 1000 / nullif(cast(h.cost_q as double), 0))
                 * cast(h.qty as double) * case when h.k % 25 = 0 then 100 else 1 end end as unrealized_pnl,
       case when h.qty < 0 then 'Short' else 'Long' end as side,
       case when h.k % 10 = 7 then 'EUR' else 'USD' end as currency, 'statement' as source
from (select account_id, k, max(y) as y, sum(dq) as qty, sum(bm) as cost_m, sum(bq) as cost_q from {{account_years}} group by account_id, k) h
left join {{px_period}} p on h.k = p.k and h.y = p.y and p.period = 'FY'
union all
select account_id, 'CASH' as symbol, make_date(max(y), 12, 31) as as_of_date, 'CASH' as asset_category,
       cast(max_by(cents, y) as double) / 1000 as quantity, cast(1 as double) as mark_price,
       cast(max_by(cents, y) as double) / 1000 as market_value, cast(null as double) as avg_cost,
       cast(null as double) as cost_basis_total, cast(null as double) as unrealized_pnl,
       'Long' as side, 'USD' as currency, 'statement' as source
from (select account_id, y, sum(cents) as cents from {{account_years}} group by account_id, y) c group by account_id
"""

# ----- decisions, filings, text ---------------------------------------------------------------

TABLES["decision_base"] = f"""
select concat('D', cast(o_orderkey as string)) as decision_id,
       {_sym('(o_custkey % (select count(*) from {supplier}))')} as symbol,
       case when o_orderstatus = 'F' then 'sell' else 'buy' end as side,
       cast(o_orderdate as date) as opened_at,
       concat('priority ', o_orderpriority) as thesis,
       case when substr(o_orderpriority, 1, 1) = '3' then cast(null as int)
            else cast(substr(o_orderpriority, 1, 1) as int) end as confidence,
       case when o_orderstatus = 'P' then '' when o_orderstatus = 'O' then 'value' else 'value,growth' end as tag_list,
       cast(o_orderdate as timestamp) as created_at
from {{orders}}
"""

TABLES["insider_transactions"] = f"""
select {_sym('(user_id % (select count(*) from {supplier}))')} as symbol,
       cast(event_id as string) as accession_no, cast(0 as int) as line_no,
       cast(ts as date) + 2 as filing_date, cast(ts as date) as transaction_date,
       concat('insider ', cast(user_id as string)) as insider, 'Director' as position,
       event_type as transaction_type,
       case event_type when 'purchase' then 'P' when 'signup' then 'S' when 'view' then 'A'
                       when 'click' then 'M' else 'F' end as code,
       cast({_cents('value')} as double) as shares, cast(1.5 as double) as price,
       cast({_cents('value')} as double) * 1.5 as value, cast(null as double) as remaining_shares,
       cast(ts as timestamp) as known_at
from {{events}}
"""

TABLES["news_items"] = f"""
select {_sym('(user_id % (select count(*) from {supplier}))')} as symbol, cast(ts as timestamp) as published_at,
       concat('http://n/', cast(event_id % 1000 as string)) as url, concat(event_type, ' ', cast(event_id as string)) as headline,
       'wire' as source, props as summary, cast(null as string) as image_url, cast(ts as timestamp) as known_at, event_id
from {{events}} where event_type in ('view', 'click')
"""

TABLES["short_interest"] = """
select symbol, settlement_date, short_interest,
       lag(short_interest) over (partition by symbol order by settlement_date) as previous_short_interest,
       (short_interest / lag(short_interest) over (partition by symbol order by settlement_date) - 1) * 100 as change_pct,
       avg_daily_volume, short_interest / avg_daily_volume as days_to_cover, symbol as security_name,
       cast(settlement_date as timestamp) as known_at
from (select symbol, last_day(trade_date) as settlement_date, cast(sum(volume) as double) as short_interest,
             cast(sum(volume) as double) / count(*) as avg_daily_volume
      from {daily_prices} where volume > 0 group by symbol, last_day(trade_date)) s
"""

# Every document is the call of one (symbol, year, quarter): a symbol's documents are its calls, newest first.
TABLES["transcripts"] = f"""
select symbol, cast(2001 - floor(n / 4) as int) as year, cast(4 - n % 4 as int) as quarter,
       last_day(make_date(cast(2001 - floor(n / 4) as int), cast(12 - 3 * (n % 4) as int), 1)) as call_date,
       content, timestamp '2001-12-20 00:00:00' as known_at
from (select {_sym('(doc_id % (select count(*) from {supplier}))')} as symbol,
             cast(floor(doc_id / (select count(*) from {{supplier}})) as bigint) as n, text as content
      from {{documents}}) t
"""

TABLES["valuation_snapshots"] = """
select concat(symbol, '-', model_type, '-', cast(fiscal_date as string)) as snapshot_id, symbol, model_type,
       fiscal_date as as_of, eps_ * factor as fair_value_per_share, px as current_price,
       eps_ * factor / nullif(px, 0) - 1 as upside_pct, cast(fiscal_date as timestamp) as created_at
from (select symbol, fiscal_date, k, px, eps_, 'multiples' as model_type, cast(40 as double) as factor from {ratio_base} where period = 'FY'
      union all
      select symbol, fiscal_date, k, px, eps_, 'peg' as model_type, cast(35 as double) as factor from {ratio_base} where period = 'FY'
      union all
      select symbol, fiscal_date, k, px, eps_, 'dcf' as model_type, cast(45 as double) as factor from {ratio_base} where period = 'FY') v
"""


def _refs(text: str) -> list[str]:
    return [name for _, name, _, _ in string.Formatter().parse(text) if name]


def closure(names: list[str]) -> list[str]:
    """Bridge tables needed for ``names``, in dependency order."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out or name not in TABLES:
            return
        for ref in _refs(TABLES[name]):
            visit(ref)
        out.append(name)

    for name in names:
        visit(name)
    return out


def with_clause(sql: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Expand ``{name}`` references in ``sql`` into one WITH clause of plain ANSI SQL.

    ``extra`` adds query-local tables, in order; they may refer to bridge tables and to each other.
    """
    extra = extra or {}
    needed = closure([r for text in [*extra.values(), sql] for r in _refs(text)])
    names = {n: n for n in [*SOURCE_TABLES, *TABLES, *extra]}
    parts = [f"{n} as ({TABLES[n].format(**names).strip()})" for n in needed]
    parts += [f"{n} as ({text.format(**names).strip()})" for n, text in extra.items()]
    body = sql.format(**names).strip()
    if not parts:
        return body
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
