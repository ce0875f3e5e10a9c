"""Queries of valuation and company research."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from equilake.functions.scores import PIOTROSKI_LEGS
from equilake.plans import research, valuation
from equilake.queries.registry import BASE, query, r2, r4, r6, s2, s4, s6
from equilake.queries.windows import _MACD, _RSI

AS_OF = dt.date(1999, 6, 30)


def _newest(table: str) -> str:
    return f"(select * from (select *, row_number() over (partition by symbol order by fiscal_date desc) as rn from {{{table}}} where period = 'FY') z where rn = 1)"


_HIST = """select symbol, list(free_cash_flow order by fiscal_date) filter (where free_cash_flow is not null) as h from (
  select *, row_number() over (partition by symbol order by fiscal_date desc) as rn from {cash_flow} where period = 'FY') x where rn <= 5 group by symbol"""
_BASE = """select symbol, h, list_aggregate(list_slice(h, greatest(len(h) - 2, 1), len(h)), 'median') as base,
  case when len(h) >= 2 and h[1] > 0 and h[len(h)] > 0 then greatest(-0.10, least(0.20, pow(h[len(h)] / h[1], 1.0 / (len(h) - 1)) - 1)) end as hg from {hist}"""
_FWD = """select symbol, case when n >= 2 and e0 > 0 and e1 > 0 then pow(e1 / e0, 365.25 / days) - 1 end as fg from (
  select symbol, count(*) as n, min_by(eps_avg, fiscal_date) as e0, max_by(eps_avg, fiscal_date) as e1, nullif(max(fiscal_date) - min(fiscal_date), 0) as days
  from (select *, row_number() over (partition by symbol order by fiscal_date) as rn from {analyst_estimates}
        where period = 'FY' and fiscal_date >= date '1999-06-30' and eps_avg is not null) x where rn <= 3 group by symbol) y"""
_EG = """select symbol, case when count(*) >= 2 and min_by(net_income, fiscal_date) > 0 and max_by(net_income, fiscal_date) > 0
    then pow(max_by(net_income, fiscal_date) / min_by(net_income, fiscal_date), 1.0 / (count(*) - 1)) - 1 end as eg
  from (select *, row_number() over (partition by symbol order by fiscal_date desc) as rn from {income_statement} where period = 'FY') x
  where rn <= 5 and net_income is not null group by symbol"""
_CAP = "coalesce(cast(json_extract_string(p.raw, '$.mktCap') as double), cast(json_extract_string(p.raw, '$.marketCap') as double))"
_IN = f"""select p.symbol, p.sector, p.industry, {_CAP} as cap, c.close as price, b.h, b.base, b.hg, f.fg, e.eg, i.eps_diluted, r.pe_ratio,
  coalesce(case when {_CAP} > 0 and cast(json_extract_string(p.raw, '$.price') as double) > 0 then {_CAP} / cast(json_extract_string(p.raw, '$.price') as double) end,
           i.net_income / nullif(i.eps_diluted, 0)) as shares,
  case when l.short_term_debt + l.long_term_debt <> 0 or l.cash_and_equivalents <> 0 then l.short_term_debt + l.long_term_debt - l.cash_and_equivalents end as debt,
  i.operating_income + abs(k.capital_expenditure) as ebitda,
  i.revenue - case when p.industry = 'Banks - Regional' then cast(json_extract_string(i.raw, '$.interestExpense') as double) else 0 end as rev,
  0.045 + coalesce(2.0 / 3.0 * p.beta + 1.0 / 3.0, 1.0) * 0.055 as wacc
from {{profiles}} p left join {_newest('income_statement')} i on p.symbol = i.symbol left join {_newest('balance_sheet')} l on p.symbol = l.symbol
left join {_newest('cash_flow')} k on p.symbol = k.symbol left join {_newest('financial_ratios')} r on p.symbol = r.symbol
left join {{base}} b on p.symbol = b.symbol left join {{fwd}} f on p.symbol = f.symbol left join {{eg}} e on p.symbol = e.symbol
left join (select symbol, max_by(close, trade_date) as close from {{daily_prices}} group by symbol) c on p.symbol = c.symbol"""


def _fair(g: str, w: str = "wacc", t: str = "0.025") -> str:
    flows = " + ".join(f"base * pow(1 + {g}, {i}) / pow(1 + {w}, {i})" for i in range(1, 6))
    end = f"base * pow(1 + {g}, 5) * (1 + {t}) / ({w} - {t}) / pow(1 + {w}, 5)"
    return f"case when {w} > {t} and base > 0 and shares > 0 then (({flows}) + {end} - coalesce(debt, 0)) / shares end"


_G = "coalesce(fg, hg, 0.04)"
_MED = """select p.sector, median(pe) as pe, median(ev) as ev, median(ps) as ps from {profiles} p join (
  select symbol, max_by(pe_ratio, case when pe_ratio is not null then fiscal_date end) as pe, max_by(ev_to_ebitda, case when ev_to_ebitda is not null then fiscal_date end) as ev,
    max_by(price_to_sales, case when price_to_sales is not null then fiscal_date end) as ps from {financial_ratios} where period = 'FY' group by symbol) r
  on p.symbol = r.symbol where p.sector is not null group by p.sector"""
_MULT = """select symbol, sector, price, cap, pp, ev, ps, (coalesce(case when pp > 0 then pp end, 0) + coalesce(case when ev > 0 then ev end, 0) + coalesce(case when ps > 0 then ps end, 0))
    / nullif((case when pp > 0 then 1 else 0 end) + (case when ev > 0 then 1 else 0 end) + (case when ps > 0 then 1 else 0 end), 0) as fv from (
  select v.symbol, v.sector, v.price, v.cap, m.pe * v.eps_diluted as pp,
    case when v.sector in ('Financial Services', 'Real Estate') then null else (m.ev * v.ebitda - coalesce(v.debt, 0)) / nullif(v.shares, 0) end as ev,
    m.ps * v.rev / nullif(v.shares, 0) as ps from {vin} v left join {med} m on v.sector = m.sector) q"""
_PEG = """select symbol, pe_ratio, g, case when pe_ratio is not null and g > 0 then pe_ratio / (g * 100) end as peg,
  case when pe_ratio is not null and g > 0 then g * 100 * eps_diluted end as fv from (select *, coalesce(fg, eg) as g from {vin}) x"""
_X = {"hist": _HIST, "base": _BASE, "fwd": _FWD, "eg": _EG, "vin": _IN}
_ALL = {**_X, "med": _MED, "mult": _MULT, "pegs": _PEG}


def _inputs(wh):
    return valuation.valuation_inputs(wh, AS_OF)


def _resolved(wh):
    return valuation.with_assumptions(_inputs(wh))


@query("v1_fcf_history", "select symbol, cast(len(h) as int) as points, " + s2("h[1]", "oldest") + ", " + s2("h[len(h)]", "newest") + " from {hist}", {"hist": _HIST})
def v1_fcf_history(wh):
    df = valuation.fcf_history(wh.cash_flow)
    return df.select("symbol", F.size("history").alias("points"), r2(F.try_element_at("history", F.lit(1)), "oldest"), r2(F.try_element_at("history", F.lit(-1)), "newest"))


@query("v2_base_fcf", f"select symbol, {s2('base', 'base_fcf')} from {{base}}", {"hist": _HIST, "base": _BASE})
def v2_base_fcf(wh):
    return valuation.fcf_history(wh.cash_flow).select("symbol", r2(valuation.base_fcf(), "base_fcf"))


@query("v3_fcf_cagr", f"select symbol, {s6('hg', 'growth')} from {{base}}", {"hist": _HIST, "base": _BASE})
def v3_fcf_cagr(wh):
    return valuation.fcf_history(wh.cash_flow).select("symbol", r6(valuation.fcf_cagr(), "growth"))


@query("v4_forward_eps_growth", f"select symbol, {s6('fg', 'forward_growth')} from {{fwd}}", {"fwd": _FWD})
def v4_forward_eps_growth(wh):
    return valuation.forward_eps_growth(wh.analyst_estimates, AS_OF).select("symbol", r6("forward_growth"))


@query("v5_earnings_growth", f"select symbol, {s6('eg', 'earnings_growth')} from {{eg}}", {"eg": _EG})
def v5_earnings_growth(wh):
    return valuation.earnings_growth(wh.income_statement).select("symbol", r6("earnings_growth"))


@query("v6_v9_inputs", f"""select symbol, {s2('shares', 'shares')}, {s2('debt', 'net_debt')}, {s2('ebitda', 'ebitda')}, {s2('rev', 'revenue_net')}, {s6('wacc', 'wacc')} from {{vin}}""", _X, share=BASE)
def v6_v9_inputs(wh):
    df = _resolved(wh)
    return df.select("symbol", r2("shares_out", "shares"), r2("debt", "net_debt"), r2("ebitda"), r2("revenue_net"), r6("a_wacc", "wacc"))


@query("v10_dcf", f"""
select symbol, {s4(_fair(_G), 'fair_value')}, case when fg is not null then 'forward_consensus' when hg is not null then 'historical_fcf_cagr' else 'default_fallback' end as growth_source
from {{vin}}""", _X, share=BASE)
def v10_dcf(wh):
    df = _resolved(wh).withColumn("d", valuation.dcf_for())
    return df.select("symbol", r4("d.fair_value", "fair_value"), "growth_source")


@query("v11_dcf_sensitivity", f"""
select symbol, cast(gi as int) as growth_index, cast(wi as int) as wacc_index, {s4(_fair('gx', 'wx'), 'fair_value')} from (
  select *, gi, wi, case gi when 0 then greatest(g - 0.04, -0.10) when 1 then greatest(g - 0.02, -0.10) when 2 then g when 3 then g + 0.02 else g + 0.04 end as gx,
    case wi when 0 then greatest(wacc - 0.02, 0.02) when 1 then greatest(wacc - 0.01, 0.02) when 2 then wacc when 3 then wacc + 0.01 else wacc + 0.02 end as wx
  from (select *, {_G} as g from {{vin}}) v cross join range(5) a(gi) cross join range(5) b(wi)) x where base > 0 and wacc > 0.025""", _X, share=BASE)
def v11_dcf_sensitivity(wh):
    df = valuation.dcf_sensitivity(_resolved(wh))
    return df.select("symbol", "growth_index", "wacc_index", r4("fair_value"))


@query("v12_implied_growth", f"""
select v.symbol, {s6('b.g', 'implied_growth')}, coalesce(v.price >= v.fh and v.price > v.fl, false) as implied_above, coalesce(v.price <= v.fl, false) as implied_below
from {{ends}} v left join (select symbol, g from {{bis}} where g is not null) b on v.symbol = b.symbol""", {
    **_X, "ends": f"select *, {_fair('-0.5')} as fl, {_fair('1.0')} as fh from {{vin}}",
    "bis": f"""select symbol, cast(-0.5 as double) as a, cast(1.0 as double) as b, 0 as it, cast(null as double) as g from {{ends}} where price > fl and price < fh
      union all
      select symbol, case when v < price then mid else a end, case when v < price then b else mid end, it + 1, case when abs(v - price) < 1e-4 * greatest(1.0, abs(price)) then mid end
      from (select x.*, {_fair('mid')} as v from (select r.symbol, r.a, r.b, r.it, (r.a + r.b) / 2 as mid, e.price, e.base, e.wacc, e.debt, e.shares
            from {{bis}} r join {{ends}} e on r.symbol = e.symbol where r.g is null and r.it < 100) x) y"""}, recursive=True, share=BASE)
def v12_implied_growth(wh):
    df = valuation.implied_growth(_resolved(wh))
    return df.select("symbol", r6("implied_growth"), "implied_above", "implied_below")


@query("v13_scenario_dcf", f"""
select symbol, {s4('lo', 'bear_value')}, {s4('mid', 'base_value')}, {s4('hi', 'bull_value')}, {s4('0.25 * lo + 0.5 * mid + 0.25 * hi', 'scenario_value')} from (
  select symbol, {_fair('(g - 0.04)')} as lo, {_fair('g')} as mid, {_fair('(g + 0.04)')} as hi from (select *, {_G} as g from {{vin}}) v where base > 0) x""", _X, share=BASE)
def v13_scenario_dcf(wh):
    df = valuation.scenario_dcf(_resolved(wh))
    return df.select("symbol", *[r4(c) for c in ("bear_value", "base_value", "bull_value", "scenario_value")])


@query("v14_peg", f"select symbol, {s6('g', 'growth_rate')}, {s4('peg', 'peg_ratio')}, {s4('fv', 'fair_value')} from {{pegs}}", {**_X, "pegs": _PEG}, share=BASE)
def v14_peg(wh):
    return valuation.peg(_inputs(wh)).select("symbol", r6("growth_rate"), r4("peg_ratio"), r4("fair_value"))


@query("v15_multiples", f"""select symbol, {s4('pp', 'pe_price')}, {s4('ev', 'ev_price')}, {s4('ps', 'ps_price')}, {s4('fv', 'fair_value')},
  {s6('fv / coalesce(nullif(price, 0), cap) - 1', 'upside')} from {{mult}}""", {**_X, "med": _MED, "mult": _MULT}, share=BASE)
def v15_multiples(wh):
    medians = valuation.peer_medians(wh.profiles, wh.financial_ratios, ["pe_ratio", "ev_to_ebitda", "price_to_sales"])
    df = valuation.multiples(_inputs(wh), medians)
    return df.select("symbol", *[r4(c) for c in ("pe_price", "ev_price", "ps_price", "fair_value")], r6("upside"))


@query("a2_peer_median", f"select sector, {s6('pe', 'median')} from {{med}}", {"med": _MED}, share=BASE)
def a2_peer_median(wh):
    return valuation.peer_median(wh.profiles, wh.financial_ratios, "pe_ratio").withColumn("median", r6("median"))


@query("v16_value_companies", f"""
select symbol, price as current_price, {s4('dv', 'dcf_value')}, {s4('pv', 'peg_value')}, {s4('mv', 'multiples_value')}, {s4('m', 'fair_value_mean')}, {s4('m / nullif(price, 0) - 1', 'upside_mean')}
from (select *, (coalesce(dv, 0) + coalesce(pv, 0) + coalesce(mv, 0)) / nullif((case when dv is null then 0 else 1 end) + (case when pv is null then 0 else 1 end)
        + (case when mv is null then 0 else 1 end), 0) as m
      from (select v.symbol, v.price, {_fair(_G)} as dv, p.fv as pv, u.fv as mv from {{vin}} v left join {{pegs}} p on v.symbol = p.symbol left join {{mult}} u on v.symbol = u.symbol) x) y""", _ALL, share=BASE)
def v16_value_companies(wh):
    df = valuation.value_companies(wh, AS_OF)
    return df.select("symbol", "current_price", *[r4(c) for c in ("dcf_value", "peg_value", "multiples_value", "fair_value_mean", "upside_mean")])


@query("v16_overrides", f"""
select v.symbol, {s4(_fair('0.07').replace('wacc', 'w'), 'dcf_value')} from (select v.*, case when p.beta > 1.5 then 0.12 else v.wacc end as w from {{vin}} v join {{profiles}} p on v.symbol = p.symbol) v""", _X, share=BASE)
def v16_overrides(wh):
    overrides = wh.profiles.select("symbol", F.lit(0.07).alias("growth_rate"), F.when(F.col("beta") > 1.5, 0.12).alias("wacc"))
    return valuation.value_companies(wh, AS_OF, overrides, ["dcf"]).select("symbol", r4("dcf_value"))


# ----- research -------------------------------------------------------------------------------

_YEARS = f"""select f.symbol, f.y, f.rn, f.ni / 10000.0 as ni, f.rev / 100.0 as rev, (40 * f.rev - 10 * f.r) / 10000.0 as gp, (20 * f.rev - 10 * f.r) / 10000.0 as oi,
  (300 + (f.k + f.y) % 9) * f.rev / 10000.0 as ta, (f.rev + f.r) / 100.0 as tl, (2 * f.rev - f.r) / 100.0 as eq, f.r / 100.0 as ltd, f.o / 100.0 as ca, f.n / 100.0 as cl,
  case when f.k % 19 = 0 then null else (2 * f.rev - f.r) / 200.0 end as re, (f.ni + 5 * f.rev) / 10000.0 as cfo,
  case when f.k % 29 = 0 then null else (cast(f.ni as double) / 10000) / nullif(cast(f.ni as double) / 10000 / nullif(f.shares, 0), 0) end as sh, p.industry = 'Banks - Regional' as bank
from (select *, row_number() over (partition by symbol order by fiscal_date desc) as rn from {{fin}} where period = 'FY') f join {{profiles}} p on f.symbol = p.symbol where rn <= 2"""
_LEGS = {
    "roa_positive": "c.ni / nullif(c.ta, 0) > 0", "cfo_positive": "c.cfo > 0", "delta_roa": "c.ni / nullif(c.ta, 0) > p.ni / nullif(p.ta, 0)", "accruals": "c.cfo > c.ni",
    "delta_leverage": "c.ltd / nullif(c.ta, 0) < p.ltd / nullif(p.ta, 0)", "delta_liquidity": "c.ca / nullif(c.cl, 0) > p.ca / nullif(p.cl, 0)",
    "no_dilution": "c.sh <= p.sh", "delta_margin": "c.gp / nullif(c.rev, 0) > p.gp / nullif(p.rev, 0)", "delta_turnover": "c.rev / nullif(c.ta, 0) > p.rev / nullif(p.ta, 0)"}
_SCORE = " + ".join(f"coalesce(cast({n} as int), 0)" for n in PIOTROSKI_LEGS)


@query("f7_piotroski", f"""
select *, {_SCORE} as score from (
  select c.symbol, {', '.join(f"cast({_LEGS[n]} as int) as {n}" for n in PIOTROSKI_LEGS)}
  from {{yr}} c join {{yr}} p on c.symbol = p.symbol and c.rn = 1 and p.rn = 2 where not c.bank) x""", {"yr": _YEARS}, share=BASE)
def f7_piotroski(wh):
    """All nine legs and the score (a missing leg counts nothing)."""
    scores = research.scores_section(wh).filter("piotroski_f is not null").select("symbol", F.col("piotroski_f.components").alias("c"), F.col("piotroski_f.score").cast("int").alias("score"))
    return scores.select("symbol", *[F.col(f"c.{n}").alias(n) for n in PIOTROSKI_LEGS], "score")


@query("f8_altman", f"""
select symbol, {s6('z', 'z_score')}, case when z > 2.6 then 'safe' when z < 1.1 then 'distress' when z is not null then 'grey' end as zone from (
  select symbol, 6.56 * (ca - cl) / nullif(ta, 0) + 3.26 * re / nullif(ta, 0) + 6.72 * oi / nullif(ta, 0) + 1.05 * eq / nullif(tl, 0) as z from {{yr}} where rn = 1 and not bank) x""", {"yr": _YEARS}, share=BASE)
def f8_altman(wh):
    df = research.scores_section(wh).filter("template = 'general'")
    return df.select("symbol", r6("altman_z.z_score", "z_score"), F.col("altman_z.zone").alias("zone"))


@query("f9_quality_general", f"""
select c.symbol, {s6('r.return_on_invested_capital - (0.045 + coalesce(2.0 / 3.0 * p.beta + 1.0 / 3.0, 1.0) * 0.055)', 'roic_wacc_spread')},
  {s6('k.free_cash_flow / nullif(c.ni, 0)', 'fcf_conversion')}, {s6('(c.ni - c.cfo) / nullif(c.ta, 0)', 'accruals_ratio')}
from {{yr}} c join {{profiles}} p on c.symbol = p.symbol join {_newest('financial_ratios')} r on c.symbol = r.symbol join {_newest('cash_flow')} k on c.symbol = k.symbol
where c.rn = 1 and not c.bank""", {"yr": _YEARS}, share=BASE)
def f9_quality_general(wh):
    df = research.quality_section(wh).filter("template = 'general'")
    return df.select("symbol", r6("roic_wacc_spread"), r6("fcf_conversion"), r6("accruals_ratio"))


@query("f10_quality_bank", f"""
select c.symbol, {s6('c.ni / nullif(c.ta, 0)', 'roa')}, {s6('c.ni / nullif(c.eq, 0)', 'roe')},
  {s6("cast(json_extract_string(i.raw, '$.netInterestIncome') as double) / nullif((c.ta + p.ta) / 2, 0)", 'net_interest_margin')},
  {s6("cast(json_extract_string(i.raw, '$.operatingExpenses') as double) / nullif(cast(json_extract_string(i.raw, '$.netInterestIncome') as double) + c.rev - cast(json_extract_string(i.raw, '$.interestIncome') as double), 0)", 'efficiency_ratio')},
  {s6('c.eq / nullif(c.ta, 0)', 'equity_to_assets')}
from {{yr}} c join {{yr}} p on c.symbol = p.symbol and p.rn = 2 join {_newest('income_statement')} i on c.symbol = i.symbol where c.rn = 1 and c.bank""", {"yr": _YEARS}, share=BASE)
def f10_quality_bank(wh):
    df = research.quality_section(wh).filter("template = 'bank'")
    return df.select("symbol", *[r6(c) for c in ("roa", "roe", "net_interest_margin", "efficiency_ratio", "equity_to_assets")])


@query("r2_quality_trends", f"""
select symbol, cast(count(*) as bigint) as n, {s6('max_by(gm, fiscal_date) - min_by(gm, fiscal_date)', 'gross_margin_change')} from (
  select i.symbol, i.fiscal_date, i.gross_profit / nullif(i.revenue, 0) as gm, row_number() over (partition by i.symbol order by i.fiscal_date desc) as rn
  from {{income_statement}} i join {{profiles}} p on i.symbol = p.symbol where i.period = 'FY' and p.industry <> 'Banks - Regional') x
where rn <= 6 and gm is not null group by symbol having count(*) >= 2""", share=BASE)
def r2_quality_trends(wh):
    df = research.quality_section(wh).filter("gross_margin_trend is not null")
    return df.select("symbol", F.col("gross_margin_trend.n").alias("n"), r6("gross_margin_trend.change", "gross_margin_change"))


@query("r2_scores_section", f"""
select p.symbol, case when coalesce(c.bank, p.industry = 'Banks - Regional', false) then 'bank' else 'general' end as template, case when not c.bank then c.y end as fiscal_year, case when not c.bank then q.y end as prior_fiscal_year,
  case when not c.bank and q.y is not null then cast({' + '.join(f"coalesce(cast({_LEGS[n].replace('p.', 'q.')} as int), 0)" for n in PIOTROSKI_LEGS)} as int) end as piotroski,
  case when not c.bank then {s6('6.56 * (c.ca - c.cl) / nullif(c.ta, 0) + 3.26 * c.re / nullif(c.ta, 0) + 6.72 * c.oi / nullif(c.ta, 0) + 1.05 * c.eq / nullif(c.tl, 0)')} end as altman,
  case when coalesce(c.bank, p.industry = 'Banks - Regional', false) then 'piotroski_f,altman_z' end as not_applicable
from {{profiles}} p left join {{yr}} c on p.symbol = c.symbol and c.rn = 1 left join {{yr}} q on p.symbol = q.symbol and q.rn = 2
where c.symbol is not null or coalesce(p.industry = 'Banks - Regional', false)""", {"yr": _YEARS}, share=BASE)
def r2_scores_section(wh):
    df = research.scores_section(wh)
    return df.select(
        "symbol", "template", F.col("fiscal_year").cast("int").alias("fiscal_year"), F.col("prior_fiscal_year").cast("int").alias("prior_fiscal_year"), F.col("piotroski_f.score").cast("int").alias("piotroski"),
        r6("altman_z.z_score", "altman"), F.array_join("not_applicable", ",").alias("not_applicable"))


@query("a4_insider_summary", """
select symbol, cast(count(*) as bigint) as transactions, cast(sum(case when code = 'P' then 1 else 0 end) as bigint) as open_market_buys,
  cast(sum(case when code = 'S' then 1 else 0 end) as bigint) as open_market_sells, coalesce(sum(case when code = 'P' then shares end), 0) as buy_shares,
  coalesce(sum(case when code = 'S' then shares end), 0) as sell_shares,
  coalesce(sum(case when code = 'P' then value end), 0) - coalesce(sum(case when code = 'S' then value end), 0) as net_open_market_value, max(filing_date) as last_filing_date
from {insider_transactions} where transaction_date >= date '2024-01-31' - 20 group by symbol""")
def a4_insider_summary(wh):
    return research.insider_summary(wh.insider_transactions, dt.date(2024, 1, 31), 20)


@query("a4_insider_recent", """
select symbol, accession_no, transaction_date, rn from (
  select *, cast(row_number() over (partition by symbol order by transaction_date desc, accession_no, line_no) as int) as rn from {insider_transactions}
  where transaction_date >= date '2024-01-31' - 180) x where rn <= 8""")
def a4_insider_recent(wh):
    return research.insider_recent(wh.insider_transactions, dt.date(2024, 1, 31)).select("symbol", "accession_no", "transaction_date", "rn")


@query("j6_earnings_surprise", f"""
select i.symbol, i.period, i.fiscal_date, e.symbol is not null as estimate_available, {s6('(coalesce(i.eps_diluted, i.eps) - e.eps_avg) / nullif(abs(e.eps_avg), 0) * 100', 'eps_surprise_pct')},
  {s6("(i.revenue - case when p.industry = 'Banks - Regional' then cast(json_extract_string(i.raw, '$.interestExpense') as double) else 0 end - e.revenue_avg) / nullif(abs(e.revenue_avg), 0) * 100", 'revenue_surprise_pct')}
from (select *, row_number() over (partition by symbol order by fiscal_date desc, period) as rn from {{income_statement}}) i
join {{profiles}} p on i.symbol = p.symbol left join {{analyst_estimates}} e on i.symbol = e.symbol and i.period = e.period and i.fiscal_date = e.fiscal_date where rn <= 4""", share=BASE)
def j6_earnings_surprise(wh):
    df = research.earnings_surprise(wh.income_statement, wh.analyst_estimates, wh.profiles)
    return df.select("symbol", "period", "fiscal_date", "estimate_available", r6("eps_surprise_pct"), r6("revenue_surprise_pct"))


@query("r3_earnings_read", """
select i.symbol, cast(count(*) as bigint) as periods_found, cast(count(e.symbol) as bigint) as estimates_matched, cast(max(d.c) as int) as thesis_count
from (select *, row_number() over (partition by symbol order by fiscal_date desc, period) as rn from {income_statement}) i
left join {analyst_estimates} e on i.symbol = e.symbol and i.period = e.period and i.fiscal_date = e.fiscal_date
left join (select symbol, least(count(*), 5) as c from {decision_base} group by symbol) d on i.symbol = d.symbol where rn <= 4 group by i.symbol""", share=BASE)
def r3_earnings_read(wh):
    from equilake.queries.portfolios import decisions

    df = research.earnings_read(wh, decisions(wh))
    return df.select("symbol", "periods_found", "estimates_matched", "thesis_count")


# The last 252 bars of a symbol with all indicators from the first of them; recurrences walk the bars by number.
_SNAP_W = "over (partition by symbol order by i"
_SNAP_WALK = {
    "last": """select symbol, trade_date, coalesce(adj_close, close) as px, coalesce(cast(volume as double), 0) as vol, adj_close is not null as adj, age, n, n - age + 1 as i from (
      select *, row_number() over (partition by symbol order by trade_date desc) as age, least(count(*) over (partition by symbol), 252) as n from {daily_prices}) a where age <= 252 and n >= 50""",
    "num": f"select symbol, trade_date, px as close, i, lag(px) {_SNAP_W}) as pc from {{last}}",
    **{k: v for k, v in {**_MACD, **_RSI}.items() if k != "num"},
    "snap": f"""select *, lag(s20) {_SNAP_W}) as p20, lag(s50) {_SNAP_W}) as p50, lag(s200) {_SNAP_W}) as p200, lag(line) {_SNAP_W}) as pline, lag(sig) {_SNAP_W}) as psig, min(trade_date) over (partition by symbol, pk) as pkd,
        max(px) over (partition by symbol) as hi, min(px) over (partition by symbol) as lo, (px - pk) / pk as dd from (
      select b.*, l.v as line, s.e as sig, case when w.l = 0 then case when w.g > 0 then 100 else 50 end else 100 - 100 / (1 + w.g / nullif(w.l, 0)) end as rsi from (
        select *, case when i >= 20 then avg(px) {_SNAP_W} rows 19 preceding) end as s20, case when i >= 50 then avg(px) {_SNAP_W} rows 49 preceding) end as s50,
          case when i >= 200 then avg(px) {_SNAP_W} rows 199 preceding) end as s200, case when i >= 20 then avg(vol) {_SNAP_W} rows 19 preceding) end as av, max(px) {_SNAP_W}) as pk from {{last}}) b
      left join {{line}} l on b.symbol = l.symbol and b.i = l.i + 25 left join {{ema9}} s on b.symbol = s.symbol and b.i = s.i + 25 left join {{wilder}} w on b.symbol = w.symbol and b.i = w.i) x"""}
_UP, _DOWN = "p{0} <= p{1} and s{0} > s{1}", "p{0} >= p{1} and s{0} < s{1}"
_SNAPSHOT = {**_SNAP_WALK, "shot": f"""select symbol, max(n) as n, min(trade_date) as oldest, max(trade_date) as latest, bool_or(adj) as adj, max(px) filter (where age = 1) as px, max(px) filter (where age = 127) as p6, max(px) filter (where age = n) as p12,
    max(hi) as hi, min(trade_date) filter (where px = hi) as hid, max(lo) as lo, min(trade_date) filter (where px = lo) as lod, min(dd) as dd, arg_min(pkd, (dd, trade_date)) as ddp, arg_min(trade_date, (dd, trade_date)) as ddt,
    max(s20) filter (where age = 1) as s20, max(s50) filter (where age = 1) as s50, max(s200) filter (where age = 1) as s200, max(rsi) filter (where age = 1) as rsi, max(line) filter (where age = 1) as line, max(sig) filter (where age = 1) as sig,
    max(av) filter (where age = 1) as av, max(vol) filter (where age = 1) as vol, max(trade_date) filter (where {_UP.format(50, 200)}) as golden, max(trade_date) filter (where {_DOWN.format(50, 200)}) as death,
    max(trade_date) filter (where age <= 60 and {_UP.format(20, 50)}) as up2050, max(trade_date) filter (where age <= 60 and {_DOWN.format(20, 50)}) as down2050, max(trade_date) filter (where age <= 60 and pline <= psig and line > sig) as gm,
    max(trade_date) filter (where age <= 60 and pline >= psig and line < sig) as dm, coalesce(string_agg(cast(trade_date as varchar), ' ' order by trade_date) filter (where age <= 60 and rsi < 30), '') as sold,
    coalesce(string_agg(cast(trade_date as varchar), ' ' order by trade_date) filter (where age <= 60 and rsi > 70), '') as bought,
    coalesce(string_agg(cast(trade_date as varchar) || ':' || cast(cast(vol as bigint) as varchar), ' ' order by trade_date) filter (where age <= 30 and i > 20 and av <> 0 and vol > 2 * av), '') as spikes from {{snap}} group by symbol"""}
_ZONE = "case when rsi is null then 'unknown' when rsi < 30 then 'oversold' when rsi > 70 then 'overbought' else 'neutral' end"
_LABELS = f"""case when s20 > s50 and s50 > s200 then 'up' when s20 < s50 and s50 < s200 then 'down' else 'mixed' end as trend_bias, {_ZONE} as momentum_bias,
  case when line > sig and line - sig > 0 then 'bullish' when line < sig and line - sig < 0 then 'bearish' else 'neutral' end as macd_bias,
  case when (px / nullif(hi, 0) - 1) * 100 > -5 then 'near_high' when (px / nullif(lo, 0) - 1) * 100 < 5 then 'near_low' else 'none' end as near_52w_extreme"""
_VS = {f"price_vs_sma{k}_pct": f"(px / nullif(s{k}, 0) - 1) * 100" for k in (20, 50, 200)}
_UP_WINS = "up2050 is not null and (down2050 is null or up2050 >= down2050)"


@query("w16_technical_snapshot", f"""
select symbol, cast(n as int) as bars, oldest as oldest_trade_date, latest as latest_trade_date, adj as adj_close_used, {s4('px', 'latest_close')}, {s4('(px / nullif(p6, 0) - 1) * 100', 'return_6m_pct')}, {s4('(px / nullif(p12, 0) - 1) * 100', 'return_1y_pct')},
  {s4('hi', 'high_52w')}, hid as high_52w_date, {s4('lo', 'low_52w')}, lod as low_52w_date, {s4('(px / hi - 1) * 100', 'pct_below_52w_high')}, {s4('(px / lo - 1) * 100', 'pct_above_52w_low')},
  {s4('case when dd * 100 < -1e-9 then dd * 100 else 0 end', 'max_drawdown_pct')}, case when dd * 100 < -1e-9 then ddp end as max_drawdown_peak_date, case when dd * 100 < -1e-9 then ddt end as max_drawdown_trough_date,
  {', '.join(s6(f's{k}', f'sma{k}') for k in (20, 50, 200))}, {', '.join(s4(v, k) for k, v in _VS.items())}, golden as last_golden_cross_50_200, death as last_death_cross_50_200,
  case when {_UP_WINS} then up2050 else down2050 end as last_cross_date, case when {_UP_WINS} then 'up' when down2050 is not null then 'down' end as last_cross_direction,
  {s4('rsi', 'rsi14_latest')}, {_ZONE} as rsi14_zone, sold as oversold_days, bought as overbought_days, {s6('line', 'line')}, {s6('sig', 'signal')}, {s6('line - sig', 'histogram')}, gm as last_golden_cross_60d, dm as last_death_cross_60d,
  {s4('av', 'avg_volume_20d')}, cast(vol as bigint) as latest_volume, {s4('vol / nullif(av, 0)', 'latest_vs_avg')}, spikes as spike_days, {_LABELS} from {{shot}}""", _SNAPSHOT, recursive=True)
def w16_technical_snapshot(wh):
    """Every field of every section; lists of days as text."""
    df = research.technical_snapshot(wh.daily_prices).filter("not insufficient_data")
    days = lambda c: F.array_join(F.transform(c, lambda d: d.cast("string")), " ")
    spikes = F.array_join(F.transform("volume.spike_days", lambda d: F.concat_ws(":", d["trade_date"].cast("string"), d["volume"].cast("string"))), " ")
    return df.select(
        "symbol", "bars", "oldest_trade_date", "latest_trade_date", "adj_close_used",
        *[r4(f"price_action.{c}", c) for c in ("latest_close", "return_6m_pct", "return_1y_pct", "high_52w", "low_52w", "pct_below_52w_high", "pct_above_52w_low", "max_drawdown_pct")],
        *[f"price_action.{c}" for c in ("high_52w_date", "low_52w_date", "max_drawdown_peak_date", "max_drawdown_trough_date")],
        *[r6(f"trend.sma{k}", f"sma{k}") for k in (20, 50, 200)], *[r4(f"trend.{k}", k) for k in _VS], "trend.last_golden_cross_50_200", "trend.last_death_cross_50_200",
        F.col("trend.last_cross_20_50.date").alias("last_cross_date"), F.col("trend.last_cross_20_50.direction").alias("last_cross_direction"),
        r4("momentum.rsi14_latest", "rsi14_latest"), "momentum.rsi14_zone", days("momentum.oversold_days").alias("oversold_days"), days("momentum.overbought_days").alias("overbought_days"),
        *[r6(f"macd.{c}", c) for c in ("line", "signal", "histogram")], "macd.last_golden_cross_60d", "macd.last_death_cross_60d",
        r4("volume.avg_volume_20d", "avg_volume_20d"), "volume.latest_volume", r4("volume.latest_vs_avg", "latest_vs_avg"), spikes.alias("spike_days"), "signal_summary.*")


@query("f11_bias_labels", f"select symbol, {_LABELS} from {{shot}}", _SNAPSHOT, recursive=True)
def f11_bias_labels(wh):
    return research.technical_snapshot(wh.daily_prices).filter("not insufficient_data").select("symbol", "signal_summary.*")


@query("w17_ratio_history", """
select symbol, cast(count(*) as int) as years, cast(count(pe_ratio) as int) as pe_points from (
  select *, row_number() over (partition by symbol order by fiscal_date desc) as rn from {financial_ratios} where period = 'FY') x where rn <= 10 group by symbol""")
def w17_ratio_history(wh):
    df = research.ratio_history(wh.financial_ratios)
    pe = F.filter(F.transform("multiples", lambda m: m["pe_ratio"]), lambda v: v.isNotNull())
    return df.select("symbol", F.size("multiples").alias("years"), F.size(pe).alias("pe_points"))


def _top(table: str, order: str, n: int, text: str, where: str = "true", agg: str | None = None) -> str:
    """(symbol, c, t) as SQL: how many of the first n rows there are, and their text in order."""
    return f"""(select symbol, cast(count(*) as int) as c, string_agg({text}, ' ' order by {agg or order}) as t
      from (select *, row_number() over (partition by symbol order by {order}) as rn from {{{table}}} where {where}) z where rn <= {n} group by symbol)"""


def _cents(c: str) -> str:
    return f"cast(cast(floor({c} * 100 + 0.50013) as bigint) as varchar)"


_BY_PERIOD = "fiscal_date desc, period"


@query("r1_research_bundles", f"""
select u.symbol, p.company_name, p.sector, p.industry, px.trade_date as price_date, {s4('px.close', 'latest_close')}, ra.fiscal_date as ratio_date, {s4('ra.pe_ratio', 'pe_ratio')}, {s6('ra.return_on_equity', 'return_on_equity')},
  i.t as income, b.t as balance, k.t as cash, e.t as forward, v.t as valuations, h.c as history_years, least(px.n, 252) as technical_bars, tx.n as insider_transactions, tr.t as insider_recent,
  sh.settlement_date as short_date, {s2('sh.short_interest', 'short_interest')}, n.t as news, t.year as transcript_year, t.quarter as transcript_quarter
from {{universe}} u left join {{profiles}} p on u.symbol = p.symbol
left join (select symbol, max(trade_date) as trade_date, max_by(close, trade_date) as close, cast(count(*) as int) as n from {{daily_prices}} group by symbol) px on u.symbol = px.symbol
left join {_newest('financial_ratios')} ra on u.symbol = ra.symbol
left join {_top('income_statement', _BY_PERIOD, 5, f"concat_ws(':', period, cast(fiscal_date as varchar), {_cents('revenue')})")} i on u.symbol = i.symbol
left join {_top('balance_sheet', _BY_PERIOD, 5, f"concat_ws(':', period, cast(fiscal_date as varchar), {_cents('total_assets')})")} b on u.symbol = b.symbol
left join {_top('cash_flow', _BY_PERIOD, 5, f"concat_ws(':', period, cast(fiscal_date as varchar), {_cents('free_cash_flow')})")} k on u.symbol = k.symbol
left join {_top('analyst_estimates', 'fiscal_date, period', 4, f"concat_ws(':', period, cast(fiscal_date as varchar), {_cents('eps_avg')})", "fiscal_date >= date '1999-06-30'")} e on u.symbol = e.symbol
left join (select symbol, string_agg(concat_ws(':', model_type, cast(as_of as varchar), {_cents('fair_value_per_share')}), ' ' order by model_type) as t from (
  select *, row_number() over (partition by symbol, model_type order by created_at desc) as rn from {{valuation_snapshots}}) z where rn = 1 group by symbol) v on u.symbol = v.symbol
left join (select symbol, cast(least(count(*), 10) as int) as c from {{financial_ratios}} where period = 'FY' group by symbol) h on u.symbol = h.symbol
left join (select symbol, cast(count(*) as bigint) as n from {{insider_transactions}} where transaction_date >= date '1999-06-30' - 180 group by symbol) tx on u.symbol = tx.symbol
left join {_top('insider_transactions', 'transaction_date desc, accession_no, line_no', 8, "concat_ws(':', cast(transaction_date as varchar), code)", "transaction_date >= date '1999-06-30' - 180")} tr on u.symbol = tr.symbol
left join (select * from (select *, row_number() over (partition by symbol order by settlement_date desc) as rn from {{short_interest}}) z where rn = 1) sh on u.symbol = sh.symbol
left join {_top('news_items', 'published_at desc, url', 10, "url")} n on u.symbol = n.symbol
left join (select * from (select *, row_number() over (partition by symbol order by year desc, quarter desc) as rn from {{transcripts}}) z where rn = 1) t on u.symbol = t.symbol""", share=BASE)
def r1_research_bundles(wh):
    """Sections with their values, lists as text; the technical, score and quality sections are compared in full under w16, r2 and f7-f10."""
    df = research.research_bundles(wh, AS_OF)

    def text(column: str, *fields: str, cents: str | None = None):
        last = lambda x: [F.floor(x[cents] * 100 + 0.50013).cast("bigint").cast("string")] if cents else []
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields], *last(x))), " ")

    return df.select(
        "symbol", "profile.company_name", "profile.sector", "profile.industry", F.col("latest_price.trade_date").alias("price_date"), r4("latest_price.close", "latest_close"), F.col("ratios_latest_annual.fiscal_date").alias("ratio_date"),
        r4("ratios_latest_annual.pe_ratio", "pe_ratio"), r6("ratios_latest_annual.return_on_equity", "return_on_equity"), text("income_statement_recent", "period", "fiscal_date", cents="revenue").alias("income"),
        text("balance_sheet_recent", "period", "fiscal_date", cents="total_assets").alias("balance"), text("cash_flow_recent", "period", "fiscal_date", cents="free_cash_flow").alias("cash"),
        text("estimates_forward", "period", "fiscal_date", cents="eps_avg").alias("forward"), text("valuation_snapshots", "model_type", "as_of", cents="fair_value_per_share").alias("valuations"),
        F.size("ratio_history.multiples").alias("history_years"), F.col("technical.bars").alias("technical_bars"), F.col("insider.transactions").alias("insider_transactions"),
        text("insider.recent", "transaction_date", "code").alias("insider_recent"), F.col("short_interest.settlement_date").alias("short_date"), r2("short_interest.short_interest", "short_interest"), text("news", "url").alias("news"),
        F.col("transcript.year").alias("transcript_year"), F.col("transcript.quarter").alias("transcript_quarter"))


@query("r1_bundle_holdings", """
select symbol, account_id, as_of_date, quantity from (select *, row_number() over (partition by account_id, symbol order by as_of_date desc) as rn
  from {holdings} where symbol in (select symbol from {universe})) x where rn = 1""")
def r1_bundle_holdings(wh):
    return research.bundle_holdings(wh).select("symbol", "account_id", "as_of_date", "quantity")
