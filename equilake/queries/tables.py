"""Queries of ingestion, table maintenance, calendars and stream replays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from equilake.operators import upsert as up
from equilake.queries.registry import query, r2, r6, s2, s6
from equilake.sources import bars as sb
from equilake.sources import vendor
from equilake.streaming import jobs

_J = "json_extract_string(raw, '$.{0}')"


@query("i6_map_profiles", f"""
select symbol, {_J.format('companyName')} as company_name, {_J.format('sector')} as sector, {_J.format('industry')} as industry,
  coalesce(nullif({_J.format('exchangeShortName')}, ''), {_J.format('exchange')}) as exchange, cast({_J.format('beta')} as double) as beta,
  cast({_J.format('ipoDate')} as date) as ipo_date, cast({_J.format('isAdr')} as boolean) as is_adr from {{raw_profiles}}""")
def i6_map_profiles(wh):
    return vendor.map_profiles(wh.raw_profiles).select("symbol", "company_name", "sector", "industry", "exchange", "beta", "ipo_date", "is_adr")


@query("i7_map_prices", """
select p.symbol, p.trade_date, p.close, coalesce(case when p.volume % 2 = 0 then nullif(p.close, 0) end, p.adj_close) as adj_close, p.volume from {daily_prices} p""")
def i7_map_prices(wh):
    text = {c: F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")}
    full = wh.daily_prices.select("symbol", F.col("trade_date").cast("string").alias("date"), *text.values(), F.when(F.col("volume") % 2 == 0, F.col("close").cast("string")).alias("adjClose"))
    adjusted = wh.daily_prices.select("symbol", F.col("trade_date").cast("string").alias("date"), F.col("adj_close").cast("string").alias("adjClose"))
    return vendor.map_prices(full, adjusted).select("symbol", "trade_date", "close", "adj_close", "volume")


def _statement_json(wh):
    """Income rows as vendor payloads: an alias key for diluted EPS and no acceptance time where there is none."""
    return wh.income_statement.select("symbol", F.to_json(F.struct(
        "period", F.col("fiscal_date").cast("string").alias("date"), F.col("calendar_year").cast("string").alias("calendarYear"),
        F.col("reported_currency").alias("reportedCurrency"), "revenue", F.col("net_income").alias("netIncome"), F.lit(0.0).alias("epsdiluted"),
        F.col("eps_diluted").alias("epsDiluted"), F.when(F.col("net_income") > 0, F.date_format("known_at", "yyyy-MM-dd HH:mm:ss")).alias("acceptedDate"))).alias("raw"))


@query("i8_map_statements", f"""
select symbol, period, fiscal_date, calendar_year, {s2('revenue', 'revenue')}, {s2('net_income', 'net_income')}, {s6('eps_diluted', 'eps_diluted')}, cast(known_at as date) as known_on
from {{income_statement}} where net_income > 0""")
def i8_map_statements(wh):
    df = vendor.map_statements(_statement_json(wh), "income")
    return df.select("symbol", "period", "fiscal_date", "calendar_year", r2("revenue"), r2("net_income"), r6("eps_diluted"), F.to_date("known_at").alias("known_on"))


@query("i9_map_ratios", f"""
select symbol, period, fiscal_date, {s6('pe_ratio', 'pe_ratio')}, {s6('return_on_equity', 'return_on_equity')}, {s6('case when net_margin > 0.02 then fcf_yield else -1.5 end', 'fcf_yield')}
from {{financial_ratios}}""")
def i9_map_ratios(wh):
    date = F.col("fiscal_date").cast("string").alias("date")
    ratios = wh.financial_ratios.select("symbol", "period", F.to_json(F.struct(
        date, F.lit("").alias("priceToEarningsRatio"), F.col("pe_ratio").alias("peRatio"), F.when(F.col("net_margin") > 0.02, F.col("fcf_yield")).alias("freeCashFlowYield"))).alias("raw"))
    metrics = wh.financial_ratios.select("symbol", "period", F.to_json(F.struct(
        date, F.col("return_on_equity").alias("returnOnEquity"), F.lit(-1.5).alias("freeCashFlowYield"))).alias("raw"))
    return vendor.map_ratios(ratios, metrics).select("symbol", "period", "fiscal_date", r6("pe_ratio"), r6("return_on_equity"), r6("fcf_yield"))


@query("i10_map_estimates", f"""
select symbol, fiscal_date, case when period = 'FY' then 'FY' else 'Q' end as period, {s6('eps_avg', 'eps_avg')}, num_analysts_eps from {{analyst_estimates}}""")
def i10_map_estimates(wh):
    raw = wh.analyst_estimates.select("symbol", F.when(F.col("period") == "FY", "annual").otherwise("quarter").alias("request"), F.to_json(F.struct(
        F.col("fiscal_date").cast("string").alias("date"), F.col("eps_avg").alias("epsAvg"), F.col("num_analysts_eps").alias("numAnalystsEps"))).alias("raw"))
    return vendor.map_estimates(raw).select("symbol", "fiscal_date", "period", r6("eps_avg"), "num_analysts_eps")


@query("i11_map_transcripts", """
select concat('C', cast(conv_id as varchar)) as symbol, 2000 as year, 3 as quarter, date '2000-09-30' as call_date,
  nullif(string_agg(case when length(text) > 0 then concat(role, ' — Speaker: ', text) end, chr(10) || chr(10) order by turn, text), '') as content
from {conversations} group by conv_id""")
def i11_map_transcripts(wh):
    parts = F.sort_array(F.collect_list(F.struct("turn", "text", "role")))
    calls = wh.conversations.groupBy("conv_id").agg(parts.alias("p"))
    segments = F.transform("p", lambda t: F.struct(t["role"].alias("speaker"), F.lit("Speaker").alias("title"), t["text"].alias("content")))
    raw = calls.select(F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("symbol"), F.lit("2000Q3").alias("quarter_label"), segments.alias("segments"))
    return vendor.map_transcripts(raw)


@query("i12_map_insider", """
select symbol, cast(filing_date as varchar) as accession_no, cast(row_number() over (partition by symbol, filing_date order by cast(accession_no as bigint)) - 1 as int) as line_no, code, shares
from {insider_transactions} where filing_date >= date '2024-01-10'""")
def i12_map_insider(wh):
    line = F.struct(
        F.col("accession_no").cast("bigint").alias("n"), F.col("transaction_date").cast("string").alias("date"), "insider", "position", "transaction_type", "code", "shares", "price", "value", "remaining_shares")
    filings = wh.insider_transactions.groupBy("symbol", "filing_date").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    filings = filings.withColumn("accession_no", F.col("filing_date").cast("string"))
    return vendor.map_insider(filings, F.lit("2024-01-10").cast("date")).select("symbol", "accession_no", "line_no", "code", "shares")


@query("i13_map_news", "select symbol, published_at as p, url, headline from {news_items} where length(url) > 10")
def i13_map_news(wh):
    raw = wh.news_items.select(F.to_json(F.struct(
        "symbol", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("publishedDate"), F.when(F.length("url") > 10, F.col("url")).alias("url"),
        F.lit("").alias("title"), "headline")).alias("raw"))
    return vendor.map_news(raw).select("symbol", F.col("published_at").cast("timestamp_ntz").alias("p"), "url", "headline")


@query("i14_map_trades", f"""
select account_id, ib_exec_id, symbol, trade_date, side, quantity, {s6('price', 'price')} from {{trades}} where symbol <> 'S0000000003'""")
def i14_map_trades(wh):
    t = wh.trades
    names = {
        "accountId": "account_id", "ibExecID": "ib_exec_id", "tradeID": "trade_id", "conid": "conid", "buySell": "side", "quantity": "quantity", "tradePrice": "price",
        "dateTime": "executed_at", "currency": "currency"}
    have = [F.col(v).cast("string").alias(k) for k, v in names.items()]
    empty = [F.lit(None).cast("string").alias(k) for k in (
        "assetCategory", "subCategory", "description", "proceeds", "netCash", "ibCommission", "fifoPnlRealized", "openCloseIndicator", "orderReference", "exchange", "fxRateToBase", "notes", "code")]
    raw = t.select(
        *have, F.when(F.col("symbol") == "S0000000003", F.lit(" ")).otherwise(F.col("symbol")).alias("symbol"), F.date_format("trade_date", "yyyyMMdd").alias("tradeDate"), *empty)
    valid, _rejected = vendor.map_trades(raw)
    return valid.select("account_id", "ib_exec_id", "symbol", "trade_date", "side", "quantity", r6("price"))


# ----- maintenance ----------------------------------------------------------------------------


def _stored(wh):
    return wh.daily_prices.filter("trade_date <= date '1999-06-30'")


def _incoming(wh):
    """Bars of 1999 onward, restated by 1, some without an adjusted close."""
    adj = F.when(F.col("volume") % 3 != 0, F.col("adj_close") + 1).alias("adj_close")
    return wh.daily_prices.filter("trade_date >= date '1999-01-01'").select(
        "symbol", "trade_date", "open", "high", "low", (F.col("close") + 1).alias("close"), adj, "volume", F.lit("2002-01-01").cast("timestamp").alias("known_at"))


_K = {
    "old": "select * from {daily_prices} where trade_date <= date '1999-06-30'",
    "inc": """select symbol, trade_date, close + 1 as close, case when volume % 3 <> 0 then adj_close + 1 end as adj_close, timestamp '2002-01-01' as known_at
      from {daily_prices} where trade_date >= date '1999-01-01'"""}


@query("k1_insert_if_absent", """
select symbol, trade_date, close from {old} union all
select symbol, trade_date, close from {inc} i where not exists (select 1 from {old} o where o.symbol = i.symbol and o.trade_date = i.trade_date)""", _K)
def k1_insert_if_absent(wh):
    return up.insert_if_absent(_stored(wh), _incoming(wh), ["symbol", "trade_date"]).select("symbol", "trade_date", "close")


@query("k1_insert_outcome", """
select i.symbol, cast(count(*) filter (where o.symbol is null) as bigint) as added, cast(count(*) filter (where o.symbol is not null) as bigint) as skipped
from {inc} i left join {old} o on o.symbol = i.symbol and o.trade_date = i.trade_date group by i.symbol""", _K)
def k1_insert_outcome(wh):
    return up.insert_outcome(_stored(wh), _incoming(wh), ["symbol", "trade_date"])


@query("k2_upsert", """
select symbol, trade_date, close from {inc} union all
select symbol, trade_date, close from {old} o where not exists (select 1 from {inc} i where o.symbol = i.symbol and o.trade_date = i.trade_date)""", _K)
def k2_upsert(wh):
    return up.upsert(_stored(wh), _incoming(wh), ["symbol", "trade_date"]).select("symbol", "trade_date", "close")


_HEAL = """select coalesce(o.symbol, i.symbol) as symbol, coalesce(o.trade_date, i.trade_date) as trade_date,
  case when i.symbol is null then 'keep' when o.symbol is null then 'insert' when o.trade_date >= f.fl then 'heal' else 'skip' end as action,
  o.close as oc, i.close as ic, o.adj_close as oa, i.adj_close as ia, coalesce(o.known_at, i.known_at) as known_at
from {old} o full join {inc} i on o.symbol = i.symbol and o.trade_date = i.trade_date
left join (select symbol, max(trade_date) - 7 as fl from {old} group by symbol) f on coalesce(o.symbol, i.symbol) = f.symbol"""


@query("k3_heal_prices", """
select symbol, trade_date, case when action in ('insert', 'heal') then ic else oc end as close, case when action in ('insert', 'heal') then coalesce(ia, oa) else oa end as adj_close,
  cast(known_at as date) as known_on from {h}""", {**_K, "h": _HEAL})
def k3_heal_prices(wh):
    state, _ = up.heal_prices(_stored(wh), _incoming(wh))
    return state.select("symbol", "trade_date", "close", "adj_close", F.to_date("known_at").alias("known_on"))


@query("k3_heal_outcome", """
select symbol, cast(count(*) filter (where action in ('insert', 'heal')) as bigint) as upserted, cast(count(*) filter (where action = 'skip') as bigint) as skipped
from {h} where action <> 'keep' group by symbol""", {**_K, "h": _HEAL})
def k3_heal_outcome(wh):
    return up.heal_outcome(up.heal_prices(_stored(wh), _incoming(wh))[1])


@query("k4_replace_table", """
select coalesce(u.symbol, t.symbol) as symbol, case when u.symbol is null then 'added' when t.symbol is null then 'removed' else 'kept' end as status, t.symbol is not null and s.symbol is null as is_new_security
from {universe} u full join (select symbol from {profile_base} where bal >= 2000 or bal < 0) t on u.symbol = t.symbol left join {securities} s on coalesce(u.symbol, t.symbol) = s.symbol""")
def k4_replace_table(wh):
    target = wh.profile_base.filter("bal >= 2000 or bal < 0").select("symbol")
    return up.replace_table(wh.universe, wh.securities, target)["diff"]


@query("k5_insert_news", "select symbol, cast(published_at as date) as day, url, cast(count(*) as bigint) as n from (select distinct symbol, published_at, url from {news_items}) x group by all")
def k5_insert_news(wh):
    news = wh.news_items.drop("event_id")
    stored = news.filter("published_at < timestamp '2024-01-15'")
    out = up.insert_news(stored, news.unionByName(news))
    return out.groupBy("symbol", F.to_date("published_at").alias("day"), "url").agg(F.count(F.lit(1)).alias("n"))


@query("k6_append_run", "select symbol, 'screen' as kind, '1m' as horizon, sha256(concat('roe > 0', '|', 'above_sma[200]')) as expr_hash, true as one_run, true as dated from {universe}")
def k6_append_run(wh):
    """The id and the time of a run are drawn, so only their being one each is compared."""
    df = up.append_run(wh.universe.select("symbol"), "screen", {"horizon": "1m"}, "roe > 0", "above_sma[200]")
    every = Window.partitionBy("kind")
    one = (F.min("run_id").over(every) == F.max("run_id").over(every)) & (F.length("run_id") == 36)
    return df.select("symbol", "kind", F.col("params")["horizon"].alias("horizon"), "expr_hash", one.alias("one_run"), (F.to_date("ran_at") == F.col("run_date")).alias("dated"))


@query("k7_clean_doubles", "select symbol, fiscal_date, period, case when net_income > 0 and eps_diluted is not null then eps_diluted end as v from {income_statement}")
def k7_clean_doubles(wh):
    bad = F.when(F.col("net_income") > 0, F.col("eps_diluted")).when(F.col("net_income") < 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return up.clean_doubles(wh.income_statement.select("symbol", "fiscal_date", "period", bad.alias("v")))


_DAYS = "select distinct trade_date as today from {daily_prices}"


@query("k8_settlement_dates", """
select distinct today, settlement_date from (
  select today, case dayofweek(s) when 0 then s - 2 when 6 then s - 1 else s end as settlement_date from (
    select today, unnest([cast(m + interval 14 day as date), last_day(m)]) as s from (
      select today, unnest(generate_series(date_trunc('month', today) - interval 5 month, date_trunc('month', today), interval 1 month)) as m from {days}) a) b) c where settlement_date <= today""", {"days": _DAYS})
def k8_settlement_dates(wh):
    days = wh.daily_prices.select(F.col("trade_date").alias("today")).distinct()
    return sb.recent_settlement_dates(days, 6)


@query("k9_recent_quarters", """
select today, cast(age as int) as age, concat(cast(year(q) as varchar), 'Q', cast(quarter(q) as varchar)) as quarter_label from (
  select today, age, date_trunc('quarter', today) - to_months(cast(3 * age as integer)) as q from {days} cross join range(4) r(age)) x""", {"days": _DAYS})
def k9_recent_quarters(wh):
    return sb.recent_quarters(wh.daily_prices.select(F.col("trade_date").alias("today")).distinct(), 4)


@query("a17_refresh_summary", """
select case when event_type in ('view', 'click') then 'news' else 'insider' end as scope, cast(count(*) filter (where value >= 5) as bigint) as ok, cast(count(*) filter (where value < 5) as bigint) as failed,
  cast(sum(case when value >= 5 then 1 else 0 end) as bigint) as upserted, cast(count(*) filter (where user_id > 75) as bigint) as skipped from {events} group by 1""")
def a17_refresh_summary(wh):
    outcomes = wh.events.select(
        F.when(F.col("event_type").isin("view", "click"), "news").otherwise("insider").alias("scope"), (F.col("value") >= 5).cast("int").alias("upserted"),
        (F.col("user_id") > 75).cast("int").alias("skipped"), F.when(F.col("value") < 5, "vendor error").alias("error"))
    return up.refresh_summary(outcomes)


# ----- stream replays -------------------------------------------------------------------------


def _ticks(wh):
    return wh.events.select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1).alias("volume"))


@query("s3_stream_bars", """
select cast(user_id as varchar) as symbol, cast(date_trunc('hour', ts) as timestamp) as bar_start, min_by(value, (ts, value)) as open, max(value) as high, min(value) as low, max_by(value, (ts, value)) as close,
  cast(count(*) as bigint) as volume from {events} group by 1, 2""")
def s3_stream_bars(wh):
    df = jobs.bars_from_ticks(_ticks(wh), "1 hour")
    return df.select("symbol", F.col("bar_start").cast("timestamp_ntz").alias("bar_start"), "open", "high", "low", "close", "volume")


@query("s3_session_bars", """
select symbol, min(ts) as bar_start, max(price) as high, min(price) as low, cast(count(*) as bigint) as volume from (
  select *, sum(brk) over (partition by symbol order by ts, price) as g from (
    select cast(user_id as varchar) as symbol, ts, value as price, case when ts - lag(ts) over (partition by user_id order by ts, value) < interval 6 hour then 0 else 1 end as brk from {events}) a) b group by symbol, g""")
def s3_session_bars(wh):
    df = jobs.session_bars(_ticks(wh), "6 hours")
    return df.select("symbol", F.col("bar_start").cast("timestamp_ntz").alias("bar_start"), "high", "low", "volume")


@query("s5_freshness_view", "select event_type as scope, cast(user_id as varchar) as symbol, max(ts) as latest from {events} group by 1, 2")
def s5_freshness_view(wh):
    df = wh.events.select(F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("symbol"), "ts")
    return jobs.stream_freshness(df)


_SG = """select event_id as signal_id, cast(user_id as varchar) as symbol, case when value < 20 then 'buy' else 'sell' end as direction,
  case when value < 20 then value + 15 else value - 15 end as target_price, case when value < 20 then value - 4 else value + 20 end as stop_loss, ts as created_at, ts + interval 36 hour as expires_at
  from {events} where event_type = 'signup'"""


@query("s4_signal_monitor", """
select s.signal_id, case when h.k = 0 then 'stopped_out' when h.k = 1 then 'target_hit' when c.clock > s.expires_at then 'expired' else 'open' end as status
from {sg} s left join (select signal_id, arg_min(k, (ts, k)) as k from (
  select s.signal_id, e.ts, case when case when direction = 'buy' then value <= stop_loss else value >= stop_loss end then 0 else 1 end as k from {sg} s
  join {events} e on s.symbol = cast(e.user_id as varchar) and e.ts between s.created_at and s.expires_at
  where case when direction = 'buy' then value <= stop_loss or value >= target_price else value >= stop_loss or value <= target_price end) x group by signal_id) h on s.signal_id = h.signal_id
left join (select cast(user_id as varchar) as symbol, max(ts) as clock from {events} group by 1) c on s.symbol = c.symbol""", {"sg": _SG})
def s4_signal_monitor(wh):
    cheap = F.col("value") < 20
    ts = F.col("ts").cast("timestamp")
    signals = wh.events.filter("event_type = 'signup'").select(
        F.col("event_id").alias("signal_id"), F.col("user_id").cast("string").alias("symbol"), F.when(cheap, "buy").otherwise("sell").alias("direction"),
        F.when(cheap, F.col("value") + 15).otherwise(F.col("value") - 15).alias("target_price"), F.when(cheap, F.col("value") - 4).otherwise(F.col("value") + 20).alias("stop_loss"),
        ts.alias("created_at"), (ts + F.expr("interval 36 hours")).alias("expires_at"), F.lit("open").alias("status"), F.lit(None).cast("timestamp").alias("closed_at"))
    return jobs.resolve_signals(signals, _ticks(wh).select("symbol", "ts", "price")).select("signal_id", "status")
