import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from equilake.functions import predicates as p
from equilake.functions import scalars as fs
from equilake.functions.predicates import ScreenError
from equilake.sources import bars as sb


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def test_coercions_never_fail(spark):
    assert one(spark, fs.as_double(F.lit("abc"))) is None
    assert one(spark, fs.as_double(F.lit("NaN"))) is None
    assert one(spark, fs.as_double(F.lit(" 1.5 "))) == 1.5
    assert one(spark, fs.as_long(F.lit("7"))) == 7
    assert one(spark, fs.as_date(F.lit("20240229"))) == dt.date(2024, 2, 29)
    assert one(spark, fs.as_date(F.lit("2024-02-30"))) is None
    assert one(spark, fs.as_timestamp(F.lit("2024-11-01T17:23:54+02:00")).cast("string")) == "2024-11-01 15:23:54"
    assert one(spark, fs.as_timestamp(F.lit("2024-11-01 17:23:54")).cast("string")) == "2024-11-01 17:23:54"
    assert one(spark, fs.as_timestamp(F.lit("later"))) is None


def test_guarded_ratios_keep_the_sign_of_the_numerator(spark):
    assert one(spark, fs.pct(F.lit(-5.0), F.lit(-100.0))) == -5.0
    assert one(spark, fs.pct(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, fs.surprise_pct(F.lit(-1.0), F.lit(-2.0))) == 50.0
    assert one(spark, fs.safe_return(F.lit(100.0), F.lit(90.0), -1.0)) == pytest.approx(0.1)
    assert one(spark, fs.safe_return(F.lit(0.0), F.lit(90.0))) is None


def test_rounding_has_no_largest_value(spark):
    rounded = lambda x: one(spark, fs.r_dec(F.lit(x), 4))
    assert rounded(8374559242195912.0) == 8374559242195912.0 and rounded(-1e17) == -1e17 and rounded(float("inf")) == float("inf")
    assert (rounded(1.23456), rounded(-1.23456), rounded(0.00005)) == (1.2346, -1.2346, 0.0001)
    assert math.isnan(rounded(float("nan"))) and one(spark, fs.r_dec(F.lit(None).cast("double"), 4)) is None


def test_bank_classification_and_net_revenue(spark):
    assert one(spark, fs.stock_type(F.lit("Financial Services"), F.lit(" Banks - Regional "))) == "bank"
    assert one(spark, fs.stock_type(F.lit("Financial Services"), F.lit("Private Banking"))) == "bank"
    assert one(spark, fs.stock_type(F.lit("Technology"), F.lit("Data Bank"))) == "general"
    assert one(spark, fs.stock_type(F.lit(None), F.lit(None))) == "general"
    raw = F.lit('{"interestExpense": 30}')
    assert one(spark, fs.net_revenue(F.lit(100.0), raw, F.lit("bank"))) == 70.0
    assert one(spark, fs.net_revenue(F.lit(100.0), F.lit("{}"), F.lit("bank"))) == 100.0


def test_vendor_aliases_skip_zero_and_blank(spark):
    raw = F.lit('{"a": 0, "b": "", "c": 5}')
    assert one(spark, fs.raw_value_nonzero(raw, "a", "b", "c")) == 5.0
    assert one(spark, fs.raw_value(raw, "a", "c")) == 0.0


def state(spark):
    return spark.createDataFrame(
        [("A", "Energy", 20.0, 1.0), ("B", None, None, 0.0), ("C", "Utilities", 40.0, None)], "symbol string, sector string, pe double, beta double")


def passing(spark, predicate):
    return [r.symbol for r in state(spark).filter(predicate).orderBy("symbol").collect()]


def test_missing_operands_are_false_per_comparison(spark):
    assert passing(spark, p.cmp(p.fld("pe"), "<", 30)) == ["A"]
    assert passing(spark, ~p.cmp(p.fld("pe"), "<", 30)) == ["B", "C"]
    assert passing(spark, p.is_in(p.fld("sector"), ["Energy"])) == ["A"]
    assert passing(spark, p.not_in(p.fld("sector"), ["Energy"])) == ["B", "C"]
    assert passing(spark, p.chain(10, "<", p.fld("pe"), "<", 30)) == ["A"]
    assert passing(spark, p.truthy("beta")) == ["A"]
    assert passing(spark, p.cmp(p.fld("sector"), "<", 5)) == []
    assert passing(spark, p.is_in("ener", p.fld("sector"))) == ["A"] or passing(spark, p.is_in("Ener", p.fld("sector"))) == ["A"]


def test_unknown_fields_fail_early(spark):
    with pytest.raises(ScreenError):
        p.fld("nope")
    with pytest.raises(ScreenError):
        p.cmp(p.fld("pe"), "~", 1)


def test_labels(spark):
    assert [one(spark, fs.peg_label(F.lit(x))) for x in (0.4, 0.9, 1.2, 1.5)] == ["deeply_undervalued", "undervalued", "fairly_priced", "overvalued"]
    assert one(spark, fs.sector_fund(F.lit(" Health Care "))) == "XLV"
    assert one(spark, fs.sector_fund(F.lit(None).cast("string"))) == "SPY"
    assert one(spark, fs.near_extreme(F.lit(-3.0), F.lit(2.0))) == "near_high"


def test_rebalance_and_settlement_calendars(spark):
    px = spark.createDataFrame([("A", dt.date(2024, 1, 10)), ("A", dt.date(2024, 3, 15))], "symbol string, trade_date date")
    monthly = sorted(r[0] for r in sb.rebalance_dates(px).collect())
    assert monthly == [dt.date(2024, 1, 31), dt.date(2024, 2, 29)]
    weekly = sorted(r[0] for r in sb.rebalance_dates(px, "weekly").collect())
    assert weekly[0] == dt.date(2024, 1, 12) and weekly[-1] == dt.date(2024, 3, 15) and len(weekly) == 10
    day = spark.createDataFrame([(dt.date(2024, 6, 20),)], "today date")
    got = sorted((r.settlement_date for r in sb.recent_settlement_dates(day, 2).collect()), reverse=True)
    # 15 June 2024 is a Saturday; 30 June lies ahead.
    assert got == [dt.date(2024, 6, 14), dt.date(2024, 5, 31), dt.date(2024, 5, 15)]
    labels = [r.quarter_label for r in sb.recent_quarters(day, 3).orderBy("age").collect()]
    assert labels == ["2024Q2", "2024Q1", "2023Q4"]


def test_whole_numbers_written_as_floats_are_cut(spark):
    df = spark.createDataFrame([("123.0",), ("1234567.8",), ("1e6",), ("-2.9",), ("9223372036854775807",), ("1e30",), ("x",)], "v string")
    assert [r[0] for r in df.select(fs.as_long("v")).collect()] == [123, 1234567, 1000000, -2, 9223372036854775807, None, None]
