"""Calendar expressions and the time dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Season ranges as (month, day) from..to, both included; the first is the default (G-08).
TET_JAN20_FEB20 = ((1, 20), (2, 20))
TET_JAN15_FEB15 = ((1, 15), (2, 15))
TET_JAN15_FEB20 = ((1, 15), (2, 20))
TET_JAN21_FEB20 = ((1, 21), (2, 20))

# Festival days and public holidays.
FESTIVALS = ((9, 9), (10, 10), (11, 11), (12, 12))
HOLIDAYS = {(1, 1): ("Tết Dương Lịch", "International"), (4, 30): ("Ngày Giải Phóng Miền Nam", "National"),
            (5, 1): ("Ngày Quốc Tế Lao Động", "International"), (9, 2): ("Ngày Quốc Khánh", "National")}
FESTIVAL_NAMES = {(9, 9): "Ngày Mua Sắm 9.9", (10, 10): "Ngày Mua Sắm 10.10",
                  (11, 11): "Ngày Độc Thân 11.11", (12, 12): "Ngày Mua Sắm 12.12"}
DAYS_VI = ("Chủ Nhật", "Thứ Hai", "Thứ Ba", "Thứ Tư", "Thứ Năm", "Thứ Sáu", "Thứ Bảy")
DAYS_EN = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MONTHS_VI = ("Tháng Một", "Tháng Hai", "Tháng Ba", "Tháng Tư", "Tháng Năm", "Tháng Sáu", "Tháng Bảy", "Tháng Tám",
             "Tháng Chín", "Tháng Mười", "Tháng Mười Một", "Tháng Mười Hai")
MONTHS_EN = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
             "November", "December")
SEASONS = ("Winter", "Winter", "Spring", "Spring", "Spring", "Summer", "Summer", "Summer", "Fall", "Fall", "Fall", "Winter")


def pick(values: Sequence[str], number: Column) -> Column:
    """Entry ``number`` (1-based) of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), number.cast("int"))


def month_day(ts: Column) -> Column:
    return F.month(ts) * 100 + F.dayofmonth(ts)


def time_key(ts: Column) -> Column:
    """F-06, U-07: yyyymmdd."""
    return F.year(ts) * 10000 + month_day(ts)


def in_season(ts: Column, span: tuple[tuple[int, int], tuple[int, int]] = TET_JAN20_FEB20) -> Column:
    """F-07, U-07: month/day inside a range that does not cross the year end."""
    (m1, d1), (m2, d2) = span
    return month_day(ts).between(m1 * 100 + d1, m2 * 100 + d2)


def on_days(ts: Column, days: Sequence[tuple[int, int]]) -> Column:
    return month_day(ts).isin([m * 100 + d for m, d in days])


def day_label(ts: Column, names: dict[tuple[int, int], str]) -> Column:
    out = F.lit(None).cast("string")
    for (m, d), name in names.items():
        out = F.when(month_day(ts) == m * 100 + d, name).otherwise(out)
    return out


def season(ts: Column) -> Column:
    return pick(SEASONS, F.month(ts))


def whole_days(start: Column, end: Column) -> Column:
    """G-16: whole elapsed days, floor of the seconds."""
    return F.floor((F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))) / 86400)


def date_parts(ts: Column) -> dict[str, Column]:
    """F-04: calendar parts (weekday Monday = 0, ISO week)."""
    return {
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts), "quarter": F.quarter(ts),
        "iso_week": F.weekofyear(ts), "day_of_year": F.dayofyear(ts), "weekday": F.weekday(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"), "is_month_start": (F.dayofmonth(ts) == 1).cast("int"),
        "is_month_end": (F.to_date(ts) == F.last_day(ts)).cast("int"), "season": season(ts),
    }


def season_flags(ts: Column, tet=TET_JAN20_FEB20) -> dict[str, Column]:
    """F-07: seasonal flags, business and school day."""
    weekend = F.dayofweek(ts).isin(1, 7)
    holiday = on_days(ts, list(HOLIDAYS))
    return {
        "is_tet_season": in_season(ts, tet), "is_shopping_festival": on_days(ts, FESTIVALS),
        "is_vietnamese_holiday": holiday, "is_ghost_month": F.month(ts) == 8,
        "is_mid_autumn": month_day(ts) == 915, "is_christmas_season": in_season(ts, ((12, 20), (12, 31))),
        "is_weekend": weekend, "is_business_day": ~weekend & ~holiday,
        "is_school_day": ~weekend & ~F.month(ts).isin(6, 7, 8),
    }


def time_dimension(spark: SparkSession, first: str = "2020-01-01", last: str = "2030-12-31") -> DataFrame:
    """D-44: one row per day with its calendar attributes."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date_value"))
    return with_calendar(days, "date_value")


def with_calendar(days: DataFrame, column: str) -> DataFrame:
    """D-44: the 38 attributes of the time dimension for any date column."""
    d = F.col(column)
    week = F.to_date(F.date_trunc("week", d))
    month, quarter, year = (F.to_date(F.date_trunc(g, d)) for g in ("month", "quarter", "year"))
    q = F.quarter(d)
    flags = season_flags(d, TET_JAN15_FEB15)
    return days.select(
        d.alias("date_value"), F.dayofweek(d).alias("day_of_week"), pick(DAYS_VI, F.dayofweek(d)).alias("day_name_vietnamese"),
        pick(DAYS_EN, F.dayofweek(d)).alias("day_name_english"), F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"), F.weekofyear(d).alias("week_of_year"), week.alias("week_start_date"),
        F.date_add(week, 6).alias("week_end_date"), F.month(d).alias("month_number"),
        pick(MONTHS_VI, F.month(d)).alias("month_name_vietnamese"), pick(MONTHS_EN, F.month(d)).alias("month_name_english"),
        F.concat(F.lit("T"), F.month(d)).alias("month_short_vietnamese"), month.alias("month_start_date"),
        F.last_day(d).alias("month_end_date"), q.alias("quarter_number"), F.concat(F.lit("Quý "), q).alias("quarter_name_vietnamese"),
        F.concat(F.lit("Q"), q).alias("quarter_name_english"), quarter.alias("quarter_start_date"),
        F.date_sub(F.add_months(quarter, 3), 1).alias("quarter_end_date"), F.year(d).alias("year_number"),
        year.alias("year_start_date"), F.date_sub(F.add_months(year, 12), 1).alias("year_end_date"),
        flags["is_vietnamese_holiday"].alias("is_vietnamese_holiday"),
        day_label(d, {k: v[0] for k, v in HOLIDAYS.items()}).alias("vietnamese_holiday_name"),
        day_label(d, {k: v[1] for k, v in HOLIDAYS.items()}).alias("holiday_type"),
        *[flags[n].alias(n) for n in ("is_tet_season", "is_ghost_month", "is_mid_autumn", "is_christmas_season", "is_shopping_festival")],
        day_label(d, FESTIVAL_NAMES).alias("shopping_festival_name"),
        *[flags[n].alias(n) for n in ("is_weekend", "is_business_day", "is_school_day")],
        F.year(d).alias("fiscal_year"), q.alias("fiscal_quarter"), F.month(d).alias("fiscal_month"))
