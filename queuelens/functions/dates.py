"""Calendar arithmetic and day-first text dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Text forms of dates.
SECOND_FORMAT = "dd/MM/yyyy HH:mm:ss"
MINUTE_FORMAT = "dd/MM/yyyy HH:mm"
DAY_FORMAT = "dd/MM/yyyy"
DAY_FIRST_PATTERN = "d/M/yyyy[ H:mm[:ss]]"
# Epoch milliseconds of the years 1 to 9999, the range the text form can hold.
EPOCH_MS_MIN, EPOCH_MS_MAX = -62135596800000, 253402300799999


def date_of(c: Column) -> Column:
    return c.cast("date")


def day_diff(end: Column, start: Column) -> Column:
    """Calendar days between two dates or timestamps (not full 24 h spans)."""
    return F.datediff(end.cast("date"), start.cast("date"))


def year_diff(end: Column, start: Column) -> Column:
    """Difference of the year numbers."""
    return F.year(end) - F.year(start)


def age_years(birth: Column, as_of: Column) -> Column:
    """Age by year numbers; null for text that is no date."""
    return year_diff(as_of.cast("date"), birth.try_cast("date"))


def epoch_text(c: Column, fmt: str = SECOND_FORMAT) -> Column:
    """Epoch milliseconds (number or numeric text) as text; '' where missing or bad.

    The number 0 counts as missing; callers pass text for values where "0" is data.
    """
    return ms_text(F.floor(c.cast("string").try_cast("double")), fmt)


def ms_text(ms: Column, fmt: str = SECOND_FORMAT) -> Column:
    """``epoch_text`` for a BIGINT column."""
    ok = (ms != 0) & ms.between(EPOCH_MS_MIN, EPOCH_MS_MAX)
    return F.coalesce(F.date_format(F.when(ok, F.timestamp_millis(ms)), fmt), F.lit(""))


def epoch_date_text(c: Column) -> Column:
    return epoch_text(c, DAY_FORMAT)


def day_first_timestamp(c: Column) -> Column:
    """Day-first text (with or without time) or ISO text as timestamp, bad text null."""
    text = F.trim(c)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit(DAY_FIRST_PATTERN)),
        text.try_cast("timestamp"),
    )


def age_text(birth: Column, as_of: Column) -> Column:
    """'<y> anos e <m> meses'; the year counts only once the birthday has passed."""
    birth, as_of = birth.cast("date"), as_of.cast("date")
    before_birthday = (F.month(as_of) * 100 + F.dayofmonth(as_of)
                       < F.month(birth) * 100 + F.dayofmonth(birth))
    years = F.year(as_of) - F.year(birth) - before_birthday.cast("int")
    months = F.pmod(F.month(as_of) - F.month(birth), F.lit(12))
    text = F.concat(years.cast("string"), F.lit(" anos e "), months.cast("string"), F.lit(" meses"))
    return F.coalesce(text, F.lit(""))
