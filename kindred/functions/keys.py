"""Ids, dates and key templates."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(c: Column) -> Column:
    """A number's integer part as text; no number, or one beyond 64 bits, becomes ''.

    Integers are read as such, so that ids above 2^53 keep every digit.
    """
    whole = c.cast("string").try_cast("bigint")
    number = c.try_cast("double")
    cut = F.when(~F.isnan(number), number.try_cast("bigint"))
    return F.coalesce(F.coalesce(whole, cut).cast("string"), F.lit(""))


def is_positive_id(c: Column) -> Column:
    """True for a positive number only; missing ids, NaN and text are not."""
    number = c.try_cast("double")
    return F.coalesce(~F.isnan(number) & (number > 0), F.lit(False))


def has_text(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def shift_date(day: Column | str, days: int) -> Column:
    """A ``yyyy-MM-dd`` text moved by some days."""
    c = F.lit(day) if isinstance(day, str) else day
    return F.date_format(F.date_add(F.to_date(c, "yyyy-MM-dd"), days), "yyyy-MM-dd")


def dated_key(day: Column | str, key: Column) -> Column:
    """``yyyyMMdd:key``."""
    c = F.lit(day) if isinstance(day, str) else day
    return F.concat(F.replace(c, F.lit("-"), F.lit("")), F.lit(":"), key)


def prefixed_key(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key)


def media_path(root: str, item: Column, number: Column) -> Column:
    """``{root}/{item}/{number}.jpg``."""
    return F.concat(F.lit(root + "/"), item, F.lit("/"), number.cast("string"), F.lit(".jpg"))
