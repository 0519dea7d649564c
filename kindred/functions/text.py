"""Title building and cleaning with built-in string expressions only."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Promotional phrases, removed in this order.
PROMO_PHRASES = (
    "【福利秒杀】",
    "【每日福利】",
    "【福利爆款】",
    "【专柜品质】",
    "【1元秒杀】",
    "【直播专用1元秒杀】",
    "【",
    "】",
    "源本",
)

# Fixed value: a bracketed remark that holds no parenthesis.
BRACKET_REMARK = r"\[[^()]*\]"

# Every character that Python's str.split() treats as white space, but the space.
WHITESPACE = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def plain_spaces(c: Column) -> Column:
    """White space of any kind becomes a space; cheaper than a pattern with all its kinds."""
    return F.translate(c, WHITESPACE, " " * len(WHITESPACE))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_digits(c: Column) -> Column:
    """Remove the ASCII digits."""
    return F.translate(c, "0123456789", "")


def collapse_whitespace(c: Column) -> Column:
    """Runs of Unicode white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(plain_spaces(c), " +", " "))


def gen_title(lv1: Column, lv2: Column, name: Column, title: Column) -> Column:
    """``lv1 lv2 name title``; digits leave every part but the name, NULL parts count as empty."""
    parts = [
        strip_digits(text_or_empty(lv1)),
        strip_digits(text_or_empty(lv2)),
        text_or_empty(name),
        strip_digits(text_or_empty(title)),
    ]
    return collapse_whitespace(F.concat_ws(" ", *parts))


def remove_phrases(c: Column, phrases: Sequence[str]) -> Column:
    """Remove each phrase in turn, so an earlier removal can change what a later one sees."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p), F.lit("")), phrases, c)


def clean_title(
    c: Column,
    phrases: Sequence[str] = PROMO_PHRASES,
    stop_words: Sequence[str] | None = None,
) -> Column:
    """Drop promotional phrases and bracketed remarks, and stop words when a list is given."""
    cleaned = F.regexp_replace(remove_phrases(c, phrases), BRACKET_REMARK, "")
    if not stop_words:
        return cleaned
    words = F.split(cleaned, " ", -1)
    return F.array_join(F.filter(words, lambda w: ~w.isin(list(stop_words))), " ")


def words(c: Column) -> Column:
    """White-space separated words of a text, without empty ones."""
    return F.array_remove(F.split(plain_spaces(c), " ", -1), "")
