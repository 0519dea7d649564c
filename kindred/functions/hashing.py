"""Seeded hashes that any SQL engine with md5 can reproduce."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits fill 52 bits, which a double holds exactly.
HEX_DIGITS = 13
HASH_RANGE = 1 << (4 * HEX_DIGITS)


def hash_int(seed: str, *cols: Column) -> Column:
    """Non-negative BIGINT below 2**52 from the columns' text and a seed."""
    text = F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("bigint")


def hash_unit(seed: str, *cols: Column) -> Column:
    """DOUBLE in [0, 1)."""
    return hash_int(seed, *cols).cast("double") / F.lit(float(HASH_RANGE))
