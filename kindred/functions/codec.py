"""Vectors and lists to text and back."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_list(c: Column) -> Column:
    """``a,b,c``."""
    return F.array_join(c, ",")


def encode_vector(c: Column, brackets: bool = True) -> Column:
    """``[a,b,c]`` or ``a,b,c``; numbers print in the shortest form that reads back the same.

    A vector with a NULL element becomes NULL.
    """
    body = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    text = F.concat(F.lit("["), body, F.lit("]")) if brackets else body
    return F.when(~F.exists(c, lambda x: x.isNull()), text)


def decode_vector(c: Column, separator: str = ",") -> Column:
    """The inverse of :func:`encode_vector`, with or without brackets; NULL where a part is no number."""
    body = F.trim(F.translate(c, "[]", ""))
    parts = F.transform(F.split(body, separator, -1), lambda x: F.trim(x).try_cast("float"))
    return F.when((body != "") & ~F.exists(parts, lambda x: x.isNull()), parts)
