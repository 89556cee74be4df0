"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from journalsieve.schema import NULL_LITERALS

# fixed values: characters that count as white space when fields are trimmed
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only the blank that ``trim`` knows."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITESPACE))


def clean_nulls(df: DataFrame, literals: list[str] = NULL_LITERALS) -> DataFrame:
    """Null literals become NULL in every string column."""
    return df.select(*[
        F.when(~F.col(f"`{name}`").isin(literals), F.col(f"`{name}`")).alias(name)
        if kind == "string" else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])
