"""Amount text to double."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from journalsieve.functions.text import WHITESPACE

_DROPPED = "€$£" + WHITESPACE
# fixed values: the shapes of amounts that must be read alike everywhere
_GERMAN = r"^-?[\d.]*,\d{1,2}$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_amounts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add amounts read from German (``1.234,56``) or English (``1,234.56``) text; NULL when it is
    neither.  ``columns`` maps the new column to its text column.

    The steps are separate projections, so each row pays for every pattern once.  The number check
    in front of the cast matters: the cast alone accepts type suffixes such as ``1d``.
    """
    bare = {f"{new}_bare": F.translate(text, _DROPPED, "") for new, text in columns.items()}
    plain = {}
    for new in columns:
        text = F.col(f"{new}_bare")
        german = F.replace(F.regexp_replace(text, r"\.(?=\d{3})", ""), F.lit(","), F.lit("."))
        english = F.regexp_replace(text, r",(?=\d{3})", "")
        plain[f"{new}_plain"] = F.when(text.rlike(_GERMAN), german).otherwise(english)
    amounts = {new: F.when(F.col(f"{new}_plain").rlike(NUMBER),
                           F.col(f"{new}_plain").try_cast("double")) for new in columns}
    return df.withColumns(bare).withColumns(plain).withColumns(amounts).drop(*bare, *plain)
