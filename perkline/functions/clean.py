"""Column functions for text cleaning, safe typing and money.

Casts never raise: what does not parse is NULL, so validation can name it. Money rounds half up; on DECIMAL input the
arithmetic is exact, on DOUBLE it is what the feeds carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAR_FUTURE = "9999-12-31"
_STYLES = {
    "plain": lambda c: c,
    "upper": F.upper,
    "lower": F.lower,
    "title": F.initcap,
    "code4": lambda c: F.lpad(c, 4, "0"),  # pads, and cuts what is longer
}


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tidy(c: str | Column, style: str = "plain") -> Column:
    """Trimmed, then in one of the styles plain, upper, lower, title, code4. NULL stays NULL."""
    return _STYLES[style](F.trim(as_col(c)))


def tidy_columns(df: DataFrame, styles: dict[str, str]) -> DataFrame:
    return df.withColumns({c: tidy(c, s) for c, s in styles.items()})


def typed(c: str | Column, kind: str) -> Column:
    return as_col(c).try_cast(kind)


def month_of(c: str | Column) -> Column:
    return F.date_format(as_col(c), "yyyy-MM")


def cents(c: str | Column, places: int = 2) -> Column:
    return F.round(as_col(c), places)


def ratio(top: str | Column, bottom: str | Column, scale: float = 1.0, places: int | None = None) -> Column:
    """scale * top / bottom in double; NULL where bottom is 0 or NULL."""
    b = as_col(bottom).cast("double")
    out = F.lit(float(scale)) * as_col(top).cast("double") / F.when(b != 0, b)
    return out if places is None else F.round(out, places)
