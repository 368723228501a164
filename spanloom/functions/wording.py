"""Figures as people read them.  A missing figure is a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def _or_dash(text: Column) -> Column:
    return F.coalesce(text, F.lit(DASH))


def _nearest(x: Column) -> Column:
    """Halves go up, below 0 too."""
    return F.floor(x + 0.5)


def money(x: Column, digits: int = 5) -> Column:
    return _or_dash(F.concat(F.lit("$"), F.format_number(F.round(x, digits), digits)))


def whole(x: Column) -> Column:
    return F.format_number(F.coalesce(x, F.lit(0)).cast("long"), 0)


def milliseconds(x: Column) -> Column:
    return _or_dash(F.concat(F.format_number(_nearest(x), 0), F.lit(" ms")))


def percent(share: Column) -> Column:
    """A share in whole percent.  Halves are told by the share's decimal digits: 0.145 is 15 %, though 100 times it is less than
    14.5 as a double."""
    exact = F.floor(share.try_cast("decimal(30,18)") * 100 + F.lit("0.5").cast("decimal(2,1)")).cast("long")
    return _or_dash(F.concat(F.coalesce(exact, _nearest(share * 100)).cast("string"), F.lit("%")))


def against(x: Column, base: Column) -> Column:
    """A figure against another in percent: -72 is 72 % less; null if either is missing, or the other is 0."""
    return _nearest((F.try_divide(x, base) - 1) * 100)


def change(percent_: Column) -> Column:
    sign = F.when(percent_ > 0, "+").when(percent_ < 0, "−").otherwise("±")
    return F.coalesce(F.concat(sign, F.abs(percent_).cast("string"), F.lit("%")), F.lit(""))


def counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
