"""Display formats of the reports, as Spark expressions.

``format_number`` rounds half-even on the binary value, the same as Python's
``format``; ``format_string('%.2f')`` would round half-up and is not used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(digits: int) -> str:
    return "0" if digits <= 0 else "0." + "0" * digits


def fixed(x: Column, digits: int = 2) -> Column:
    """Fixed-point text without grouping: ``f"{x:.2f}"``."""
    return F.call_function("format_number", x, F.lit(_pattern(digits)))


def pct(ratio: Column, digits: int = 2) -> Column:
    """Percentage text of a ratio: ``f"{ratio:.2%}"``."""
    return F.concat(fixed(ratio * F.lit(100.0), digits), F.lit("%"))


def thousands(x: Column, digits: int = 0) -> Column:
    """Grouped number text: ``f"{x:,}"`` / ``f"{x:,.2f}"``."""
    return F.format_number(x, digits)


def one_decimal_pct(ratio: Column) -> Column:
    """Ratio times 100, rounded half-even to one decimal, with ``%``: ``12.5%``."""
    return F.concat(fixed(F.bround(ratio * F.lit(100.0), 1), 1), F.lit("%"))
