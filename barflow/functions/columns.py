"""Guards, labels and small formulas as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def rows(w: WindowSpec, size: int) -> WindowSpec:
    """The frame of the current row and the `size - 1` rows before it."""
    return w.rowsBetween(-(size - 1), 0)


def rolling(agg: Callable[[Column], Column], c: Column, w: WindowSpec, size: int, at_least: int | None = None) -> Column:
    """`agg` over the last `size` rows, NULL until `at_least` (default all) are non-NULL."""
    frame = rows(w, size)
    return F.when(F.count(c).over(frame) >= (size if at_least is None else at_least), agg(c).over(frame))


def log_return(c: Column, w: WindowSpec) -> Column:
    """ln(c / previous c); NULL where either is missing or not positive."""
    return F.ln(F.try_divide(c, F.lag(c, 1).over(w)))


def pct_change(c: Column, w: WindowSpec, lag: int = 1) -> Column:
    return F.try_divide(c, F.lag(c, lag).over(w)) - 1


def clip(c: Column, low: float, high: float) -> Column:
    """Clamp, keeping NULL (greatest/least would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def direction(c: Column, threshold: float) -> Column:
    """1 above the threshold, -1 below minus the threshold, else 0; NULL stays NULL."""
    return F.when(c > threshold, 1).when(c < -threshold, -1).when(c.isNotNull(), 0)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den where den is positive, else the default."""
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present, NULL where one is constant.

    The built-in raises on a constant side in ANSI mode.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def hour_fraction(ts: Column) -> Column:
    """Hour of the day over 24."""
    return F.hour(ts) / 24.0


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def to_utc(ts: Column, zone: str) -> Column:
    """A wall-clock time of `zone` as UTC."""
    return F.to_utc_timestamp(ts, zone)


def price_text(c: Column) -> Column:
    """$1,234.56 above 100, else four decimals; a dash where missing."""
    text = F.when(c > 100, F.format_number(c, 2)).otherwise(F.format_string("%.4f", c))
    return F.when(c.isNotNull(), F.concat(F.lit("$"), text)).otherwise("—")


def percent_text(c: Column, digits: int = 3) -> Column:
    """+1.234%; a dash where missing."""
    return F.when(c.isNotNull(), F.format_string(f"%+.{digits}f%%", c)).otherwise("—")
