"""Order statistics over bounded arrays and numeric clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once.

    The optimizer may move a column's definition into a lambda that mentions it,
    where it would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def percentile_sql(values: str, fraction: str) -> str:
    """Linear-interpolation percentile of an ascending array as SQL; null when empty.

    Written as text because the statistics vector needs many of these: one parsed
    expression per column keeps query building fast.
    """
    place = f"(size({values}) - 1) * {fraction}"
    low, high = f"get({values}, int(floor({place})))", f"get({values}, int(ceil({place})))"
    return f"{low} + ({high} - {low}) * ({place} - floor({place}))"


def percentiles_sql(values: str, percents: Sequence[int]) -> str:
    """Array of percentiles, one per percent."""
    wanted = ", ".join(f"{p / 100}D" for p in percents)
    return f"transform(array({wanted}), f -> {percentile_sql(values, 'f')})"


def median_sql(values: str) -> str:
    return percentile_sql(values, "0.5D")


def mad_sql(values: str) -> str:
    """Median absolute deviation of an ascending array.

    The one-element arrays bind the median and the distances, so that neither is
    computed again for every element.
    """
    distances = f"sort_array(transform({values}, x -> abs(x - m)))"
    inner = f"get(transform(array({distances}), d -> {median_sql('d')}), 0)"
    return f"get(transform(array({median_sql(values)}), m -> {inner}), 0)"


def percentile_of_counts(
    value: str, upto: str, size: str, fraction: float, over: WindowSpec | None = None
) -> Column:
    """Linear-interpolation percentile of values given with running counts; null when empty.

    ``upto`` is the number of items up to and with the row's ``value``, ``size`` that of
    all. An aggregate, or a window function ``over`` a window.
    """
    place = (F.col(size) - 1) * F.lit(fraction)

    def at(index: Column) -> Column:
        found = F.min(F.when((F.col(upto) > index) & (F.col(size) > 0), F.col(value)))
        return found if over is None else found.over(over)

    low, high = at(F.floor(place)), at(F.ceil(place))
    whole = F.max(place - F.floor(place)) if over is None else place - F.floor(place)
    return low + (high - low) * whole


def finite_or_zero(x: Column) -> Column:
    """NaN, infinities and null become 0."""
    x = x.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def percent_of(part: Column, whole: Column) -> Column:
    return ratio_or_zero(part * F.lit(100.0), whole)
