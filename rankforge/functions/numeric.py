"""Numbers, dates and score conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

YEAR_SECONDS = 31557600  # 365.25 days
# Hours at which a part of the day begins (fixed values): before 5 and from 22 on it is night.
DAYPARTS = (("Morning", 5, 11), ("Afternoon", 12, 16), ("Evening", 17, 21))
DAYPART_ORDER = ("Morning", "Afternoon", "Evening", "Night")
WEEKDAY_ORDER = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def to_number(c: Column, kind: str = "double") -> Column:
    return c.try_cast(kind)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def steady_round(c: Column, digits: int) -> Column:
    """Round in two steps: the first takes away the noise of summation order, which else could turn
    the last digit of a value that lies half way."""
    return F.round(F.round(c, 9), digits)


def clip_round(c: Column, digits: int = 1, low: float = 0.0, high: float = 10.0) -> Column:
    """Half-even rounding, then clipping."""
    return clip(F.bround(c, digits), low, high)


def impute_year(c: Column, fill: Column, low: int = 1900, high: int = 2025) -> Column:
    return F.when(c.between(low, high), c).otherwise(fill).cast("int")


def daypart(hour: Column) -> Column:
    out = F
    for name, low, high in DAYPARTS:
        out = out.when(hour.between(low, high), name)
    return out.otherwise("Night")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone is."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return days * 86_400_000_000 + seconds.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def min_max(c: Column, low: Column, high: Column) -> Column:
    """(c - low) / (high - low); 0 when all values are equal."""
    return F.when(high > low, (c - low) / (high - low)).otherwise(F.lit(0.0))


def popularity(count_norm: Column, mean_norm: Column) -> Column:
    return 0.7 * count_norm + 0.3 * mean_norm


def z_score(c: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (c - mean) / std).otherwise(F.lit(0.0))


def similarity(c: Column, kind: str, largest: Column | None = None) -> Column:
    """Turn an inner product or a distance into a similarity.

    `largest` is the largest distance of the same result list (kind 'list_distance').
    """
    if kind == "cosine":
        return clip(c, 0.0, 1.0)
    if kind == "shifted":
        return (c + 1) / 2
    if kind == "percent":
        return clip((c + 1) * 50, 0.0, 100.0)
    if kind == "exp_distance":
        return F.exp(-c)
    if kind == "inverse_distance":
        return 1 / (1 + c)
    if kind == "half_distance":
        return 1 - c / 2
    if kind == "list_distance":
        if largest is None:
            raise ValueError("kind 'list_distance' needs the largest distance of the list")
        return F.when(largest > 0, 1 - F.sqrt(c) / F.sqrt(largest)).otherwise(F.lit(1.0))
    raise ValueError(f"unknown similarity kind: {kind}")


def percent_text(c: Column, digits: int = 2) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", steady_round(c * 100, digits)), F.lit("%"))


def time_decay(ts: Column, as_of: Column, factor: float) -> Column:
    """exp(-factor * age in years)."""
    age = (micros(as_of) - micros(ts)) / 1e6
    return F.exp(-factor * age / YEAR_SECONDS)


def default_neighbours(n_items: int) -> int:
    """Square root of the number of items, between 10 and 100."""
    return int(min(100, max(10, n_items ** 0.5)))


def default_components(n_items: int) -> int:
    """Square root of the number of items, between 50 and 200."""
    return int(min(200, max(50, n_items ** 0.5)))
