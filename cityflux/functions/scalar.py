"""Text, number and date columns with defined results for nulls and edges."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chosen(cases: Iterable[tuple[Column, object]], rest: object) -> Column:
    """The value of the first case that holds, else ``rest``."""
    out: Column | type = F
    for p, value in cases:
        out = out.when(p, value)
    return out.otherwise(rest)


# Predicates


def truth(p: Column) -> Column:
    """A predicate with null as false."""
    return F.coalesce(p, F.lit(False))


def any_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, map(truth, predicates), F.lit(False))


def outside(x: Column | str, start: str, end: str) -> Column:
    """Not in the half-open period [start, end)."""
    x = col(x)
    return (x < F.lit(start).cast("timestamp_ntz")) | (x >= F.lit(end).cast("timestamp_ntz"))


def blank(x: Column | str) -> Column:
    x = col(x)
    return x.isNull() | (F.trim(x.cast("string")) == "")


def contains_folded(x: Column | str, part: str) -> Column:
    return col(x).ilike(f"%{part}%")


# Text


def clean(x: Column | str) -> Column:
    """White space runs (Unicode ones too) as one space, ends trimmed, empty as null."""
    return F.nullif(F.trim(F.regexp_replace(col(x), r"(?U)\s+", " ")), F.lit(""))


def lookup(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(values.items())])


def canonical(x: Column | str, values: Mapping[str, str]) -> Column:
    """The canonical label of a cleaned text by its upper-case form; unknown texts pass through."""
    x = clean(x)
    return F.coalesce(F.try_element_at(lookup({k.upper(): v for k, v in values.items()}), F.upper(x)), x)


def label(x: Column | str, values: Mapping[int | str, str], default: str | None = None) -> Column:
    """A code's label, else ``default``."""
    return chosen([(col(x) == code, name) for code, name in values.items()], default)


def row_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def row_hash(*columns: str) -> Column:
    return F.sha2(row_json(*columns), 256)


def hour_label(x: Column | str) -> Column:
    return F.concat_ws(":", F.lpad(col(x).cast("string"), 2, "0"), F.lit("00"))


# Numbers


def number(x: Column | str) -> Column:
    """A double, or null where the text is none."""
    return col(x).try_cast(T.DoubleType())


def moment(x: Column | str) -> Column:
    """An ISO timestamp without zone, or null where the text is none."""
    return col(x).try_cast(T.TimestampNTZType())


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def percent_error(error: Column, actual: Column) -> Column:
    return F.when(actual.isNull() | (actual == 0), None).otherwise(F.abs(error) * 100.0 / actual)


def money(x: Column | str) -> Column:
    return col(x).cast(T.DecimalType(18, 2))


def bands(x: Column | str, edges: Iterable[tuple[float, str]], rest: str) -> Column:
    """The label of the first edge that a value is below, else ``rest``."""
    return chosen([(col(x) < edge, name) for edge, name in edges], rest)


def right_closed(x: Column | str, edges: Iterable[tuple[float, str]], rest: str) -> Column:
    """The label of the first edge that a value doesn't exceed, else ``rest``; a negative or null value has none."""
    out = F.when(col(x).isNull() | (col(x) < 0), None)
    for edge, name in edges:
        out = out.when(col(x) <= edge, name)
    return out.otherwise(rest)


#: Demand levels, right-closed (fixed values).
DEMAND_LEVELS = ((0, "Zero (0)"), (5, "Very Low (1-5)"), (20, "Low (6-20)"), (50, "Moderate (21-50)"), (100, "High (51-100)"))
#: Temperature and snow bands, left-closed (fixed values).
TEMPERATURE_BANDS = ((0, "Freezing (<0C)"), (10, "Cold (0-10C)"), (20, "Cool (10-20C)"), (30, "Warm (20-30C)"))


def demand_level(x: Column | str) -> Column:
    return right_closed(x, DEMAND_LEVELS, "Very High (101+)")


def temperature_band(x: Column | str) -> Column:
    return bands(x, TEMPERATURE_BANDS, "Hot (30C+)")


def snow_band(x: Column | str) -> Column:
    x = col(x)
    return F.when(x == 0, "No Snow").when((x > 0) & (x < 1), "Light Snow").when((x >= 1) & (x < 5), "Moderate Snow").otherwise("Heavy Snow")


def rain_group(x: Column | str) -> Column:
    return F.when(col(x) > 0, "Rain").otherwise("Dry")


def integral(x: Column | str, tolerance: float = 1e-9) -> Column:
    x = col(x)
    return F.abs(x - F.round(x)) < tolerance


# Time


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end)).cast("double") / F.lit(60_000_000).cast("double")


def month_start(x: Column | str) -> Column:
    return F.trunc(col(x).cast("date"), "MM")


def weekend(x: Column | str) -> Column:
    """Saturday or Sunday (Monday is 0)."""
    return F.weekday(col(x)) >= 5


def daypart(hour: Column | str) -> Column:
    return bands(hour, ((6, "Night"), (12, "Morning"), (18, "Afternoon")), "Evening")


def zone_or_unknown(x: Column | str, low: int = 1, high: int = 265) -> Column:
    return F.when(col(x).between(low, high), col(x)).otherwise(0)
