"""Scalar expressions over billing columns.

All of them are built-in expressions, so they stay inside whole-stage code
generation. Division is always ``try_divide``: ANSI mode raises on a bare
division by zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo import schema as S

# raw column -> name of the double measure (fixed values of the data model)
MEASURES = {
    "volfac": "consumo",
    "imagua": "importe_agua",
    "imalca": "importe_alc",
    "imcafi": "cargo_fijo",
    "hoxdia": "horas_dia",
    "diasem": "dias_semana",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cast_measures(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Add each measure as a double under its analytic name."""
    names = names or MEASURES
    return df.withColumns({new: F.col(raw).cast("double") for raw, new in names.items()})


def season(month: Column | str) -> Column:
    """Southern-hemisphere season; a missing month falls to the last branch."""
    m = col(month)
    return (
        F.when(m.isin(S.SUMMER_MONTHS), S.SUMMER)
        .when(m.isin(S.AUTUMN_MONTHS), S.AUTUMN)
        .when(m.isin(S.WINTER_MONTHS), S.WINTER)
        .otherwise(S.SPRING)
    )


def month_index(year: Column | str, month: Column | str, base_year: int = 0) -> Column:
    """Months since ``base_year``; 0 gives the absolute calendar month."""
    return ((col(year) - F.lit(base_year)) * 12 + col(month)).cast("int")


def safe_ratio(num: Column | str, den: Column | str, guard: str = "positive") -> Column:
    """Division that yields null for an unusable denominator.

    ``positive`` rejects zero and negative denominators, ``nonzero`` only zero.
    """
    den = col(den)
    if guard == "positive":
        return F.try_divide(col(num), F.when(den > 0, den))
    if guard == "nonzero":
        return F.try_divide(col(num), den)
    raise ValueError(f"unknown guard {guard!r}")


def service_quality(hours: Column | str = "horas_dia", days: Column | str = "dias_semana") -> Column:
    """Share of the week with service, per record."""
    return (col(hours) / 24.0) * (col(days) / 7.0)


def bill_total(
    water: Column | str = "importe_agua",
    sewer: Column | str = "importe_alc",
    fixed: Column | str = "cargo_fijo",
) -> Column:
    """Billed amount; a missing component makes the whole amount missing."""
    return col(water) + col(sewer) + col(fixed)


def subsidy_flag(status: Column | str = "situdu") -> Column:
    return F.coalesce((col(status) == S.SUBSIDISED).cast("int"), F.lit(0))


def size_bucket(units: Column | str) -> Column:
    """Size class of a connection by its number of units (fixed limits)."""
    u = col(units)
    return (
        F.when(u == 1, "Unifamiliar").when(u <= 4, "Pequeno").when(u <= 10, "Mediano").otherwise("Grande")
    )


def share_pct(part: Column | str, whole: Column | str) -> Column:
    """Part of a whole on the 0-100 scale."""
    return F.try_divide(col(part).cast("double"), col(whole)) * 100


def share(part: Column | str, whole: Column | str) -> Column:
    """Part of a whole on the 0-1 scale."""
    return F.try_divide(col(part).cast("double"), col(whole))


def spread(upper: Column | str, lower: Column | str) -> Column:
    return col(upper) - col(lower)
