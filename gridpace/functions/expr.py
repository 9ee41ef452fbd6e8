"""Column expressions used by many operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridpace.constants import KNOTS


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Round for reporting; the nudge settles exact ties the same way in every engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(0.0000000013), digits)


def big(c: Column) -> Column:
    return c.cast("bigint")


def duration_seconds(c: Column) -> Column:
    """Seconds of a '0 days 01:23:45.678' duration string; null when it does not parse."""
    p = r"^(\d+) days (\d{2}):(\d{2}):(\d{2}(?:\.\d+)?)$"
    part = lambda i: F.regexp_extract(c, p, i).cast("double")
    return F.when(c.rlike(p), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def status_bucket(c: Column) -> Column:
    """Green, yellow or red from concatenated status codes."""
    return F.when(c.contains("5"), "red").when(c.rlike("[2467]"), "yellow").otherwise("green")


def status_letter(sc: Column, vsc: Column, red: Column) -> Column:
    return F.when(sc, "S").when(vsc, "V").when(red, "R").otherwise("G")


def alias_name(c: Column, aliases: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(m[c], c)


def hinge(age: Column, knots: tuple[int, ...] = KNOTS) -> list[Column]:
    """Piecewise-linear basis: how far age is past each knot."""
    return [F.greatest(age - k, F.lit(0)).cast("double") for k in knots]


def recency_weight(x: Column, newest: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), (newest - x) / F.lit(float(half_life)))


def race_quarter(lap: Column, race_laps: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(4 * lap / race_laps)).cast("int")


def finished(status: Column) -> Column:
    s = F.coalesce(status, F.lit(""))
    return s.rlike("^Finished") | s.startswith("+")


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def lerp(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear interpolation between two brackets, flat where one is missing or they coincide."""
    return (F.when(x0.isNull(), y1).when(x1.isNull() | (x1 == x0), y0)
            .otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0)))
