"""Helpers to write the SQL twin of a query."""

from gridpace.operators.features import FEATURES_SQL
from gridpace.sources.lapview import LAPS_SQL, WEATHER_SQL


def laps_sql(body: str, *ctes: str) -> str:
    """SQL over ``laps``."""
    return "with " + ",\n".join([LAPS_SQL, *ctes]) + "\n" + body


def weather_sql(body: str, *ctes: str) -> str:
    """SQL over ``laps`` and ``weather``."""
    return "with " + ",\n".join([LAPS_SQL, WEATHER_SQL, *ctes]) + "\n" + body


def feat_sql(body: str, *ctes: str) -> str:
    """SQL over ``laps``, ``weather`` and the feature table ``f``."""
    return "with " + ",\n".join([LAPS_SQL, WEATHER_SQL, FEATURES_SQL, *ctes]) + "\n" + body


def rnd(expr: str, digits: int = 6) -> str:
    """Rounding text shared by both engines: a nudge far below the last digit settles exact ties the same way."""
    return f"round(cast({expr} as double) + 0.0000000013, {digits})"
