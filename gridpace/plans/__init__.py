"""Registered queries, one module per operator family."""

from importlib import import_module

FAMILIES = ["cleaning", "files", "joins", "windows", "aggregates", "ordering", "models", "decide", "scalars", "tracks", "learning", "pace", "streams"]


def load_all() -> None:
    for name in FAMILIES:
        import_module(f"gridpace.plans.{name}")
