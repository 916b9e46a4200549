"""The registered queries and the SQL that checks them."""

from importlib import import_module

MODULES = ("profiling", "cleaning", "charting", "relational", "series", "statistics", "models", "neighbors", "detectors")


def load() -> None:
    """Import every query module, which fills the registry."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
