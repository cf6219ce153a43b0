"""Named queries with the SQL each one is checked against."""

from importlib import import_module

MODULES = ("index_numbers", "cleaning", "ingest", "publishing", "analysis", "watch", "forecasting", "streams")


def load_all():
    """Import every query module and return the registry."""
    for m in MODULES:
        import_module(f"quotemill.catalog.{m}")
    return import_module("quotemill.catalog.registry")
