"""Registered queries. Importing a module registers its entries."""

from importlib import import_module

from .registry import entries

MODULES = ("scans", "journeys", "integrity", "reporting", "views_laws", "scoring", "streams")


def load_all():
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return entries()
