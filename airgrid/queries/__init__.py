"""All registered queries."""

from importlib import import_module

from airgrid.queries.registry import REGISTRY, Query

MODULES = ["scores", "reporting", "gaps", "merging", "features", "evaluation", "ingest", "modelling", "streams"]

for _name in MODULES:
    import_module(f"airgrid.queries.{_name}")

__all__ = ["REGISTRY", "Query"]
