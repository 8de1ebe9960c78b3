"""All registered queries; importing the modules fills the registry."""

from importlib import import_module

from .registry import QUERIES, SQL

_MODULES = ("detection", "statistics", "vectors", "points", "analytics", "geometry")
for _m in _MODULES:
    import_module(f"{__name__}.{_m}")

__all__ = ["QUERIES", "SQL"]
