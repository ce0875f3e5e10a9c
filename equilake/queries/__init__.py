"""Registered queries with their reference SQL."""

from importlib import import_module

from equilake.queries.registry import ORACLES, QUERIES

for _name in ("windows", "panels", "screens", "companies", "portfolios", "backtests", "tables"):
    import_module(f"equilake.queries.{_name}")

__all__ = ["ORACLES", "QUERIES"]
