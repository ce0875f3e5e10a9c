"""equilake: equity-research analytics over a point-in-time warehouse of DataFrames."""

from equilake.warehouse import Warehouse

__all__ = ["Warehouse"]
