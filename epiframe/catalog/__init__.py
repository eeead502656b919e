"""Queries over the driver's tables, one module per operator family."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _family in ("relational", "sources", "cleaning", "joins", "timeseries", "streams", "contingency", "summaries", "survival",
                "models", "evaluation", "splits", "cohorts", "trajectories", "texts", "graphs", "spatial"):
    import_module(f"{__name__}.{_family}")

__all__ = ["ORACLES", "QUERIES"]
