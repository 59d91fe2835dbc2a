"""Queries over the given tables."""

from importlib import import_module

from tidemark.plans.registry import ORACLES, QUERIES

for _name in ("clean", "pit", "features", "samples", "graph", "ranking", "portfolio", "forward", "text", "sources"):
    import_module(f"tidemark.plans.q_{_name}")

__all__ = ["ORACLES", "QUERIES"]
