"""Named queries over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from shardframe.plans.registry import QUERIES, Query

MODULES = ["function", "index", "sharding", "placement", "catalogue", "allocation", "run", "tensor", "structure", "reshard", "file", "stream"]

for _name in MODULES:
    import_module(f"shardframe.plans.{_name}_queries")

__all__ = ["QUERIES", "Query"]
