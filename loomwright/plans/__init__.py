"""Named queries of the engine."""

from __future__ import annotations

from importlib import import_module

from loomwright.registry import CORE, Registry

MODULES = ("problems", "panels", "linking", "scoring", "similarity", "ingestion", "assembly", "evidence", "features")


def load_core() -> Registry:
    """The registry with every core query in it."""
    for name in MODULES:
        import_module(f"loomwright.plans.{name}")
    return CORE
