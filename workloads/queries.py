"""All registered queries."""

from __future__ import annotations

from . import registry


def load():
    import importlib, pkgutil, workloads
    for m in sorted(x.name for x in pkgutil.iter_modules(workloads.__path__)):
        if m.startswith("q_"):
            importlib.import_module("workloads." + m)
    return registry.QUERIES, registry.SQL
