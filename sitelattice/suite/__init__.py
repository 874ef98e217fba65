"""Registered queries over the given tables."""

import importlib

MODULES = ["tables", "patterns", "metrics", "decisions", "models", "learners", "files"]


def load_all():
    from sitelattice.suite import registry
    for m in MODULES:
        importlib.import_module(f"sitelattice.suite.{m}")
    return registry.QUERIES, registry.ORACLES
