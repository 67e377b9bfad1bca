"""Registered queries, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every query module of this package; returns (queries, sql)."""
    from fairline.queries import registry

    for info in pkgutil.iter_modules(__path__):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
    return registry.QUERIES, registry.ORACLES
