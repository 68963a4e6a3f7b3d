"""Named queries over the test tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every query module once; hand back the registry."""
    from ledgerlift.catalog import registry

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return registry
