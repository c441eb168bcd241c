"""Imports every catalogue module, so that the registry is filled."""

from __future__ import annotations

import importlib
import pkgutil

import panelweave.plans as package


def load() -> None:
    for module in pkgutil.iter_modules(package.__path__):
        if module.name.startswith("catalog_"):
            importlib.import_module(f"{package.__name__}.{module.name}")


load()
