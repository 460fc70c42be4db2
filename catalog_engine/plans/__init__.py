"""Bindings of every operator to the driver tables."""

from importlib import import_module
from pkgutil import iter_modules


def load_bindings() -> None:
    for module in iter_modules(__path__):
        if module.name.startswith("bind_"):
            import_module(f"{__name__}.{module.name}")
