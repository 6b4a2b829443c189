"""Import every query module so that it registers itself."""

import importlib
import pkgutil

import suite

for _module in sorted(m.name for m in pkgutil.iter_modules(suite.__path__)):
    if _module not in ("all", "registry", "model"):
        importlib.import_module(f"suite.{_module}")
