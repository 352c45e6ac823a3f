"""All registered queries. Importing the modules registers them."""

from __future__ import annotations

import importlib
import pkgutil

from rolloom import plans
from rolloom.plans import base

for _module in pkgutil.iter_modules(plans.__path__):
    if _module.name.startswith("on_"):
        importlib.import_module(f"rolloom.plans.{_module.name}")


def queries():
    return dict(sorted(base.registered().items()))


def oracle_sql():
    return dict(sorted(base.oracles().items()))
