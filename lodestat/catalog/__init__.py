"""All registered queries."""

import importlib
import pkgutil

from lodestat.catalog import registry


def _load():
    for m in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("c_")):
        importlib.import_module(f"{__name__}.{m}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
