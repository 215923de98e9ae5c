"""Every query of the library by name, with the SQL that DuckDB answers alike."""

from __future__ import annotations

import importlib
import pkgutil

from .sources.views import oracle, view

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, *inputs: str, sql: str | None = None):
    """Register a function of the named input DataFrames as a query."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, i) for i in inputs])
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def _load():
    from . import plans

    for m in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"{plans.__name__}.{m.name}")


_load()
