"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import functools
import importlib
import pkgutil

import plenum.llm
from plenum.llm.common import prepared


def _modules():
    for found in sorted(pkgutil.iter_modules(plenum.llm.__path__), key=lambda m: m.name):
        if found.name != "queries":
            yield importlib.import_module(f"plenum.llm.{found.name}")


def queries() -> dict:
    """Every function named opN_... of the modules here, in the order of N."""
    found = {k: f for m in _modules() for k, f in vars(m).items() if k.startswith("op") and k[2:3].isdigit() and callable(f) and f.__module__ == m.__name__}
    return {k: _shipping(found[k]) for k in sorted(found, key=lambda k: int(k[2:].split("_")[0]))}


def _shipping(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        return query(prepared(spark), sf_dir)

    return run


def oracle_sql() -> dict:
    """The constants ORACLE of the modules here."""
    return {k: sql for m in _modules() for k, sql in getattr(m, "ORACLE", {}).items()}
