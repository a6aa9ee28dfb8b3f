"""All queries of the analytics operators, and the SQL that each must agree with where SQL can express it."""

from __future__ import annotations

import importlib

#: Modules with QUERIES and ORACLES.
MODULES = [
    "verbarium.operators.profile",
    "verbarium.operators.ranking",
    "verbarium.operators.cooccurrence",
    "verbarium.operators.comparison",
    "verbarium.operators.statistics",
    "verbarium.operators.networks",
    "verbarium.operators.agreement",
    "verbarium.query.evaluate",
    "verbarium.operators.multivariate",
    "verbarium.sources.text",
    "verbarium.plans.analysis",
]


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(importlib.import_module(name).QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for name in MODULES:
        out.update(importlib.import_module(name).ORACLES)
    return out
