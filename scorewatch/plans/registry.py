"""Imports every query module so their `register` calls run, then exposes the catalogue."""

from __future__ import annotations

import importlib

from scorewatch.plans.catalog import ORACLE, QUERIES

_MODULES = (
    "scorewatch.plans.q_metrics",
    "scorewatch.plans.q_drift",
    "scorewatch.plans.q_basic",
    "scorewatch.plans.q_features",
    "scorewatch.plans.q_ensemble",
    "scorewatch.plans.q_stream",
    "scorewatch.plans.q_train",
)


def _load():
    for m in _MODULES:
        importlib.import_module(m)


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
