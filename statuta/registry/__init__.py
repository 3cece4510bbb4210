"""Registered queries: operators bound to the given tables."""

from __future__ import annotations

import importlib

from statuta.registry.base import ORACLES, QUERIES

MODULES = ("search", "text", "survey", "rules", "corpus", "answers", "streams")


def load_all():
    for name in MODULES:
        importlib.import_module(f"statuta.registry.{name}")
    return QUERIES, ORACLES
