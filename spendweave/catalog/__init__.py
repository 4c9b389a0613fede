"""All registered queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = ["text_queries", "list_queries", "report_queries", "family_queries", "merge_queries", "io_queries", "payload_queries", "classify_queries"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"spendweave.catalog.{name}")


def queries():
    from spendweave.catalog.registry import QUERIES

    _load()
    return dict(QUERIES)


def checks():
    from spendweave.catalog.registry import CHECKS

    _load()
    return dict(CHECKS)
