"""Collects the registered queries from every plan module."""

from __future__ import annotations


def _load():
    from . import queries  # noqa: F401  (registers on import)
    from . import queries_ml  # noqa: F401
    from . import queries_text  # noqa: F401
    from . import queries_models  # noqa: F401
    return queries.QUERIES, queries.ORACLE


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
