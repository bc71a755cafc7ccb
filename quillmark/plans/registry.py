"""Assembles the query registry and the SQL twins from their modules."""
from __future__ import annotations

import functools

from ..session import release


def _fresh(fn):
    """A query starts by releasing what this package persisted for an earlier one."""
    @functools.wraps(fn)
    def run(spark, sf_dir):
        release()
        return fn(spark, sf_dir)
    return run


def all_queries():
    from . import experiments, flagship, queries_more, sources_queries  # noqa: F401  (registration side effects)
    from .queries import REGISTRY

    return {k: _fresh(v) for k, v in REGISTRY.items()}


def all_oracles():
    from . import oracle_more  # noqa: F401  (registration side effects)
    from .oracle import ORACLE

    names = all_queries()
    return {k: v for k, v in ORACLE.items() if k in names}
