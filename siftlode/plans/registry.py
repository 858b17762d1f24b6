"""All queries of the core, by name."""

from __future__ import annotations

from siftlode.plans import catalog, changes, chunks, graphs, retrieval, syncing

FLAGSHIP = "hybrid_rrf"
_MODULES = (changes, retrieval, chunks, syncing, graphs, catalog)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.oracle_sql().items()}
