"""Registered queries and their SQL."""

from . import items, library, listing, retrieval, scholarly, usage

_MODULES = [usage, retrieval, items, library, listing, scholarly]
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE: dict = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
