"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("jaccard", "mixing", "tokenstore", "langid", "pii", "decontaminate", "sharding", "url_filter", "suffix_dedup", "vector_dedup", "packing", "merkle", "collocations")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _m = import_module(f"{__package__}.{_name}")
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
