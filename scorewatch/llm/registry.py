"""Queries and SQL of this subpackage by name."""

from __future__ import annotations

from scorewatch.llm import chat, huffman, jaccard, mtree, packing, pieces, privacy, quality, sharding, spelling, tokencounts, urls, whitening

_MODULES = (mtree, huffman, quality, pieces, jaccard, packing, sharding, urls, privacy, chat, spelling, tokencounts, whitening)


def _entries(attribute: str) -> dict:
    out = {}
    for m in _MODULES:
        out.update(getattr(m, attribute))
    return out


def queries() -> dict:
    return _entries("QUERIES")


def oracle_sql() -> dict:
    return _entries("ORACLE")
