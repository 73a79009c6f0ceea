"""Queries and SQL oracles of the language-model data operators."""

from __future__ import annotations

from framewright.llm import balanced, canonical, grouped_splits, leaks, mixing, neighbours, overlap, readability

_MODULES = [overlap, neighbours, grouped_splits, canonical, mixing, balanced, readability, leaks]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
