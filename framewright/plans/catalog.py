"""All queries of the core and their SQL oracles."""

from __future__ import annotations

from framewright.plans import corpora, evidence, inventory, planning, reporting, rules, sequences, sampling_timelines, selecting, skewed_keys, snapshot

FLAGSHIP = "split_coverage"

_MODULES = [reporting, selecting, sampling_timelines, corpora, evidence, inventory, planning, rules, sequences, snapshot, skewed_keys]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
