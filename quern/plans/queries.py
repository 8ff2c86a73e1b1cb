"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from quern.plans import policies, signals, state, streams, vectors

_MODULES = (vectors, policies, streams, signals, state)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
