"""The registered queries and their SQL, gathered from the modules of ``palisade.plans``."""

from __future__ import annotations

from . import detections, exports, feeds, lookups, relational, stored, supply, surfaces

MODULES = (relational, detections, exports, surfaces, supply, stored, lookups, feeds)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
