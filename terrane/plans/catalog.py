"""All queries of the library over the standard tables, with the SQL that gives the same rows."""

from __future__ import annotations

from terrane.plans import associations, bagplans, checks, features, inferences, models, samples, scores, spaces, times, zones
from terrane.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for module in (associations, bagplans, checks, features, inferences, models, samples, scores, spaces, times, zones):
    QUERIES |= module.C.queries
    ORACLES |= module.C.oracles
