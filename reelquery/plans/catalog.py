"""All queries of the engine with the SQL that gives the same rows."""

from __future__ import annotations

from reelquery.plans import boxes, images, layout, text, timeline

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (timeline, boxes, text, images, layout):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
