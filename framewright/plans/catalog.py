"""The queries over the reference's own operators, and their SQL counterparts."""

from __future__ import annotations

from framewright.plans import documents, export, geometry, layout, more, pictures, pixel_art, pose, quality, raster, sequence, sheets, signal, skeleton, store, text

_PARTS = (sequence, signal, layout, text, store, raster, pictures, pose, more, export, documents, quality, sheets, pixel_art, geometry, skeleton)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
