"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import columns, images, metadata, regions

QUERIES = columns.QUERIES | regions.QUERIES | images.QUERIES | metadata.QUERIES
ORACLES = columns.ORACLES | regions.ORACLES | images.ORACLES | metadata.ORACLES
