"""Name -> (query, SQL twin) for the training-data operators."""

from __future__ import annotations

from tesserix.llm import queries as _queries

QUERIES = _queries.QUERIES
ORACLES = _queries.ORACLES
