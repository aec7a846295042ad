"""All queries of the library (without the llm subpackage) and their oracles."""

from __future__ import annotations

from quire.queries import ORACLES, QUERIES, articles, catalog, ingest, language, library, state, structure  # noqa: F401
