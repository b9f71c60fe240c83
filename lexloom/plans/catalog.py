"""All queries of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import corpus, edits, events, files, game, ranking, records, state, storage, terms  # noqa: F401  (each registers its queries)
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

# The stream gives what the log at rest gives.
ORACLE_SQL["stream_chance_accumulator"] = ORACLE_SQL["chance_accumulator"]
