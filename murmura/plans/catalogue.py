"""All queries of the library by name, with the SQL that says the same."""

from __future__ import annotations

from murmura.plans import guards, intervals, operations, records, services, speakers, transcripts, vectors

MODULES = (transcripts, guards, intervals, vectors, services, speakers, operations, records)

QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.SQL.items()}
