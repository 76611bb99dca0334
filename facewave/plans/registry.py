"""All registered queries outside the training-data operators."""

from __future__ import annotations

from facewave.plans import frame_queries, stream_queries, study_queries

MODULES = (frame_queries, study_queries, stream_queries)


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.ENTRIES.items() if sql}
