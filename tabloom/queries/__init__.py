"""Registered queries of the engine's own operators and their SQL twins."""

from tabloom.queries import catalog_queries, database_queries, engine_queries, profile_queries, workload_queries

_PARTS = (profile_queries, catalog_queries, engine_queries, workload_queries, database_queries)
QUERIES: dict = {n: q for part in _PARTS for n, q in part.Q.items()}
ORACLES: dict = {n: q for part in _PARTS for n, q in part.O.items()}
