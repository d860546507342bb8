"""The planning-domain queries by name, and their oracle SQL."""

from . import boundary_queries, context_queries, document_queries, register_queries, shape_queries, space_queries, stream_queries, text_queries, value_queries

MODULES = (boundary_queries, context_queries, document_queries, text_queries, register_queries, space_queries, value_queries, stream_queries, shape_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
