"""Queries over the library's own operators, with their SQL where SQL can express them on whole tables."""

from tracewright.plans import assessment, bulk, cases, events, incidents, knowledge_base, parsing, retrieval

MODULES = [incidents, parsing, events, retrieval, assessment, bulk, cases, knowledge_base]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
FLAGSHIP = "incidents_by_user"
