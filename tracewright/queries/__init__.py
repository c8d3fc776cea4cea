"""Queries over the shared tables, each a thin use of an operator, with their SQL counterparts."""

from tracewright.queries import conversations, economy, graph, misc, text

PARTS = (conversations, economy, graph, text, misc)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
