"""All registered queries of the packet engine, with the SQL that gives the same rows."""

from __future__ import annotations

from flowlake.plans import queries

QUERIES = dict(queries.QUERIES)
ORACLE_SQL = dict(queries.SQL)
