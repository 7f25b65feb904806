"""Name -> query and name -> oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from . import audits, content, metrics, records, reports, responses, sites, structures

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (content, metrics, sites, audits, records, responses, structures, reports):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
