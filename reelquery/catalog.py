"""Registered queries and the SQL that states each of them independently."""

from __future__ import annotations

from reelquery.plans import extra, retrieval, text

QUERIES = retrieval.QUERIES | text.QUERIES | extra.QUERIES
ORACLE_SQL = retrieval.ORACLE_SQL | text.ORACLE_SQL | extra.ORACLE_SQL
