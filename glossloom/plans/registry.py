"""Queries by name, and DuckDB SQL with the same results."""

from __future__ import annotations

from glossloom.plans import exports, queries, reports, wider

FLAGSHIP = "exact_run_links"
QUERIES = queries.QUERIES | exports.QUERIES | reports.QUERIES | wider.QUERIES
ORACLES = queries.ORACLES | exports.ORACLES | reports.ORACLES | wider.ORACLES
