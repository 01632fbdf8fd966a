"""All registered queries and their oracle SQL."""

from __future__ import annotations

from tierlake.plans import catalog, catalog_checks, catalog_dims, catalog_ops
from tierlake.plans.oracle import ORACLE
from tierlake.plans.oracle_checks import ORACLE_CHECKS
from tierlake.plans.oracle_dims import ORACLE_DIMS
from tierlake.plans.oracle_ops import ORACLE_OPS

QUERIES = {**catalog.QUERIES, **catalog_dims.QUERIES, **catalog_ops.QUERIES, **catalog_checks.QUERIES}
ORACLE_SQL = {**ORACLE, **ORACLE_DIMS, **ORACLE_OPS, **ORACLE_CHECKS}
