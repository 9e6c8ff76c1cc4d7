"""The registered queries of the catalog engine and their DuckDB twins."""

from . import code_plans, search_plans, sync_plans

QUERIES = {**code_plans.QUERIES, **search_plans.QUERIES, **sync_plans.QUERIES}
ORACLE = {**code_plans.ORACLE, **search_plans.ORACLE, **sync_plans.ORACLE}
