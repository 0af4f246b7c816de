"""All registered queries with their DuckDB SQL."""

from __future__ import annotations

from tidemill.plans import q_contract, q_eda, q_full, q_learned, q_models, q_orders, q_recursion, q_review, q_ridge, q_runlog, q_sealed, q_series, q_space, q_statistics, q_whole
from tidemill.plans.catalogue import QUERIES, SQL

MODULES = (q_series, q_eda, q_runlog, q_models, q_whole, q_full, q_ridge, q_recursion, q_orders, q_sealed, q_statistics, q_learned, q_contract, q_review, q_space)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
