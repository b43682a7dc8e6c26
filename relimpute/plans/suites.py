"""All registered queries."""

from __future__ import annotations

from relimpute.plans import suite_impute, suite_paths, suite_tables, suite_vectors
from relimpute.plans.registry import Query

SUITES = (suite_tables.suite, suite_paths.suite, suite_vectors.suite, suite_impute.suite)


def all_queries() -> dict[str, Query]:
    return {name: query for suite in SUITES for name, query in suite.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: text for suite in SUITES for name, text in suite.sql.items()}
