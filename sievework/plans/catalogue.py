"""All queries of the core."""

from sievework.plans import aggregates, entities, graphs, pipelines, quality, ranking, relational, runs, scalars, scores, state  # noqa: F401
from sievework.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
