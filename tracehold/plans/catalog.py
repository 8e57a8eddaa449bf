"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from tracehold.plans import detections, evaluation, evidence, intake, proofs, signing, streams, surface, verdicts  # noqa: F401  (they register their queries)
from tracehold.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
