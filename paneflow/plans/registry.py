"""All queries of the core and their SQL."""

from __future__ import annotations

from paneflow.plans import general, reference, reference_sql


def queries() -> dict:
    return {**reference.QUERIES, **general.QUERIES}


def oracle_sql() -> dict:
    return {**reference_sql.SQL, **general.SQL}
