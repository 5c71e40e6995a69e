"""All registered queries of the library."""

from __future__ import annotations

from . import boundaries, controls, fingerprints, measures, models, profiles, recovery, selection, transcriptions  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
