"""Named queries over the test tables, each with the SQL that checks it where SQL can express it."""

from helixbag.catalog import cohorts, files, knockouts, learned, scores, sequences  # noqa: F401
from helixbag.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
