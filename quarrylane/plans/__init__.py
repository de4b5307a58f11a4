"""Queries over the test tables."""

from . import queries  # noqa: F401
from . import classify_queries, document_queries, extract_queries, job_queries, record_queries, workbook_queries  # noqa: F401
