"""Catalogue of named queries and their DuckDB counterparts."""

from . import catalogue_checks, catalogue_docx, catalogue_knowledge, catalogue_lines, catalogue_python, catalogue_references, catalogue_review, catalogue_rules, catalogue_stages, catalogue_structure, catalogue_text  # noqa: F401  they register their queries
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
