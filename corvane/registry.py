"""The queries of the operators outside the training-data subpackage, and their SQL."""

from corvane.plans.queries import FLAGSHIP, ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
