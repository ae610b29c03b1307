"""All queries of the library, by name, with their SQL where it can be said in SQL."""

from placeloom.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
