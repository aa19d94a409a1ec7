"""Plans: the operators applied to the given tables, each with SQL of the same result where SQL can express it."""

from . import files, live, merging, pages, references, scalars  # noqa: F401
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
