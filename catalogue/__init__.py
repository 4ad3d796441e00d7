"""The query catalogue: every operator on the given tables, each with SQL that gives the same rows where SQL can."""

from .base import ORACLE, QUERIES
from . import samples, cleaning, statistics, selection, relations, dating, themes, storage, mmd, analysis

__all__ = ["ORACLE", "QUERIES"]
