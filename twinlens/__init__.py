"""Two-sample analytics on Spark: which columns make two samples differ, and which rows show it."""

from .model import TwoSample

__all__ = ["TwoSample"]
