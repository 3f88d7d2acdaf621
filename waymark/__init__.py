"""Lifecycle-event analytics on Spark DataFrames."""

from .spec import LifecycleSpec

__all__ = ["LifecycleSpec"]
