"""Joins and sums that no key holds in one task, as everywhere in the library."""

from zonalyx.operators.ranges import hot_limit, running, spread_join

__all__ = ["hot_limit", "running", "spread_join"]
