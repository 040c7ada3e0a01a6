"""Joins of tables that both grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def matched(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` by sorting both, whatever the planner takes their sizes to be.

    It takes them from compressed files and does not count what explode or
    repeat add, so it would gather tables of any size on the driver and send
    them to every task. Tables whose size is bounded need not come here.
    """
    return left.join(right.hint("merge"), on, how)
