"""Macro control flow, decided while the plan is built."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from quarry.operators.merge import stack


def do_over(values: Iterable, body: Callable[..., DataFrame]) -> DataFrame:
    """%DO: one variant of a step for each value, stacked."""
    return stack(*[body(v) for v in values])


def choose(condition: bool, yes: Callable[[], DataFrame], no: Callable[[], DataFrame]) -> DataFrame:
    """%IF: only the chosen branch is ever planned."""
    return yes() if condition else no()
