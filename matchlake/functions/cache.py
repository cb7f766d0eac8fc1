"""Reuse of column expressions that do not depend on their arguments' data."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext


def once_per_jvm(build: Callable) -> Callable:
    """Build an expression once and hand out the same one for every query.

    Expressions with long word lists take the driver longer to build than to run on
    small tables.  A column is a description, free of data and session.
    """
    kept: dict = {}

    @functools.wraps(build)
    def get(*args):
        key = (id(SparkContext._gateway), args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]
    return get
