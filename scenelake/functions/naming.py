"""Columns of the user's that are called like an operator's own."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame


def fresh(taken: list[str], name: str) -> str:
    """``name`` with as many letters before it as it takes to be none of ``taken``, in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"x{name}"
    return name


def keeps_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators whose own helper columns begin with an underscore: columns of their first table that do so too
    stand under other names meanwhile, and names of columns among the arguments follow."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        other: dict[str, str] = {}
        for c in [c for c in df.columns if c.startswith("_")]:
            other[c] = fresh([*df.columns, *other.values()], f"kept{c}")
        if not other:
            return operator(df, *args, **kwargs)

        def named(value):
            if isinstance(value, str):
                return other.get(value, value)
            return type(value)(named(v) for v in value) if isinstance(value, list | tuple) else value

        out = operator(df.withColumnsRenamed(other), *map(named, args), **{n: named(v) for n, v in kwargs.items()})
        return out.withColumnsRenamed({new: old for old, new in other.items()})

    return run
