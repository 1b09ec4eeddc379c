"""Names of columns that an operator adds."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def others(columns: Iterable[str], *made: str) -> list[str]:
    """``columns`` but those of a name in ``made``, in any letter case: an operator's own columns take their place."""
    taken = {m.lower() for m in made}
    return [c for c in columns if c.lower() not in taken]


def aside(df: DataFrame, apply: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """What ``apply`` makes of ``df`` under names that clash with no operator's, back under its own names.

    ``apply`` gets the renamed rows and the new name of each column.
    """
    named = {c: f"__lw_c{i}" for i, c in enumerate(df.columns)}
    made = apply(df.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]), named)
    return made.select(*[F.col(n).alias(c) for c, n in named.items()])
