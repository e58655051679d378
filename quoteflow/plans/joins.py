"""Join helpers: broadcast only behind a size check, shuffle join otherwise.

A side is broadcast when a bounded count proves it has at most ``max_rows``
rows; the counted side is persisted so the join does not recompute it.
Beyond the bound the join is left to the planner (sort-merge or shuffle hash),
and AQE may still switch it to a broadcast from real shuffle statistics or
split skewed partitions.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a broadcast side may have (a few tens of MB of narrow rows).
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000


_PERSISTED: list[DataFrame] = []


def release_cached() -> None:
    """Unpersist the small sides cached by size checks (call after a query's
    results are consumed; a later use recomputes them)."""
    while _PERSISTED:
        _PERSISTED.pop().unpersist()


def cache_small(df: DataFrame) -> DataFrame:
    """Persist a small, bounded DataFrame read by several branches and
    register it for ``release_cached``."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _PERSISTED.append(df)
    return df


def bounded(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Persist ``df`` and report whether it has at most ``max_rows`` rows.

    ``limit(max_rows + 1).count()`` stops reading once the bound is passed.
    The cached side is registered for ``release_cached``."""
    df = cache_small(df)
    n = df.limit(max_rows + 1).count()
    return df, n <= max_rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    small, ok = bounded(small, max_rows)
    return big.join(F.broadcast(small) if ok else small, on, how)


def semi_join_small(big: DataFrame, keys: DataFrame, on,
                    max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    return join_small(big, keys.distinct(), on, "left_semi", max_rows)
