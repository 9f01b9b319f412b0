"""Shared folders, tables that cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut, shared_base, shared_dir

__all__ = ["BROADCAST_IDS", "cut", "free", "release", "semi_by_id", "shared_base", "shared_dir"]

#: Rows of at most this many ids are sent to every executor; more are shuffled.
BROADCAST_IDS = 500_000


def semi_by_id(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``key`` is (``left_semi``) or is not (``left_anti``) in ``ids``, which has its columns.

    The ids go to all executors only if their counted number is at most ``BROADCAST_IDS`` (a few numbers each);
    otherwise both sides are shuffled.
    """
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, how)


def free(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores at its end, so that ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs left behind.

    Spark removes shuffle files and broadcasts of plans that nothing refers to any more, but only after the
    driver's garbage collection found that out; between long steps it is asked to look.
    """
    gc.collect()
    spark._jvm.System.gc()
