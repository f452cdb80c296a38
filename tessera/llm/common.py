"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.store import shared_dir, written

__all__ = ["SPACES", "column_or_null", "give_back", "id_hash", "shared_dir", "shuffle_width", "small_or_joined", "thinned", "written"]

#: Words are what lies between these characters, wherever a contract says so.
SPACES = "\\x20\\x09-\\x0D"


def id_hash(column: str, buckets: int) -> Column:
    """crc32 of an id's text modulo buckets; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % buckets


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_or_joined(side: DataFrame, rows: int, bound: int) -> DataFrame:
    """side with a broadcast hint if its counted rows are within the bound; else as it is, so that the join shuffles."""
    return F.broadcast(side) if rows <= bound else side


def thinned(df: DataFrame, hashed: Column, n: int, total: int) -> DataFrame:
    """Somewhat more than n of df's rows, about total in all, by a hash: of these an ordered limit then takes n, and little else travels."""
    share = 1.25 * n / max(1, total)
    return df if share >= 1 else df.where(F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30)))


def give_back() -> None:
    """At the end of a task, memory that Python has freed goes back to the system: the worker lives on, for other stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass
