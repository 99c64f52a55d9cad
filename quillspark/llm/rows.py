"""Repeated rows of a table of texts, without sending the texts through a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that may be broadcast.
MOST_IDS = 1_000_000


def once(df: DataFrame, keys: list[str], keep: Callable[[DataFrame], DataFrame] = lambda df: df, id_col: str = "chunk_id") -> DataFrame:
    """Rows of ``df`` that pass ``keep``, of those equal in ``keys`` (which hold the id) one.

    Only ids that stand more than once are compared with their texts; they
    are broadcast if they are few, else joined by shuffle. Null ids are
    compared like any other.
    """
    repeated = df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(F.col(id_col).alias("_id"))
    if repeated.limit(MOST_IDS + 1).count() <= MOST_IDS:
        repeated = F.broadcast(repeated)
    kept = keep(df)
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(keys))
