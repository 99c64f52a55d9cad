"""Ids of files and chunks, and the links between neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stable_uuid(*parts: Column) -> Column:
    """A UUID (version 8 by form) that is the same in every run for the same parts."""
    h = F.sha2(F.concat_ws("\u0001", *parts), 256)
    piece = lambda a, n: F.substring(h, a, n)
    return F.concat(piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-8"), piece(14, 3), F.lit("-a"), piece(18, 3), F.lit("-"), piece(21, 12))


def with_ids(df: DataFrame, file_id: str = "file_id", index: str = "chunk_index") -> DataFrame:
    return df.withColumn("chunk_id", stable_uuid(F.col(file_id), F.col(index).cast("string")))


#: Where documents are cut for windows: at multiples of this of the first order column.
SPAN = 1 << 14


def positions(df: DataFrame, doc: str, order: list[str], amount: Column | None = None, neighbour: str | None = None, span: int = SPAN) -> DataFrame:
    """Adds ``_before``: the sum of ``amount`` (1 a row) over the rows before, and ``_prev``, ``_next``: ``neighbour`` of the rows beside.

    No task holds a whole document: its rows are windowed by the part that
    the first order column, a whole number, falls into, and totals of the
    parts, a row each, are summed up. ``df`` is read twice, the second time
    for these columns only, and must give the same rows.
    """
    amount = F.lit(1) if amount is None else amount
    held = df.withColumn("_part", F.coalesce(F.floor(F.col(order[0]) / span).cast("bigint"), F.lit(-(2**62)))).withColumn("_amount", amount.cast("bigint"))
    name = F.col(neighbour) if neighbour else F.lit(None).cast("string")
    w = W.partitionBy(doc, "_part").orderBy(*order)
    local = held.withColumn("_in", F.coalesce(F.sum("_amount").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    local = local.withColumn("_p", F.lag(name).over(w)).withColumn("_n", F.lead(name).over(w))
    parts = held.groupBy(doc, "_part").agg(F.sum("_amount").alias("_sum"), F.min_by(name, F.struct(*order)).alias("_first"), F.max_by(name, F.struct(*order)).alias("_last"))
    whole = W.partitionBy(doc).orderBy("_part")
    parts = parts.select(
        F.col(doc).alias("_doc"), F.col("_part").alias("_at"), F.coalesce(F.sum("_sum").over(whole.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"),
        F.lag("_last").over(whole).alias("_left"), F.lead("_first").over(whole).alias("_right"),
    )
    joined = local.join(parts, F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("_part") == F.col("_at")))
    out = joined.withColumn("_before", F.col("_in") + F.col("_earlier")).withColumn("_prev", F.coalesce("_p", "_left")).withColumn("_next", F.coalesce("_n", "_right"))
    return out.select(*df.columns, "_before", "_prev", "_next")


def numbered(df: DataFrame, doc: str, order: list[str], name: str = "chunk_index", first: int = 0, span: int | None = None) -> DataFrame:
    """Adds the place within the document. With ``span``, documents are cut as in ``positions``; else one task orders a whole document."""
    if span:
        return positions(df, doc, order, span=span).withColumn(name, (F.col("_before") + first).cast("int")).drop("_before", "_prev", "_next")
    return df.withColumn(name, F.row_number().over(W.partitionBy(doc).orderBy(*order)) - 1 + first)


def linked(df: DataFrame, doc: str, order: list[str], end: str | None = "", span: int | None = None) -> DataFrame:
    """Adds ``prev_chunk_id`` and ``next_chunk_id``; ``end`` stands where there is no neighbour. ``span``: see ``numbered``; ids must not be null then."""
    if span:
        side = lambda c: F.coalesce(c, F.lit(end)) if end is not None else F.col(c)
        return positions(df, doc, order, neighbour="chunk_id", span=span).withColumn("prev_chunk_id", side("_prev")).withColumn("next_chunk_id", side("_next")).drop("_before", "_prev", "_next")
    w = W.partitionBy(doc).orderBy(*order)
    return df.withColumn("prev_chunk_id", F.lag("chunk_id", 1, end).over(w)).withColumn("next_chunk_id", F.lead("chunk_id", 1, end).over(w))


def file_style_ids(df: DataFrame, doc: str, order: list[str], span: int | None = None) -> DataFrame:
    """``chunk_id`` as ``<file>-<n>`` from 1, and links that are null at the ends."""
    ids = numbered(df, doc, order, "_n", 1, span)
    name = lambda n: F.concat_ws("-", F.col(doc).cast("string"), n.cast("string"))
    if span:  # neighbours follow from the number, so no second window is needed
        sizes = df.groupBy(F.col(doc).alias("_doc")).agg(F.count("*").alias("_size"))
        known = ids.join(sizes, F.col(doc).eqNullSafe(F.col("_doc"))).drop("_doc")
        n = F.col("_n")
        linked_ = known.withColumn("chunk_id", name(n)).withColumn("prev_chunk_id", F.when(n > 1, name(n - 1))).withColumn("next_chunk_id", F.when(n < F.col("_size"), name(n + 1)))
        return linked_.drop("_n", "_size")
    return linked(ids.withColumn("chunk_id", name(F.col("_n"))), doc, ["_n"], None).drop("_n")


def batch_ids(files: DataFrame, counts: str = "n_chunks", expected: int | None = None) -> DataFrame:
    """``(file_id, chunk_index, chunk_id)`` for files with the given numbers of chunks; ``expected`` files or an error."""
    if expected is not None and files.count() != expected:
        raise ValueError("the number of files and of chunk counts differ")
    rows = files.where(F.col(counts) > 0).select("file_id", F.explode(F.sequence(F.lit(0), F.col(counts).cast("int") - 1)).alias("chunk_index"))
    return with_ids(rows)
