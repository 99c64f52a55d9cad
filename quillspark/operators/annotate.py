"""Image annotations placed in the chunks of their document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_shuffle

MARKER = r"(?i)<!--\s*image\s*-->|!\[.*?\]\(.*?\)"


def position(text: Column, reference: Column, caption: Column, index: Column) -> Column:
    """Where an annotation stands in the text, from 0: at its reference, else its caption, else the image marker of its number; null if nowhere."""
    by_reference = F.when(reference != "", F.nullif(F.instr(text, reference), F.lit(0)))
    by_caption = F.when(caption != "", F.nullif(F.instr(F.lower(text), F.lower(F.substring(caption, 1, 100))), F.lit(0)))
    marker = F.get(F.regexp_extract_all(text, F.lit(MARKER), F.lit(0)), index)
    before = F.aggregate(
        F.slice(F.split(text, MARKER, -1), F.lit(1), index + 1), F.lit(0), lambda n, x: n + F.length(x)
    ) + F.aggregate(F.slice(F.regexp_extract_all(text, F.lit(MARKER), F.lit(0)), F.lit(1), index), F.lit(0), lambda n, x: n + F.length(x))
    return F.coalesce(by_reference - 1, by_caption - 1, F.when(marker.isNotNull(), before))


#: Characters of a bin of positions, and parts into which the chunks of a document are dealt where texts must be searched.
BIN, PARTS = 1 << 16, 16


def placed(annotations: DataFrame, chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``annotations`` with ``chunk_index`` of the chunk that holds them, null if none.

    ``annotations``: doc, annotation_no, self_ref, caption, pos. ``chunks``:
    doc, chunk_index, content, char_start, char_end. With a position, the
    first chunk whose span holds it; without, the first that holds an image
    marker, the caption's first 50 characters or the reference. Positions
    meet spans by document and bin, searches by document and part, so a
    document with very many chunks is spread over tasks.
    """
    c = F.col
    bin_of = lambda x: F.floor(x / BIN).cast("bigint")
    covered = F.explode(F.sequence(bin_of(c("char_start")), bin_of(F.greatest(c("char_start"), c("char_end") - 1))))
    spans = chunks.where("char_start is not null and char_end is not null").select(doc, "chunk_index", "char_start", "char_end", covered.alias("_bin"))
    ranged = annotations.where("pos is not null").withColumn("_bin", bin_of(c("pos"))).join(spans, [doc, "_bin"]).where((c("char_start") <= c("pos")) & (c("pos") < c("char_end")))
    low = F.lower("content")
    holds = lambda what: F.coalesce(F.contains(low, F.lower(what)) & (what != ""), F.lit(False))
    marked = F.contains(low, F.lit("<!-- image -->")) | F.contains(low, F.lit("!["))
    dealt = chunks.select(doc, "chunk_index", "content", F.pmod(F.xxhash64("chunk_index"), F.lit(PARTS)).alias("_part"))
    sought = annotations.where("pos is null").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    told = by_shuffle(sought).join(dealt, [doc, "_part"]).where(marked | holds(F.substring("caption", 1, 50)) | holds(c("self_ref")))
    keys = [doc, "annotation_no"]
    found = ranged.select(*keys, "chunk_index").unionByName(told.select(*keys, "chunk_index")).groupBy(*keys).agg(F.min("chunk_index").alias("chunk_index"))
    return annotations.join(found, keys, "left")
