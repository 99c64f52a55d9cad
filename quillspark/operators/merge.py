"""Merging of short neighbours: a fold over the ordered chunks of a document.

Whether a chunk is merged depends on what was merged before it. A document's
chunks are cut into runs where no merge can cross (after a chunk that is
long enough by itself, between kinds that never merge); each run is gathered
and folded by ``F.aggregate`` in the JVM. With ``span``, runs are found
without one task seeing a whole document (see ``links.positions``), for
tables in which a document may hold a large share of all rows; without, for
chunks of documents that were single rows a moment ago.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import front_matter, stripped, tokens_by_length, tokens_by_words
from ..session import cut
from .links import positions


def _folded(df: DataFrame, doc: str, order: list[str], parted: Column, fold: Callable[[Column], Column], span: int | None) -> DataFrame:
    """Fold of each run of rows that no merge can cross; ``parted``: whether a row and the next stay apart for certain (reads ``_next_row``)."""
    fields = [x for x in df.columns if x != doc]
    w = W.partitionBy(doc).orderBy(*order)
    if span:
        ends = _ends(df, doc, order, parted, span)
        runs = df.join(ends, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([doc, *order])]).select(*df.columns, "_run")
    else:
        flagged = df.withColumn("_next_row", F.lead(F.struct(*_side(df))).over(w)).withColumn("_apart", F.coalesce(parted, F.lit(False)).cast("bigint"))
        runs = flagged.withColumn("_run", F.coalesce(F.sum("_apart").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_next_row", "_apart")
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("_order"), F.struct(*fields).alias("_row")))), lambda x: x["_row"])
    folded = runs.groupBy(doc, "_run").agg(rows.alias("_rows")).select(doc, "_run", fold(F.col("_rows")).alias("_rows"))
    if span:
        folded = cut(folded)
        first = positions(folded.select(doc, "_run", F.size("_rows").alias("_size")), doc, ["_run"], F.col("_size"), span=span)
        first = first.select(F.col(doc).alias("_doc"), F.col("_run").alias("_at"), "_before")
        placed = folded.join(first, F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("_run") == F.col("_at")))
    else:
        placed = folded.withColumn("_before", F.coalesce(F.sum(F.size("_rows")).over(W.partitionBy(doc).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    each = placed.select(doc, "_before", F.posexplode("_rows").alias("_at", "_row"))
    return each.select(doc, (F.col("_before") + F.col("_at")).cast("int").alias("chunk_index"), "_row.*")


def _side(df: DataFrame) -> list[str]:
    return [c for c in ("section_header", "content_type") if c in df.columns]


def _ends(df: DataFrame, doc: str, order: list[str], parted: Column, span: int) -> DataFrame:
    """Keys of all rows (as ``_k0`` ...) and the run each is in; texts stay where they are."""
    side = F.to_json(F.struct(*_side(df)), {"ignoreNullFields": "false"})
    keys = df.select(doc, *order, side.alias("_side"), *[c for c in ("estimated_tokens", "content", *_side(df)) if c not in order])
    nexts = positions(keys, doc, order, neighbour="_side", span=span)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in _side(df))
    flagged = nexts.withColumn("_next_row", F.from_json("_next", kinds)).withColumn("_apart", F.coalesce(parted, F.lit(False)).cast("bigint")).select(doc, *order, "_apart")
    runs = positions(cut(flagged), doc, order, F.col("_apart"), span=span)
    return runs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([doc, *order])], F.col("_before").alias("_run"))


def merge_short(df: DataFrame, doc: str, order: list[str], most: int, least: int, span: int | None = None, tokens: Callable[[Column], Column] = tokens_by_words) -> DataFrame:
    """Chunks below ``least`` tokens take up what follows them, in the same section and kind or both in front matter.

    The sum of both must be within ``most``; the first one's columns are
    kept. Adds ``chunk_index`` from 0. ``df`` must not have that column.
    """

    c, after = F.col, F.col("_next_row")
    alike = (c("section_header").eqNullSafe(after["section_header"]) & c("content_type").eqNullSafe(after["content_type"])) | (
        front_matter(c("section_header")) & front_matter(after["section_header"]) & (c("content_type") == "prose") & (after["content_type"] == "prose")
    )
    full = F.coalesce((c("estimated_tokens") >= least) & (tokens(c("content")) >= least), F.lit(False))

    def fits(a: Column, b: Column) -> Column:
        same = a["section_header"].eqNullSafe(b["section_header"]) & a["content_type"].eqNullSafe(b["content_type"])
        front = front_matter(a["section_header"]) & front_matter(b["section_header"]) & (a["content_type"] == "prose") & (b["content_type"] == "prose")
        return (a["estimated_tokens"] < least) & (same | front) & (a["estimated_tokens"] + b["estimated_tokens"] <= most)

    def fold(rows: Column) -> Column:
        start = F.struct(F.slice(rows, 1, 0).alias("done"), F.get(rows, F.lit(0)).alias("now"))

        def step(acc: Column, x: Column) -> Column:
            whole = F.concat(acc["now"]["content"], F.lit("\n\n"), x["content"])
            joined = acc["now"].withField("content", whole).withField("estimated_tokens", tokens(whole))
            return F.when(F.coalesce(fits(acc["now"], x), F.lit(False)), F.struct(acc["done"].alias("done"), joined.alias("now"))).otherwise(
                F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), x.alias("now"))
            )

        return F.aggregate(F.slice(rows, F.lit(2), F.size(rows)), start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))

    return _folded(df, doc, order, full | ~F.coalesce(alike, F.lit(False)), fold, span)


def united(first: Column, second: Column) -> Column:
    """Annotations of two chunks; of those with the same reference the first, those without one all."""
    known = lambda pool, a: F.exists(pool, lambda b: b["self_ref"] == a["self_ref"])
    none = lambda a: a["self_ref"].isNull() | (a["self_ref"] == "")
    return F.concat(first, F.filter(second, lambda a, i: none(a) | ~(F.coalesce(known(first, a), F.lit(False)) | F.coalesce(known(F.slice(second, F.lit(1), i), a), F.lit(False)))))


def join_short(df: DataFrame, doc: str, order: list[str], least: int, tokens: Callable[[Column], Column] = tokens_by_length, annotations: str | None = None, span: int | None = None) -> DataFrame:
    """Chunks that are short or only repeat their header go into the chunk after them, whose columns are kept.

    The last chunk of a document always stays. ``annotations`` names an
    array column to be united. Adds ``chunk_index`` from 0.
    """

    def short(x: Column) -> Column:
        header, text = F.coalesce(x["section_header"], F.lit("")), stripped(F.coalesce(x["content"], F.lit("")))
        only = (header != "") & (F.length(text) < F.greatest(F.lit(50), F.length(header) * 2)) & F.contains(F.lower(text), F.lower(stripped(header)))
        return only | (x["estimated_tokens"] < least)

    def fold(rows: Column) -> Column:
        start = F.struct(F.slice(rows, 1, 0).alias("done"), F.get(rows, F.lit(0)).alias("now"))

        def step(acc: Column, x: Column) -> Column:
            whole = stripped(F.concat(stripped(F.coalesce(acc["now"]["content"], F.lit(""))), F.lit("\n\n"), stripped(F.coalesce(x["content"], F.lit("")))))
            joined = x.withField("content", whole).withField("estimated_tokens", tokens(whole))
            if annotations:
                joined = joined.withField(annotations, united(acc["now"][annotations], x[annotations]))
            return F.when(short(acc["now"]), F.struct(acc["done"].alias("done"), joined.alias("now"))).otherwise(
                F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), x.alias("now"))
            )

        return F.aggregate(F.slice(rows, F.lit(2), F.size(rows)), start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))

    text, header = stripped(F.coalesce("content", F.lit(""))), F.coalesce("section_header", F.lit(""))
    full = (F.col("estimated_tokens") >= least) & (tokens(text) >= least) & (F.length(text) >= F.greatest(F.lit(50), F.length(header) * 2))
    return _folded(df, doc, order, F.coalesce(full, F.lit(False)), fold, span)
