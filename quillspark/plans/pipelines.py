"""The pipelines: documents in, scored and linked chunks out.

Chunking is a lazy plan; the search for duplicates runs jobs while it is built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BATCH, LAYOUT, PAGES, SINGLE, Chunking, Parity
from ..functions.fingerprint import as_bits, simhash
from ..functions.text import cleaned_markdown, normalised_layout, stripped, tokens_by_length, tokens_by_quarter, tokens_by_words, without_waste
from ..operators import annotate, block_store, blocks, evaluate, hamming, links, merge, sections, toc
from ..operators.block_store import BlockStore
from ..session import cut


def chunked(
    docs: DataFrame, settings: Chunking = SINGLE, doc: str = "file_id", text: str = "markdown", tokens: Callable[[Column], Column] = tokens_by_words, count: Callable[[str], int] = blocks.words_count
) -> DataFrame:
    """Sections, blocks, pieces, merged short ones, scanner waste removed: one row a chunk, ``chunk_index`` from 0."""
    found = sections.styled_sections(docs.select(doc, text), text).where(stripped(F.col("section_content")) != "")
    pieces = blocks.chunks_of_sections(found, settings.most_tokens, settings.overlap_tokens, settings.split_prose, tokens, count)
    order = ["section_idx", "block_idx", "piece_idx"]
    kept = pieces.select(doc, *order, "content", "content_type", "estimated_tokens", "section_header", "section_level", "parent_section", "top_header")
    merged = merge.merge_short(kept, doc, order, settings.most_tokens, settings.least_tokens, tokens=tokens) if settings.merge_short else links.numbered(kept, doc, order)
    clean = merged.drop(*order).withColumn("content", without_waste(F.col("content"), F.col("content_type")))
    return clean.withColumn("estimated_tokens", tokens(F.col("content")))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.withColumn("file_id", links.stable_uuid(F.col("path"), F.col("seq").cast("string"))) if "file_id" not in docs.columns else docs


def screened(docs: DataFrame, known: DataFrame | None = None, on_duplicate: str = "skip", store: BlockStore | None = None) -> DataFrame:
    """Adds ``simhash``, ``status`` (ok, skipped, failed), ``reason`` and ``matches``; judged in order of ``seq``.

    ``docs``: path, markdown, seq; a null markdown has failed, and so has a
    row with an ``error`` of its converter, which is the reason. ``known``
    holds (file_id, simhash) of earlier runs, all of which count as
    accepted; instead of it ``store`` holds them as block tables, which are
    read by key only, and takes up what is accepted now. ``matches`` are the
    file ids of all accepted before within three bits, empty for none.
    ``on_duplicate='keep'`` marks nothing as skipped.
    """
    marked = cut(_identified(docs).withColumn("simhash", simhash(F.col("markdown"))))
    sound = "markdown is not null and error is null" if "error" in docs.columns else "markdown is not null"
    usable = marked.where(sound).select(F.col("file_id").cast("string").alias("id"), as_bits(F.col("simhash")).alias("fp"), F.col("seq").cast("bigint").alias("seq"))
    if store is not None:
        _, matches = block_store.screened(store, usable)
    else:
        near = known and hamming.entries_of(known.select(F.col("file_id").cast("string").alias("id"), as_bits(F.col("simhash")).alias("fp")))
        _, matches = hamming.judged(usable, near)
    named = matches.groupBy("id").agg(F.array_sort(F.collect_set("match_id")).alias("matches")).withColumnRenamed("id", "file_id")  # accepted within three bits of one: few
    out = marked.join(named, "file_id", "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<string>")))
    broken = F.col("markdown").isNull() if "error" not in docs.columns else F.col("markdown").isNull() | F.col("error").isNotNull()
    status = F.when(broken, "failed").when((F.size("matches") > 0) & F.lit(on_duplicate == "skip"), "skipped").otherwise("ok")
    reason = F.when(status == "failed", F.coalesce("error", F.lit("no text")) if "error" in docs.columns else F.lit("no text")).when(status == "skipped", "duplicate")
    return out.withColumn("status", status).withColumn("reason", reason)


def process(
    docs: DataFrame, mode: str = "batch", known: DataFrame | None = None, on_duplicate: str = "skip", parity: Parity | None = None, settings: Chunking | None = None, store: BlockStore | None = None
) -> tuple[DataFrame, DataFrame]:
    """The main pipeline: (files with status, evaluated and linked chunks).

    ``mode``: ``single`` or ``batch``, which differ in the budget and in
    that only batch joins chunks with the table of contents.
    """
    parity = parity or Parity()
    settings = settings or (SINGLE if mode == "single" else BATCH)
    files = cut(screened(docs, known, on_duplicate, store))
    usable = files.where("status = 'ok'")
    heading_only = mode == "batch" and parity.batch_contents_heading_only
    body = usable.select("file_id", toc.without_contents(F.col("markdown"), heading_only).alias("markdown"))
    chunks = chunked(body, settings)
    if mode == "batch":
        keys = toc.lookup(toc.parsed(usable.select("file_id", toc.contents(F.col("markdown"), heading_only).alias("_toc")), "_toc", "file_id"), "file_id")
        chunks = toc.enriched(chunks, keys, "file_id", empty_matches=parity.empty_header_matches_first_entry)
    judged = evaluate.scored(chunks, fixed_placeholder=not parity.accept_placeholder)
    return files, links.linked(links.with_ids(judged), "file_id", ["chunk_index"])


def results(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(file, status, reason, file_id, chunks)`` of a run."""
    counted = chunks.groupBy("file_id").agg(F.count("*").alias("chunks"))
    status = F.when(F.col("status") == "ok", "success").otherwise(F.col("status"))
    return files.join(counted, "file_id", "left").select(F.col("path").alias("file"), status.alias("status"), "reason", "file_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def status_counts(run: DataFrame) -> DataFrame:
    return run.groupBy("status").agg(F.count("*").alias("n"))


def _levelled(docs: DataFrame, settings: Chunking, split: Callable, tokens: Callable, doc: str) -> DataFrame:
    """Sections of three heading levels, those over the budget split by sentences, with running offsets."""
    found = sections.markdown_sections(docs.select(doc, "markdown"), "markdown", 3)
    text = F.col("section_content")
    parts = found.withColumn("_parts", F.when(tokens(text) <= settings.most_tokens, F.array(text)).otherwise(split(text, settings.most_tokens)))
    each = parts.select(doc, "section_idx", "section_header", "section_level", "parent_section", F.col("char_start").alias("_s"), "_parts", F.posexplode("_parts").alias("piece_idx", "content"))
    start = F.col("_s") + F.aggregate(F.slice("_parts", F.lit(1), F.col("piece_idx")), F.lit(0), lambda n, p: n + F.length(p))
    placed = each.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("content")).drop("_s", "_parts")
    return placed.withColumn("estimated_tokens", tokens(F.col("content")))


def process_layout(docs: DataFrame, annotations: DataFrame | None = None, settings: Chunking = LAYOUT, doc: str = "file_id", normalise: bool = True) -> DataFrame:
    """The layout pipeline: chunks with annotations, verdicts without score, and ids ``<file>-<n>``.

    ``annotations``: doc, annotation_no, self_ref, caption, descriptions.
    """
    text = normalised_layout(F.col("markdown")) if normalise else F.col("markdown")
    ready = docs.select(doc, text.alias("markdown"))
    order = ["section_idx", "piece_idx"]
    pieces = links.numbered(_levelled(ready, settings, blocks.split_sentences_hard, tokens_by_length, doc), doc, order, "orig_index", 1)
    kind = "array<struct<self_ref:string,caption:string,descriptions:array<string>>>"
    if annotations is None:
        pieces = pieces.withColumn("image_annotations", F.array().cast(kind))
    else:
        found = annotations.join(ready, doc).withColumn("pos", annotate.position(F.col("markdown"), F.col("self_ref"), F.col("caption"), F.col("annotation_no"))).drop("markdown")
        spans = pieces.select(doc, F.col("orig_index").alias("chunk_index"), "content", "char_start", "char_end")
        put = annotate.placed(found, spans, doc).where("chunk_index is not null")
        held = put.groupBy(doc, F.col("chunk_index").alias("orig_index")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("annotation_no", F.struct("self_ref", "caption", "descriptions").alias("a")))), lambda x: x["a"]).alias("image_annotations")
        )
        pieces = pieces.join(held, [doc, "orig_index"], "left").withColumn("image_annotations", F.coalesce("image_annotations", F.array().cast(kind)))
    joined = merge.join_short(pieces.drop("char_start", "char_end"), doc, order, settings.least_tokens, tokens_by_length, "image_annotations").drop(*order)
    return links.file_style_ids(evaluate.layout_scored(joined), doc, ["chunk_index"])


def process_pages(docs: DataFrame, settings: Chunking = PAGES, doc: str = "file_id") -> DataFrame:
    """The page-loader pipeline: cleaned markdown, chunks joined forward, ids from 1 with document metadata."""
    clean = docs.withColumn("markdown", cleaned_markdown(F.col("markdown")))
    order = ["section_idx", "piece_idx"]
    pieces = _levelled(clean, settings, blocks.split_sentences_sum, tokens_by_quarter, doc).drop("char_start", "char_end")
    joined = merge.join_short(pieces, doc, order, settings.least_tokens, tokens_by_quarter).drop(*order)
    ids = joined.withColumn("chunk_id", (F.col("chunk_index") + 1).cast("string"))
    linked = links.linked(ids, doc, ["chunk_index"], None)
    extra = [c for c in docs.columns if c not in linked.columns and c != "markdown"]
    return linked.join(docs.select(doc, *extra), doc) if extra else linked
