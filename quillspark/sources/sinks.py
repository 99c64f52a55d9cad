"""Sinks: the linked tables of files and chunks, and exports of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_label
from ..operators.links import linked

#: Columns of the table of files that come from a file's metadata, by the metadata's own names.
META = {
    "format": "format", "title": "title", "author": "author", "subject": "subject", "keywords": "keywords", "creator": "creator", "producer": "producer",
    "creation_date": "creationDate", "mod_date": "modDate", "trapped": "trapped", "encryption": "encryption",
}
EXPORT = ("chunk_id", "content", "section_header", "parent_section", "estimated_tokens", "prev_chunk_id", "next_chunk_id")


def files_table(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """The 17 columns of the table of files; missing metadata as ``''``, missing encryption as the text ``None``."""
    held = {c: F.coalesce(F.element_at(F.col(metadata), k), F.lit("None" if c == "encryption" else "")).alias(c) for c, k in META.items()}
    return df.select(
        "file_id", F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "simhash", *held.values(),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("processed_at"), F.length("markdown").cast("bigint").alias("content_length"),
    )


def chunks_table(df: DataFrame) -> DataFrame:
    """The 16 columns of the table of chunks, with links; unscored chunks are usable."""
    e = F.col("evaluation")
    rows = linked(df, "file_id", ["chunk_index"])
    return rows.select(
        "chunk_id", "file_id", "chunk_index", "content", "section_header", "parent_section", "top_header", "content_type", "estimated_tokens", "prev_chunk_id", "next_chunk_id",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"), e["quality_score"].alias("quality_score"),
        e["content_type"].alias("eval_content_type"), e["reason"].alias("eval_reason"), F.coalesce(e["should_use"], F.lit(True)).alias("should_use"),
    )


def append(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Add rows to a table of files or chunks; CSV with a head line, quotes doubled."""
    writer = df.write.mode("append")
    if form == "csv":
        writer.csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        writer.format(form).save(path)


def save_chunks(df: DataFrame, path: str, formats: tuple[str, ...] = ("jsonl",), title: str = "document_title") -> list[str]:
    """Write chunks as ``jsonl``, ``json`` (one array a file), ``text`` and ``indiv`` (a file each); returns the formats written.

    Unknown formats are left out, case does not matter. Arrays and joined
    texts are made per ``file_id``, so none holds more than one document.
    """
    known = [f for f in dict.fromkeys(x.lower() for x in formats) if f in ("jsonl", "json", "text", "indiv")]
    label = file_label(F.col(title)) if title in df.columns else F.lit("document")
    rows = df.select("file_id", "chunk_index", label.alias("_label"), *[c if c in df.columns else F.lit(None).cast("string").alias(c) for c in EXPORT])
    comment = F.concat(F.lit("<!-- Chunk "), F.col("chunk_index") + 1, F.lit(" | "), F.coalesce("section_header", F.lit("")), F.lit(" -->\n\n"), F.col("content"))
    in_order = lambda x: F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", x.alias("x")))), lambda r: r["x"])
    for form in known:
        to = f"{path}/{form}"
        if form == "jsonl":
            rows.drop("file_id", "chunk_index", "_label").write.mode("overwrite").json(to)
        elif form == "json":
            rows.groupBy("file_id").agg(F.to_json(in_order(F.struct(*EXPORT))).alias("value")).write.mode("overwrite").partitionBy("file_id").text(to)
        elif form == "text":
            rows.groupBy("file_id").agg(F.array_join(in_order(comment), "\n\n---\n\n").alias("value")).write.mode("overwrite").partitionBy("file_id").text(to)
        else:
            number = F.lpad((F.col("chunk_index") + 1).cast("string"), 3, "0")
            name = F.concat_ws("_", F.col("_label"), F.col("file_id"), number)
            rows.select(F.col("content").alias("value"), name.alias("chunk")).write.mode("overwrite").partitionBy("chunk").text(to)
    return known


def save_layout(chunks: DataFrame, docs: DataFrame, path: str) -> list[str]:
    """Markdown and chunks of every document, and formulas, code and annotations where there are any, by file name."""
    docs.select(F.col("markdown").alias("value"), "file_name").write.mode("overwrite").partitionBy("file_name").text(f"{path}/markdown")
    chunks.write.mode("overwrite").partitionBy("file_name").json(f"{path}/chunks")
    written = ["markdown", "chunks"]
    for part in ("formulas", "code_blocks", "annotations"):
        if part in docs.columns:
            rows = docs.where(F.size(F.coalesce(part, F.array().cast(docs.schema[part].dataType))) > 0).select("file_name", F.explode(part).alias("item"))
            if rows.limit(1).count():
                rows.write.mode("overwrite").partitionBy("file_name").json(f"{path}/{part}")
                written.append(part)
    return written
