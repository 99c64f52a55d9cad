"""Sources: text files, converted files, and the tables of earlier runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import path_parts

FILES_SCHEMA = (
    "file_id string, file_path string, file_name string, simhash string, format string, title string, author string, subject string, keywords string, "
    "creator string, producer string, creation_date string, mod_date string, trapped string, encryption string, processed_at string, content_length bigint"
)
CHUNKS_SCHEMA = (
    "chunk_id string, file_id string, chunk_index int, content string, section_header string, parent_section string, top_header string, content_type string, "
    "estimated_tokens int, prev_chunk_id string, next_chunk_id string, created_at string, quality_score double, eval_content_type string, eval_reason string, should_use boolean"
)
CONVERTED = "markdown string, metadata map<string,string>, formulas array<string>, code_blocks array<string>, annotations array<struct<self_ref:string,caption:string,descriptions:array<string>>>, error string"
SUFFIXES = (".pdf", ".txt")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, markdown)`` of whole UTF-8 files, each one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))


def dispatched(df: DataFrame) -> DataFrame:
    """Adds ``file_name``, ``suffix`` and ``error`` (null where the suffix is known); no exception is raised."""
    parts = path_parts(F.col("path"))
    named = df.withColumn("_p", parts).select("*", F.col("_p.name").alias("file_name"), F.col("_p.suffix").alias("suffix")).drop("_p")
    return named.withColumn("error", F.when(~F.coalesce(F.col("suffix").isin(*SUFFIXES), F.lit(False)), F.concat(F.lit("Unsupported file type: "), F.coalesce("suffix", F.lit("")))))


def converted_files(spark: SparkSession, path: str, convert: Callable[[str, bytes], dict], pattern: str = "*.pdf") -> DataFrame:
    """``(path, markdown, metadata, formulas, code_blocks, annotations, error)`` of binary files.

    ``convert(path, bytes)`` returns any of these fields; converters are not
    part of this library. A failing file gives a row with its error.
    """
    fields = ["markdown", "metadata", "formulas", "code_blocks", "annotations"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    got = convert(name, bytes(content))
                    rows.append((name, *[got.get(f) for f in fields], None))
                except Exception as e:
                    rows.append((name, *[None] * len(fields), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", *fields, "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, {CONVERTED}")


def primary_descriptions(df: DataFrame) -> DataFrame:
    """One row for each annotation: ``annotation_no`` (from 0), self_ref, caption, descriptions, primary_description (the first)."""
    each = df.select(*[c for c in df.columns if c != "annotations"], F.posexplode("annotations").alias("annotation_no", "a"))
    return each.select(*[c for c in df.columns if c != "annotations"], "annotation_no", "a.*").withColumn("primary_description", F.get("descriptions", F.lit(0)))


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', mode="PERMISSIVE")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def files_csv(spark: SparkSession, path: str) -> DataFrame:
    """The table of files of earlier runs; no row where the path does not exist. Empty cells read as null."""
    return _csv(spark, path, FILES_SCHEMA)


def chunks_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, CHUNKS_SCHEMA)


def known_fingerprints(files: DataFrame) -> DataFrame:
    """``(file_id, simhash)`` of the files that have both."""
    return files.where("file_id != '' and simhash != ''").select("file_id", "simhash")


def row_count(df: DataFrame) -> int:
    return df.count()


def enrichment_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(chunk_id, chunk_text, metadata)`` of a log whose JSON objects stand one a line among other text."""
    inner = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("TAGS", "QUESTIONS", "ANSWERS")])
    schema = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("chunk_text", T.StringType()), T.StructField("metadata", inner)])
    lines = spark.read.text(path).where(F.col("value").startswith("{"))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*").where("chunk_id is not null")


def question_pairs(enrichment: DataFrame) -> DataFrame:
    """``(chunk_id, pair_no, question, answer)`` by position; null where one array is shorter, no row where both are null or empty."""
    pairs = F.arrays_zip(F.coalesce("metadata.questions", F.array().cast("array<string>")).alias("question"), F.coalesce("metadata.answers", F.array().cast("array<string>")).alias("answer"))
    return enrichment.select("chunk_id", F.posexplode(pairs).alias("pair_no", "p")).select("chunk_id", "pair_no", F.col("p.question").alias("question"), F.col("p.answer").alias("answer"))


