"""The pN_ queries: each applies its operator to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from . import history, packing, pii, scan_noise, splitting, text_quality, tokenizing

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.find_noise(_table(spark, folder, "chunks"), _table(spark, folder, "lexicon"))


def p1_text(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.repaired(_table(spark, folder, "chunks"), _table(spark, folder, "lexicon"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality.not_prose(_table(spark, folder, "chunks"), _table(spark, folder, "lexicon"))


def p2_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality.kinds_of_chunks(_table(spark, folder, "chunks"), _table(spark, folder, "lexicon"))


def p2_files(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality.file_statistics(_table(spark, folder, "chunks"), _table(spark, folder, "lexicon"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    _, matches = history.deduplicate(_table(spark, folder, "files"))
    return matches.select(F.least("file_id", "match_id").alias("file_a"), F.greatest("file_id", "match_id").alias("file_b")).distinct()


def p3_files(spark: SparkSession, folder: str) -> DataFrame:
    files, matches = history.deduplicate(_table(spark, folder, "files"))
    compared = history.agreement(matches, _table(spark, folder, "chunks"))
    same = F.array_sort(F.collect_set(F.when(F.col("same_text"), F.col("match_id"))))
    named = compared.groupBy("file_id").agg(F.array_sort(F.collect_set("match_id")).alias("match_ids"), same.alias("same_text_ids"))
    return files.select("file_id", "batch_no", "seq", "accepted").join(named, "file_id", "left")


def p3_batches(spark: SparkSession, folder: str) -> DataFrame:
    _, done = history.judge_all(_table(spark, folder, "files"), counted=True)
    return history.figures(done, spark)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.natural_boundaries(_table(spark, folder, "chunks"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_chunks(_table(spark, folder, "chunks"))


def p4_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.tiling(p4_pieces(spark, folder))


def p4_files(spark: SparkSession, folder: str) -> DataFrame:
    """All contents written out as text files, a few large ones, which are then cut by byte ranges."""
    path = shared_path(spark, "texts")
    contents = _table(spark, folder, "chunks").select(F.coalesce("content", F.lit("")).alias("value"))
    contents.write.text(path)
    pieces = splitting.split_files(spark, path, range_bytes=1 << 18)
    own = F.length("content") - F.col("n_overlap")
    faults = F.count_if((F.col("estimated_tokens") > splitting.LIMIT) | (F.col("end_pos") - F.col("start_pos") != own))
    per_file = pieces.groupBy("path").agg(F.sum(own).alias("n"), faults.alias("faults"), F.max("end_pos").alias("end"), (F.max("piece_no") + 1 - F.countDistinct("piece_no")).alias("gaps"))
    return per_file.agg(F.sum("n").alias("n_chars"), F.sum(F.col("faults") + F.col("gaps") + F.abs(F.col("end") - F.col("n"))).alias("faults"))


def p5_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizing.encode_corpus(_table(spark, folder, "documents"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), _table(spark, folder, "pack_specs"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal(_table(spark, folder, "documents"), _table(spark, folder, "lexicon"))
    return found.select("doc_id", "kind", "start_pos").distinct()


def p7_text(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(_table(spark, folder, "documents"), _table(spark, folder, "lexicon"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_text, p2_found, p2_chunks, p2_files, p3_found, p3_files, p3_batches, p4_found, p4_pieces, p4_tiling, p4_files, p5_ids, p6_containers, p7_found, p7_text)
}

_WS = "[\\t\\n\\v\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_WS_LINE = _WS.replace("\\n", "")

#: The same boundaries from the definition, by splitting whole contents.
_P4 = f"""
WITH big AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE length(content) // 4 > 500),
cut AS (
    SELECT chunk_id,
        list_max(list_transform(regexp_split_to_array(content, '\\n{_WS}*\\n'), lambda x: length(x))) // 4 AS by_paragraph,
        list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) // 4 AS by_line,
        list_max(list_transform(string_split(regexp_replace(content, '([.!?]){_WS_LINE}+', '\\1' || chr(10), 'g'), chr(10)), lambda x: length(x))) // 4 AS by_sentence,
        list_max(list_transform(regexp_split_to_array(content, '{_WS}+'), lambda x: length(x))) // 4 AS by_word
    FROM big
)
SELECT DISTINCT chunk_id, CASE WHEN by_paragraph <= 500 THEN 'paragraph' WHEN by_line <= 500 THEN 'line'
    WHEN by_sentence <= 500 THEN 'sentence' WHEN by_word <= 500 THEN 'word' ELSE 'none' END AS boundary
FROM cut
"""

#: Pieces put together are the contents, and no piece is at fault.
_P4_TILING = "SELECT DISTINCT chunk_id, length(content)::BIGINT AS n_chars, md5(content) AS hash, 0::BIGINT AS faults FROM chunks WHERE length(content) // 4 > 500"
_P4_FILES = "SELECT sum(length(coalesce(content, '')) + 1)::BIGINT AS n_chars, 0::BIGINT AS faults FROM chunks"

SQL: dict[str, str] = {"p4_found": _P4, "p4_tiling": _P4_TILING, "p4_files": _P4_FILES}
