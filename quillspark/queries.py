"""Queries over the tables of files, chunks, contents and documents, and the same in SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .config import BATCH, SINGLE
from .functions import fingerprint, text
from .operators import annotate, blocks, evaluate, hamming, links, merge, sections, toc
from .plans import pipelines
from .session import shared_path
from .sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/chunks.parquet")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/files.parquet")


def _toc(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/toc_entries.parquet")


def _distinct_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk once: its earliest row. Only ids and times are compared, contents travel once."""
    return _chunks(spark, folder).groupBy("chunk_id").agg(F.min_by(F.struct("file_id", "chunk_index", "content", "section_header", "content_type"), "created_at").alias("r")).select("chunk_id", "r.*")


#: White space of Unicode for DuckDB's engine, and stripping by it.
_WS = "[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_US = "[\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_US}+', ''), '{_US}+$', '')"


def _scored_sql(table: str, content: str, header: str, extra: str) -> str:
    terms = " OR ".join(f"contains(head, '{t}')" for t in evaluate.HEADER_TERMS)
    return f"""
    WITH a AS (SELECT {extra}, {_strip(f"coalesce({content}, '')")} AS bare, lower(coalesce({header}, '')) AS head, length(coalesce({header}, '')) AS hl FROM {table}),
    b AS (SELECT *, lower(bare) AS low, length(bare) AS n, CASE WHEN length(bare) = 0 THEN 0 ELSE length(regexp_replace(bare, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length(bare) END AS share,
        string_split(bare, chr(10)) AS ls FROM a),
    c AS (SELECT *, substr(low, 1, 400) AS top, len(list_filter(ls, lambda x: contains(x, '|'))) AS bars,
        len(list_filter(ls, lambda x: regexp_matches({_strip('x')}, '\\.{{3,}}\\s*\\d{{1,4}}(\\s*\\|)?$'))) AS leaders FROM b),
    d AS (SELECT *, CASE
        WHEN n < 30 THEN 1 WHEN {terms} THEN 2 WHEN starts_with(low, 'figure:') OR starts_with(low, 'fig.') THEN 3
        WHEN n < 150 AND regexp_matches(low, 'https?://|www\\.|doi:10\\.\\d{{4,9}}/') THEN 4
        WHEN contains(top, 'copyright') OR contains(top, 'all rights reserved') THEN 5
        WHEN leaders > 3 OR contains(top, 'table of contents') THEN 6
        WHEN regexp_matches(bare, 'def\\s+[\\p{{L}}\\p{{N}}_]+\\(|import\\s+[\\p{{L}}\\p{{N}}_]|class\\s+[\\p{{L}}\\p{{N}}_]+:|const\\s+[\\p{{L}}\\p{{N}}_]+\\s*=|function\\s+[\\p{{L}}\\p{{N}}_]+\\(') THEN 7
        WHEN share < 0.30 AND NOT contains(head, 'contents') AND bars > 5 AND bars::DOUBLE / len(ls) > 0.4 THEN 8 WHEN share < 0.30 THEN 9 ELSE 10 END AS rule FROM c)
    SELECT {extra}, rule IN (7, 8, 10) AS should_use,
        CASE rule WHEN 1 THEN 'Empty or image-only' WHEN 2 THEN 'Header filter: ' || head WHEN 3 THEN 'Forbidden prefix' WHEN 4 THEN 'Citation/Link chunk' WHEN 5 THEN 'Metadata keyword detected'
            WHEN 6 THEN 'Detected Table of Contents' WHEN 7 THEN 'Source code block' WHEN 8 THEN 'Useful data table' WHEN 9 THEN printf('Low alpha (%.2f%%)', share * 100) ELSE 'OK' END AS reason,
        CASE WHEN rule IN (1, 2, 4, 5, 9) THEN 'metadata' WHEN rule = 3 THEN 'other' WHEN rule = 6 THEN 'toc' WHEN rule = 7 THEN 'code' WHEN rule = 8 THEN 'table' ELSE 'main_content' END AS content_type,
        CASE rule WHEN 7 THEN 85 WHEN 8 THEN 70 WHEN 9 THEN 20 WHEN 10 THEN least(100, 50 + CASE WHEN n BETWEEN 400 AND 1200 THEN 25 WHEN n BETWEEN 200 AND 2000 THEN 10 ELSE 0 END
            + CASE WHEN share > 0.75 THEN 15 ELSE 0 END + CASE WHEN regexp_matches(bare, '^\\p{{Lu}}') AND regexp_matches(bare, '[.!?]$') THEN 10 ELSE 0 END + CASE WHEN hl > 3 THEN 5 ELSE 0 END) ELSE 0 END::DOUBLE AS quality_score
    FROM d"""


_EVALUATED = _scored_sql("chunks", "content", "section_header", "chunk_id, created_at")


@_query(
    f"""WITH v AS ({_scored_sql("documents", "text", "NULL::VARCHAR", "doc_id, source")})
    SELECT v.source, count(*) AS total, count(*) FILTER (should_use) AS accepted, count(*) FILTER (NOT should_use) AS rejected, count(*) FILTER (should_use) * 100.0::DOUBLE / count(*) AS acceptance_rate,
        coalesce(round(avg(CASE WHEN should_use THEN quality_score END), 2), 0.0) AS average_quality_score FROM v GROUP BY v.source"""
)
def quality_by_source(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", "source", "text").withColumn("section_header", F.lit(None).cast("string"))
    return evaluate.verdict_totals(evaluate.scored(docs, "text"), "source")


@_query(_EVALUATED)
def eval_p1(spark: SparkSession, folder: str) -> DataFrame:
    judged = evaluate.scored(_chunks(spark, folder).select("chunk_id", "created_at", "content", "section_header"))
    return judged.select("chunk_id", "created_at", "evaluation.*")


@_query(
    f"""WITH v AS ({_EVALUATED}) SELECT count(*) AS total, count(*) FILTER (should_use) AS accepted, count(*) FILTER (NOT should_use) AS rejected,
    count(*) FILTER (should_use) * 100.0::DOUBLE / count(*) AS acceptance_rate, coalesce(round(avg(CASE WHEN should_use THEN quality_score END), 2), 0.0) AS average_quality_score FROM v"""
)
def eval_p1_stats(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.verdict_totals(evaluate.scored(_chunks(spark, folder).select("content", "section_header")))


@_query(f"WITH v AS ({_EVALUATED}) SELECT reason, count(*) AS n FROM v WHERE NOT should_use GROUP BY reason")
def eval_reason_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.reason_counts(evaluate.scored(_chunks(spark, folder).select("content", "section_header")))


@_query(f"WITH v AS ({_EVALUATED}) SELECT content_type, count(*) AS n FROM v GROUP BY content_type")
def eval_content_type_dist(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.type_counts(evaluate.scored(_chunks(spark, folder).select("content", "section_header")))


@_query(
    f"""WITH v AS ({_EVALUATED}), t AS (SELECT count(*)::DOUBLE AS total, (count(*) FILTER (should_use))::DOUBLE AS accepted, (count(*) FILTER (NOT should_use))::DOUBLE AS rejected,
        count(*) FILTER (should_use) * 100.0::DOUBLE / count(*) AS acceptance_rate, coalesce(round(avg(CASE WHEN should_use THEN quality_score END), 2), 0.0) AS average_quality_score FROM v)
    SELECT 'total' AS part, name, value FROM (UNPIVOT t ON total, accepted, rejected, acceptance_rate, average_quality_score INTO NAME name VALUE value)
    UNION ALL SELECT 'reason', reason, count(*)::DOUBLE FROM v WHERE NOT should_use GROUP BY reason UNION ALL SELECT 'content_type', content_type, count(*)::DOUBLE FROM v GROUP BY content_type"""
)
def eval_p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.verdict_report(evaluate.scored(_chunks(spark, folder).select("content", "section_header")))


@_query(f"WITH v AS ({_EVALUATED}) SELECT chunk_id, created_at FROM v WHERE should_use")
def filter_accepted(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.evaluate_and_keep(_chunks(spark, folder).select("chunk_id", "created_at", "content", "section_header")).select("chunk_id", "created_at")


@_query(f"WITH v AS ({_EVALUATED}) SELECT chunk_id, created_at FROM v WHERE NOT should_use")
def filter_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.refused(evaluate.scored(_chunks(spark, folder).select("chunk_id", "created_at", "content", "section_header"))).select("chunk_id", "created_at")


def _layout_sql() -> str:
    case = lambda marks, of, say: " ".join(f"WHEN {of.format(m)} THEN '{say} ''{m}'''" for m in marks)
    return f"""
    WITH a AS (SELECT chunk_id, created_at, {_strip("coalesce(content, '')")} AS bare, lower(coalesce(section_header, '')) AS head FROM chunks),
    b AS (SELECT *, lower(bare) AS low, substr(lower(bare), 1, 400) AS top, length(bare) AS n, string_split(bare, chr(10)) AS ls,
        CASE WHEN length(bare) = 0 THEN 0 ELSE length(regexp_replace(bare, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length(bare) END AS share FROM a),
    c AS (SELECT *, CASE {case(evaluate.LAYOUT_HEADER_TERMS, "contains(head, '{}')", 'Header contains')}
        WHEN n < 30 OR low = '<!-- image -->' THEN 'Empty or image-only' {case(evaluate.LAYOUT_PREFIXES, "starts_with(low, '{}')", 'Starts with')}
        {case(evaluate.LAYOUT_MARKS, "contains(top, '{}')", 'Contains')}
        WHEN len(list_filter(ls, lambda x: regexp_matches({_strip('x')}, '\\.{{3,}}\\s*\\d{{1,4}}$'))) > 3 OR contains(top, 'table of contents') THEN 'Detected Table of Contents'
        WHEN share < 0.30 AND NOT contains(head, 'contents') AND len(list_filter(ls, lambda x: contains(x, '|'))) > 5 AND head NOT IN ('', '##', '###') THEN 'Useful data table'
        WHEN share < 0.30 THEN 'Low alphabetic content' ELSE 'OK' END AS reason FROM b)
    SELECT chunk_id, created_at, reason IN ('Useful data table', 'OK') AS should_use, reason,
        CASE WHEN reason = 'OK' THEN 'main_content' WHEN reason = 'Useful data table' THEN 'table' WHEN starts_with(reason, 'Starts with') THEN 'other' WHEN reason = 'Detected Table of Contents' THEN 'toc' ELSE 'metadata' END AS content_type
    FROM c"""


@_query(_layout_sql())
def eval_p2(spark: SparkSession, folder: str) -> DataFrame:
    judged = evaluate.layout_scored(_chunks(spark, folder).select("chunk_id", "created_at", "content", "section_header"))
    return judged.select("chunk_id", "created_at", "evaluation.*").drop("quality_score")


@_query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE length(regexp_replace(text, '[^\\p{L}]', '', 'g'))::DOUBLE / length(text) END AS alpha_ratio FROM documents")
def alpha_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", text.letter_share(F.col("text")).alias("alpha_ratio"))


@_query(
    f"""SELECT doc_id, greatest(1, (len(list_filter(regexp_split_to_array(text, '{_US}+'), lambda x: x <> '')) * 13) // 10)::INTEGER AS by_words,
    (CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END)::INTEGER AS by_length, (length(text) // 4)::INTEGER AS by_quarter FROM documents"""
)
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return _documents(spark, folder).select("doc_id", text.tokens_by_words(t).alias("by_words"), text.tokens_by_length(t).alias("by_length"), text.tokens_by_quarter(t).alias("by_quarter"))


@_query(f"SELECT doc_id, {oracles.STYLE} AS style FROM documents")
def header_style(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", text.heading_style(F.col("text")).alias("style"))


@_query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, line_no, {_strip('line')} AS bare FROM l)
    SELECT doc_id, line_no::INTEGER AS line_no, list_transform(string_split(rtrim(regexp_extract(bare, '^(\\d+(?:\\.\\d+)*\\.?)\\s+(.+)$', 1), '.'), '.'), lambda p: coalesce(try_cast(p AS INTEGER)::VARCHAR, '?')).array_to_string('.') AS levels,
        regexp_extract(bare, '^(\\d+(?:\\.\\d+)*\\.?)\\s+(.+)$', 2) AS title FROM s WHERE regexp_matches(bare, '^\\d+(?:\\.\\d+)*\\.?\\s+[^\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]+$')"""
)
def numeric_headings(spark: SparkSession, folder: str) -> DataFrame:
    lines = _documents(spark, folder).select("doc_id", F.posexplode(text.text_lines(F.col("text"))).alias("line_no", "line"))
    parsed = lines.select("doc_id", "line_no", text.numbered_heading(F.col("line")).alias("h")).where("h is not null")
    levels = F.array_join(F.transform("h.levels", lambda x: x.cast("string")), ".", "?")
    return parsed.select("doc_id", "line_no", levels.alias("levels"), "h.title")


@_query(oracles.SENTENCE_COUNTS)
def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    n = F.when(F.col("text").isNotNull(), F.size(text.sentences(F.col("text"))))
    return _documents(spark, folder).select("doc_id", n.alias("n_sentences"))


@_query(oracles.NORMALIZE_MD)
def normalize_md(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", text.normalised_layout(F.col("text")).alias("markdown"))


@_query(oracles.CLEAN_MD)
def clean_md(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", text.cleaned_markdown(F.col("text")).alias("markdown"))


@_query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[|\\-\\t\\n\\x0b\\f\\r ]+$')), chr(10)) AS markdown FROM documents")
def clean_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", text.without_rule_lines(F.col("text")).alias("markdown"))


@_query(oracles.LINE_NOISE)
def line_noise_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = _chunks(spark, folder).select("chunk_id", "created_at", text.without_waste(F.col("content"), F.col("content_type")).alias("content"))
    return rows.withColumn("estimated_tokens", text.tokens_by_words(F.col("content")))


@_query("SELECT chunk_id, created_at, upper(trim(coalesce(section_header, ''))) IN ('', 'ARTICLE HISTORY', 'ABSTRACT', 'KEYWORDS', 'AUTHOR INFORMATION') AS front_matter FROM chunks")
def front_matter_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("chunk_id", "created_at", text.front_matter(F.col("section_header")).alias("front_matter"))


@_query(
    """SELECT file_id, seq, regexp_extract(file_path, '[^/]*$') AS file_name, lower(regexp_extract(file_path, '[^/.](\\.[^./]+)$', 1)) AS suffix,
    lower(regexp_extract(file_path, '[^/.](\\.[^./]+)$', 1)) NOT IN ('.pdf', '.txt') OR file_path IS NULL AS unsupported FROM files"""
)
def file_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    rows = readers.dispatched(_files(spark, folder).select("file_id", "seq", F.col("file_path").alias("path")))
    return rows.select("file_id", "seq", "file_name", "suffix", F.col("error").isNotNull().alias("unsupported"))


@_query(oracles.MD_SECTIONS)
def md_sections(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", F.col("text").alias("markdown"))
    return sections.markdown_sections(docs).drop("markdown")


@_query(oracles.NUM_SECTIONS)
def num_sections(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", F.col("text").alias("markdown"))
    return sections.numeric_sections(docs).drop("markdown")


@_query(oracles.STYLED_SECTIONS)
def section_parents(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", F.col("text").alias("markdown"))
    return sections.styled_sections(docs).select("doc_id", "section_idx", "section_header", "section_level", "parent_section", "top_header")


@_query(oracles.SECTION_OFFSETS)
def section_char_offsets(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", F.col("text").alias("markdown"))
    return sections.markdown_sections(docs, levels=3).select("doc_id", "section_idx", "char_start", "char_end")


@_query(oracles.CONTENT_BLOCKS)
def content_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.posexplode(blocks.exact_blocks(F.col("text"))).alias("block_idx", "b")).select("doc_id", "block_idx", "b.*")


@_query(oracles.SENTENCES_HARD)
def sentence_pieces_hard(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.posexplode(blocks.split_sentences_hard(F.col("text"), 300)).alias("piece_idx", "content"))


@_query(oracles.SENTENCES_SUM)
def sentence_pieces_sum(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.posexplode(blocks.split_sentences_sum(F.col("text"), 300)).alias("piece_idx", "content"))


@_query(oracles.TABLE_PIECES)
def table_pieces(spark: SparkSession, folder: str) -> DataFrame:
    tables = _chunks(spark, folder).where(F.col("content").rlike(r"(?md)^\|[-:| ]+\|[ \t]*$")).select("chunk_id", "content").distinct()
    return tables.select("chunk_id", F.posexplode(blocks.split_table(F.col("content"), 60)).alias("piece_idx", "content"))


@_query(oracles.NGRAM_COUNTS)
def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    n = F.when(F.col("text").isNotNull(), F.size(fingerprint.grams(F.col("text"))).cast("bigint"))
    return _documents(spark, folder).select("doc_id", n.alias("n_grams"))


@_query(oracles.SIMHASH)
def simhash(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", fingerprint.simhash(F.col("text")).alias("simhash"))


@_query(oracles.SIMHASH_WORDS)
def simhash_words(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", fingerprint.simhash(F.col("text"), by_words=True).alias("simhash"))


_FP = """fp AS (SELECT DISTINCT file_id, seq, lpad(lower(regexp_extract(simhash, '^\\s*(?:0[xX])?0*([0-9a-fA-F]{1,16})\\s*$', 1)), 16, '0') AS hex FROM files
    WHERE regexp_extract(simhash, '^\\s*(?:0[xX])?0*([0-9a-fA-F]{1,16})\\s*$', 1) NOT IN ('', '0')), num AS (SELECT file_id, seq, hex, ('0x' || hex)::UBIGINT AS v FROM fp)"""


@_query(
    f"""WITH {_FP}, c AS (SELECT v, arg_min(file_id, seq) AS class_id FROM num GROUP BY v), l AS (SELECT a.v AS v, count(*) AS n FROM c a, c b WHERE a.v <> b.v AND bit_count(xor(a.v, b.v)) <= 3 GROUP BY a.v)
    SELECT DISTINCT file_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM num JOIN c USING (v) LEFT JOIN l USING (v)"""
)
def near_dup_classes(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder).select("file_id", "seq", hamming.fingerprint(F.col("simhash")).alias("fp"))
    return hamming.near_classes(files, "file_id", "fp", "seq")[0].withColumnRenamed("id", "file_id")


@_query(
    f"""WITH {_FP}, c AS (SELECT v, arg_min(file_id, seq) AS class_id, min(seq) AS seq FROM num GROUP BY v)
    SELECT a.class_id AS class_a, b.class_id AS class_b, bit_count(xor(a.v, b.v))::BIGINT AS distance FROM c a JOIN c b ON a.seq < b.seq AND bit_count(xor(a.v, b.v)) <= 3"""
)
def near_dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder).select("file_id", "seq", hamming.fingerprint(F.col("simhash")).alias("fp"))
    return hamming.near_classes(files, "file_id", "fp", "seq")[1]


@_query(oracles.DEDUP_GREEDY)
def dedup_greedy(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", fingerprint.as_bits(fingerprint.simhash(F.col("text"))).alias("fp"))
    return hamming.greedy_keep(docs, "doc_id", "fp", "doc_id").withColumnRenamed("id", "doc_id")


@_query(oracles.DEDUP_STATUS)
def dedup_status_summary(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_greedy(spark, folder).groupBy("status").agg(F.count("*").alias("n"))


#: Files of the first batches count as known, all others are judged.
_KNOWN_BATCHES = 5


@_query(
    f"""WITH f AS (SELECT file_id, arg_min({{'seq': seq, 'batch_no': batch_no, 'simhash': simhash}}, seq) AS r FROM files WHERE file_id IS NOT NULL GROUP BY file_id),
    x AS (SELECT file_id, r.seq AS seq, r.batch_no AS batch_no, regexp_extract(r.simhash, '^\\s*(?:0[xX])?0*([0-9a-fA-F]{{1,16}})\\s*$', 1) AS hex FROM f),
    n AS (SELECT file_id AS id, seq AS o, batch_no, ('0x' || hex)::UBIGINT AS v FROM x WHERE hex NOT IN ('', '0')), known AS (SELECT id, v FROM n WHERE batch_no < {_KNOWN_BATCHES}), r AS (SELECT id, o, v FROM n WHERE batch_no >= {_KNOWN_BATCHES}),
    {oracles.greedy('r').replace('{kind}', 'VARCHAR')}, a AS (SELECT y.id AS id FROM (SELECT unnest(kept) AS y FROM k) WHERE y.id IS NOT NULL),
    e AS (SELECT id, v, -1 AS o FROM known UNION ALL SELECT r.id, r.v, r.o FROM r JOIN a USING (id)),
    c AS (SELECT r.id, count(*) AS n FROM r JOIN e ON e.o < r.o AND e.id <> r.id AND bit_count(xor(e.v, r.v)) <= 3 GROUP BY r.id)
    SELECT r.id AS file_id, a.id IS NOT NULL AS accepted, coalesce(c.n, 0)::BIGINT AS n_matches FROM r LEFT JOIN a USING (id) LEFT JOIN c USING (id)"""
)
def dedup_against_known(spark: SparkSession, folder: str) -> DataFrame:
    first = _files(spark, folder).where("file_id is not null").groupBy("file_id").agg(F.min(F.struct("seq", "batch_no", "simhash")).alias("r"))
    rows = first.select(F.col("file_id").alias("id"), "r.seq", "r.batch_no", hamming.fingerprint(F.col("r.simhash")).alias("fp")).where("fp is not null")
    fresh = rows.where(F.col("batch_no") >= _KNOWN_BATCHES)
    accepted, matches = hamming.judged(fresh, hamming.entries_of(rows.where(F.col("batch_no") < _KNOWN_BATCHES)))
    counted = matches.groupBy("id").agg(F.count("*").alias("n_matches"))
    judged = fresh.join(accepted.select("id", F.lit(True).alias("accepted")), "id", "left").join(counted, "id", "left")
    return judged.select(F.col("id").alias("file_id"), F.coalesce("accepted", F.lit(False)).alias("accepted"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


@_query(f"WITH {_FP} SELECT file_id, seq, bit_count(xor(v, ('0x0123456789abcdef')::UBIGINT))::BIGINT AS distance FROM num")
def hamming_distance(spark: SparkSession, folder: str) -> DataFrame:
    rows = _files(spark, folder).select("file_id", "seq", hamming.fingerprint(F.col("simhash")).alias("fp")).where("fp is not null").distinct()
    return rows.select("file_id", "seq", F.bit_count(F.col("fp").bitwiseXOR(F.lit(0x0123456789ABCDEF))).cast("bigint").alias("distance"))


@_query(f"WITH {_FP} SELECT count(DISTINCT file_id) AS files, count(DISTINCT {{'band': b, 'bits': substr(hex, 4 * b + 1, 4)}}) AS buckets FROM num, (VALUES (0), (1), (2), (3)) AS t(b)")
def index_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Files with a fingerprint and buckets of four bands of 16 bits, which is what an index of distance 3 counts as its size."""
    rows = _files(spark, folder).select("file_id", hamming.fingerprint(F.col("simhash")).alias("fp")).where("fp is not null")
    bands = rows.select("file_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.struct(b.alias("band"), F.col("fp").alias("fp")))).alias("b"))
    bits = F.expr("shiftrightunsigned(b.fp, 48 - 16 * b.band) & 65535")
    return bands.agg(F.countDistinct("file_id").alias("files"), F.countDistinct(F.struct("b.band", bits)).alias("buckets"))


@_query("SELECT count(DISTINCT file_id) AS files, count(DISTINCT simhash) AS fingerprints FROM files WHERE file_id <> '' AND simhash <> ''")
def index_size(spark: SparkSession, folder: str) -> DataFrame:
    return readers.known_fingerprints(_files(spark, folder)).agg(F.countDistinct("file_id").alias("files"), F.countDistinct("simhash").alias("fingerprints"))


@_query(
    """SELECT file_id, count(*) AS total_entries, coalesce(max(level), 0)::INTEGER AS max_depth, count(*) FILTER (level = 0) AS chapters,
    bool_or(page IS NOT NULL) AS has_page_numbers, bool_or(numeric_id IS NOT NULL) AS has_numeric_ids FROM toc_entries GROUP BY file_id"""
)
def toc_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return toc.contents_figures(_toc(spark, folder), "file_id")


@_query(oracles.TOC_PARENTS)
def toc_parents(spark: SparkSession, folder: str) -> DataFrame:
    return toc.resolved(_toc(spark, folder)).select("file_id", "entry_no", F.col("parent_no").cast("int").alias("parent_no"))


def _rendered(spark: SparkSession, folder: str) -> DataFrame:
    """A table of contents as text for each file, from its entries, between a title and a section."""
    c = F.col
    line = F.concat(
        F.when(c("numeric_id").isNotNull(), F.concat("numeric_id", F.lit(" "))).otherwise(F.repeat(F.lit("- "), F.coalesce("level", F.lit(0)) + 1)),
        F.coalesce("title", F.lit("")), F.when(c("page").isNotNull(), F.concat(F.lit(" ..... "), c("page").cast("string"))).otherwise(""),
    )
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_no", line.alias("x")))), lambda e: e["x"]), "\n")
    return _toc(spark, folder).groupBy("file_id").agg(F.concat(F.lit("# Volume\n\n## Table of Contents\n"), lines, F.lit("\n\n## Opening\nThe text begins here.")).alias("text"))


@_query(oracles.TOC_LINES)
def toc_lines(spark: SparkSession, folder: str) -> DataFrame:
    return toc.parsed(_rendered(spark, folder).select("file_id", toc.contents(F.col("text")).alias("toc")), "toc", "file_id")


@_query(oracles.TOC_REMOVED)
def toc_removed(spark: SparkSession, folder: str) -> DataFrame:
    return _rendered(spark, folder).select("file_id", toc.without_contents(F.col("text")).alias("markdown"))


@_query()
def toc_nested(spark: SparkSession, folder: str) -> DataFrame:
    return toc.nested(toc_lines(spark, folder), "file_id")


_KEYS = """k AS (SELECT file_id, entry_no, 0 AS k, title AS key, title, level, numeric_id, parent_id, full_path FROM toc_entries WHERE title IS NOT NULL
    UNION ALL SELECT file_id, entry_no, 1, numeric_id || '. ' || title, title, level, numeric_id, parent_id, full_path FROM toc_entries WHERE title IS NOT NULL AND numeric_id IS NOT NULL
    UNION ALL SELECT file_id, entry_no, 2, numeric_id || ' ' || title, title, level, numeric_id, parent_id, full_path FROM toc_entries WHERE title IS NOT NULL AND numeric_id IS NOT NULL),
    u AS (SELECT *, row_number() OVER (PARTITION BY file_id, key ORDER BY entry_no DESC, k DESC) AS rn, min(entry_no * 3 + k) OVER (PARTITION BY file_id, key) AS key_no FROM k),
    m AS (SELECT * FROM u WHERE rn = 1)"""


@_query(f"WITH {_KEYS} SELECT c.chunk_id, c.created_at, m.full_path AS toc_full_path, m.level AS toc_level, m.numeric_id AS toc_numeric_id FROM chunks c JOIN m ON m.file_id = c.file_id AND m.key = c.section_header WHERE {_strip('c.section_header')} <> ''")
def toc_enrich_exact(spark: SparkSession, folder: str) -> DataFrame:
    keys = toc.lookup(_toc(spark, folder), "file_id").select("file_id", F.col("key").alias("section_header"), "full_path", "level", "numeric_id")
    rows = _chunks(spark, folder).where(text.stripped(F.col("section_header")) != "").select("chunk_id", "created_at", "file_id", "section_header")
    joined = rows.join(keys, ["file_id", "section_header"])
    return joined.select("chunk_id", "created_at", F.col("full_path").alias("toc_full_path"), F.col("level").alias("toc_level"), F.col("numeric_id").alias("toc_numeric_id"))


@_query(
    f"""WITH {_KEYS}, h AS (SELECT DISTINCT file_id, section_header AS h FROM chunks WHERE {_strip('section_header')} <> ''),
    e AS (SELECT h.file_id, h.h, m.full_path, m.level FROM h JOIN m ON m.file_id = h.file_id AND m.key = h.h),
    f AS (SELECT h.file_id, h.h, arg_min(struct_pack(p := m.full_path, l := m.level), m.key_no) AS s FROM h JOIN m ON m.file_id = h.file_id AND contains(lower(m.key), lower(h.h))
        WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.file_id = h.file_id AND e.h = h.h) GROUP BY ALL),
    x AS (SELECT file_id, h, full_path, level FROM e UNION ALL SELECT file_id, h, s.p, s.l FROM f)
    SELECT c.chunk_id, c.created_at, x.full_path AS toc_full_path, x.level AS toc_level FROM chunks c LEFT JOIN x ON x.file_id = c.file_id AND x.h = c.section_header"""
)
def toc_enrich_fallback(spark: SparkSession, folder: str) -> DataFrame:
    keys = toc.lookup(_toc(spark, folder), "file_id")
    rows = _chunks(spark, folder).select("chunk_id", "created_at", "file_id", "section_header")
    return toc.enriched(rows, keys, "file_id").select("chunk_id", "created_at", "toc_full_path", "toc_level")


_ROWS = "(SELECT chunk_id, min(file_id) AS file_id, min(chunk_index) AS chunk_index FROM chunks GROUP BY chunk_id)"


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).groupBy("chunk_id").agg(F.min("file_id").alias("file_id"), F.min("chunk_index").alias("chunk_index"))


@_query(f"SELECT chunk_id, (row_number() OVER (PARTITION BY file_id ORDER BY chunk_index, chunk_id) - 1)::INTEGER AS position FROM {_ROWS}")
def chunk_index(spark: SparkSession, folder: str) -> DataFrame:
    return links.numbered(_rows(spark, folder), "file_id", ["chunk_index", "chunk_id"], "position", span=links.SPAN).select("chunk_id", "position")


@_query(f"SELECT chunk_id, lag(chunk_id, 1, '') OVER w AS prev_chunk_id, lead(chunk_id, 1, '') OVER w AS next_chunk_id FROM {_ROWS} WINDOW w AS (PARTITION BY file_id ORDER BY chunk_index, chunk_id)")
def chunk_links_uuid_style(spark: SparkSession, folder: str) -> DataFrame:
    return links.linked(_rows(spark, folder), "file_id", ["chunk_index", "chunk_id"], span=links.SPAN).select("chunk_id", "prev_chunk_id", "next_chunk_id")


@_query(
    f"""WITH n AS (SELECT file_id, file_id || '-' || row_number() OVER (PARTITION BY file_id ORDER BY chunk_index, chunk_id) AS id, row_number() OVER (PARTITION BY file_id ORDER BY chunk_index, chunk_id) AS k FROM {_ROWS})
    SELECT id AS chunk_id, lag(id) OVER w AS prev_chunk_id, lead(id) OVER w AS next_chunk_id FROM n WINDOW w AS (PARTITION BY file_id ORDER BY k)"""
)
def chunk_links_file_style(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).withColumnRenamed("chunk_id", "old_id")
    return links.file_style_ids(rows, "file_id", ["chunk_index", "old_id"], links.SPAN).select("chunk_id", "prev_chunk_id", "next_chunk_id")


@_query(oracles.MERGE_SHORT)
def merge_short(spark: SparkSession, folder: str) -> DataFrame:
    rows = _distinct_chunks(spark, folder).withColumnRenamed("chunk_index", "place").withColumn("content", F.coalesce("content", F.lit("")))
    rows = rows.withColumn("estimated_tokens", text.tokens_by_words(F.col("content")))
    return merge.merge_short(rows, "file_id", ["place", "chunk_id"], SINGLE.most_tokens, SINGLE.least_tokens, links.SPAN)


@_query(oracles.JOIN_SHORT)
def join_short(spark: SparkSession, folder: str) -> DataFrame:
    rows = _distinct_chunks(spark, folder).withColumnRenamed("chunk_index", "place").withColumn("content", F.coalesce("content", F.lit("")))
    rows = rows.withColumn("estimated_tokens", text.tokens_by_length(F.col("content")))
    return merge.join_short(rows, "file_id", ["place", "chunk_id"], 50, span=links.SPAN)


@_query(
    """WITH a AS (SELECT file_id, entry_no, entry_no * 997 AS pos FROM toc_entries),
    s AS (SELECT file_id, chunk_index, sum(n) OVER (PARTITION BY file_id ORDER BY chunk_index) - n AS lo, sum(n) OVER (PARTITION BY file_id ORDER BY chunk_index) AS hi
        FROM (SELECT file_id, chunk_index, max(length(coalesce(content, ''))) AS n FROM chunks GROUP BY ALL))
    SELECT a.file_id, a.entry_no, min(s.chunk_index)::INTEGER AS chunk_index FROM a LEFT JOIN s ON s.file_id = a.file_id AND s.lo <= a.pos AND a.pos < s.hi GROUP BY ALL"""
)
def annotation_range_join(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _chunks(spark, folder).groupBy("file_id", "chunk_index").agg(F.max(F.length(F.coalesce("content", F.lit("")))).alias("n"))
    end = F.expr("sum(n) over (partition by file_id order by chunk_index)")
    spans = sizes.withColumn("char_end", end).withColumn("char_start", F.col("char_end") - F.col("n")).withColumn("content", F.lit(""))
    marks = _toc(spark, folder).select(
        "file_id", F.col("entry_no").alias("annotation_no"), (F.col("entry_no") * 997).alias("pos"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("self_ref")
    )
    return annotate.placed(marks, spans, "file_id").select("file_id", F.col("annotation_no").alias("entry_no"), "chunk_index")


@_query(
    f"""WITH a AS (SELECT file_id, entry_no, numeric_id || ' ' || title AS self_ref, title AS caption FROM toc_entries),
    c AS (SELECT DISTINCT file_id, chunk_index, lower(content) AS low FROM chunks WHERE content IS NOT NULL),
    h AS (SELECT a.file_id, a.entry_no, min(c.chunk_index) AS chunk_index FROM a JOIN c USING (file_id) WHERE contains(low, '<!-- image -->') OR contains(low, '![')
        OR (caption <> '' AND contains(low, lower(substr(caption, 1, 50)))) OR (self_ref <> '' AND contains(low, lower(self_ref))) GROUP BY ALL)
    SELECT a.file_id, a.entry_no, h.chunk_index::INTEGER AS chunk_index FROM a LEFT JOIN h USING (file_id, entry_no)"""
)
def annotation_content_join(spark: SparkSession, folder: str) -> DataFrame:
    marks = _toc(spark, folder).select(
        "file_id", F.col("entry_no").alias("annotation_no"), F.lit(None).cast("bigint").alias("pos"), F.col("title").alias("caption"), F.concat("numeric_id", F.lit(" "), "title").alias("self_ref")
    )
    spans = _chunks(spark, folder).where("content is not null").select("file_id", "chunk_index", "content", F.lit(None).cast("bigint").alias("char_start"), F.lit(None).cast("bigint").alias("char_end"))
    return annotate.placed(marks, spans, "file_id").select("file_id", F.col("annotation_no").alias("entry_no"), "chunk_index")


_MARKS = f"""m AS (SELECT doc_id, text, 0 AS annotation_no, substr(text, 101, 20) AS reference, NULL::VARCHAR AS caption FROM documents UNION ALL SELECT doc_id, text, 1, '', {oracles.LOWER.format('substr(text, 51, 30)')} FROM documents
    UNION ALL SELECT doc_id, text, 2, NULL, NULL FROM documents UNION ALL SELECT doc_id, text, 3, 'in no text', 'nor this one' FROM documents)"""
_IMAGE = "(?i)<!--[\\t\\n\\x0b\\f\\r ]*image[\\t\\n\\x0b\\f\\r ]*-->|!\\[[^\\n\\r\\x{85}\\x{2028}\\x{2029}]*?\\]\\([^\\n\\r\\x{85}\\x{2028}\\x{2029}]*?\\)"


@_query(
    f"""WITH {_MARKS}, p AS (SELECT *, regexp_extract_all(text, '{_IMAGE}') AS images, regexp_split_to_array(text, '{_IMAGE}') AS gaps FROM m)
    SELECT doc_id, annotation_no, coalesce(CASE WHEN reference <> '' THEN nullif(strpos(text, reference), 0) - 1 END, CASE WHEN caption <> '' THEN nullif(strpos({oracles.LOWER.format('text')}, {oracles.LOWER.format('caption')}), 0) - 1 END,
        CASE WHEN len(images) > annotation_no THEN list_sum(list_transform(gaps[1:annotation_no + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(images[1:annotation_no], lambda x: length(x))), 0) END)::INTEGER AS pos FROM p"""
)
def annotation_positions(spark: SparkSession, folder: str) -> DataFrame:
    """By reference, by caption in lower case, by the marker of the number, and by none of them."""
    t, none = F.col("text"), F.lit(None).cast("string")
    marks = [(F.substring(t, 101, 20), none), (F.lit(""), F.lower(F.substring(t, 51, 30))), (none, none), (F.lit("in no text"), F.lit("nor this one"))]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("annotation_no"), r.alias("reference"), c.alias("caption")) for n, (r, c) in enumerate(marks)]))
    rows = _documents(spark, folder).select("doc_id", "text", each.alias("a")).select("doc_id", "text", "a.*")
    return rows.select("doc_id", "annotation_no", annotate.position(t, F.col("reference"), F.col("caption"), F.col("annotation_no")).alias("pos"))


@_query("SELECT f.file_id, count(DISTINCT c.chunk_id) AS n_chunks FROM (SELECT DISTINCT file_id FROM files) f LEFT JOIN chunks c USING (file_id) GROUP BY f.file_id")
def file_chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = _rows(spark, folder).groupBy("file_id").agg(F.count("*").alias("n_chunks"))
    return _files(spark, folder).select("file_id").distinct().join(counted, "file_id", "left").select("file_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


@_query(
    """SELECT chunk_id, (i - 1)::INTEGER AS pair_no, metadata.questions[i] AS question, metadata.answers[i] AS answer
    FROM (SELECT chunk_id, metadata, unnest(range(1, greatest(coalesce(len(metadata.questions), 0), coalesce(len(metadata.answers), 0)) + 1)) AS i FROM enrichment)"""
)
def enrichment_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return readers.question_pairs(spark.read.parquet(f"{folder}/enrichment.parquet"))


@_query(
    """SELECT chunk_id, created_at, file_id, chunk_index, nullif(content, '') AS content, nullif(section_header, '') AS section_header, estimated_tokens, quality_score, should_use FROM chunks"""
)
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The table of chunks written as CSV and read again; empty cells come back as null."""
    path = shared_path(spark, "chunks-csv")
    names = [c.split()[0] for c in readers.CHUNKS_SCHEMA.split(", ")]
    sinks.append(_chunks(spark, folder).select(*names), path, "csv")
    return readers.chunks_csv(spark, path).select("chunk_id", "created_at", "file_id", "chunk_index", "content", "section_header", "estimated_tokens", "quality_score", "should_use")


def _as_files(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select(F.format_string("doc-%012d", "doc_id").alias("path"), F.format_string("doc-%012d", "doc_id").alias("file_id"), F.col("text").alias("markdown"), F.col("doc_id").alias("seq"))


@_query()
def pipeline_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.process(_as_files(spark, folder), "batch", settings=BATCH)[1]


@_query(oracles.PIPELINE_STATUS)
def pipeline_status(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.screened(_as_files(spark, folder)).select("path", "status", "reason", F.size("matches").alias("n_matches"))


@_query()
def pipeline_results(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.results(*pipelines.process(_as_files(spark, folder), "batch"))


def _verdicts_of(source: str) -> str:
    """Verdicts of the layout rules on the chunks of a query."""
    judged = _layout_sql().replace("chunk_id, created_at", "file_id, chunk_id").replace("FROM chunks)", "FROM src2)")
    return f"WITH src2 AS ({source}) SELECT src2.*, v.should_use, v.reason, v.content_type FROM src2 JOIN ({judged}) v USING (file_id, chunk_id)"


@_query(_verdicts_of(oracles.LAYOUT_CHUNKS))
def layout_chunks(spark: SparkSession, folder: str) -> DataFrame:
    found = pipelines.process_layout(_as_files(spark, folder).select("file_id", "markdown"))
    return found.select(
        "file_id", "chunk_id", "chunk_index", "prev_chunk_id", "next_chunk_id", "section_header", "section_level", "parent_section", "content", "estimated_tokens",
        "evaluation.should_use", "evaluation.reason", "evaluation.content_type",
    )


@_query(oracles.PAGE_CHUNKS)
def page_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.process_pages(_as_files(spark, folder).select("file_id", "markdown"))
