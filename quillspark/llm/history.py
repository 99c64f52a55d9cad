"""Problem 3: new batches of files against all fingerprints accepted before.

Fingerprints of 64 bits lie in block tables (``operators.block_store``): the
bits are cut into six blocks, and for each choice of three blocks a table is
keyed by their bits (20 tables). Two fingerprints within three bits agree on
at least three blocks, so they meet in some table by an exact match of key;
a meeting is verified by counting bits. Accepted fingerprints are appended
with their file ids. A batch reads the buckets of its own keys only.

Verdicts of all judged files lie beside the tables, by a hash of the file
id, so that a file sent again in a later batch is known by its first row.

A table entry whose key is shared by very many fingerprints is replaced by
entries with longer keys (a quarter of the other bits each, one of which
must agree), so no key gathers a large share of the rows. A batch in which
dense groups would still meet themselves too often is taken in two halves
by order of arrival, which gives the same result, as arrivals are judged in
order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.block_store import BlockStore, screened
from ..operators.hamming import block_masks, fingerprint, keyed
from ..session import by_shuffle, cut, shared_path

_VERDICTS = "file_id string, seq bigint, batch_no int, fp bigint, accepted boolean, part int"
#: Folders of the verdicts, by hash of the file id.
PARTS = 16
#: Batches at the end of a table of files that are judged one by one; those before are loaded in steps of up to so many times the history.
SINGLY, STEP = 4, 4


class History:
    """All judged files: block tables of the accepted, verdicts of all, in a folder that may be opened again later."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or shared_path(spark, "history")
        self.store = BlockStore(spark, f"{self.path}/fingerprints")
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/verdicts")
        self._begun = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)

    def verdicts(self) -> DataFrame:
        """``(file_id, seq, batch_no, fp, accepted)`` of every file judged so far."""
        if not self._begun:
            return self.spark.createDataFrame([], _VERDICTS).drop("part")
        return self.spark.read.schema(_VERDICTS).parquet(f"{self.path}/verdicts").drop("part")

    def _unknown(self, firsts: DataFrame) -> DataFrame:
        if not self._begun:
            return firsts
        part = F.pmod(F.xxhash64("file_id"), F.lit(PARTS)).cast("int")
        parts = [r[0] for r in firsts.select(part).distinct().collect()]  # at most PARTS
        known = self.spark.read.schema(_VERDICTS).parquet(f"{self.path}/verdicts").where(F.col("part").isin(parts))
        return firsts.join(by_shuffle(known.select("file_id")), "file_id", "left_anti")

    def judge(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Judge a batch of files that come after all judged so far, in order of seq.

        ``files``: file_id, simhash, seq, batch_no; other columns are
        ignored. A file counts by its first row; one that was judged in an
        earlier batch has no row here. Rows without file_id or seq are left
        out. Returns verdicts ``(file_id, seq, batch_no, fp, accepted)`` and
        matches ``(file_id, match_id)`` of each refused file with every
        accepted one before it within three bits. Files without fingerprint
        (null, blank, unreadable, zero) are accepted and match nothing.
        """
        firsts = cut(self._unknown(first_rows(files)))
        _, matches = screened(self.store, firsts.where("fp is not null").select(F.col("file_id").alias("id"), "fp", "seq"))
        refused = matches.select(F.col("id").alias("file_id")).distinct().withColumn("_refused", F.lit(True))
        verdict = firsts.join(refused, "file_id", "left").select("file_id", "seq", "batch_no", "fp", F.col("_refused").isNull().alias("accepted"))
        verdict = cut(verdict.withColumn("part", F.pmod(F.xxhash64("file_id"), F.lit(PARTS)).cast("int")))
        verdict.repartition(min(PARTS, self.spark.sparkContext.defaultParallelism), "part").write.mode("append").partitionBy("part").parquet(f"{self.path}/verdicts")
        self._begun = True
        return verdict.drop("part"), matches.withColumnRenamed("id", "file_id")


def first_rows(files: DataFrame) -> DataFrame:
    """``(file_id, seq, batch_no, fp)``: each file at its first row by ``seq``; rows without id or seq are left out."""
    return (
        files.where("file_id is not null and seq is not null")
        .groupBy("file_id")
        .agg(F.min(F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("batch_no").cast("int").alias("batch_no"), "simhash")).alias("r"))
        .select("file_id", "r.seq", "r.batch_no", fingerprint(F.col("r.simhash")).alias("fp"))
    )


def steps(sizes: list[tuple[int, int]], singly: int) -> list[list[int]]:
    """Batch numbers, in order, in the steps in which they are judged: each ``STEP`` times as large as all before it, the last ``singly`` alone."""
    numbers = [b for b, _ in sizes]
    early, out, held, now, size = max(0, len(numbers) - singly), [], 0, [], 0
    for number, n in sizes[:early]:
        now.append(number)
        size += n
        if size >= STEP * held:
            out.append(now)
            held, now, size = held + size, [], 0
    return out + ([now] if now else []) + [[b] for b in numbers[early:]]


def judge_all(files: DataFrame, history: History | None = None, singly: int = SINGLY, counted: bool = False) -> tuple[History, list[tuple]]:
    """Judge a whole table of files, ``batch_no`` after ``batch_no``.

    The last ``singly`` batches are judged one by one; those before them, a
    first load, in steps of whole batches that are ``STEP`` times as large as the
    history so far, which changes no result and reads the history a few
    times in all. The batch numbers must rise with seq; null ones come first.
    Returns the history, which holds all verdicts, and for each step
    (first batch, last batch, verdicts, matches, rows stored before, rows
    read), the last two null unless ``counted``.
    """
    history = history or History(files.sparkSession)
    rows = files.select("file_id", "simhash", "seq", "batch_no", F.coalesce(F.col("batch_no").cast("int"), F.lit(-(2**31))).alias("_batch"))
    sizes = [(r._batch, r.n) for r in rows.groupBy("_batch").agg(F.count("*").alias("n")).orderBy("_batch").collect()]  # a row for each batch
    done = []
    for numbers in steps(sizes, singly):
        batch = rows.where(F.col("_batch").between(numbers[0], numbers[-1]))
        stored = read = None
        if counted:
            stored = history.store.rows
            read = history.store.rows_read(keyed(first_rows(batch).where("fp is not null"), block_masks()))
        verdicts, matches = history.judge(batch)
        done.append((numbers[0], numbers[-1], verdicts, matches, stored, read))
        history = History(files.sparkSession, history.path)  # each step knows only what is stored
    return history, done


def deduplicate(files: DataFrame, history: History | None = None, singly: int = SINGLY) -> tuple[DataFrame, DataFrame]:
    """Files ``(file_id, seq, batch_no, fp, accepted)`` and matches ``(file_id, match_id)`` of a whole table, see ``judge_all``."""
    _, done = judge_all(files, history, singly)
    spark = files.sparkSession
    verdicts, matches = spark.createDataFrame([], _VERDICTS).drop("part"), spark.createDataFrame([], "file_id string, match_id string")
    for _, _, v, m, _, _ in done:
        verdicts, matches = verdicts.unionByName(v), matches.unionByName(m)
    return verdicts, matches


def agreement(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds ``same_text`` to matches ``(file_id, match_id)``: whether both files hold the same texts, as far as ``chunks`` has any.

    Texts are compared by the sorted hashes of a file's distinct chunk
    contents (letters and digits in lower case); null where either file has
    no chunk. Only hashes are shuffled.
    """
    flat = F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}]+", "")
    hashes = chunks.where("content is not null and file_id is not null").select("file_id", F.xxhash64(flat).alias("h")).distinct()
    held = cut(hashes.groupBy("file_id").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.shiftright("h", 20)).alias("s")))
    mine = held.select("file_id", F.struct("n", "x", "s").alias("mine"))
    theirs = held.select(F.col("file_id").alias("match_id"), F.struct("n", "x", "s").alias("theirs"))
    return matches.join(mine, "file_id", "left").join(theirs, "match_id", "left").select("file_id", "match_id", (F.col("mine") == F.col("theirs")).alias("same_text"))



def figures(done: list[tuple], spark: SparkSession) -> DataFrame:
    """``(first_batch, last_batch, files, accepted, refused, rows_stored, rows_read)`` of each step of ``judge_all`` with ``counted``."""
    kind = "first_batch int, last_batch int, files bigint, accepted bigint, refused bigint, rows_stored bigint, rows_read bigint"
    out = spark.createDataFrame([], kind)
    for first, last, verdicts, _, stored, read in done:
        counts = verdicts.agg(F.count("*").alias("files"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))
        step = [F.lit(v).cast(t).alias(n) for n, v, t in (("first_batch", first, "int"), ("last_batch", last, "int"))]
        out = out.unionByName(counts.select(*step, "files", "accepted", "refused", F.lit(stored).cast("bigint").alias("rows_stored"), F.lit(read).cast("bigint").alias("rows_read")))
    return out
