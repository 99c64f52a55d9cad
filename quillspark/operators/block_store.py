"""Accepted fingerprints of earlier runs, kept as block tables in a shared folder.

A fingerprint has one row under each of the 20 masks of ``hamming``. Rows
lie in buckets by a hash of mask and key. A batch of ``n`` fingerprints has
``20 * n`` keys and reads only the buckets of those, so it reads at most
``20 * n * bucket_rows`` rows, about, however long the history is. When the
rows outgrow the buckets, the table is written anew with four times as many,
which costs a constant share a row. Beyond
``MOST_BUCKETS`` the buckets themselves grow.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import by_shuffle, shared_path
from .hamming import block_masks, judged, keyed, signed

STORED = "id string, fp bigint, seq bigint, mask bigint, key bigint, bucket int"
#: Rows that a bucket should hold, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 1 << 17, 1 << 14


class BlockStore:
    """Rows ``(id, fp, seq)`` of accepted fingerprints; a folder that has a table already is opened with what it holds."""

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.bucket_rows = spark, bucket_rows
        self.path = path or shared_path(spark, "fingerprints")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets, self._table = self._newest()
        self.rows = self._read().count() if self._table else 0

    def _newest(self) -> tuple[int, str | None]:
        """Buckets and folder of the newest table that was written to its end."""
        if not self._fs.exists(self._root):
            return 1, None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        done = [n for n in names if n.startswith("b") and self._fs.exists(self._sub(f"{n}/_SUCCESS"))]
        best = max(done, key=lambda n: int(n[1:].split("-")[0]), default=None)
        return (int(best[1:].split("-")[0]), best) if best else (1, None)

    def _sub(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(f"{self.path}/{self._table}")

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("mask", "key"), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str, buckets: int) -> None:
        tasks = max(1, min(buckets, self.spark.sparkContext.defaultParallelism))
        dealt = rows.withColumn("bucket", self._bucket(buckets)).repartition(tasks, "bucket").sortWithinPartitions("bucket", "mask", "key")
        dealt.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def append(self, accepted: DataFrame) -> int:
        """Add rows ``(id, fp, seq)`` and return their number; the frame must give the same rows each time it is read."""
        fresh = accepted.count()
        if not fresh:
            return 0
        needed = self.rows + fresh * len(block_masks())
        buckets = self.buckets
        while buckets < MOST_BUCKETS and needed > buckets * self.bucket_rows:
            buckets *= 4
        new = keyed(accepted.select("id", "fp", "seq"), block_masks())
        if self._table is None or buckets > self.buckets:
            old, folder = self._table, f"b{buckets}-{uuid.uuid4().hex[:8]}"
            held = self._read().drop("bucket") if old else None
            self._write(held.unionByName(new) if old else new, folder, buckets)
            self.buckets, self._table = buckets, folder
            if old:
                self._fs.delete(self._sub(old), True)
        else:
            self._write(new, self._table, self.buckets)
        self.rows = needed
        return fresh

    def _wanted(self, mine: DataFrame) -> DataFrame | None:
        if self._table is None:
            return None
        numbers = [r[0] for r in mine.select(self._bucket(self.buckets)).distinct().collect()]  # at most MOST_BUCKETS
        return self._read().where(F.col("bucket").isin(numbers)) if len(numbers) < self.buckets else self._read()

    def near(self, mine: DataFrame) -> DataFrame | None:
        """Stored rows ``(id, fp, seq, mask, key)`` under the keys of a batch (mask, key); None from an empty table."""
        held = self._wanted(mine)
        return held and held.drop("bucket").join(by_shuffle(mine.select("mask", "key").distinct()), ["mask", "key"], "left_semi")

    def rows_read(self, mine: DataFrame) -> int:
        """Rows of the buckets that a batch (mask, key) reads."""
        held = self._wanted(mine)
        return held.count() if held is not None else 0

    def accepted(self) -> DataFrame:
        """All accepted ``(id, fp, seq)``."""
        if self._table is None:
            return self.spark.createDataFrame([], "id string, fp bigint, seq bigint")
        return self._read().where(F.col("mask") == signed(block_masks()[0])).select("id", "fp", "seq")


def screened(store: BlockStore, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``hamming.judged`` of a batch ``(id, fp, seq)`` against ``store``, to which the accepted are added; ids become strings."""
    return judged(batch.select(F.col("id").cast("string").alias("id"), "fp", F.col("seq").cast("bigint").alias("seq")), store.near, store.append)
