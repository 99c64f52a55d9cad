"""The main pipeline over arriving documents: each micro-batch against the tables of all before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from ..operators.block_store import BlockStore
from ..plans import pipelines
from ..sources.sinks import append, chunks_table, files_table


def ingest(batch: DataFrame, files_path: str, chunks_path: str, store_path: str | None = None) -> DataFrame:
    """Process a batch of documents (path, markdown, seq) and append its files and chunks; returns the results.

    Fingerprints of all accepted files lie in block tables at
    ``store_path`` (beside the table of files), of which a batch reads the
    buckets of its own keys. Files are written last: a run that breaks off
    before leaves its fingerprints in the tables, where the repeated batch
    meets them under its own ids, which are stable, and so is accepted again.
    """
    store = BlockStore(batch.sparkSession, store_path or f"{files_path.rstrip('/')}_fingerprints")
    files, chunks = pipelines.process(batch, store=store)
    done = files.where("status = 'ok'")
    append(chunks_table(chunks), chunks_path)
    meta = done if "metadata" in done.columns else done.withColumn("metadata", F.create_map().cast("map<string,string>"))
    append(files_table(meta), files_path)
    return pipelines.results(files, chunks)


def start(stream: DataFrame, files_path: str, chunks_path: str, checkpoint: str) -> StreamingQuery:
    """Ingest a stream of documents with what is available now; ``checkpoint`` is a shared folder."""

    def handle(batch: DataFrame, _: int) -> None:
        ingest(batch, files_path, chunks_path)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
