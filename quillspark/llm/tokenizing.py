"""Problem 5: token ids of a whole corpus by a public byte-level vocabulary.

Texts are cut into pre-tokens by the JVM's regex engine. Arrow batches of
pre-tokens go to Python, where the distinct ones of a batch are found by
dictionary encoding; each is encoded once in a worker's life (``bpe.py``)
and the ids of all are gathered by array arithmetic. No shuffle.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary

#: Where the public vocabularies lie unless a caller says otherwise.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

#: White space of Unicode, for classes of Java's engine, and
#: the pre-token pattern published with the vocabulary, with it put in.
SPACE = r"\t-\r\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + "]+"
)

#: Distinct pre-tokens a worker remembers; beyond it starts to remember anew.
REMEMBERED = 500_000

_known: dict[str, tuple[Vocabulary, dict[bytes, np.ndarray]]] = {}


def _worker(lines: bytes) -> tuple[Vocabulary, dict[bytes, np.ndarray]]:
    key = hashlib.md5(lines).hexdigest()
    if key not in _known:
        _known[key] = (Vocabulary(lines), {})
    return _known[key]


def ids_of_lists(pieces: pa.ListArray, lines: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, end to end, and the offsets of the rows in them."""
    vocabulary, memory = _worker(lines)
    if len(memory) > REMEMBERED:
        memory.clear()
    flat = pieces.flatten()
    bounds = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    if not len(flat):
        return np.zeros(0, np.int32), np.zeros(len(pieces) + 1, np.int64)
    coded = pc.dictionary_encode(flat.cast(pa.binary()))
    each = []
    for piece in coded.dictionary.to_pylist():
        ids = memory.get(piece)
        if ids is None:
            ids = memory[piece] = np.array(vocabulary.encode(piece), np.int32)
        each.append(ids)
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    pool = np.concatenate(each)
    index = coded.indices.to_numpy()
    lengths = sizes[index]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    ids = pool[np.repeat(starts[index] - ends[:-1], lengths) + np.arange(ends[-1])]
    return ids, ends[bounds]


def vocabulary_lines(spark: SparkSession, name: str = "byte_bpe_50k", path: str | None = None):
    """The vocabulary file (below 2 MB, checked), sent to the executors once."""
    with open(os.path.join(path or TOKENIZERS, f"{name}.tiktoken"), "rb") as file:
        lines = file.read()
    if len(lines) > 2_000_000:
        raise ValueError(f"vocabulary of {len(lines)} bytes is too large to send to every executor")
    return spark.sparkContext.broadcast(lines)


def _pieces(df: DataFrame, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("_id"), *extra, F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0)).alias("_pieces"))


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", path: str | None = None) -> DataFrame:
    """``(id_col, ids array<int>)`` of every row, without special tokens.

    Null and empty texts give an empty list. Repeated rows and null ids are
    kept as they come, one row out for each row in; other columns of ``df``
    are ignored, whatever their names.
    """
    lines = vocabulary_lines(df.sparkSession, name, path)
    kind = df.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = ids_of_lists(batch.column(1), lines.value)
            out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[id_col, "ids"])

    return _pieces(df, id_col, text_col, []).mapInArrow(encode, f"`{id_col}` {kind.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", path: str | None = None) -> DataFrame:
    """``(id_col, n_tokens int)`` of every row; 0 for null and empty texts."""
    lines = vocabulary_lines(df.sparkSession, name, path)
    kind = df.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bounds = ids_of_lists(batch.column(1), lines.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int32())], names=[id_col, "n_tokens"])

    return _pieces(df, id_col, text_col, []).mapInArrow(count, f"`{id_col}` {kind.simpleString()}, n_tokens int")
