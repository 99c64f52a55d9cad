"""Problem 4: oversized texts into pieces under a limit, at natural boundaries.

A text is read in ranges. The worker of a range detects the boundaries that
begin in it; so that both sides of an edge see the same, it reads on to the
left and right (the halo) as long as white space goes on. For files the
ranges are byte ranges dealt to different workers: a first pass gives the
table of boundaries (where each range's own part begins and ends, its
characters and pieces), prefix sums over that table number the pieces and
place them, and a second pass emits the pieces by offset. No worker holds
more than a range and its halo. A text that is a row of a table is in memory
already; its ranges are scanned and stitched by the worker that has it. The
size of a text is its length div 4.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .rows import once

LIMIT, OVERLAP = 500, 50
#: Bytes of a range of a file, characters of a range of a row that is cut, and of one whose boundaries are sought.
RANGE, ROW_RANGE, SCAN_RANGE = 1 << 20, 1 << 16, 1 << 12
#: The white space of Unicode, and the levels from coarse to fine.
SPACE = "\t-\r \x85\xa0  -     　"
LEVELS = {
    "paragraph": re.compile(rf"\n[{SPACE}]*\n"),
    "line": re.compile(r"\n"),
    "sentence": re.compile(rf"\n|(?<=[.!?])(?:(?!\n)[{SPACE}])+"),
    "word": re.compile(rf"[{SPACE}]+"),
}
_IS_SPACE = re.compile(rf"[{SPACE}]")


def most_chars(limit: int) -> int:
    """The longest text whose length div 4 is within the limit."""
    return 4 * limit + 3


def scan_range(text: str, level: str, low: int, high: int) -> tuple[int, int, int] | None:
    """Of the boundaries of a level that begin in [low, high): first start, last end, longest gap between two; None without any."""
    begin = low
    while 0 < begin < len(text) and _IS_SPACE.match(text[begin - 1]):
        begin -= 1
    first = last = None
    gap = 0
    for found in LEVELS[level].finditer(text, begin):
        start = found.start()
        if start >= high:
            break
        if start < low:
            continue
        if first is None:
            first = start
        else:
            gap = max(gap, start - last)
        last = found.end()
    return None if first is None else (first, last, gap)


def longest_piece(text: str, level: str, span: int = SCAN_RANGE) -> int:
    """Longest piece of a text cut at a level, stitched from the tables of its ranges."""
    longest, end = 0, 0
    for low in range(0, max(len(text), 1), span):
        part = scan_range(text, level, low, min(low + span, len(text)))
        if part is not None:
            first, last, gap = part
            longest, end = max(longest, first - end, gap), last
    return max(longest, len(text) - end)


def boundary_of(text: str, limit: int = LIMIT, span: int = SCAN_RANGE) -> str:
    """The first level whose every piece is within the limit, else ``none``."""
    most = most_chars(limit)
    return next((level for level in LEVELS if longest_piece(text, level, span) <= most), "none")


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows whose content is over the limit."""
    return chunks.where(F.length("content") > most_chars(limit))


def natural_boundaries(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(chunk_id, boundary)`` of the chunks over the limit; equal rows once.

    Null, empty and small contents have no row. A chunk id that stands with
    several contents gives each of their boundaries once.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [boundary_of(text, limit) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["chunk_id", "boundary"])

    return oversized(chunks, limit).select("chunk_id", "content").mapInArrow(find, "chunk_id string, boundary string").distinct()


def _cut_end(text: str, start: int, most: int) -> int:
    """Where a piece from ``start`` ends: after the last boundary of the coarsest level in its later three quarters, else after the last white space in it."""
    if most >= len(text):
        return len(text)
    least = start + (most - start) // 4
    for level, pattern in LEVELS.items():
        if level in ("line", "word"):
            at = text.rfind("\n", least, most) if level == "line" else next((i for i in range(most - 1, least - 1, -1) if _IS_SPACE.match(text[i])), -1)
            if at >= 0:
                return at + 1
            continue
        end = max((m.end() for m in pattern.finditer(text, least, most)), default=0)
        if end > start:
            return end
    return next((i + 1 for i in range(min(least, most) - 1, start - 1, -1) if _IS_SPACE.match(text[i])), most)


def _overlap_start(text: str, start: int, floor: int, overlap: int) -> int:
    """Where the repeated end of the predecessor begins: at a word, at most ``overlap`` characters back."""
    low = max(floor, start - overlap)
    if low >= start or low == floor:
        return min(low, start)
    if _IS_SPACE.match(text[low - 1]):
        return low
    found = LEVELS["word"].search(text, low, start)
    return found.end() if found and found.end() < start else low


def _back(limit: int, overlap: int) -> int:
    """Characters of overlap: at most half of a piece."""
    return min(4 * overlap, most_chars(limit) // 2)


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP, start: int = 0) -> list[int]:
    """Where the parts end that tile the text from ``start``; each leaves room for the overlap in its piece.

    Ends depend on the text from ``start`` on only, not on what is repeated
    of a piece before, so the worker of a range knows how many there are.
    """
    most, ends = most_chars(limit), []
    room = most - _back(limit, overlap)
    while start < len(text):
        end = _cut_end(text, start, start + room)
        found = LEVELS["word"].search(text, start, start + most + 1)
        stop = found.start() if found else len(text)
        if end < stop <= start + most:  # a token that is whole with less overlap
            end = stop
        ends.append(end)
        start = end
    return ends


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, start: int = 0, floor: int = 0) -> list[tuple[int, int, int]]:
    """``(overlap_start, start, end)`` of the pieces from ``start``; the parts [start, end) tile the text.

    ``floor``: where the part before ``start`` begins.
    """
    most, back, pieces = most_chars(limit), _back(limit, overlap), []
    for end in cut_points(text, limit, overlap, start):
        pieces.append((_overlap_start(text, start, floor, min(back, most - (end - start))), start, end))
        floor, start = start, end
    return pieces


def _first_boundary(halo: str) -> int:
    """Characters to the end of the first boundary of the coarsest level in a halo; 0 for none."""
    for pattern in LEVELS.values():
        found = pattern.search(halo)
        if found and found.end() < len(halo):
            return found.end()
    return 0


def cut_row(text: str, limit: int = LIMIT, overlap: int = OVERLAP, span: int = ROW_RANGE) -> list[tuple[int, int, int]]:
    """``cut_text`` of a text that is in memory, by ranges: each begins after a boundary in its halo, and is cut on its own."""
    halo = 4 * most_chars(limit)
    starts = [0] + [at + _first_boundary(text[at : at + halo]) for at in range(span, len(text), span)]
    pieces, floor = [], 0
    for a, z in zip(starts, [*starts[1:], len(text)], strict=True):
        if a < z:
            base = max(0, a - _back(limit, overlap))
            part = cut_text(text[base:z], limit, overlap, a - base, max(0, floor - base))
            pieces += [(base + before, base + start, base + end) for before, start, end in part]
            floor = pieces[-1][1]
    return pieces


PIECES = "piece_no int, start_pos bigint, end_pos bigint, n_overlap int, content string, estimated_tokens int"


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(chunk_id, section_header, piece_no, start_pos, end_pos, n_overlap, content, estimated_tokens)``.

    The pieces of every chunk over the limit in order. ``content`` holds the
    last ``n_overlap`` characters of the predecessor and the characters
    [start_pos, end_pos) of the chunk; these tile it. Repeated rows of a
    chunk count once; small, empty and null contents have no row.
    """

    def cut_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for chunk_id, header, text in frame.itertuples(index=False):
                for number, (before, start, end) in enumerate(cut_row(text, limit, overlap)):
                    rows.append((chunk_id, header, number, start, end, start - before, text[before:end], (end - before) // 4))
            yield pd.DataFrame(rows, columns=["chunk_id", "section_header", "piece_no", "start_pos", "end_pos", "n_overlap", "content", "estimated_tokens"])

    rows = once(chunks.select("chunk_id", "section_header", "content"), ["chunk_id", "content"], lambda df: oversized(df, limit))
    return rows.mapInPandas(cut_all, f"chunk_id string, section_header string, {PIECES}")


def tiling(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Per chunk: characters that the pieces tile, hash of the text put together from them, and faults of size, number, place, overlap.

    Only the chunk's own pieces are put together, of which a text has few.
    """
    whole = F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "n_overlap", "content"))), lambda p: p)
    own = lambda p: F.substring(p["content"], p["n_overlap"] + 1, F.length(p["content"]))
    texts = pieces.groupBy("chunk_id").agg(whole.alias("p")).withColumn("text", F.array_join(F.transform("p", own), ""))
    before = lambda p: F.substring(F.col("text"), (p["start_pos"] - p["n_overlap"] + 1).cast("int"), p["n_overlap"])
    right = lambda p, i: (
        (F.floor(F.length(p["content"]) / 4) <= limit) & (p["piece_no"] == i) & (p["n_overlap"] <= 4 * overlap) & (F.substring(p["content"], F.lit(1), p["n_overlap"]) == before(p))
        & (p["start_pos"] == F.coalesce(F.get("p", i - 1)["end_pos"], F.lit(0)))
    )
    return texts.select("chunk_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("hash"), F.size(F.filter("p", lambda p, i: ~right(p, i))).cast("bigint").alias("faults"))


def _reader(path: str) -> tuple[Callable[[int, int], bytes], int]:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
    source = system.open_input_file(inner)

    def read(start: int, stop: int) -> bytes:
        source.seek(max(0, start))
        return source.read(max(0, stop - max(0, start)))

    return read, source.size()


def _snap(read: Callable[[int, int], bytes], at: int, size: int, limit: int) -> int:
    """The byte at which the part of the range beginning at ``at`` begins: after the first boundary of the coarsest level in its halo."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    halo = read(at, at + 4 * most_chars(limit))
    skip = next((k for k, b in enumerate(halo[:4]) if b & 0xC0 != 0x80), 0)  # to the first whole character
    text = halo[skip:].decode("utf-8", "ignore")
    return at + skip + len(text[: _first_boundary(text)].encode())


def split_files(spark: SparkSession, paths: str | list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE) -> DataFrame:
    """``(path, piece_no, start_pos, end_pos, n_overlap, content, estimated_tokens)`` of UTF-8 files of any size.

    Positions count characters of the file. Bytes that are not UTF-8 are
    replaced; empty files have no row. Only names and lengths of the files
    pass through Spark; workers read the bytes of their ranges.
    """
    back = _back(limit, overlap)
    files = spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("low"))
    ranges = ranges.repartition(F.col("path"), F.col("low"))

    def part(read: Callable, low: int, high: int, back: int) -> tuple[str, int]:
        """Text from up to ``back`` characters before ``low`` to ``high``, and where ``low`` lies in it."""
        halo = read(low - 4 * back, low)
        halo = halo[next((k for k, b in enumerate(halo[:4]) if b & 0xC0 != 0x80), 0) :] if low > 4 * back else halo
        left = halo.decode("utf-8", "replace")
        left = left[-back:] if back else ""
        return left + read(low, high).decode("utf-8", "replace"), len(left)

    def detect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, low in frame.itertuples(index=False):
                read, size = _reader(path)
                a, z = _snap(read, low, size, limit), _snap(read, low + range_bytes, size, limit)
                if a < z:
                    text, at = part(read, a, z, back)
                    ends = cut_points(text, limit, overlap, at)
                    rows.append((path, a, z, len(text) - at, len(ends), len(text) - ([at] + ends)[-2]))
            yield pd.DataFrame(rows, columns=["path", "a", "z", "n_chars", "n_pieces", "last_chars"])

    table = cut(ranges.mapInPandas(detect, "path string, a bigint, z bigint, n_chars bigint, n_pieces bigint, last_chars bigint"))
    earlier = W.partitionBy("path").orderBy("a").rowsBetween(W.unboundedPreceding, -1)
    placed = table.select(
        "path", "a", "z",
        F.coalesce(F.sum("n_chars").over(earlier), F.lit(0)).alias("chars"),
        F.coalesce(F.sum("n_pieces").over(earlier), F.lit(0)).alias("pieces"),
        F.coalesce(F.lag("last_chars").over(W.partitionBy("path").orderBy("a")), F.lit(0)).alias("last"),
    )

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, a, z, chars, numbers, last in frame.itertuples(index=False):
                read, _ = _reader(path)
                text, at = part(read, a, z, back)
                for k, (before, start, end) in enumerate(cut_text(text, limit, overlap, at, max(0, at - last))):
                    rows.append((path, numbers + k, chars + start - at, chars + end - at, start - before, text[before:end], (end - before) // 4))
            yield pd.DataFrame(rows, columns=["path", "piece_no", "start_pos", "end_pos", "n_overlap", "content", "estimated_tokens"])

    return placed.repartition(F.col("path"), F.col("a")).mapInPandas(emit, f"path string, {PIECES}")
