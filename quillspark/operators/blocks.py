"""Blocks of code, math and tables within sections, and splitting to a budget."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound, part_of, scanned, sentences, stripped, tokens_by_length, tokens_by_quarter, tokens_by_words

# What opens and closes special blocks, in the order of trial.
PATTERNS = (
    ("code", r"```[\s\S]*?```", 0),
    ("math", r"\$\$[\s\S]*?\$\$", 0),
    ("math", r"\\\[[\s\S]*?\\\]", 0),
    ("math", r"\\begin\{(equation|align|gather|multline|eqnarray).*?\}\\end\{\1\}", 0),
    ("table", r"(?:^\|.*\|\s*\n^\|[-: ]+\|\s*\n(?:^\|.*\|\s*\n)+)", re.MULTILINE),
)
BLOCKS = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("start_idx", T.IntegerType()), T.StructField("end_idx", T.IntegerType())]))


def find_blocks(text: str | None) -> list[tuple[str, str, int, int]]:
    """Special blocks and the prose between them, stripped; patterns are sought on their own, so blocks may overlap.

    A text of which nothing remains is one prose block as it stands; null has none.
    """
    if text is None:
        return []
    hits = sorted(((m.start(), n, m.end(), kind) for n, (kind, p, flags) in enumerate(PATTERNS) for m in re.finditer(p, text, flags)), key=lambda h: h[:2])
    out, end = [], 0

    def prose(a: int, z: int) -> None:
        part = text[a:z].strip()
        if part:
            out.append((part, "prose", a, z))

    for start, _, stop, kind in hits:
        if start > end:
            prose(end, start)
        out.append((text[start:stop], kind, start, stop))
        end = stop
    if end < len(text):
        prose(end, len(text))
    return out or [(text, "prose", 0, len(text))]


@F.pandas_udf(BLOCKS)
def exact_blocks(text: pd.Series) -> pd.Series:
    names = ("content", "content_type", "start_idx", "end_idx")
    return pd.Series([[dict(zip(names, b, strict=True)) for b in find_blocks(t)] for t in text])


def _joined(parts: Column, fresh: Column, glue: str) -> Column:
    """Parts put together from each one that is marked ``fresh`` to the next."""
    starts = F.filter(F.transform(fresh, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    piece = lambda s, at, k: F.array_join(part_of(parts, at, F.coalesce(F.get(s, k + 1), F.size(parts))), glue)
    return bound(starts, lambda s: F.transform(s, lambda at, k: piece(s, at, k)))


def _packed(parts: Column, most: int, tokens: Callable[[Column], Column], glue: str, tail: str = "") -> Column:
    """Parts put together in order while the whole is within the budget; a part over it stands alone."""
    over = lambda now, part: now.isNull() | (tokens(F.concat(now, F.lit(glue), part, F.lit(tail))) > most)
    step = lambda now, part: F.when(over(now, part), part).otherwise(F.concat(now, F.lit(glue), part))

    def packed(held: Column) -> Column:
        before = scanned(held, F.lit(None).cast("string"), "string", step)
        return bound(before, lambda b: _joined(held, F.transform(held, lambda part, i: over(F.get(b, i), part)), glue))

    return bound(parts, packed)


def split_lines(text: Column, most: int, tokens: Callable[[Column], Column] = tokens_by_words) -> Column:
    """Pieces of whole lines within the budget (code and math)."""
    pieces = F.transform(_packed(F.split(text, "\n", -1), most, tokens, "\n", "\n"), lambda x: F.regexp_replace(x, r"\n+$", ""))
    return F.when(tokens(text) <= most, F.array(text)).otherwise(pieces)


def split_table(text: Column, most: int, tokens: Callable[[Column], Column] = tokens_by_words) -> Column:
    """Pieces of rows within the budget, each under the table's two head lines."""
    rows = F.split(stripped(text), "\n", -1)
    head = F.concat(F.get(rows, F.lit(0)), F.lit("\n"), F.get(rows, F.lit(1)), F.lit("\n"))
    bodies = _packed(F.slice(rows, F.lit(3), F.greatest(F.size(rows) - 2, F.lit(0))), most, lambda t: tokens(F.concat(head, t)), "\n")
    return F.when((tokens(text) <= most) | (F.size(rows) < 3), F.array(text)).otherwise(F.transform(bodies, lambda b: F.concat(head, b)))


def split_sentences_hard(text: Column, most: int) -> Column:
    """Sentences put together within the budget; what is still over it is cut every ``4 * most`` characters.

    A code fence is never cut at a sentence end.
    """
    fences = F.regexp_extract_all(text, F.lit(r"(?s)```.*?```"), F.lit(0))
    hidden = F.aggregate(
        F.transform(fences, lambda f, i: F.struct(f.alias("f"), F.concat(F.lit("@@CODE"), i.cast("string"), F.lit("@@")).alias("t"))), text, lambda acc, x: F.replace(acc, x["f"], x["t"])
    )
    packed = _packed(F.filter(sentences(hidden), lambda s: s != ""), most, tokens_by_length, " ")
    shown = F.transform(
        packed, lambda p: F.aggregate(F.transform(fences, lambda f, i: F.struct(f.alias("f"), F.concat(F.lit("@@CODE"), i.cast("string"), F.lit("@@")).alias("t"))), stripped(p), lambda acc, x: F.replace(acc, x["t"], x["f"]))
    )
    width = 4 * most
    hard = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / width).cast("int")), lambda k: F.substring(p, k * width + 1, F.lit(width)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(shown, lambda p: F.when(tokens_by_length(p) > most, hard(p)).otherwise(F.array(p)))))


def split_sentences_sum(text: Column, most: int) -> Column:
    """Sentences put together while the sum of their own counts is within the budget; never empty, never cut."""
    sizes = lambda parts: F.transform(parts, tokens_by_quarter)
    step = lambda n, x: F.when(n.isNull() | (n + x > most), x).otherwise(n + x)

    def packed(parts: Column) -> Column:
        before = bound(sizes(parts), lambda held: scanned(held, F.lit(None).cast("int"), "int", step))
        fresh = lambda b: F.transform(parts, lambda part, i: F.get(b, i).isNull() | (F.get(b, i) + tokens_by_quarter(part) > most))
        return bound(before, lambda b: _joined(parts, fresh(b), " "))

    return bound(sentences(text), packed)


SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_recursive(text: str, most: int, overlap: int, count: Callable[[str], int], separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces within ``most`` tokens: cut at the first separator present, put together again, too large parts cut by the next.

    Neighbours share up to ``overlap`` tokens of whole parts.
    """
    mark = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(mark) + 1 :]
    parts = list(text) if mark == "" else [p if i == 0 else mark + p for i, p in enumerate(text.split(mark))]
    out, now = [], []

    def flush() -> None:
        whole = "".join(now).strip()
        if whole:
            out.append(whole)

    size = 0
    for part in parts:
        n = count(part)
        if n > most and rest:
            flush()
            now, size = [], 0
            out.extend(split_recursive(part, most, overlap, count, rest))
            continue
        if size + n > most and now:
            flush()
            while now and (size > overlap or size + n > most):
                size -= count(now.pop(0))
        now.append(part)
        size += n
    flush()
    return out


def words_count(text: str) -> int:
    return max(1, len(text.split()) * 13 // 10)


def recursive_splitter(most: int, overlap: int, count: Callable[[str], int] = words_count) -> Callable[[Column], Column]:
    """``array<string>`` of prose pieces; ``most`` is four times the gate of the chunker, as in its established form. ``count`` must be picklable."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(text: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else split_recursive(t, most, overlap, count) for t in text])

    return split


def chunks_of_sections(
    df: DataFrame, most: int, overlap: int = 50, split_prose: bool = True, tokens: Callable[[Column], Column] = tokens_by_words, count: Callable[[str], int] = words_count
) -> DataFrame:
    """One row for each piece of each block: ``section_idx, block_idx, piece_idx, content, content_type, estimated_tokens``.

    Only prose above the budget goes through Python a second time. A
    tokenizer is plugged in as ``tokens`` (a column of counts) and ``count``
    (the same for one text).
    """
    c = F.col
    content = stripped(c("section_content"))
    blocks = df.select("*", F.posexplode(exact_blocks(content)).alias("block_idx", "_b"))
    blocks = blocks.withColumn("content_type", c("_b.content_type")).withColumn("_text", c("_b.content")).drop("_b")
    over = (c("content_type") == "prose") & (tokens(c("_text")) > most)
    long = blocks.where(over)
    rest = blocks.where(~over)
    pieces = F.when(c("content_type") == "table", split_table(c("_text"), most, tokens)).when(c("content_type").isin("code", "math"), split_lines(c("_text"), most, tokens)).otherwise(F.array("_text"))
    rest = rest.select("*", F.posexplode(pieces).alias("piece_idx", "content"))
    cut = recursive_splitter(4 * most, overlap, count)(c("_text")) if split_prose else F.array("_text")
    long = long.select("*", F.posexplode(cut).alias("piece_idx", "content"))
    both = rest.unionByName(long).where(~((c("content_type") == "prose") & (stripped(c("content")) == "")))
    return both.withColumn("estimated_tokens", tokens(c("content"))).drop("_text")
