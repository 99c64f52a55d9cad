"""Text functions as column expressions: counting, cleaning, headings, names.

All stay inside the JVM. Null text gives null unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that carry one of these marks are scanner waste (fixed values).
WASTE_MARKS = r"(?i)1\\_b|<latexi|&lt;|&gt;|64=\""
#: What stands for a chunk of which nothing remained (fixed value).
REMOVED = "[REMOVED: Corrupted LaTeX content]"
NUMBERED = r"^(\d+(?:\.\d+)*\.?)\s+(.+)$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it, also inside its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part_of(items: Column, start: Column, stop: Column) -> Column:
    """Items from ``start`` to before ``stop``, which is greater; taken one by one, where ``slice`` would go over the whole array."""
    return F.transform(F.sequence(start, stop - 1), lambda i: F.get(items, i))


#: Items of a block of ``scanned``.
BLOCK = 64


def scanned(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """The state before each item of an array, ``zero`` being the first and ``step`` giving the next; ``kind`` is the state's type.

    A fold that gathers its states copies all of them at every step. Here
    the array is cut into blocks: one fold over the blocks keeps the state
    at each block's begin, then each block is folded by itself, so the time
    grows with the array and not with its square.
    """
    empty = F.array().cast(f"array<{kind}>")
    gather = lambda s, done: F.struct(s.alias("s"), done.alias("done"))
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    blocks_of = F.transform(F.sequence(F.lit(0), last), lambda k: part_of(items, k * BLOCK, F.least(F.size(items), (k + 1) * BLOCK)))
    cut = F.when(F.size(items) > 0, blocks_of).otherwise(F.array(F.slice(items, 1, 0)))

    def through(blocks: Column) -> Column:
        begins = F.aggregate(blocks, gather(zero, empty), lambda acc, b: gather(F.aggregate(b, acc["s"], step), F.concat(acc["done"], F.array(acc["s"]))), lambda acc: acc["done"])
        within = lambda b, s: F.aggregate(b, gather(s, empty), lambda acc, x: gather(step(acc["s"], x), F.concat(acc["done"], F.array(acc["s"]))), lambda acc: acc["done"])
        return bound(begins, lambda held: F.flatten(F.transform(blocks, lambda b, k: within(b, F.get(held, k)))))

    return bound(cut, through)


def _chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return _chain(text, [(r"(?U)^\s+", ""), (r"(?U)\s+$", "")])


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def tokens_by_words(text: Column) -> Column:
    """1.3 tokens a word, rounded down, at least 1."""
    return F.greatest(F.lit(1), F.floor(word_count(text) * 13 / 10)).cast("int")


def tokens_by_length(text: Column) -> Column:
    """A token for four characters, at least 1; 0 for the empty text."""
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("int")


def tokens_by_quarter(text: Column) -> Column:
    """A token for four characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def letter_share(text: Column) -> Column:
    """Letters among all characters; 0 for the empty text."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(letters / F.length(text))


def heading_style(text: Column) -> Column:
    """``markdown`` or ``numeric``: numeric only where no markdown heading stands."""
    markdown = text.rlike(r"(?dm)^#{1,4}\s+.+")
    numeric = text.rlike(r"(?dm)^(?!#{1,4}\s)\d+(?:\.\d+)*\.?\s+.+")
    return F.when(~markdown & numeric, "numeric").when(text.isNotNull(), "markdown")


def numbered_heading(line: Column) -> Column:
    """``struct<levels array<int>, title string>`` of a line such as ``1.2 Title``, else null."""
    bare = stripped(line)
    levels = F.transform(F.split(F.regexp_replace(F.regexp_extract(bare, NUMBERED, 1), r"\.$", ""), r"\."), lambda p: p.try_cast("int"))
    return F.when(bare.rlike(NUMBERED), F.struct(levels.alias("levels"), F.regexp_extract(bare, NUMBERED, 2).alias("title")))


def sentences(text: Column) -> Column:
    """Parts between white space that follows ``.``, ``!`` or ``?``."""
    return F.split(text, r"(?U)(?<=[.!?])\s+", -1)


def normalised_layout(text: Column) -> Column:
    """Markdown of the layout converter without comments, page lines, dot leaders and rules."""
    return stripped(
        _chain(
            text,
            [
                (r"(?s)<!--.*?-->", " "),
                (r"(?mdi)^\s*(page\s*\d+|\d{1,4})\s*$", ""),
                (r"\.{3,}", " ... "),
                (r"-{3,}", "\n"),
                (r"\n{3,}", "\n\n"),
            ],
        )
    )


def single_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def spaced_headings(text: Column) -> Column:
    return _chain(text, [(r"(?md)^(#{1,6})\s{2,}", "$1 "), (r"(?md)^(#{1,6})([^\s#])", "$1 $2")])


def without_rule_lines(text: Column) -> Column:
    """Without lines of bars, dashes and blanks only."""
    return F.array_join(F.filter(text_lines(text), lambda x: ~x.rlike(r"^[|\-\s]+$")), "\n")


def without_artifacts(text: Column) -> Column:
    return _chain(text, [(r"(?md)^\s*\d+\s*$", ""), (r"(?md)^\s*[a-zA-Z]\s*$", ""), (r"(https?://)\s+", "$1")])


def even_lists(text: Column) -> Column:
    return _chain(text, [(r"(?md)^[*\-]\s+", "- "), (r"(?md)^(\d+)\.\s{2,}", "$1. ")])


def even_spacing(text: Column) -> Column:
    return _chain(text, [(r"(?md)[ \t]+$", ""), (r"\s+([.,;:!?])", "$1"), (r"([.,;:!?])([A-Za-z])", "$1 $2")])


def cleaned_markdown(text: Column) -> Column:
    """All cleaning steps of the page loader in their order."""
    for step in (single_blank_lines, spaced_headings, without_rule_lines, without_artifacts, even_lists, even_spacing):
        text = step(text)
    return stripped(text)


def _kept_line(line: Column) -> Column:
    return bound(stripped(line), _kept_bare)


def _kept_bare(bare: Column) -> Column:
    size = F.length(bare)
    marked = bare.rlike(r"^(?:[#\-*>]|1\.|2\.)")
    ended = bare.rlike(r"[.:!?)\]]$")
    odd = F.length(F.regexp_replace(bare, r"[\p{L}\p{N}]", "")) / F.greatest(size, F.lit(1)) > 0.4
    return (bare == "") | (~bare.rlike(WASTE_MARKS) & ((size >= 15) | ((size > 2) & (marked | ended) & ~odd)))


def without_waste(text: Column, content_type: Column) -> Column:
    """Without scanner waste lines; code and math stay as they are, an emptied text becomes ``REMOVED``.

    Of short lines only those remain that are marked up or end like a
    sentence and are not mostly symbols.
    """
    lines = F.split(text, r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]")
    kept = F.transform(F.filter(lines, _kept_line), lambda x: F.when(stripped(x) == "", F.lit("")).otherwise(x))
    joined = single_blank_lines(stripped(F.array_join(kept, "\n")))
    result = bound(joined, lambda t: F.when(F.length(t) < 5, F.lit(REMOVED)).otherwise(t))
    return F.when(F.coalesce(content_type.isin("code", "math"), F.lit(False)), text).otherwise(result)


def front_matter(header: Column) -> Column:
    """Whether a section header is one of front matter; no header is."""
    names = ("", "ARTICLE HISTORY", "ABSTRACT", "KEYWORDS", "AUTHOR INFORMATION")
    return F.upper(stripped(F.coalesce(header, F.lit("")))).isin(*names)


def file_label(title: Column, fallback: str = "document") -> Column:
    """A title as file name: letters, digits and ``_``, at most 200 characters."""
    name = _chain(F.coalesce(title, F.lit("")), [(r"(?U)[^\w\s\-]", ""), (r"(?U)[-\s]+", "_")])
    return F.when(F.length(name) == 0, F.lit(fallback)).otherwise(F.substring(name, 1, 200))


def path_parts(path: Column) -> Column:
    """``struct<name, stem, suffix>`` of a path; the suffix in lower case, with its dot."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return F.struct(name.alias("name"), stem.alias("stem"), F.lower(suffix).alias("suffix"))
