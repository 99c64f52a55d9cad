"""Sections of a document, found inside its row: no shuffle, whatever its length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NUMBERED, bound, heading_style, part_of, scanned, stripped, text_lines


def _at(line: Column, place: Column) -> Column:
    return F.struct(place.alias("at"), line.alias("line"))


def numeric_headings(text: Column) -> Column:
    """``array<struct<at, level, header>>`` of lines such as ``1.2 Title``; the header is ``1.2. Title``."""
    found = F.filter(F.transform(text_lines(text), _at), lambda x: stripped(x["line"]).rlike(NUMBERED))

    def heading(x: Column) -> Column:
        bare = stripped(x["line"])
        parts = F.split(F.regexp_replace(F.regexp_extract(bare, NUMBERED, 1), r"\.$", ""), r"\.")
        plain = F.transform(parts, lambda p: F.regexp_replace(p, r"^0+(?=\d)", ""))
        return F.struct(x["at"].alias("at"), F.size(parts).alias("level"), F.concat(F.array_join(plain, "."), F.lit(". "), F.regexp_extract(bare, NUMBERED, 2)).alias("header"))

    return F.transform(found, heading)


def markdown_headings(text: Column, levels: int = 4) -> Column:
    """``array<struct<at, level, header>>`` of lines that begin with 1 to ``levels`` hashes, outside code fences."""
    mark = rf"^(#{{1,{levels}}})\s+(.*)$"
    marked = lambda x: x["line"].rlike(r"^(?:```|~~~)") | x["line"].rlike(mark)
    placed = F.filter(F.transform(text_lines(text), lambda x, i: F.struct(i.alias("at"), stripped(x).alias("line"))), marked)

    def outside(lines: Column) -> Column:
        """Headings among fences and headings, where an even number of fences stands before."""
        fenced = scanned(lines, F.lit(False), "boolean", lambda s, x: s != ~x["line"].startswith("#"))
        return bound(fenced, lambda f: F.filter(lines, lambda x, i: x["line"].startswith("#") & ~F.get(f, i)))

    return F.transform(
        bound(placed, outside),
        lambda x: F.struct(x["at"].alias("at"), F.length(F.regexp_extract(x["line"], mark, 1)).alias("level"), F.regexp_extract(x["line"], mark, 2).alias("header")),
    )


_LIVE = "struct<live:array<struct<level:int,header:string>>,top:string,chars:int>"


def sections(df: DataFrame, headings: Column, text: str = "markdown") -> DataFrame:
    """One row for each section: ``section_idx, section_header, section_level, parent_section, top_header, section_content, char_start, char_end``.

    The heading line stays in the content. The parent is the live heading
    one level up, null where that level is absent; text before the first
    heading has no header. ``char_start`` counts the contents before. Null
    texts have no section. One scan over the headings, which keeps the live
    ones, so the time grows with the text.
    """
    nothing = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("header"))
    none = F.struct(F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("header"))
    last = lambda live: F.element_at(F.concat(F.array(none), live), -1)
    above = lambda s, x: F.filter(s["live"], lambda o: o["level"] < x["level"])
    top = lambda s, x: F.when(x["level"] == 1, x["header"]).otherwise(s["top"])

    def step(s: Column, x: Column) -> Column:
        own = F.struct(x["level"].alias("level"), x["header"].alias("header"))
        live = F.when(x["level"].isNull(), s["live"]).otherwise(F.concat(above(s, x), F.array(own)))
        return F.struct(live.alias("live"), top(s, x).alias("top"), (s["chars"] + x["size"]).alias("chars"))

    def parts(held: Column) -> Column:
        lines, h = held["lines"], held["heads"]
        bounds = F.when((F.size(h) == 0) | (F.coalesce(F.get(h, F.lit(0))["at"], F.lit(0)) > 0), F.concat(F.array(nothing), h)).otherwise(h)
        content = lambda b, x, i: F.array_join(part_of(lines, x["at"], F.coalesce(F.get(b, i + 1)["at"], F.size(lines))), "\n")
        cut = bound(bounds, lambda b: F.transform(b, lambda x, i: F.struct(x["level"].alias("level"), x["header"].alias("header"), content(b, x, i).alias("content"))))
        return F.transform(cut, lambda x: x.withField("size", F.length(x["content"])))

    def whole(cut: Column) -> Column:
        start = F.struct(F.array().cast("array<struct<level:int,header:string>>").alias("live"), F.lit(None).cast("string").alias("top"), F.lit(0).alias("chars"))
        slim = F.transform(cut, lambda x: x.dropFields("content"))

        def section(x: Column, i: Column, s: Column) -> Column:
            up = last(above(s, x))
            return F.struct(
                i.alias("section_idx"), x["header"].alias("section_header"), x["level"].alias("section_level"), F.when(up["level"] == x["level"] - 1, up["header"]).alias("parent_section"),
                top(s, x).alias("top_header"), x["content"].alias("section_content"), s["chars"].alias("char_start"), (s["chars"] + x["size"]).alias("char_end"),
            )

        states = bound(slim, lambda items: scanned(items, start, _LIVE, step))
        return bound(states, lambda held: F.transform(cut, lambda x, i: section(x, i, F.get(held, i))))

    found = df.where(F.col(text).isNotNull()).withColumn("_held", F.struct(text_lines(F.col(text)).alias("lines"), headings.alias("heads")))
    return found.select(*df.columns, F.explode(bound(bound(F.col("_held"), parts), whole)).alias("_s")).select(*df.columns, "_s.*")


def numeric_sections(df: DataFrame, text: str = "markdown") -> DataFrame:
    return sections(df, numeric_headings(F.col(text)), text)


def markdown_sections(df: DataFrame, text: str = "markdown", levels: int = 4) -> DataFrame:
    return sections(df, markdown_headings(F.col(text), levels), text)


def styled_sections(df: DataFrame, text: str = "markdown") -> DataFrame:
    """Markdown sections of texts in markdown style, numeric ones of all others."""
    style = heading_style(F.col(text))
    return sections(df, F.when(style == "numeric", numeric_headings(F.col(text))).otherwise(markdown_headings(F.col(text))), text)
