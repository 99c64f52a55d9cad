"""Tables of contents: found, cut out, parsed, given a hierarchy, and joined to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bound, stripped, text_lines
from ..session import by_shuffle

# The title of a table of contents, and the forms of its lines.
_TITLE = r"(?:##\s*Table of Contents|TABLE OF CONTENTS)"
WHOLE = rf"(?i){_TITLE}[\s\S]*?(?=\n##\s*(?!Table of Contents)|\z)"
HEADING_ONLY = rf"(?idm){_TITLE}[\s\S]*?(?=##\s*(?!Table of Contents)|$)"
_PAGE = r"(?:\s*\.{2,}\s*(\d+))?$"
NUMERIC = r"^(\d+(?:\.\d+)*\.?)\s+(.+?)" + _PAGE
CHAPTER = r"(?i)^(CHAPTER\s+(\d+)|ABSTRACT|INTRODUCTION|CONCLUSION|REFERENCES|APPENDIX)" + _PAGE
SIMPLE = r"^(.+?)" + _PAGE


def contents(text: Column, heading_only: bool = False) -> Column:
    """The first table of contents, up to the next heading or the end; null where there is none."""
    found = F.regexp_extract(text, HEADING_ONLY if heading_only else WHOLE, 0)
    return F.when(found != "", found)


def without_contents(text: Column, heading_only: bool = False) -> Column:
    """Without the first table of contents, and without white space at the ends if there was one."""
    found = contents(text, heading_only)
    at = F.instr(text, found)
    rest = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(found), F.length(text)))
    return F.when(found.isNull(), text).otherwise(stripped(rest))


def _prepared(text: Column) -> Column:
    plain = F.replace(F.replace(F.replace(text, F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\s*\.\s*\.", "..")


def is_table(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) > 3


def _entry(line: Column, forced: Column) -> Column:
    part = lambda pattern, k: F.regexp_extract(line, pattern, k)
    page = lambda pattern, k: F.nullif(part(pattern, k), F.lit("")).try_cast("int")
    text = F.lit(None).cast("string")
    number = F.regexp_replace(part(NUMERIC, 1), r"\.$", "")
    level = F.size(F.split(number, r"\."))
    form = lambda title, page, level, number, parent: F.struct(
        title.alias("title"), page.alias("page"), level.cast("int").alias("level"), number.alias("numeric_id"), parent.alias("parent_id")
    )
    numeric = form(stripped(part(NUMERIC, 2)), page(NUMERIC, 3), level, number, F.when(level > 1, F.regexp_replace(number, r"\.\d+$", "")))
    chapter = form(stripped(part(CHAPTER, 1)), page(CHAPTER, 3), F.lit(0), F.nullif(part(CHAPTER, 2), F.lit("")), text)
    simple = form(stripped(part(SIMPLE, 1)), page(SIMPLE, 2), forced, text, text)
    return F.when(line.rlike(NUMERIC), numeric).when(line.rlike(CHAPTER), chapter).when(forced.isNotNull() & line.rlike(SIMPLE), simple)


def entries(text: Column) -> Column:
    """``array<struct<title, page, level, numeric_id, parent_id, parent_idx, full_path>>`` of a table of contents.

    Rows of a table give numbered and chapter entries only; list lines give
    any, at the depth of their marks. Where any entry has a number, parents
    are found by number (of repeated numbers the last), else by level.
    """
    return bound(_prepared(text), _entries)


def _entries(ready: Column) -> Column:
    titled = lambda x: F.contains(F.upper(x), F.lit("TABLE OF CONTENTS"))
    lines = F.transform(text_lines(ready), lambda x: stripped(x))
    row = lambda x: stripped(F.regexp_replace(x, r"^\|+|\|+$", ""))
    rows = F.transform(F.filter(lines, lambda x: (x != "") & ~x.startswith("|---") & ~titled(x)), lambda x: _entry(row(x), F.lit(None).cast("int")))
    marks = lambda x: F.regexp_extract(x, r"^((?:[-*+]\s*)*)", 1)
    depth = lambda x: F.greatest(F.length(F.regexp_replace(marks(x), r"\s", "")) - 1, F.lit(0))
    listed = F.transform(F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~titled(x)), lambda x: _entry(F.regexp_replace(x, r"^(?:[-*+]\s*)+", ""), depth(x)))
    return bound(F.filter(F.when(is_table(ready), rows).otherwise(listed), lambda e: e.isNotNull()), with_hierarchy)


def with_hierarchy(flat: Column) -> Column:
    """Entries in order with ``parent_idx`` (from 0; null at the root) and ``full_path``."""
    numbered = F.exists(flat, lambda e: e["numeric_id"].isNotNull())
    deepest = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(flat, lambda e: e["level"])), F.lit(0)) + 2)
    last = lambda found: F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.transform(found, lambda e: e["i"])), -1)
    spots = F.transform(flat, lambda e, i: F.struct(i.alias("i"), e["level"].alias("level"), e["numeric_id"].alias("number")))

    def parents(spots: Column) -> Column:
        by_number = lambda e: last(F.filter(spots, lambda o: F.coalesce(o["number"] == e["parent_id"], F.lit(False))))
        by_level = lambda e, i: last(F.filter(F.slice(spots, F.lit(1), i), lambda o: o["level"] < e["level"]))
        return bound(numbered, lambda n: F.transform(flat, lambda e, i: e.withField("parent_idx", F.when(n, by_number(e)).otherwise(by_level(e, i)))))

    def paths(entries: Column) -> Column:
        def path(e: Column) -> Column:
            start = F.struct(e["title"].alias("path"), e["parent_idx"].alias("up"))
            up = lambda acc: F.get(entries, acc["up"])
            climb = lambda acc, _: F.when(acc["up"].isNull(), acc).otherwise(
                F.struct(F.concat(up(acc)["title"], F.lit(" > "), acc["path"]).alias("path"), up(acc)["parent_idx"].alias("up"))
            )
            return F.aggregate(F.sequence(F.lit(1), deepest), start, climb, lambda acc: acc["path"])

        return F.transform(entries, lambda e: e.withField("full_path", path(e)))

    return bound(bound(spots, parents), paths)


def parsed(df: DataFrame, text: str, doc: str = "doc_id") -> DataFrame:
    """One row for each entry: ``doc, entry_no`` (from 0) and the fields of ``entries``."""
    return df.where(F.col(text).isNotNull()).select(doc, F.posexplode(entries(F.col(text))).alias("entry_no", "e")).select(doc, "entry_no", "e.*")


def contents_figures(flat: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: number of entries, deepest level (0 for none known), chapters, whether pages and numbers occur."""
    return flat.groupBy(doc).agg(
        F.count("*").alias("total_entries"), F.coalesce(F.max("level"), F.lit(0)).alias("max_depth"), F.count_if(F.col("level") == 0).alias("chapters"),
        F.bool_or(F.col("page").isNotNull()).alias("has_page_numbers"), F.bool_or(F.col("numeric_id").isNotNull()).alias("has_numeric_ids"),
    )


def lookup(flat: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc, key, key_no, title, level, numeric_id, parent_id, full_path)`` under the keys title, ``id. title`` and ``id title``.

    Of entries with the same key the last counts; ``key_no`` orders keys by
    their first appearance.
    """
    keys = F.when(F.col("numeric_id").isNull(), F.array("title")).otherwise(F.array("title", F.concat("numeric_id", F.lit(". "), "title"), F.concat("numeric_id", F.lit(" "), "title")))
    rows = flat.where("title is not null").select(doc, "entry_no", F.posexplode(keys).alias("k", "key"), F.struct("title", "level", "numeric_id", "parent_id", "full_path").alias("entry"))
    merged = rows.groupBy(doc, "key").agg(F.max_by("entry", F.struct("entry_no", "k")).alias("entry"), F.min(F.struct("entry_no", "k")).alias("first"))
    return merged.select(doc, "key", (F.col("first.entry_no") * 3 + F.col("first.k")).alias("key_no"), "entry.*")


FIELDS = ("full_path", "level", "numeric_id", "parent_id")
#: Parts into which the headers of a document are dealt where keys must be searched.
PARTS = 8


def enriched(chunks: DataFrame, keys: DataFrame, doc: str = "doc_id", header: str = "section_header", empty_matches: bool = False) -> DataFrame:
    """Adds ``toc_full_path, toc_level, toc_numeric_id, toc_parent_id`` by the chunk's header.

    An equal key wins, else the first key that contains the header without
    regard to case. Null and blank headers match nothing (``empty_matches``
    lets the empty one match the first key). Distinct headers are matched
    once, so a document with very many chunks costs no more than its headers.
    """
    fields = [F.col(x).alias(f"toc_{x}") for x in FIELDS]
    heads = chunks.select(doc, F.col(header).alias("_h")).distinct()
    heads = heads.where("_h is not null") if empty_matches else heads.where(stripped(F.col("_h")) != "")
    exact = heads.join(by_shuffle(keys.select(doc, F.col("key").alias("_h"), *fields)), [doc, "_h"])
    open_ = heads.join(exact.select(doc, "_h"), [doc, "_h"], "left_anti")
    # headers of a document are dealt to parts, each of which meets all keys of the document
    dealt = open_.withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(PARTS)))
    spread = keys.select(doc, "key", "key_no", *fields, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).alias("_part"))
    inside = dealt.join(by_shuffle(spread), [doc, "_part"]).where(F.contains(F.lower("key"), F.lower("_h")))
    names = [f"toc_{x}" for x in FIELDS]
    first = inside.groupBy(doc, "_h").agg(F.min_by(F.struct(*names), "key_no").alias("_e")).select(doc, "_h", "_e.*")
    return chunks.join(exact.unionByName(first).withColumnRenamed("_h", header), [doc, header], "left")


def resolved(flat: DataFrame, doc: str = "file_id", order: str = "entry_no") -> DataFrame:
    """Entries of a table with ``parent_no`` and ``parent_title``, null at the root.

    In a document where any entry has a number, by number (of repeated ones
    the last); else the nearest earlier entry of a smaller level, whatever
    the levels. Reads the deepest level of the table first.
    """
    deepest = flat.agg(F.max("level")).first()[0] or 0
    numbered = flat.where("numeric_id is not null").groupBy(doc).agg(F.lit(True).alias("_numbered"))
    owners = flat.where("numeric_id is not null").groupBy(doc, F.col("numeric_id").alias("parent_id")).agg(F.max_by(F.struct(F.col(order).alias("no"), "title"), order).alias("_p"))
    by_id = flat.join(numbered, doc, "left").join(owners, [doc, "parent_id"], "left")
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    spot = lambda k: F.max_by(F.struct(F.col(order).alias("no"), "title"), F.when(F.col("level") <= k, F.col(order))).over(w).alias(f"_l{k}")
    staged = by_id.select("*", *[spot(k) for k in range(deepest)])
    held = lambda k: F.when(F.col(f"_l{k}.no").isNotNull() & (F.col("level") == k + 1), F.col(f"_l{k}"))
    near = F.coalesce(*[held(k) for k in range(deepest)]) if deepest else F.lit(None).cast("struct<no:int,title:string>")
    parent = F.when(F.col("_numbered"), F.col("_p")).otherwise(near)
    return staged.withColumn("_up", parent).select(doc, order, "title", "level", "numeric_id", "parent_id", F.col("_up.no").alias("parent_no"), F.col("_up.title").alias("parent_title"))


def nested(flat: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc, contents)``: each document's entries (from ``parsed``) as JSON, every entry with its children under it.

    Built from the deepest level up; a document's table of contents is one row.
    """
    shown = ["title", "page", "level", "numeric_id", "parent_id", "full_path"]
    rows = flat.withColumn("_depth", F.size(F.split("full_path", " > ", -1))).withColumn("_json", F.lit(None).cast("string"))
    entry = lambda kids: F.concat(
        F.regexp_replace(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}), r"\}$", ""), F.lit(',"children":['), F.coalesce(kids, F.lit("")), F.lit("]}")
    )
    joined = lambda: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_no", "_json"))), lambda x: x["_json"]), ",")
    ups = flat.select(doc, "entry_no", "parent_idx")
    heights = [r[0] for r in rows.select("_depth").distinct().collect()]  # levels of nesting
    done = None
    for depth in sorted(heights, reverse=True):
        level = rows.where(F.col("_depth") == depth).drop("_json")
        if done is not None:
            kids = done.groupBy(doc, F.col("parent_idx").alias("entry_no")).agg(joined().alias("_kids"))
            level = level.join(kids, [doc, "entry_no"], "left")
        else:
            level = level.withColumn("_kids", F.lit(None).cast("string"))
        done = level.select(doc, "entry_no", entry(F.col("_kids")).alias("_json")).join(ups, [doc, "entry_no"])
        roots = done.where("parent_idx is null") if depth == 1 else None
    if done is None:
        return flat.select(doc, F.lit("[]").alias("contents")).limit(0)
    return roots.groupBy(doc).agg(F.concat(F.lit("["), joined(), F.lit("]")).alias("contents"))
