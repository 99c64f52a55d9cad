"""Rules that accept or refuse chunks, and the figures over their verdicts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import REMOVED, letter_share, stripped, text_lines

# Words and marks by which chunks are refused, and patterns.
HEADER_TERMS = (
    "table of contents", "references", "reference", "bibliography", "acknowledgment", "acknowledgement", "appendix", "author", "index", "funding", "glossary",
)
LAYOUT_HEADER_TERMS = ("table of contents", "references", "bibliography", "acknowledgment", "acknowledgement", "appendix", "author")
LAYOUT_PREFIXES = ("the image is", "<!-- image -->")
LAYOUT_MARKS = ("copyright", "doi:", "contact@", "http://", "https://", "www.")
CODE = r"def\s+\w+\(|import\s+\w+|class\s+\w+:|const\s+\w+\s*=|function\s+\w+\("
LEADER = r"\.{3,}\s*\d{1,4}(?:\s*\|)?$"
LAYOUT_LEADER = r"\.{3,}\s*\d{1,4}$"
LINK = r"https?://|www\.|doi:10\.\d{4,9}/"


def _verdict(use: bool, reason: Column | str, kind: str, score: Column | float | None) -> Column:
    held = score if isinstance(score, Column) else F.lit(score)
    return F.struct(
        F.lit(use).alias("should_use"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
        F.lit(kind).alias("content_type"), held.cast("double").alias("quality_score"),
    )


def _first(rules: list[tuple[Column, Column]], last: Column) -> Column:
    chosen = F.when(*rules[0])
    for test, verdict in rules[1:]:
        chosen = chosen.when(test, verdict)
    return chosen.otherwise(last)


def _any_in(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def _first_in(text: Column, marks: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in marks])


def _leader_lines(text: Column, pattern: str) -> Column:
    return F.size(F.filter(text_lines(text), lambda x: stripped(x).rlike(pattern)))


def scored(df: DataFrame, text: str = "content", header: str = "section_header", fixed_placeholder: bool = False) -> DataFrame:
    """Adds ``evaluation`` (should_use, reason, content_type, quality_score) by the rules with scores.

    The first rule that holds decides. Null text counts as empty, null
    header as none. ``fixed_placeholder``: also refuse the placeholder of
    emptied chunks, which the case-sensitive rule otherwise lets pass.
    """
    bare, head, low, share, rows, n, top, many = (f"_{k}" for k in ("bare", "head", "low", "share", "rows", "n", "top", "many"))
    prepared = (
        df.withColumn(bare, stripped(F.coalesce(text, F.lit(""))))
        .withColumn(head, F.lower(F.coalesce(header, F.lit(""))))
        .withColumn(low, F.lower(bare))
        .withColumn(share, letter_share(F.col(bare)))
    )
    c = F.col
    prepared = prepared.withColumn(top, F.substring(low, 1, 400)).withColumn(n, F.length(bare)).withColumn(many, _leader_lines(c(bare), LEADER) > 3)
    lines = text_lines(c(bare))
    prepared = prepared.withColumn(rows, F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|")))))
    useful = ~F.contains(c(head), F.lit("contents")) & (c(rows) > 5) & (c(rows) / F.size(lines) > 0.4)
    by_size = F.when(c(n).between(400, 1200), 25).when(c(n).between(200, 399) | c(n).between(1201, 2000), 10).otherwise(0)
    whole = F.substring(bare, 1, 1).rlike(r"^\p{Lu}") & c(bare).rlike(r"[.!?]$")
    points = 50 + by_size + F.when(c(share) > 0.75, 15).otherwise(0) + F.when(whole, 10).otherwise(0) + F.when(F.length(F.coalesce(header, F.lit(""))) > 3, 5).otherwise(0)
    prefixes = ("figure:", "fig.") + ((REMOVED.lower(),) if fixed_placeholder else ())
    rules = [
        (c(n) < 30, _verdict(False, "Empty or image-only", "metadata", 0)),
        (_any_in(c(head), HEADER_TERMS), _verdict(False, F.concat(F.lit("Header filter: "), c(head)), "metadata", 0)),
        (reduce(lambda a, b: a | b, [c(low).startswith(p) for p in prefixes]), _verdict(False, "Forbidden prefix", "other", 0)),
        ((c(n) < 150) & c(low).rlike(LINK), _verdict(False, "Citation/Link chunk", "metadata", 0)),
        (_any_in(c(top), ("copyright", "all rights reserved")), _verdict(False, "Metadata keyword detected", "metadata", 0)),
        (c(many) | F.contains(c(top), F.lit("table of contents")), _verdict(False, "Detected Table of Contents", "toc", 0)),
        (c(bare).rlike(f"(?U){CODE}"), _verdict(True, "Source code block", "code", 85)),
        ((c(share) < 0.30) & useful, _verdict(True, "Useful data table", "table", 70)),
        (c(share) < 0.30, _verdict(False, F.format_string("Low alpha (%.2f%%)", c(share) * 100), "metadata", 20)),
    ]
    verdict = _first(rules, _verdict(True, "OK", "main_content", F.least(points, F.lit(100))))
    return prepared.withColumn("evaluation", verdict).drop(bare, head, low, share, rows, n, top, many)


def layout_scored(df: DataFrame, text: str = "content", header: str = "section_header") -> DataFrame:
    """Adds ``evaluation`` by the rules of the layout pipeline, which give no score (null).

    Null text counts as empty, null header as none.
    """
    bare, head, low, share, rows = (f"_{k}" for k in ("bare", "head", "low", "share", "rows"))
    c = F.col
    prepared = (
        df.withColumn(bare, stripped(F.coalesce(text, F.lit(""))))
        .withColumn(head, F.lower(F.coalesce(header, F.lit(""))))
        .withColumn(low, F.lower(bare))
        .withColumn(share, letter_share(F.col(bare)))
        .withColumn(rows, F.size(F.filter(text_lines(F.col(bare)), lambda x: F.contains(x, F.lit("|")))))
    )
    top = F.substring(low, 1, 400)
    starts = F.coalesce(*[F.when(c(low).startswith(p), F.lit(p)) for p in LAYOUT_PREFIXES])
    quoted = lambda say, what: F.concat(F.lit(f"{say} '"), what, F.lit("'"))
    useful = ~F.contains(c(head), F.lit("contents")) & (c(rows) > 5) & ~c(head).isin("", "##", "###")
    rules = [
        (_any_in(c(head), LAYOUT_HEADER_TERMS), _verdict(False, quoted("Header contains", _first_in(c(head), LAYOUT_HEADER_TERMS)), "metadata", None)),
        ((F.length(bare) < 30) | (c(low) == "<!-- image -->"), _verdict(False, "Empty or image-only", "metadata", None)),
        (starts.isNotNull(), _verdict(False, quoted("Starts with", starts), "other", None)),
        (_any_in(top, LAYOUT_MARKS), _verdict(False, quoted("Contains", _first_in(top, LAYOUT_MARKS)), "metadata", None)),
        ((_leader_lines(c(bare), LAYOUT_LEADER) > 3) | F.contains(top, F.lit("table of contents")), _verdict(False, "Detected Table of Contents", "toc", None)),
        ((c(share) < 0.30) & useful, _verdict(True, "Useful data table", "table", None)),
        (c(share) < 0.30, _verdict(False, "Low alphabetic content", "metadata", None)),
    ]
    return prepared.withColumn("evaluation", _first(rules, _verdict(True, "OK", "main_content", None))).drop(bare, head, low, share, rows)


def accepted(df: DataFrame) -> DataFrame:
    return df.where("evaluation.should_use")


def refused(df: DataFrame) -> DataFrame:
    return df.where("not evaluation.should_use")


def evaluate_and_keep(df: DataFrame, rules: Callable[[DataFrame], DataFrame] = scored) -> DataFrame:
    return accepted(rules(df))


def verdict_totals(df: DataFrame, *by: str) -> DataFrame:
    """Counts, acceptance rate in percent (0 for none) and average score of the accepted (two decimals, 0 for none), by columns or overall."""
    use = F.col("evaluation.should_use")
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(use).alias("accepted"), F.count_if(~use).alias("rejected"),
        F.coalesce(F.count_if(use) * 100.0 / F.when(F.count("*") > 0, F.count("*")), F.lit(0.0)).alias("acceptance_rate"),
        F.coalesce(F.round(F.avg(F.when(use, F.col("evaluation.quality_score"))), 2), F.lit(0.0)).alias("average_quality_score"),
    )


def reason_counts(df: DataFrame) -> DataFrame:
    return df.where("not evaluation.should_use").groupBy(F.col("evaluation.reason").alias("reason")).agg(F.count("*").alias("n"))


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("evaluation.content_type").alias("content_type")).agg(F.count("*").alias("n"))


def verdict_report(df: DataFrame) -> DataFrame:
    """``(part, name, value)``: the totals, the count of each reason of refusal and of each content type, a row each."""
    totals = verdict_totals(df)
    row = lambda part, name, value: F.struct(F.lit(part).alias("part"), name.alias("name"), value.cast("double").alias("value"))
    first = totals.select(F.explode(F.array(*[row("total", F.lit(c), F.col(c)) for c in totals.columns])).alias("r")).select("r.*")
    reasons = reason_counts(df).select(F.lit("reason").alias("part"), F.col("reason").alias("name"), F.col("n").cast("double").alias("value"))
    kinds = type_counts(df).select(F.lit("content_type").alias("part"), F.col("content_type").alias("name"), F.col("n").cast("double").alias("value"))
    return first.unionByName(reasons).unionByName(kinds)
