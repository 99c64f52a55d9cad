"""Text functions, evaluation and fingerprints, against values derived by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fingerprint, text
from quillspark.operators import evaluate


def value(spark, column, content):
    return spark.createDataFrame([(content,)], "t string").select(column(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    ("content", "words", "length", "quarter"), [("", 1, 0, 0), ("abc", 1, 1, 0), ("one two three four", 5, 4, 4), ("  a   b ", 2, 2, 2), ("x" * 400, 1, 100, 100)]
)
def test_token_counts(spark, content, words, length, quarter):
    assert value(spark, text.tokens_by_words, content) == words
    assert value(spark, text.tokens_by_length, content) == length
    assert value(spark, text.tokens_by_quarter, content) == quarter


def test_letter_share_counts_letters_of_any_script(spark):
    assert value(spark, text.letter_share, "aé𝒳1") == 0.75
    assert value(spark, text.letter_share, "") == 0.0
    assert value(spark, text.letter_share, None) is None


@pytest.mark.parametrize(("content", "style"), [("# A\ntext", "markdown"), ("1.2 Scope\ntext", "numeric"), ("plain", "markdown"), ("##### five", "markdown")])
def test_heading_style(spark, content, style):
    assert value(spark, text.heading_style, content) == style


def test_numbered_heading(spark):
    got = value(spark, text.numbered_heading, "  01.2. Title here ")
    assert (got.levels, got.title) == ([1, 2], "Title here")
    assert value(spark, text.numbered_heading, "no number") is None


def test_layout_markdown_is_normalised(spark):
    assert value(spark, text.normalised_layout, "a<!-- x\ny -->b\nPage 12\n17\n\n\n\nc.....d\n----\ne") == "a b\n\nc ... d\n\n\ne".replace("\n\n\n", "\n\n")


def test_cleaned_markdown(spark):
    raw = "##  Head\n#Tail\n|---|---|\n* item\n1.   one\n7\nx\nhttps:// site.org\nword , next.Then  "
    got = value(spark, text.cleaned_markdown, raw)
    assert got.startswith("## Head\n# Tail\n- item\n1. one") and "|---" not in got and "word, next. Then" in got


@pytest.mark.parametrize(
    ("line", "kept"), [("ab", False), ("#ab", True), ("short frag", False), ("short end.", True), ("+z/*=.", False), ("this line is long enough", True), ("text with &lt; in it here", False), ("| a | b |", False)]
)
def test_waste_lines(spark, line, kept):
    frame = spark.createDataFrame([("a line that stays here\n" + line, "prose")], "t string, k string")
    got = frame.select(text.without_waste(F.col("t"), F.col("k")).alias("v")).first().v
    assert (got == "a line that stays here\n" + line) is kept


def test_waste_leaves_code_and_marks_the_emptied(spark):
    frame = spark.createDataFrame([("ab", "code"), ("ab", None)], "t string, k string")
    assert [r.v for r in frame.select(text.without_waste(F.col("t"), F.col("k")).alias("v")).collect()] == ["ab", text.REMOVED]


def test_file_label_and_path(spark):
    assert value(spark, text.file_label, "A b—c: d/e") == "A_bc_de" and value(spark, text.file_label, None) == "document"
    parts = value(spark, text.path_parts, "/a/b.c/Name.Part.PDF")
    assert (parts.name, parts.stem, parts.suffix) == ("Name.Part.PDF", "Name.Part", ".pdf")


E1 = "Standard paragraph text for testing."
CASES = [
    (E1, "Intro", True, "OK", "main_content", 80.0),
    ("import os\nprint(os.name)", "Code", False, "Empty or image-only", "metadata", 0.0),
    ("x" * 29, None, False, "Empty or image-only", "metadata", 0.0),
    ("x" * 30, None, True, "OK", "main_content", 65.0),
    (E1, "Indexing methods", False, "Header filter: indexing methods", "metadata", 0.0),
    ("Figure: a long caption of the drawing", None, False, "Forbidden prefix", "other", 0.0),
    ("see https://example.org for all of this text", None, False, "Citation/Link chunk", "metadata", 0.0),
    ("All rights reserved by the press of the town", None, False, "Metadata keyword detected", "metadata", 0.0),
    ("\n".join(f"Part {i} ........ {i}" for i in range(4)), None, False, "Detected Table of Contents", "toc", 0.0),
    ("Then import goods from the port over there", None, True, "Source code block", "code", 85.0),
    ("\n".join("| 1 | 2 | 34 |" for _ in range(6)), "Data", True, "Useful data table", "table", 70.0),
    ("1" * 40, None, False, "Low alpha (0.00%)", "metadata", 20.0),
    ("A" + "a" * 398 + ".", None, True, "OK", "main_content", 100.0),
    (None, None, False, "Empty or image-only", "metadata", 0.0),
]


def test_scored_rules(spark):
    frame = spark.createDataFrame([(i, c, h) for i, (c, h, *_) in enumerate(CASES)], "i int, content string, section_header string")
    got = {r.i: r.evaluation for r in evaluate.scored(frame).collect()}
    for i, (_, _, *want) in enumerate(CASES):
        e = got[i]
        assert [e.should_use, e.reason, e.content_type, e.quality_score] == want, CASES[i][0]


def test_layout_rules(spark):
    rows = [
        (0, E1, "Appendix B", "Header contains 'appendix'"), (1, "The image is a drawing of an old house", None, "Starts with 'the image is'"),
        (2, "Read more at www.example.org about this", None, "Contains 'www.'"), (3, "7" * 40, None, "Low alphabetic content"), (4, E1, None, "OK"),
        (5, "\n".join("| 1 | 2 |" for _ in range(6)), "Data", "Useful data table"),
    ]
    frame = spark.createDataFrame([r[:3] for r in rows], "i int, content string, section_header string")
    got = {r.i: r.evaluation.reason for r in evaluate.layout_scored(frame).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_verdict_figures(spark):
    frame = evaluate.scored(spark.createDataFrame([(c, h) for c, h, *_ in CASES[:2]], "content string, section_header string"))
    r = evaluate.verdict_totals(frame).first()
    assert (r.total, r.accepted, r.rejected, r.acceptance_rate, r.average_quality_score) == (2, 1, 1, 50.0, 80.0)
    report = {(x.part, x.name): x.value for x in evaluate.verdict_report(frame).collect()}
    assert report["reason", "Empty or image-only"] == report["content_type", "main_content"] == report["content_type", "metadata"] == 1 and report["total", "acceptance_rate"] == 50.0
    empty = evaluate.verdict_totals(frame.limit(0)).first()
    assert (empty.total, empty.acceptance_rate, empty.average_quality_score) == (0, 0.0, 0.0)


def plain_simhash(content):
    flat = "".join(c for c in content.lower() if c.isalnum() or c == "_")
    grams = [flat[i : i + 3] for i in range(max(len(flat) - 2, 1))]
    hashes = [int.from_bytes(hashlib.md5(g.encode()).digest()[-8:], "big") for g in grams]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def test_simhash_and_distance(spark):
    texts = ["This is a simple document for testing.", "This is a sample document for training", "ab", "Größe der Straße", "!!!"]
    frame = spark.createDataFrame([(t,) for t in [*texts, "  \n", None]], "t string").select("t", fingerprint.simhash(F.col("t")).alias("h"))
    got = {r.t: r.h for r in frame.collect()}
    assert all(got[t] == plain_simhash(t) for t in texts)
    assert got["  \n"] == got[None] == "0" * 16
    pair = spark.createDataFrame([(got[texts[0]], got[texts[1]])], "a string, b string").select(fingerprint.distance(F.col("a"), F.col("b")).alias("d")).first().d
    assert pair == (int(got[texts[0]], 16) ^ int(got[texts[1]], 16)).bit_count()
