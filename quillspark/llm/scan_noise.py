"""Problem 1: noise in text from scanned pages, found and repaired.

Misread words: words of the whole corpus are counted; an anagram hash (sum
over characters of the fifth power of a code) turns "a is read as b" into a
fixed difference, so a rare word is joined with its frequent variants by
equality of hash plus difference, in SQL. Variants are verified, ranked by
frequency, and kept where the rare word is no more frequent than that
misreading is elsewhere. Edge lines (running headers, page numbers) are
recognised by form, by the file's titles and by recurring in a file.
Divided words are joined where the corpus knows the joined word better
than the hyphenated one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .line_roles import STATISTICS, roles, statistics
from .rows import once
from .text_quality import common_words, settled

# What scanners read (first) for what is printed (second).
CONFUSED = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("0", "o"), ("ª", "a"), ("º", "o"), ("1", "i"), ("1", "l"), ("5", "s"), ("ri", "n"), ("n", "ri"),
    ("|", "l"), ("|", "i"), ("ii", "u"), ("u", "ii"), ("¢", "c"), ("rn", "m"), ("m", "rn"), ("b", "h"), ("h", "b"), ("cl", "d"), ("d", "cl"),
    ("9", "g"), ("8", "b"), ("6", "b"), ("6", "o"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("in", "m"), ("ni", "m"),
    ("nn", "m"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"), ("u", "n"), ("n", "u"), ("@", "a"), ("$", "s"), ("€", "e"), ("£", "e"), ("fl", "fi"), ("q", "g"), ("g", "q"), ("ß", "b"), ("lc", "k"), ("lt", "h"),
]
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: A word counts as frequent from this many occurrences, a misreading must be this many times rarer.
FREQUENT, RARER = 10, 10
#: A misread word may be this many times as frequent, to its variant, as the misreading is in long words.
TOLERANCE = 5
#: Rows of corrections, and of recurring lines, that may be broadcast; more are joined by shuffle.
MOST_ROWS = 500_000

_LETTERS = r"\p{L}\p{N}|ªº¢€£@$"
WORD = rf"[{_LETTERS}]+(?:['’\-‐][{_LETTERS}]+)*"
_PAGE = re.compile(
    r"\s*(?:[-–—~=·•*|\[(<]\s*)*(?:(?:page|pages|seite|página|pág\.?|pag\.?|p\.|pp\.|s\.|folio|f\.)\s*)?(?:\d{1,5}|(?=[ivxlc])[ivxlc]{1,8}|(?=[IVXLC]{2})[IVXLC]{2,8})"
    r"(?:\s*(?:/|of|von|de|sur)\s*\d{1,5})?(?:\s*[-–—~=·•*|\])>.])*\s*",
    re.I,
)
_NUMBERED = re.compile(r"^(?:(\d{1,5}|[ivxlc]{1,7})(?:\s{2,}|\s*[|·•—–]\s*)(?=\D))|(?:(?:\s{2,}|\s*[|•—–]\s*)(\d{1,5}|[ivxlc]{1,7}))$")
_PUBLISHER = re.compile(r"[·•|]\s*(?:1[5-9]|20)\d\d$")
_CHAPTER = re.compile(r"(?:chapter|chapitre|kapitel|capítulo|section|part|teil|partie|parte)\s+(?:\d{1,3}|[ivxlc]{1,6})\s*[:.–—-]\s*\S", re.I)
_TAIL = re.compile(r"([^\W\d_](?:[^\W_]|[|ªº¢])*(?:['’][^\W\d_]+)?|[^\W\d_])([-‐¬\xad])\s*$")
_HEAD = re.compile(r"\s*([^\W_](?:[^\W_]|[|ªº¢])*(?:[-‐'’][^\W_]+)*)")
_NUMBERING = re.compile(r"^(?:#+\s*)?(?:\d+(?:\.\d+)*\.?|[ivxlc]+\.)\s+", re.I)
_SKELETON = (("ﬁ", "fi"), ("ﬂ", "fl"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("cl", "d"))
_FOLDED = str.maketrans({"1": "l", "i": "l", "|": "l", "0": "o", "º": "o", "5": "s", "8": "h", "6": "h", "b": "h", "9": "g", "q": "g", "ª": "a", "@": "a", "4": "a", "¢": "e", "c": "e", "€": "e", "3": "e", "f": "l", "t": "l", "7": "l", "$": "s"})


def skeleton(text: str) -> str:
    """The same for two texts that differ by misreadings only (and for few others)."""
    text = text.lower()
    for wrong, right in _SKELETON:
        text = text.replace(wrong, right)
    return text.translate(_FOLDED)


def skeleton_column(text: Column) -> Column:
    out = F.lower(text)
    for wrong, right in _SKELETON:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    keys = [chr(k) for k in _FOLDED]
    return F.translate(out, "".join(keys), "".join(_FOLDED[ord(k)] for k in keys))


def _value(c: Column) -> Column:
    code = F.pmod(F.ascii(c), F.lit(1999)).cast("bigint")
    return code * code * code * code * code


def anagram(word: Column) -> Column:
    """Sum over the characters of the fifth power of their code (modulo 1999, so that no sum overflows)."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda acc, c: acc + _value(c))


def _difference(wrong: str, right: str) -> int:
    return sum((ord(c) % 1999) ** 5 for c in right) - sum((ord(c) % 1999) ** 5 for c in wrong)


def count_words(chunks: DataFrame) -> DataFrame:
    """``(word, n)`` over all contents, in lower case; words hold a letter and 2 to 40 characters."""
    words = chunks.select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(r"length(word) between 2 and 40 and word rlike '\\p{L}'")


def corrections(words: DataFrame) -> DataFrame:
    """``(word, variant)``: misread words and what is printed."""
    frequent = words.where((F.col("n") >= FREQUENT) & F.col("word").rlike(r"^[\p{L}'’\-]+$")).select(
        F.col("word").alias("variant"), F.col("n").alias("n_variant"), anagram(F.col("word")).alias("hash")
    )
    kinds = F.array(*[F.struct(F.lit(a).alias("wrong"), F.lit(b).alias("right"), F.lit(_difference(a, b)).alias("difference")) for a, b in CONFUSED])
    tried = words.withColumn("hash", anagram(F.col("word"))).withColumn("k", F.explode(F.filter(kinds, lambda k: F.contains(F.col("word"), k["wrong"]))))
    tried = tried.select("word", "n", "k.wrong", "k.right", (F.col("hash") + F.col("k.difference")).alias("hash"))
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - F.length("wrong") + 1)),
        lambda at: F.concat(F.substring(F.col("word"), F.lit(1), at - 1), F.col("right"), F.substring(F.col("word"), at + F.length("wrong"), F.length("word"))) == F.col("variant"),
    )
    pairs = cut(tried.join(frequent, "hash").where((F.col("n") * RARER <= F.col("n_variant")) & swapped))
    usual = pairs.where(F.length("word") >= 6).groupBy("wrong", "right").agg(F.percentile_approx(F.col("n") / F.col("n_variant"), 0.75).alias("rate"))
    kept = pairs.join(usual, ["wrong", "right"], "left").where(F.col("n") <= TOLERANCE * F.coalesce("rate", F.lit(0.0)) * F.col("n_variant") + 2)
    return kept.groupBy("word").agg(F.max_by("variant", F.struct(F.col("n_variant") * F.coalesce("rate", F.lit(0.0)), "n_variant", "variant")).alias("variant"))


_FOUND = (
    "chunk_id string, file_id string, roles string, heads array<struct<line_no:int,key:string,strong:boolean>>, pages array<int>, "
    "divided array<struct<line_no:int,next_no:int,a:string,b:string,sep:string>>"
)


_FOUND_TYPES = pa.schema([
    ("chunk_id", pa.string()), ("file_id", pa.string()), ("roles", pa.string()),
    ("heads", pa.list_(pa.struct([("line_no", pa.int32()), ("key", pa.string()), ("strong", pa.bool_())]))), ("pages", pa.list_(pa.int32())),
    ("divided", pa.list_(pa.struct([("line_no", pa.int32()), ("next_no", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("sep", pa.string())]))),
])
_HYPHENS = ("-", "‐", "¬", "\xad")


def _furniture(lines: list[str], kinds: str, first: bool, header: str | None, top: str | None) -> tuple[list, list]:
    """Candidates of running headers (line, key, certain by itself) and page numbers."""
    full = [k for k in range(len(lines)) if lines[k].strip()]
    own = {skeleton(" ".join(_NUMBERING.sub("", h.strip()).split())) for h in (header,) if h and h.strip()}
    title = skeleton(" ".join(top.split())) if top and top.strip() else None
    pages = {k for i, k in enumerate(full) if len(lines[k]) < 80 and len(lines[k].strip()) <= 16 and _PAGE.fullmatch(lines[k]) and not (i and lines[full[i - 1]].rstrip().endswith(":"))}
    heads = []
    for i, k in enumerate(full):
        bare = lines[k].strip()
        if k in pages or len(bare) > 110 or bare[-1] in ".!?,;:-¬\xad‐" or kinds[k] in "CF":
            continue
        edge = bare[0].isdigit() or bare[-1].isdigit() or "  " in bare
        mark = _NUMBERED.search(bare) if edge else None
        if not (mark or bare[0].isupper() or bare[0].isdigit()) or (kinds[k] == "T" and re.search(r"[|\t<;]", bare)):
            continue
        near = (i and full[i - 1] in pages) or (i + 1 < len(full) and full[i + 1] in pages)
        apart = k and k + 1 < len(lines) and not lines[k - 1].strip() and not lines[k + 1].strip()
        publisher = ("·" in bare or "•" in bare or "|" in bare) and bool(_PUBLISHER.search(bare[: mark.start()] + bare[mark.end() :] if mark else bare))
        chapter = not publisher and bool(_CHAPTER.match(bare[mark.end() :].lstrip() if mark and not mark.start() else bare))
        upper = len(bare) > 6 and bare.isupper()
        alike = bool(title) and abs(len(bare) - len(title)) <= 4 + bare.count("  ") * 12
        if not (mark or near or apart or publisher or chapter or upper or alike):
            continue
        key = bare[: mark.start()] + bare[mark.end() :] if mark else bare
        key = " ".join(key.split())
        if not key or len(key.split()) > 14 or not any(map(str.isalpha, key)):
            continue
        folded = skeleton(key)
        if not mark and own and skeleton(_NUMBERING.sub("", key)) in own:
            continue
        if not mark and not near and first and i == 0 and not publisher:
            continue
        known = folded == title
        strong = bool(publisher or chapter or known or (near and (mark or upper) and len(key) > 6))
        if strong or mark or near or apart or upper:
            heads.append((k, folded, strong))
    return heads, sorted(pages)


def inspect(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Of every row of running prose: line roles, candidates of edge lines and of divided words."""
    common = common_words(lexicon)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk, file, number, text, header, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.split("\n")
                kinds = roles(lines)
                if settled("junk", dict(zip(STATISTICS, statistics(text, common, lines, kinds), strict=True))) != "prose":
                    continue
                if "L" in kinds:
                    kinds = "".join("." if c == "L" and "L" not in kinds[max(0, k - 1) : k] + kinds[k + 1 : k + 2] else c for k, c in enumerate(kinds))
                heads, pages = _furniture(lines, kinds, number == 0, header, top)
                skip = {h[0] for h in heads} | set(pages)
                divided = []
                for k, line in enumerate(lines):
                    tail = _TAIL.search(line) if line.rstrip()[-1:] in _HYPHENS and kinds[k] == "." and k not in skip else None
                    if not tail:
                        continue
                    after = k + 1
                    while after < len(lines) and (not lines[after].strip() or after in skip):
                        after += 1
                    head = _HEAD.match(lines[after]) if after < len(lines) else None
                    stem = re.search(r"[^\s]*$", line[: tail.start()])[0]
                    a = (stem[stem.rfind("-") + 1 :] if stem.endswith("-") else stem if stem and stem[-1].isalnum() else "") + tail[1]
                    b = head[1].lower() if head and lines[after].strip()[0].islower() or head and tail[1].isupper() else ""
                    divided.append({"line_no": k, "next_no": after, "a": a.lower(), "b": b, "sep": tail[2]})
                out.append((chunk, file, kinds, [dict(zip(("line_no", "key", "strong"), h, strict=True)) for h in heads], pages, divided))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FOUND_TYPES.types, strict=True)], schema=_FOUND_TYPES)

    rows = chunks.where(r"length(trim(content)) > 0").select("chunk_id", "file_id", "chunk_index", "content", "section_header", "top_header")
    return rows.mapInArrow(look, _FOUND)


def edge_lines(seen: DataFrame) -> DataFrame:
    """``(chunk_id, line_no, kind)`` of running headers and page numbers."""
    heads = seen.select("chunk_id", "file_id", F.explode("heads").alias("h")).select("chunk_id", "file_id", "h.*")
    again = heads.groupBy("file_id", "key").agg((F.min("chunk_id") != F.max("chunk_id")).alias("again"), F.max("strong").alias("known"))
    marked = again.where("again or known").select(F.col("file_id").alias("_file"), F.col("key").alias("_key"), F.lit(True).alias("marked"))
    marked = cut(marked)
    heads = heads.join(F.broadcast(marked) if _few(marked) else marked, F.col("file_id").eqNullSafe(F.col("_file")) & (F.col("key") == F.col("_key")), "left").where("strong or marked")
    found = heads.select("chunk_id", (F.col("line_no") + 1).alias("line_no"), F.lit("running_header").alias("kind"))
    pages = seen.select("chunk_id", F.explode("pages").alias("at")).select("chunk_id", (F.col("at") + 1).alias("line_no"), F.lit("page_number").alias("kind"))
    return found.unionByName(pages).distinct()


def divided_words(seen: DataFrame, words: DataFrame) -> DataFrame:
    """``(chunk_id, line_no, next_no, joined, word)``: words divided by a line break only; ``word`` is the joined word as the corpus knows it."""
    rows = seen.select("chunk_id", F.explode("divided").alias("d")).select("chunk_id", "d.*").withColumn("joined", F.concat("a", "b"))
    rows = rows.withColumn("key", skeleton_column(F.col("joined"))).withColumn("compound", F.concat("a", F.lit("-"), "b"))
    plain = words.where(r"word rlike '^[\\p{L}\'’]+$'")
    by_key = plain.where(F.col("n") >= FREQUENT).groupBy(skeleton_column(F.col("word")).alias("key")).agg(F.max_by("word", "n").alias("known"), F.sum("n").alias("n_known"))
    exact = plain.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    hyphenated = words.where("word like '%-%'")
    compounds = hyphenated.groupBy(skeleton_column(F.col("word")).alias("ckey")).agg(F.sum("n").alias("n_compound"))

    def half(name: str, part: int) -> DataFrame:
        """How often a half stands in the corpus, alone or as that part of a hyphenated word, and how often at a divided line."""
        parts = hyphenated.select(F.element_at(F.split("word", "-"), part).alias(name), "n")
        stands = plain.select(F.col("word").alias(name), "n").unionByName(parts).groupBy(name).agg(F.sum("n").alias(f"n_{name}"))
        return rows.where(F.col(name) != "").groupBy(name).agg(F.count("*").alias(f"cut_{name}")).join(stands, name, "left")

    joined = (
        rows.withColumn("ckey", skeleton_column(F.col("compound")))
        .join(by_key, "key", "left").join(exact, "joined", "left").join(compounds, "ckey", "left").join(half("a", 1), "a", "left").join(half("b", -1), "b", "left")
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    whole = F.greatest(zero("n_known"), zero("n_joined"))
    own = lambda name: zero(f"n_{name}") >= 2 * zero(f"cut_{name}")
    apart = own("a") & own("b")
    case = F.when(F.col("b") == "", ~own("a")).when((whole > 0) | (zero("n_compound") > 0), whole > zero("n_compound")).otherwise(~apart)
    return joined.where(case).select("chunk_id", "line_no", "next_no", "a", "b", "joined", F.coalesce("known", "joined").alias("word"))


def _few(df: DataFrame) -> bool:
    """Whether the rows are few enough for a broadcast."""
    return df.limit(MOST_ROWS + 1).count() <= MOST_ROWS


def misread_words(chunks: DataFrame, fixes: DataFrame) -> DataFrame:
    """``(chunk_id, line_no, word, variant)`` of every misread word, of whatever kind of line; ligatures included."""
    ligatures = f"[{''.join(LIGATURES)}]"
    lines = F.split("content", "\n", -1)
    hyphen = lambda x: F.right(F.rtrim(x), F.lit(1)).isin(*_HYPHENS)
    each = chunks.select("chunk_id", lines.alias("lines")).select("chunk_id", "lines", F.posexplode("lines").alias("at", "line"))
    back = lambda k: F.coalesce(F.get("lines", F.col("at") - k), F.lit(""))
    before = hyphen(back(1)) | ((F.trim(back(1)) == "") & hyphen(back(2)))
    line = F.when(before, F.regexp_replace("line", r"^\s*\S+", "")).otherwise(F.col("line"))
    line = F.when(hyphen(F.col("line")), F.regexp_replace(F.rtrim(line), r"(?<!\S)\S+$", "")).otherwise(line)
    found = each.select("chunk_id", (F.col("at") + 1).alias("line_no"), F.explode(F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))).alias("word"))
    found = found.where(r"length(word) > 1 and word rlike '\\p{L}'")
    joined = reduce(lambda c, k: F.replace(c, F.lit(k), F.lit(LIGATURES[k])), LIGATURES, F.col("word"))
    ligature = F.col("word").rlike(ligatures)
    columns = ["chunk_id", "line_no", "word", "variant"]
    if _few(fixes):
        return found.join(F.broadcast(fixes), "word", "left").withColumn("variant", F.coalesce("variant", F.when(ligature, joined))).where("variant is not null").select(columns)
    known = found.join(fixes, "word").select(columns)
    return known.unionByName(found.where(ligature).join(fixes, "word", "left_anti").withColumn("variant", joined).select(columns))


class Noise:
    """The noise of a table of chunks: ``edges``, ``divided`` and ``misread``, each with chunk_id and line_no (from 1)."""

    def __init__(self, chunks: DataFrame, lexicon: DataFrame) -> None:
        words = cut(count_words(chunks))
        fixes = cut(corrections(words))
        seen = cut(inspect(chunks, lexicon))
        self.edges = cut(edge_lines(seen))
        kinds = seen.select("chunk_id", "roles").dropDuplicates(["chunk_id"])
        held = lambda df: df.join(self.edges.select("chunk_id", "line_no"), ["chunk_id", "line_no"], "left_anti")
        divided = cut(divided_words(seen, words).withColumn("line_no", F.col("line_no") + 1).withColumn("next_no", F.col("next_no") + 1).distinct())
        self.divided = held(divided)
        misread = cut(misread_words(chunks, fixes).distinct()).join(kinds, "chunk_id")
        misread = misread.where(F.substring("roles", F.col("line_no"), F.lit(1)) == ".").select("chunk_id", "line_no", "word", "variant")
        # a joined word that the corpus knows only in another spelling was misread in the half that differs
        wrong = self.divided.where("word != joined")
        first = wrong.where(F.substring("word", F.lit(1), F.length("a")) != F.col("a")).select("chunk_id", "line_no", F.col("a").alias("word"), F.lit(None).cast("string").alias("variant"))
        second = wrong.where(F.right("word", F.length("b")) != F.col("b")).select("chunk_id", F.col("next_no").alias("line_no"), F.col("b").alias("word"), F.lit(None).cast("string").alias("variant"))
        self.misread = cut(held(misread.unionByName(first).unionByName(second)).distinct())


def find_noise(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(chunk_id, line_no, kind)``: hyphen, misread, running_header, page_number; lines from 1.

    Only running prose has cases; null and blank contents have none.
    Repeated rows of a chunk count once. Other columns are ignored.
    """
    noise = Noise(chunks, lexicon)
    kind = lambda df, name: df.select("chunk_id", F.col("line_no").cast("int").alias("line_no"), F.lit(name).alias("kind"))
    return noise.edges.withColumn("line_no", F.col("line_no").cast("int")).unionByName(kind(noise.divided, "hyphen")).unionByName(kind(noise.misread, "misread")).distinct()


_ENDED = re.compile(r"[.!?:;…\"”»)]\s*$")


def repair(text: str, edges: set[int], divided: dict[int, tuple[int, str, str]], misread: dict[int, dict[str, str]]) -> str:
    """One chunk's text as paragraphs: edge lines gone, divided words joined, misread words printed right."""
    lines = text.split("\n")
    moved: dict[int, str] = {}
    out: list[str] = []
    blank = True
    for k, line in enumerate(lines, 1):
        if k in edges:
            continue
        body = line.rstrip("\r")
        if k in moved:
            body = body.lstrip()[len(moved[k]) :].lstrip(" ")
        for word, right in misread.get(k, {}).items():
            body = re.sub(rf"(?<![\w|¢]){re.escape(word)}(?![\w|¢])", lambda m, right=right: right.capitalize() if m[0][:1].isupper() else right, body, flags=re.I)
        if k in divided:
            after, b, word = divided[k]
            tail = _TAIL.search(body)
            if tail and b:
                head = next((m[1] for m in [_HEAD.match(lines[after - 1])] if m), "") if after <= len(lines) else ""
                if head.lower().startswith(b):
                    rest = re.match(r"[^\s\w]*", lines[after - 1].lstrip()[len(head) :])[0]
                    moved[after] = head + rest
                    whole = body[: tail.start()] + tail[1] + head if word == tail[1].lower() + b else body[: tail.start()] + (word.capitalize() if tail[1][:1].isupper() else word)
                    body = whole + rest
        if not body.strip():
            if not blank and not any(d[0] > k > at for at, d in divided.items()) and out and _ENDED.search(out[-1]):
                blank = True
            continue
        if blank or not out or body[:2] == "  ":
            out.append(body.strip())
        else:
            out[-1] += " " + body.strip()
        blank = False
    return "\n\n".join(out)


def repaired(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(chunk_id, content)``: every distinct chunk, those with noise repaired, all others unchanged."""
    noise = Noise(chunks, lexicon)
    edges = noise.edges.groupBy("chunk_id").agg(F.collect_set("line_no").alias("edges"))
    divided = noise.divided.groupBy("chunk_id").agg(F.collect_list(F.struct("line_no", "next_no", "b", "word")).alias("divided"))
    misread = noise.misread.where("variant is not null").groupBy("chunk_id").agg(F.collect_list(F.struct("line_no", "word", "variant")).alias("misread"))
    rows = once(chunks.select("chunk_id", "content"), ["chunk_id", "content"]).join(edges, "chunk_id", "left").join(divided, "chunk_id", "left").join(misread, "chunk_id", "left")
    noisy = F.coalesce(F.col("edges").isNotNull() | F.col("divided").isNotNull() | F.col("misread").isNotNull(), F.lit(False))

    def mend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for text, e, d, m in zip(frame["content"], frame["edges"], frame["divided"], frame["misread"], strict=True):
                words: dict[int, dict[str, str]] = {}
                for x in m if m is not None else ():
                    words.setdefault(x["line_no"], {})[x["word"]] = x["variant"]
                joins = {x["line_no"]: (x["next_no"], x["b"], x["word"]) for x in (d if d is not None else ())}
                texts.append(repair(text, set(e) if e is not None else set(), joins, words))
            yield pd.DataFrame({"chunk_id": frame["chunk_id"], "content": texts})

    same = rows.where(~noisy).select("chunk_id", "content")
    return same.unionByName(rows.where(noisy).mapInPandas(mend, "chunk_id string, content string"))
