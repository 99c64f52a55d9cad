"""What each line of a chunk is, and statistics of the whole chunk.

One pass of cheap tests; shared by the repair of scans (problem 1) and by
the statistics of text quality (problem 2).
"""

from __future__ import annotations

import re

# Marks of list entries, code, formulas, glyph codes.
_ENTRY = re.compile(r"\s*(?:[-*•◦▪‣–·+►○●]|\[[ xX✓]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)]|\[\d{1,4}\]|[☐☑✓✔])\s+\S")
_LEADER = re.compile(r"(?:\.{3,}|(?: \.){3,}|…+|_{4,})\s*(?:\d+|[ivxlc]+)\s*$")
_TERM = re.compile(r"\s*[^\s:.,;!?][^:.;!?]{0,30}: \S[^.;!?]{0,60}$")
_REFERENCE = re.compile(r"\s*(?:\[\d+\]|\d+\.|\(\d+\))?\s*\S.{5,}\b(?:1[89]|20)\d\d\b.{0,12}\bpp?\.\s*\d+")
_CODE = re.compile(
    r"\s*(?:```|~~~|#include|import [\w.]+\s*;?$|from [\w.]+ import|def \w+\(|class \w+[:({]|return\b.*[\])};]?$|for \w+ in .*:$|while .*[:{]$|if .*[:{]$|else\s*[:{]|elif .*:$|"
    r"(?:const|let|var|public|private|static|int|void|function|func|fn) \w+.*[;={(]|SELECT .* FROM |INSERT INTO|UPDATE \w+ SET|CREATE TABLE|# \w+|// ?\w|[\w.\[\]]+\s*(?:[+\-*/]?=)\s*[^=].*[\w)\]};\"']$|[{}]+;?$|\$ \w+)"
)
_FENCE = re.compile(r"(?:`{3,4}|~{3,4})\s*[\w+#.\-]*$")
_CODE_ENDS = frozenset(":;{}()[]\"'`")
_CODE_STARTS = ("import ", "from ", "SELECT ", "#", "//", "$ ", "else", "return", "INSERT", "UPDATE", "CREATE")
_FORMULA = re.compile(r"\s*(?:\$\$|\\\[|\\begin\{|\\end\{|\\(?:frac|sum|int|alpha|left)\b)|\\frac\{|\\sum_|\\alpha\b")
_COLUMNS = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
_HTML = re.compile(r"</?(?:tr|td|th|table|tbody|thead)\b", re.I)
_RULE = re.compile(r"[\s|:+\-=_*~.#]+$")
_GLYPH = re.compile(r"\(cid:\d+\)|glyph<[^>]*>|/g\d+|\\x[0-9a-f]{2}|\\u[0-9a-f]{4}|&#\d+;")
_GLYPH_MARKS = ("cid:", "glyph<", "/g", "\\x", "\\u", "&#")
_VOWELS = "aeiouyáéíóúàèìòùâêîôûäöüëïœæåøаеёиоуыэюяіїєαεηιουω"
_FOREIGN = re.compile(r"[^\W\d_\u0000-\u024f\u1e00-\u1eff\ufb00-\ufb06]")
_WORDS = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_STOPS = (".", "!", "?", ":", ";", "…", '."', ".”", ".»", ".)", "。", "！", "？", "؟", "۔", "।")
_ODD = re.compile(r"[�□¤¿¶\u0080-\u009f-]")

TABLE, LIST, CODE, FORMULA, RULE, BLANK, TEXT = "TLCFRB."


def _cells(line: str) -> bool:
    for mark in (";", ","):
        if line.count(mark) >= 2:
            cells = line.split(mark)
            tight = sum(not c[:1].isspace() for c in cells[1:])
            if tight * 10 >= 9 * (len(cells) - 1) and all(len(c.split()) <= 3 for c in cells):
                return True
    return False


def roles(lines: list[str]) -> str:
    """One letter a line: T table row, L list entry, C code, F formula, R rule, B blank, '.' text."""
    out, fenced = [], False
    for line in lines:
        bare = line.strip()
        if not bare:
            out.append(BLANK)
            continue
        first, last = bare[0], bare[-1]
        if first in "`~" and _FENCE.match(bare):
            fenced = not fenced
            out.append(CODE)
        elif fenced:
            out.append(CODE)
        elif bare.count("|") >= 2 or "\t" in bare or ("<" in bare and _HTML.search(bare)):
            out.append(RULE if _heap(bare) else TABLE)
        elif ("\\" in bare or "$" in bare) and _FORMULA.search(bare):
            out.append(FORMULA)
        elif not first.isalnum() and len(bare) > 2 and _RULE.match(bare):
            out.append(RULE)
        elif ("..." in bare or "…" in bare or ". ." in bare or "____" in bare) and _LEADER.search(bare):
            out.append(LIST)
        elif last.isdigit() | (last == ".") and (" pp" in bare or " p." in bare) and _REFERENCE.match(line):
            out.append(LIST)
        elif (last in _CODE_ENDS or "=" in bare or "(" in bare or bare.startswith(_CODE_STARTS)) and _CODE.match(line):
            out.append(CODE)
        elif (not first.isalpha() or bare[1:2] in ".)" or bare[:6].find(")") > 0 or bare[:5].find(".") > 0) and _ENTRY.match(line):
            out.append(LIST)
        elif "  " in bare and last != "." and (gaps := len(_COLUMNS.findall(bare))) >= 2 and len(bare.split()) <= 4 * gaps and _wide(bare):
            out.append(TABLE)
        elif (";" in bare or "," in bare) and _cells(bare):
            out.append(RULE if _heap(bare) else TABLE)
        elif ": " in bare and len(bare) < 110 and _TERM.match(line) and len(bare.split()) <= 9:
            out.append("t")
        else:
            out.append(TEXT)
    # a term or a short line is an entry where several stand together
    k, n = 0, len(out)
    while k < n:
        if out[k] == "t":
            e = k
            while e < n and out[e] in "tB":
                e += 1
            many = out[k:e].count("t") >= 3
            for i in range(k, e):
                if out[i] == "t":
                    out[i] = LIST if many else TEXT
            k = e
        else:
            k += 1
    k = 0
    while k < n:
        if out[k] == TEXT and _bare_entry(lines[k]):
            e, short, capital = k, 0, 0
            while e < n and out[e] == TEXT and _bare_entry(lines[e]):
                short += len(lines[e].split()) <= 4
                capital += not lines[e].lstrip()[:1].islower()
                e += 1
            if e - k >= 3 and capital * 10 >= 9 * (e - k) and short * 3 >= 2 * (e - k):
                out[k:e] = LIST * (e - k)
            k = e
        else:
            k += 1
    # a list entry may go on over the next lines; so may two neighbours in a row of columns
    for k in range(1, n):
        if out[k] == TEXT and out[k - 1] == LIST and lines[k][:2] == "  " and lines[k - 1].strip()[-1:] not in ".!?":
            out[k] = LIST
    columns = [k for k in range(n) if out[k] == TEXT and len(lines[k].split()) <= 4 and _COLUMNS.search(lines[k].strip())] if TABLE in out else []
    for k in columns:
        if (k and out[k - 1] == TABLE) or (k + 1 < n and out[k + 1] == TABLE):
            out[k] = TABLE
    return "".join(out)


def _heap(bare: str) -> bool:
    """Mostly marks, of many sorts: bars among them are no cells."""
    marks = [c for c in bare if not (c.isalnum() or c.isspace())]
    return len(marks) * 2 > len(bare) - sum(map(str.isspace, bare)) and len(set(marks)) >= 8


def _wide(bare: str) -> bool:
    """Cells apart by three or more spaces, or several of them by two: not text that is justified by spaces."""
    cells = re.split(r" {2,}", bare)
    return len(cells) >= 3 and sum(len(c.split()) <= 3 for c in cells) == len(cells) and not all(len(c.split()) == 1 and c.isalpha() for c in cells) or len(re.findall(r" {3,}", bare)) >= 2


def _bare_entry(line: str) -> bool:
    bare = line.strip().rstrip(";")
    return 0 < len(bare) <= 48 and not any(c in bare for c in ".!?:;,-") and bare[-1:].isalnum()


STATISTICS = ("n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_share", "list_share", "table_share", "code_share", "odd_share", "distinct_share", "vowel_share", "foreign_share", "token_length")


def statistics(text: str, common: frozenset[str], lines: list[str] | None = None, kinds: str | None = None) -> list[float]:
    """Values of ``STATISTICS``; all 0 for a blank text. ``lines`` and ``kinds``, if known already, are those of the text."""
    lines = text.split("\n") if lines is None else lines
    kinds = roles(lines) if kinds is None else kinds
    size = [len(x.strip()) for x in lines]
    total = sum(size)
    if not total:
        return [0.0] * len(STATISTICS)
    share = dict.fromkeys("TLCFRB.", 0)
    stops = full = 0
    for kind, n, line in zip(kinds, size, lines, strict=True):
        share[kind] += n
        if n:
            full += 1
            stops += line.rstrip().endswith(_STOPS)
    low = text.lower()
    plain = text.isascii()
    words = _WORDS.findall(low)
    count = max(1, len(words))
    letters = sum(map(len, words))
    tokens = low.split()
    solid = sum(map(len, tokens)) or 1
    odd = share["R"] + (0 if plain else len(_ODD.findall(text)))
    if any(mark in low for mark in _GLYPH_MARKS):
        odd += sum(map(len, _GLYPH.findall(text)))
    digits = sum(map(str.isdigit, text)) if letters < 0.8 * solid else 0
    vowels = sum(map(low.count, "aeiouy" if plain else _VOWELS))
    foreign = len(_FOREIGN.findall(low)) if letters and not plain else 0
    return [
        float(len(words)), letters / count, max(0, solid - letters - digits) / solid, stops / full, sum(map(common.__contains__, words)) / count,
        share["L"] / total, share["T"] / total, (share["C"] + share["F"]) / total, odd / solid, len(set(tokens)) / max(1, len(tokens)), vowels / max(1, letters), foreign / max(1, letters), solid / max(1, len(tokens)),
    ]
