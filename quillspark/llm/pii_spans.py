"""Candidate spans of personal information in one text, with the votes of the local labelers.

Each candidate carries votes (1 for, -1 against, 0 silent) of the regex and
context labelers of its kind, and hashed features for the final classifier.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

KINDS = ("email", "phone", "id_number", "address", "person")
#: Hashed features of each kind.
DIMENSIONS = 1 << 12

_UPPER = "".join(chr(c) for c in range(0x41, 0x250) if chr(c).isupper())
_CAP = rf"[{_UPPER}][^\W\d_]*(?:['’\-][^\W\d_]+)*"
_GAP = r"(?:[ \xa0]|[ \t]?\r?\n)"

# Titles, particles, role and field labels, street words beyond
# the lexicon and abbreviations, in the languages of the tables.
TITLES = (
    "Mr Mrs Ms Miss Dr Prof Professor Sir Dame Herr Frau Hr Fr Mme Mlle Madame Monsieur Maître Sr Sra Srta Señor Señora Don Doña Doctor"
).split()
PARTICLES = "van von del de da di du der den dos zu zum ten ter la le el al bin ibn y af av".split()
PHONE_WORDS = set("tel tél phone telephone mobile cell fax call ring dial telefon telefonisch rufnummer mobil handy téléphone appelez portable teléfono llame móvil telf".split())
ID_WORDS = set(
    "identity id passport registration reg candidate student ssn tax social insurance licence license national mark sheet stamp ausweisnummer ausweis "
    "matrikelnummer matrikel steuernummer personalausweis reisepass identité étudiant numéro passeport matricule documento dni nie nif alumno "
    "pasaporte expediente matrícula kandidat".split()
)
THING_WORDS = set(
    "order ticket grant isbn issn serial version doi invoice article item part room table figure page pages "
    "model batch lot account parcel shipment seite tabelle auftrag bestellung rechnung commande facture pedido factura equation section".split()
)
ADDRESS_WORDS = set("address adresse anschrift dirección domicilio resident lives wohnhaft residing".split())
MAIL_WORDS = set("mail email courriel correo mailto contact kontakt".split())
STREETS_EN = "Street St Road Rd Lane Ln Avenue Ave Close Court Ct Mews Row Boulevard Blvd Square Sq Way Terrace Drive Gardens Crescent Parade Walk Hill Place Pl".split()
STREETS_FR = "rue avenue impasse place boulevard allée chemin quai cours route square passage".split()
STREETS_DE = "straße strasse str. weg gasse platz allee ring damm ufer steig".split()
STREETS_ES = "Calle C/ C. Avenida Av. Avda. Plaza Pza. Paseo Pº Camino Ronda Travesía Carrer".split()

_any = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))

_PAIR = re.compile(rf"(?<![\w'’\-])({_CAP})(?=({_GAP}(?:(?:[{_UPPER}]\.|{_any(PARTICLES)}){_GAP}){{0,3}})({_CAP})(?!\w))")
_TITLED = re.compile(rf"(?<![\w'’\-])(?:(?:{_any(TITLES)})\.?{_GAP})+((?:[{_UPPER}]\.{_GAP}?)*)((?:(?:{_any(PARTICLES)}){_GAP}){{0,3}}{_CAP})")
_INITIALS = re.compile(rf"(?<![\w'’\-])((?:[{_UPPER}]\.{_GAP}?)+)((?:(?:{_any(PARTICLES)}){_GAP}){{0,3}}{_CAP})")
_INVERTED = re.compile(rf"(?<![\w'’\-])([{_UPPER}]+(?:['’\-][{_UPPER}]+)*|[{_UPPER}]c[{_UPPER}]{{2,}}),{_GAP}({_CAP}|[{_UPPER}]\.)")
_INITIAL_DOT = re.compile(rf"\.(?<=[{_UPPER}]\.)(?<![\w'’\-][{_UPPER}]\.)")
_UPPER_COMMA = re.compile(rf",(?<=[{_UPPER}],)")
_UPPER_WORD = re.compile(r"[\w'’\-]+$")
_AT = re.compile(
    r"[ \t\r\n]{0,2}(?:[@＠]|[\[({<][ ]?(?:at|AT|arobase|ät)[ ]?[\])}>])[ \t\r\n]{0,2}|[ ](?:at|AT)[ ](?=[\w-]+[ ](?:dot|DOT)[ ])"
)
_DOT_BEFORE = re.compile(r"(?:[ \t\n]?[\[({<][ ]?(?:dot|DOT|punkt|punto|point)[ ]?[\])}>][ \t\n]?|[ ](?:dot|DOT)[ ])$")
#: Every form of _AT holds one of these.
_MARKS = ("@", "＠", *(f"{at}{gap}{bracket}" for at in ("at", "AT", "ät") for gap in ("", " ") for bracket in "])}>"), "arobase", " dot ", " DOT ")
_DOMAIN = re.compile(r"\w[\w-]*(?:(?:\.|[ \t\n]?[\[({][ ]?(?:dot|DOT|punkt|punto|point)[ ]?[\])}][ \t\n]?|[ ](?:dot|DOT)[ ])[\w-]+)+")
_NUMBER = re.compile(r"(?<![\w@])(?<![\d][.,/-])(?:[+＋][ ]?)?\(?\d(?:[ \xa0./()\-–]{0,2}(?:\r?\n)?\d)+(?![\w]*[@])")
_EXTENSION = re.compile(r"(?:,?[ \n]?(?:x|ext\.?|extension|poste|Durchwahl|App\.|int\.?)[ \n]?\d{1,5})", re.I)
_CODE = re.compile(r"\d(?:[\d\-]{3,}\d-?[A-Za-z]?|\d{4}-\d)(?![\w@])")
_LETTERS_BEFORE = re.compile(r"(?:^|(?<=[^\w@./]))[A-Za-z]{1,6}-?$")
_TAIL = (
    rf"(?:,?{_GAP}(?:Apt|Apartment|Flat|Suite)\.?[ ]\d+\w?|,?{_GAP}\d{{1,2}}\.?º[ ]?[A-Z]\b|[,]{_GAP}{_CAP}|{_GAP}[A-Z]{{2}}\d{{1,2}}[ ]\d[A-Z]{{2}}|,?{_GAP}[A-Z]{{2}}[ ]\d{{5}}|,?{_GAP}\d{{5}}(?:[ ]{_CAP})?){{0,4}}"
)
_NUM = r"\d{1,5}(?:[ ]?[a-zA-Z]\b)?"
_UNIT = re.compile(rf"(?<![\w.,/\-])(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|No\.?){_GAP}\d+\w?,?{_GAP}$")
_NUMBER_FIRST = re.compile(
    rf"{_NUM},?{_GAP}(?:[NSEW]\.{_GAP})?(?:{_CAP}{_GAP}){{1,3}}(?:{_any(STREETS_EN)})\b\.?"
    rf"|\d{{1,5}}(?:{_GAP}(?:bis|ter|quater|[a-z]))?,?{_GAP}(?:{_any(STREETS_FR)}){_GAP}(?:[dl]['’]|(?:de|du|des|la|le|les|aux?|à){_GAP}){{0,3}}\w+(?:{_GAP}{_CAP}(?=,))?"
)
_STREET_FIRST = re.compile(
    rf"(?<![\w.\-])(?:(?:{_CAP}(?:{_any(STREETS_DE)})|(?:{_CAP}[ \-]){{1,2}}(?:Straße|Weg|Gasse|Platz|Allee|Str\.)|(?:Am|An der|Im|Zum|Zur){_GAP}{_CAP})"
    rf"|(?:{_any(STREETS_ES)}){_GAP}?(?:(?:de|del|la|las|los|el|{_CAP}){_GAP}?){{1,5}}),?{_GAP}?(?:(?:n[.º°o]*|núm\.?|número){_GAP}?)?$"
)
_STREETS_BEFORE = (*STREETS_DE, *STREETS_ES, "Straße", "Weg", "Gasse", "Platz", "Allee", "Str.", "Am", "An der", "Im", "Zum", "Zur")
_HOUSE = re.compile(r"\d{1,5}")
_HOUSE_LETTER = re.compile(r"[ ]?[a-z]\b")
_ADDRESS_TAIL = re.compile(_TAIL)
_POSTCODE = re.compile(r"\d{5}|[A-Z]{2}\d{1,2} \d[A-Z]{2}")
_WORD = re.compile(r"[^\W\d_]+")
_PLUS = re.compile(r"[+＋]")
# Groupings in which telephone numbers and personal numbers are written.
_PHONE_SHAPE = re.compile(
    r"\(?0\d{1,4}\)?[ /\-.]?\d{3,}(?:[ \-]?\d{2,})*|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4}|\d{10}|0\d(?:[ .]\d\d){4}|0\d{2,4}-\d{2}-\d{6,8}|0\d{3}-\d{2}-\d{4,8}"
)
_ID_SHAPE = re.compile(r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{13}|\d{5}-\d{7}-\d|\d{2}(?: \d{3}){3}|\d{2,3}(?: \d{3}){2,3}|[A-Za-z]{1,6}-?\d[\d\-]{4,}|\d{7,9}-?[A-Za-z]")
_DATE = re.compile(r"\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}")


def _hashed(features: list[str]) -> list[int]:
    return sorted({zlib.crc32(f.encode()) % DIMENSIONS for f in features})


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str], str, str]:
    """Lower-case words before (nearest first, within the sentence's line group) and after, and the characters that touch the span."""
    before, after = text[max(0, start - 48) : start], text[end : end + 32]
    cut = max(before.rfind("\n\n"), before.rfind(". ") if not before.endswith(("o. ", "r. ", "l. ")) else -1, before.rfind("? "), before.rfind("! "))
    left = [w.lower() for w in _WORD.findall(before[cut + 1 :])][::-1]
    right = [w.lower() for w in _WORD.findall(after.split("\n\n")[0])]
    return left, right, before.rstrip(" ")[-1:] or "^", after.lstrip(" ")[:1] or "$"


def _shape(span: str) -> str:
    return re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", span)))


def _vote(words: list[str], known: set[str], value: int) -> int:
    return value if any(w in known for w in words) else 0


Span = tuple[str, int, int, str, str, list[int], list[int]]


def _numbers(text: str) -> Iterator[Span]:
    for pattern in (_NUMBER, _CODE):
        for m in pattern.finditer(text):
            start, end = m.span()
            if pattern is _CODE:
                letters = _LETTERS_BEFORE.search(text[max(0, start - 8) : start])
                if letters:
                    start -= len(letters[0])
                elif not text[end - 1].isalpha() or (start and (text[start - 1].isalnum() or text[start - 1] in "_@./-")):
                    continue
            span = text[start:end]
            digits = sum(c.isdigit() for c in span)
            if digits < 6 or digits > 17 or (pattern is _NUMBER and digits < 7):
                continue
            if span[0] == "(" and span.count("(") > span.count(")"):
                start, span = start + 1, span[1:]
            flat = re.sub(r"\s+", " ", span)
            left, right, l1, r1 = _around(text, start, end)
            near = left[:6]
            plus, phone, ident = bool(_PLUS.match(span)), bool(_PHONE_SHAPE.fullmatch(flat)), bool(_ID_SHAPE.fullmatch(flat))
            date, thing = bool(_DATE.fullmatch(flat)), any(w in THING_WORDS for w in near[:3])
            features = [f"s:{_shape(flat)}", f"l1:{left[0] if left else l1}", f"l2:{' '.join(left[:2])}", f"r1:{right[0] if right else r1}", f"lc:{l1}", f"rc:{r1}", f"n:{digits}"]
            features += [f"b:{w}" for w in near] + ["plus"] * plus + ["phoneshape"] * phone + ["idshape"] * ident + ["thing"] * thing
            extension = _EXTENSION.match(text, end)
            if pattern is _NUMBER:
                votes = [1 if plus else 0, 1 if phone else (0 if plus else -1), _vote(near, PHONE_WORDS, 1), -1 if thing or date else 0, _vote(near, ID_WORDS, -1), 1 if extension else 0, -1 if ident and not phone else 0, -1 if text[end : end + 1].isalpha() else 0]
                yield "phone", start, extension.end() if extension else end, " ".join(near), "", votes, _hashed(features + ["ext"] * bool(extension))
            votes = [_vote(near, ID_WORDS, 1), 1 if ident else -1, -1 if thing or date else 0, _vote(near, PHONE_WORDS, -1), -1 if plus or extension else 0, 1 if l1 in "=:(" else 0, -1 if phone and not ident else 0, 0]
            yield "id_number", start, end, " ".join(near), "", votes, _hashed(features)


def _local_start(text: str, end: int) -> int:
    """Where the local part of an address that ends at ``end`` begins, dots written out included; ``end`` where there is none."""
    if not end or not (text[end - 1].isalnum() or text[end - 1] == "_"):
        return end
    at = end
    while True:
        begin = at
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.+-’'"):
            begin -= 1
        while begin < at and text[begin] in ".+-'’":
            begin += 1
        dot = _DOT_BEFORE.search(text, max(0, begin - 12), begin)
        if begin == at or not dot or not dot.start() or not text[dot.start() - 1].isalnum():
            return begin
        at = dot.start()


def _emails(text: str) -> Iterator[Span]:
    for at in _AT.finditer(text):
        start, domain = _local_start(text, at.start()), _DOMAIN.match(text, at.end())
        if start == at.start() or not domain:
            continue
        end = domain.end()
        whole = text[start:end]
        left, right, l1, r1 = _around(text, start, end)
        tail = re.split(r"[.\s)\]}]", whole)[-1]
        plain = bool(re.fullmatch(r"[\w.+\-’']+[@＠][\w.-]+", whole))
        named = tail.isalpha() and len(tail) > 1
        votes = [1 if plain else 0, 1 if named else -1, _vote(left[:5], MAIL_WORDS, 1), 0 if any(c.isalpha() for c in whole[:2]) else -1, -1 if any(c.isdigit() for c in tail) else 0, 0, 0, 0]
        yield "email", start, end, "", "", votes, _hashed([f"t:{tail.lower()}", f"l1:{left[0] if left else l1}", f"lc:{l1}", f"rc:{r1}", f"plain:{plain}", f"named:{named}"])


def _behind(text: str, start: int, size: int, gaps: int) -> str:
    """At least ``size`` characters before ``start``, and as many more as hold ``gaps`` blanks or line ends."""
    near = text[max(0, start - size) : start]
    while size < start and near.count(" ") + near.count("\n") + near.count("\xa0") < gaps:
        size *= 2
        near = text[max(0, start - size) : start]
    return near


def _addresses(text: str, streets: re.Pattern) -> Iterator[Span]:
    # forms are tried at house numbers only: street after the number, or before it
    done = -1
    for m in _HOUSE.finditer(text):
        start, end = m.span()
        before = text[start - 1 : start]
        if start < done or before.isdigit() or (before in (".", ",", "/", "-") and text[start - 2 : start - 1].isdigit()):
            continue
        joined = before.isalnum() or before in (".", ",", "/", "-")
        ahead = None if joined else _NUMBER_FIRST.match(text, start)
        if ahead:
            unit = _UNIT.search(_behind(text, start, 24, 3))
            start, end = start - len(unit[0]) if unit else start, ahead.end()
        else:
            unit, near = None, _behind(text, start, 72, 10)
            behind = _STREET_FIRST.search(near) if any(k in near for k in _STREETS_BEFORE) else None
            if not behind:
                continue
            start -= len(near) - behind.start()
            letter = _HOUSE_LETTER.match(text, end)
            end = letter.end() if letter else end
        span = _address(text, start, end, bool(unit), streets)
        done = span[2]
        yield span


def _address(text: str, start: int, end: int, unit: bool, streets: re.Pattern) -> Span:
    tail = _ADDRESS_TAIL.match(text, end)
    stop = tail.end() if tail else end
    left, right, l1, r1 = _around(text, start, stop)
    post, line = bool(tail and _POSTCODE.search(tail[0])), l1 in "\n^"
    known = bool(streets.search(text, start, end))
    votes = [1 if known else -1, _vote(left[:6], ADDRESS_WORDS, 1), 1 if post else 0, 1 if unit else 0, 1 if line else 0, -1 if right[:1] in (["was"], ["is"], ["lists"], ["were"]) else 0, 1 if tail and "," in tail[0] else 0, 0]
    return "address", start, stop, "", "", votes, _hashed([f"l1:{left[0] if left else l1}", f"l2:{' '.join(left[:2])}", f"r1:{right[0] if right else r1}", f"lc:{l1}", f"unit:{unit}", f"post:{post}", f"known:{known}", f"line:{line}"])


def _inverted(text: str) -> Iterator[re.Match]:
    for comma in _UPPER_COMMA.finditer(text):
        word = _UPPER_WORD.search(_behind(text, comma.start(), 40, 1))
        m = word and _INVERTED.match(text, comma.start() - len(word[0]))
        if m:
            yield m


_A_TITLE = re.compile(rf"[DFHMPS](?:{'|'.join(sorted({t[1:] for t in TITLES}))})[.\s]")
_TITLE_SET = {t.lower() for t in TITLES}


def _persons(text: str, given: frozenset[str], common: frozenset[str]) -> Iterator[Span]:
    seen, titled = set(), set()

    def span(start: int, end: int, a: str, b: str, has_title: bool, inner: str, form: str) -> Span:
        left, right, l1, r1 = _around(text, start, end)
        before = text[max(0, start - 12) : start]
        has_title = has_title or bool(left and left[0] in _TITLE_SET)
        article = bool(left and left[0] in ("the", "a", "an") and before[-1:].isspace())
        heading = text.rfind("\n", 0, start) + 1
        heading = text[heading : heading + 2].strip()[:1] == "#"
        follows = text[end : end + 2]
        longer = not has_title and follows[:1] == " " and follows[1:2].isupper()
        linked = "@" in text[end : end + 30] or l1 in "=|"
        middle = bool(re.search(rf"[{_UPPER}]\.|[a-z]", inner))
        votes = [1 if a in given else 0, 1 if has_title else 0, -1 if article else 0, 1 if middle else 0, -1 if heading or longer else 0, 1 if linked else 0]
        features = [f"l1:{left[0] if left else l1}", f"r1:{right[0] if right else r1}", f"lc:{l1}", f"rc:{r1}", f"form:{form}", f"given:{a in given}", f"titled:{has_title}", f"article:{article}", f"longer:{longer}", f"heading:{heading}", f"l2:{' '.join(left[:2])}", f"b:{b.lower()[-3:]}"]
        return "person", start, end, a, b, votes, _hashed(features)

    for m in _TITLED.finditer(text) if _A_TITLE.search(text) else ():
        start = m.start(1) if m[1] else m.start(2)
        b = m[2].split()[-1]
        titled.add(start)
        yield span(start, m.end(), "", sys.intern(_bare(b)), True, m[1], "titled")
    for m in _PAIR.finditer(text):
        a, b = m[1], _bare(m[3])
        low = a.lower()
        if low in common or low in _TITLE_SET or m.start() in seen:
            continue
        seen.add(m.start())
        yield span(m.start(), m.start(3) + len(b), a, b, False, m[2], "pair")
    seen |= titled
    for m in filter(None, (_INITIALS.match(text, dot.start() - 1) for dot in _INITIAL_DOT.finditer(text))):
        if m.start() in seen or (m.start() and text[m.start() - 1] == " " and re.search(rf"{_CAP} $", text[max(0, m.start() - 24) : m.start()]) and text[max(0, m.start() - 24) : m.start()].split()[-1].lower() not in common | _TITLE_SET):
            continue
        if m[2].split()[-1].lower() in common:
            continue
        seen.add(m.start())
        yield span(m.start(), m.end(), "", _bare(m[2].split()[-1]), False, m[1], "initials")
    for m in _inverted(text):
        if m.start() not in seen and len(m[1]) > 2:
            seen.add(m.start())
            yield span(m.start(), m.end(), m[2], m[1].title(), False, "", "inverted")


def _bare(word: str) -> str:
    return word[:-2] if word.endswith(("'s", "’s")) else word


def spans(text: str, given: frozenset[str], common: frozenset[str], streets: re.Pattern) -> Iterator[Span]:
    """``(kind, start, end, first name, last name, votes, features)`` of every candidate of a text; numbers have the words before them in place of the first name."""
    if any(mark in text for mark in _MARKS):
        yield from _emails(text)
    yield from _numbers(text)
    yield from _addresses(text, streets)
    yield from _persons(text, given, common)
