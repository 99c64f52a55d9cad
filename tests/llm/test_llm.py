"""Operators for training text: against brute force, exact round trips, and cases derived by hand."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, history, line_roles, packing, pii, pii_spans, queries, scan_noise, splitting, text_quality, tokenizing
from quillspark.operators import hamming

LEXICON = [("the", "en", "common"), ("of", "en", "common"), ("and", "en", "common"), ("was", "en", "common"), ("in", "en", "common"), ("is", "en", "common"), ("a", "en", "common"),
           ("Ana", None, "given_name"), ("Bruno", None, "given_name"), ("Clara", None, "given_name"), ("street", "en", "street_word"), (None, None, None)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, lang string, kind string")


# --- problem 5 ---------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    with open(f"{tokenizing.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = bpe.Vocabulary(f.read()).ranks
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "a", "It's  two\n\n spaces \t!", "naïve Größe 北京 emoji 👩‍🎓 mix123", "x" * 3000, "ab" * 2000, "<|endoftext|>", "a b c　 d", "123456789" * 50, " leading", "trailing   "]


def test_ids_equal_the_public_tokenizer(spark, reference):
    frame = spark.createDataFrame(list(enumerate(TEXTS)) + [(1, ""), (None, "a")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("_pieces", F.lit(0))
    rows = tokenizing.encode_corpus(frame).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "a" if r.doc_id is None else TEXTS[r.doc_id]
        assert r.ids == reference.encode_ordinary(text or ""), text
    counted = {r.doc_id: r.n_tokens for r in tokenizing.count_tokens(frame).collect()}
    assert counted[0] == 0 and counted[3] == 1
    assert tokenizing.encode_corpus(frame.limit(0)).count() == 0


def test_rank_queue_on_long_pieces(reference):
    with open(f"{tokenizing.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        vocabulary = bpe.Vocabulary(f.read())
    r = random.Random(4)
    for piece in ("abc" * 700, "".join(r.choice("etaoinsh") for _ in range(4000)), "".join(r.choice("ab") for _ in range(999))):
        assert vocabulary.encode(piece.encode()) == reference.encode_ordinary(piece)


# --- problem 6 ---------------------------------------------------------------


@pytest.mark.parametrize("capacity", [1, 7, 64, 512])
def test_balance_fills_and_keeps_whole(capacity):
    r = random.Random(capacity)
    sizes = sorted((r.randint(1, capacity) for _ in range(400)), reverse=True)
    numbers = packing.fewest(sizes, capacity)
    load = np.bincount(numbers, sizes)
    assert len(numbers) == len(sizes) and load.max() <= capacity and load.min() > 0
    assert len(load) <= 1.22 * math.ceil(sum(sizes) / capacity) + 1


def test_every_document_is_placed_once(spark):
    docs = [(i, "word " * n) for i, n in enumerate([0, 1, 3, 10, 40, 200, 200, 5])] + [(99, None), (None, "two words")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    specs = spark.createDataFrame([(1, 16), (2, 64), (2, 64), (3, None), (4, 0)], "spec_id int, capacity int")
    rows = packing.pack_documents(frame, specs).collect()
    sizes = {r.doc_id: r.n_tokens for r in tokenizing.count_tokens(frame).collect() if r.n_tokens}
    for spec, capacity in ((1, 16), (2, 64)):
        mine = [r for r in rows if r.spec_id == spec]
        load = {}
        for r in mine:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert max(load.values()) <= capacity
        for doc, n in sizes.items():
            parts = sorted((r.start_token, r.n_tokens) for r in mine if r.doc_id == doc)
            assert sum(p[1] for p in parts) == n and len(parts) == math.ceil(n / capacity)
            assert [p[0] for p in parts] == [capacity * k for k in range(len(parts))]
    assert {r.spec_id for r in rows} == {1, 2}
    assert packing.pack_documents(frame, specs.limit(0)).count() == 0 == packing.pack_documents(frame.limit(0), specs).count()


# --- problem 3 ---------------------------------------------------------------


def brute_history(rows):
    seen, accepted, out, refused = set(), [], set(), set()
    for seq, name, text in sorted(rows):
        if name in seen:
            continue
        seen.add(name)
        m = re.fullmatch(r"\s*(?:0[xX])?([0-9a-fA-F]{1,16})\s*", text or "")
        if not m or not int(m[1], 16):
            continue
        v = int(m[1], 16)
        near = [n for n, w in accepted if (v ^ w).bit_count() <= 3]
        out |= {(name, n) for n in near}
        if near:
            refused.add(name)
        else:
            accepted.append((name, v))
    return out, refused


def history_rows(seed, n):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(max(3, n // 12))]
    rows = []
    for seq in range(n):
        v = (base[0] if r.random() < 0.34 else r.choice(base)) ^ sum(1 << k for k in r.sample(range(64), r.choice([0, 0, 1, 2, 3, 4, 6])))
        text = r.choice([f"{v:016x}", f"0x{v:x}", f" {v:016X}\n", f"{v:016x}"])
        rows.append((seq, f"f{seq if r.random() > 0.1 else r.randrange(seq + 1)}", r.choice([text] * 12 + [None, "", "n/a", "0" * 16])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_brute_force(spark, seed):
    rows = history_rows(seed, 260)
    frame = spark.createDataFrame([(n, t, s, s // 20) for s, n, t in rows] + [(None, "1", 9_999, 1), ("x", "1", None, 1)], "file_id string, simhash string, seq long, batch_no int")
    verdict, matches = history.deduplicate(frame.withColumn("fp", F.lit("clash")).withColumn("accepted", F.lit(1)))
    want, refused = brute_history(rows)
    assert {tuple(r) for r in matches.select("file_id", "match_id").collect()} == want
    assert {r.file_id for r in verdict.where("not accepted").collect()} == refused


def test_batches_and_halves_give_the_same(spark, monkeypatch):
    rows = history_rows(5, 200)
    frame = spark.createDataFrame([(n, t, s, 0) for s, n, t in rows], "file_id string, simhash string, seq long, batch_no int")
    want, _ = brute_history(rows)
    monkeypatch.setattr(hamming, "CROWDED", 2)
    monkeypatch.setattr(hamming, "DEPTH", 0)
    monkeypatch.setattr(hamming, "MOST_PAIRS", 300)
    _, matches = history.deduplicate(frame)
    assert {tuple(r) for r in matches.select("file_id", "match_id").collect()} == want
    assert history.deduplicate(frame.limit(0))[1].count() == 0


def test_batches_one_by_one_with_the_tables_opened_anew(spark, tmp_path):
    rows = history_rows(9, 150)
    want, refused = brute_history(rows)
    got, verdicts = set(), []
    for at in range(0, 150, 50):
        batch = spark.createDataFrame([(n, t, s, s // 50) for s, n, t in rows[at : at + 50]], "file_id string, simhash string, seq long, batch_no int")
        verdict, matches = history.History(spark, f"{tmp_path}/h").judge(batch)
        got |= {tuple(r) for r in matches.select("file_id", "match_id").collect()}
        verdicts += verdict.collect()
    assert got == want and {r.file_id for r in verdicts if not r.accepted} == refused
    assert sorted(r.file_id for r in verdicts) == sorted({n for _, n, _ in rows})
    assert history.History(spark, f"{tmp_path}/h").verdicts().count() == len(verdicts)


def test_steps_grow_and_end_singly():
    assert history.steps([(b, 10) for b in range(10)], 2) == [[0], [1, 2, 3, 4], [5, 6, 7], [8], [9]]
    assert history.steps([(b, 10) for b in range(6)], 2) == [[0], [1, 2, 3], [4], [5]] and history.steps([], 3) == [] and history.steps([(7, 1)], 3) == [[7]]


def test_texts_of_matches_are_compared(spark):
    chunks = spark.createDataFrame([("a", "One, two."), ("a", "Three"), ("b", "three!"), ("b", "one two"), ("c", "four"), ("d", None)], "file_id string, content string")
    pairs = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "a")], "file_id string, match_id string")
    assert {r.file_id: r.same_text for r in history.agreement(pairs, chunks).collect()} == {"b": True, "c": False, "d": None}


# --- problem 4 ---------------------------------------------------------------


def plain_boundary(text):
    ws = f"[{splitting.SPACE}]"
    ok = lambda parts: all(len(p) // 4 <= 500 for p in parts)
    if ok(re.split(rf"\n{ws}*\n", text)):
        return "paragraph"
    if ok(text.split("\n")):
        return "line"
    if ok([p for line in text.split("\n") for p in re.split(rf"(?<=[.!?]){ws}+", line)]):
        return "sentence"
    return "word" if ok(re.split(f"{ws}+", text)) else "none"


def odd_texts():
    r = random.Random(6)
    parts = ["word", "x" * 30, ".", "!", " ", "\n", "\n\n", "\n \n", " ", "\t", "é", "\x1c"]
    return ["".join(r.choice(parts) * r.choice([1, 1, 1, 40]) for _ in range(r.choice([50, 400]))) for _ in range(60)] + [" " * 5000, "\n" * 5000, "a" * 2004, "a" * 2003 + "\n\n" + "b", "é" * 9000]


def test_boundaries_do_not_depend_on_ranges():
    for text in odd_texts():
        assert {splitting.boundary_of(text, 500, span) for span in (7, 64, 1000, 1 << 20)} == {plain_boundary(text)}


def test_pieces_tile_and_overlap(spark):
    rows = [(f"c{i}", t, None) for i, t in enumerate(odd_texts())] + [("n", None, "h"), ("e", "", "h"), ("c1", odd_texts()[1], None)]
    frame = spark.createDataFrame(rows, "chunk_id string, content string, section_header string").withColumn("estimated_tokens", F.lit(7)).withColumn("piece_no", F.lit("clash"))
    pieces = {}
    for p in splitting.split_chunks(frame).collect():
        pieces.setdefault(p.chunk_id, []).append(p)
    big = {c: t for c, t, _ in rows if t and len(t) // 4 > 500}
    assert pieces.keys() == big.keys()
    for c, parts in pieces.items():
        parts.sort(key=lambda p: p.piece_no)
        assert "".join(p.content[p.n_overlap :] for p in parts) == big[c]
        assert all(p.estimated_tokens == len(p.content) // 4 <= 500 and p.n_overlap <= 200 for p in parts)
        assert all(big[c][: q.start_pos].endswith(q.content[: q.n_overlap]) for q in parts)
    found = {r.chunk_id: r.boundary for r in splitting.natural_boundaries(frame).collect()}
    assert found == {c: plain_boundary(t) for c, t in big.items()}


def test_tokens_that_fit_a_piece_stay_whole():
    for n in (1500, 1750, 1950, 2003):
        for head in ("some words before. ", "word " * 90, "a\n\nb "):
            text = head + "x" * n + " and words after it" * 40
            assert splitting.boundary_of(text) == "word"
            pieces = splitting.cut_text(text)
            assert any("x" * n in text[start:end] for _, start, end in pieces), (n, head)
            assert "".join(text[start:end] for _, start, end in pieces) == text and all(end - before <= 2003 for before, _, end in pieces)


def test_files_are_cut_by_ranges(spark, tmp_path):
    text = "\n\n".join(t for t in odd_texts() if "\x1c" not in t)
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "b.txt").write_bytes(b"")
    for size in (3000, 1 << 20):
        parts = splitting.split_files(spark, str(tmp_path), range_bytes=size).orderBy("piece_no").collect()
        assert "".join(p.content[p.n_overlap :] for p in parts) == text
        assert [p.piece_no for p in parts] == list(range(len(parts))) and max(p.estimated_tokens for p in parts) <= 500
        assert all(text[p.start_pos : p.end_pos] == p.content[p.n_overlap :] for p in parts)


@pytest.mark.parametrize(("limit", "overlap", "size"), [(50, 20, 700), (50, 20, 1500), (30, 25, 400), (500, 50, 6000), (40, 0, 333)])
def test_numbers_do_not_skip_at_any_range(spark, tmp_path, limit, overlap, size):
    r = random.Random(size)
    texts = [" ".join("w" * r.choice([1, 3, 9, 60]) + r.choice(["", ".", "!\n", "\n\n"]) for _ in range(r.choice([40, 900]))) for _ in range(12)]
    for i, text in enumerate(texts):
        (tmp_path / f"{i:02}.txt").write_bytes(text.encode())
    found = {}
    for p in splitting.split_files(spark, str(tmp_path), limit, overlap, size).collect():
        found.setdefault(p.path[-6:-4], []).append(p)
    for i, text in enumerate(texts):
        parts = sorted(found[f"{i:02}"], key=lambda p: p.piece_no)
        assert [p.piece_no for p in parts] == list(range(len(parts))) and "".join(p.content[p.n_overlap :] for p in parts) == text
        assert all(p.estimated_tokens <= limit and p.n_overlap <= 4 * overlap and text[p.start_pos - p.n_overlap : p.end_pos] == p.content for p in parts)
        rows = splitting.cut_row(text, limit, overlap, size)
        assert [b for _, _, b in rows[:-1]] == [a for _, a, _ in rows[1:]] and rows[0][1] == 0 and rows[-1][2] == len(text)
        assert all((z - b) // 4 <= limit and a - b <= 4 * overlap for b, a, z in rows)


def test_pieces_tile_by_their_own_account(spark):
    rows = [(f"c{i}", t, None) for i, t in enumerate(odd_texts())] + [("c1", odd_texts()[1], "again"), (None, "z" * 3000, None), (None, "z" * 3000, None)]
    frame = spark.createDataFrame(rows, "chunk_id string, content string, section_header string")
    pieces = splitting.split_chunks(frame)
    got = {r.chunk_id: (r.n_chars, r.faults) for r in splitting.tiling(pieces).collect()}
    assert got == {c: (len(t), 0) for c, t, _ in rows if len(t) // 4 > 500}
    wrong = splitting.tiling(pieces.where("piece_no != 1")).where("faults > 0").count()
    assert wrong > 0


# --- problems 1 and 2 --------------------------------------------------------


def test_line_roles():
    lines = ["Plain text of a sentence, which goes on", "| a | b |", "- item one", "Avel;1;2", "def f(x):", "$$ x $$", "", "1.1 Scope ....... 7", "-----"]
    assert line_roles.roles(lines) == ".TLTCFBLR"
    assert line_roles.roles(["Oak", "Maple tree", "Birch", "Linden"]) == "LLLL"
    assert line_roles.roles(["and so it went on over", "the hills until the", "evening came at last."]) == "..."


def test_examples_keep_their_kinds(spark, lexicon):
    common = frozenset("the of and was in is a it not had been that on but le la les est que pas on et mais ce die der den und nicht so ist für wenn auch am im zu you all these which by then at he she his with for".split())
    for kind, texts in text_quality.EXAMPLES.items():
        for t in texts:
            s = dict(zip(line_roles.STATISTICS, line_roles.statistics(t, common), strict=True))
            assert text_quality.settled(kind, s) == kind, t
    assert text_quality.settled("junk", dict(zip(line_roles.STATISTICS, line_roles.statistics("", common), strict=True))) is None


def chunk_frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, file_id string, chunk_index int, content string, section_header string, top_header string").withColumn("kind", F.lit("clash"))


def test_kinds_of_a_small_table(spark, lexicon):
    rows = [(f"{kind}-{i}", f"f{i}", 0, t, None, None) for kind, texts in text_quality.EXAMPLES.items() for i, t in enumerate(texts)] + [("null", "f0", 1, None, None, None), ("blank", None, 2, " \n ", None, None)]
    got = {r.chunk_id: r.kind for r in text_quality.kinds_of_chunks(chunk_frame(spark, rows + rows[:3]), lexicon).collect()}
    assert len(got) == len(rows) and got["null"] is None and got["blank"] is None
    assert sum(got[c] == c.split("-")[0] for c in got if "-" in c) >= 0.85 * (len(rows) - 2)
    files = text_quality.file_statistics(chunk_frame(spark, rows), lexicon).collect()
    assert sum(f.n_chunks for f in files) == len(rows)
    assert text_quality.not_prose(chunk_frame(spark, rows).limit(0), lexicon).count() == 0


def scan_rows():
    r = random.Random(8)
    nouns = "record window station harbour teacher library morning weather village journey kitchen meadow".split()
    line = lambda: f"the {r.choice(nouns)} of the {r.choice(nouns)} was in the {r.choice(nouns)} and it"
    rows = [(f"p{i}", "clean", i, "\n".join(line() for _ in range(8)) + ".", None, "Tales of the Coast") for i in range(60)]
    noisy = ["the record of the statlon was in the kit-", "", "42", "Tales of the Coast   42", "chen and it was the low-", "cost village of the ﬁsh and", "the line was as follows:", "17", "a low-cost window and a vi1lage in the end."]
    rows += [("n1", "scan", 1, "\n".join(noisy), "Own Head", "Tales of the Coast"), ("n1", "scan", 1, "\n".join(noisy), "Own Head", "Tales of the Coast")]
    rows += [(f"c{i}", "clean", i, "a low-cost window and a fish of the village was in the low-cost kitchen", None, None) for i in range(15)]
    return [*rows, ("null", "scan", 2, None, None, None), ("blank", "scan", 3, " \n", None, None), ("list", "scan", 4, "- one\n- two\n12\n- three", None, None)]


def test_scan_noise(spark, lexicon):
    frame = chunk_frame(spark, scan_rows())
    got = {(r.chunk_id, r.line_no, r.kind) for r in scan_noise.find_noise(frame, lexicon).collect()}
    assert got == {("n1", 1, "misread"), ("n1", 1, "hyphen"), ("n1", 3, "page_number"), ("n1", 4, "running_header"), ("n1", 6, "misread"), ("n1", 9, "misread")}
    fixed = {r.chunk_id: r.content for r in scan_noise.repaired(frame, lexicon).collect()}
    assert fixed["p0"] == scan_rows()[0][3] and fixed["null"] is None and fixed["list"] == "- one\n- two\n12\n- three"
    assert fixed["n1"] == "the record of the station was in the kitchen and it was the low- cost village of the fish and the line was as follows: 17 a low-cost window and a village in the end."


def test_frequent_misreadings_are_looked_up(spark, lexicon):
    clean = "the village of the harbour was in the record and it was the fish of the end"
    rows = [(f"p{i}", "clean", i, "\n".join([clean] * 8) + ".", None, None) for i in range(130)]
    rows += [(f"m{i}", "scan", i, "\n".join([clean, clean.replace("the record", "tbe record"), clean.replace("fish", "ﬁsh")]) + ".", None, None) for i in range(30)]
    rows += [(f"b{i}", "scan", 50 + i, "\n".join([clean, clean.replace("harbour", "barbour")]) + ".", None, None) for i in range(3)]
    frame = chunk_frame(spark, rows)
    got = {(r.chunk_id, r.line_no) for r in scan_noise.find_noise(frame, lexicon).where("kind = 'misread'").collect()}
    assert got == {(f"m{i}", k) for i in range(30) for k in (2, 3)} | {(f"b{i}", 2) for i in range(3)}
    fixed = [r.content for r in scan_noise.repaired(frame, lexicon).where("chunk_id like 'm%'").collect()]
    assert len(fixed) == 30 and not any("tbe" in t or "ﬁ" in t for t in fixed)


def test_halves_are_judged_by_share_not_by_count(spark, lexicon):
    clean = "the village of the harbour was in the record and it was a low-cost window of the end"
    rows = [(f"p{i}", "clean", i, "\n".join([clean] * 4) + ".", None, None) for i in range(30)]
    rows += [(f"{half}{i}", "scan", i, f"{clean}\nand it was in the {half}-", None, None) for half in ("illegi", "low") for i in range(25)]
    got = {(r.chunk_id, r.line_no) for r in scan_noise.find_noise(chunk_frame(spark, rows), lexicon).where("kind = 'hyphen'").collect()}
    assert got == {(f"illegi{i}", 2) for i in range(25)}


def test_anagram_difference(spark):
    row = spark.createDataFrame([("rnodel", "model")], "a string, b string").select((scan_noise.anagram(F.col("b")) - scan_noise.anagram(F.col("a"))).alias("d")).first()
    assert row.d == scan_noise._difference("rn", "m")
    pair = spark.createDataFrame([("Mar1ow Rídge",)], "a string").select(scan_noise.skeleton_column(F.col("a")).alias("s")).first()
    assert pair.s == scan_noise.skeleton("Mar1ow Rídge")


# --- problem 7 ---------------------------------------------------------------

STREET = re.compile("Street|Lane", re.I)


def kinds_at(text):
    given, common = frozenset({"Ana", "Bruno"}), frozenset({"the", "and"})
    return {(s[0], text[s[1] : s[2]]) for s in pii_spans.spans(text, given, common, STREET)}


def test_candidates():
    found = kinds_at("Mail Ana Velt at ana.velt@example.org or b [at] site (dot) net, call +44 1632 960 654 x19.")
    assert {("email", "ana.velt@example.org"), ("email", "b [at] site (dot) net"), ("phone", "+44 1632 960 654 x19"), ("person", "Ana Velt")} <= found
    found = kinds_at("Flat 3, 22 Weir Lane, Lakemont. Prof. Dr. K. Sommer and VELT, Bruno wrote to Amselstraße 62, 00062 Ort; ID AB1234567")
    assert ("address", "Amselstraße 62, 00062 Ort") in found and any(k == "address" and t.startswith("Flat 3, 22 Weir Lane") for k, t in found)
    assert {("person", "K. Sommer"), ("person", "VELT, Bruno"), ("id_number", "AB1234567")} <= found
    assert kinds_at("") == set() and not {k for k, _ in kinds_at("uses torch@1.2.3 and 12.5 of 7")} & {"phone", "address"}


def test_addresses_whose_number_follows_no_blank():
    for address in ("C/ Molino Viejo, nº12", "Calle Mayor,12", "Am\nMarkt 5", "Am\xa0Markt 5", "Zur\nMühle 7"):
        assert ("address", address) in kinds_at(f"sent to {address}"), address


def test_every_form_of_at_is_sought():
    for word in ("at", "AT", "arobase", "ät"):
        for left, right in ("[]", "()", "{}", "<>"):
            for at in (f" {left}{word}{right} ", f" {left} {word} {right} "):
                assert any(k == "email" for k, _ in kinds_at(f"jane{at}uni.example")), at


def test_addresses_of_mail_have_no_longest_part():
    for mail in ("x" * 70 + "@example.org", "jane dot doe at example dot org", "jane (dot) doe (at) example (dot) org", "a.b[dot]c [at] d.example"):
        assert ("email", mail) in kinds_at(f"write to {mail} today"), mail
    assert {t for k, t in kinds_at("the dot stands at home. Look (at) x.y. @b.org") if k == "email"} == {"Look (at) x.y"}
    street = "Avenida " + " ".join("Q" + "x" * 40 for _ in range(3))
    assert ("address", f"{street}, 12") in kinds_at(f"sent to {street}, 12")
    assert ("person", "A" * 50 + ", Bruno") in kinds_at("by " + "A" * 50 + ", Bruno")


def pii_rows():
    r = random.Random(9)
    firsts, lasts = ["Ana", "Bruno", "Clara", "Zeno"], ["Velt", "Korvin", "Damaris", "Ostrow"]
    rows = []
    for i in range(160):
        f, s = r.choice(firsts), r.choice(lasts)
        rows.append((i, r.choice([
            f"The draft was read by {f} {s} in spring.\nE-mail: {s.lower()}@example.org", f"Passport no. AB{r.randrange(10**6, 10**7)} is kept on file.", f"Call 01632 960{r.randrange(100, 999)} if it fails.",
            f"Order 555 0{r.randrange(100, 999)} 41 58 was never delivered.", f"Address: {r.randrange(1, 99)} Weir Lane, Lakemont NW0 4QT", f"The {f} Table covers most of the table of cases, and the table is long.",
        ])))
    return rows


def test_personal_information_is_found_and_replaced(spark, lexicon):
    rows = pii_rows() + [(500, None), (501, ""), (502, "   "), (None, "Ana Velt"), (0, pii_rows()[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("score", F.lit(1))
    found = pii.find_personal(docs, lexicon)
    got = {(r.doc_id, r.kind) for r in found.collect()}
    want = set()
    for i, t in pii_rows():
        want |= {(i, k) for k, mark in (("person", "read by"), ("email", "@"), ("id_number", "Passport"), ("phone", "Call"), ("address", "Address")) if mark in t}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    redacted = {r.doc_id: r.text for r in pii.redact(docs.where("doc_id != 0"), found).collect()}
    assert redacted[500] is None and redacted[501] == ""
    sample = next(i for i, t in pii_rows() if i and "read by" in t and (i, "person") in got and (i, "email") in got)
    assert redacted[sample] == "The draft was read by [PERSON] in spring.\nE-mail: [EMAIL]"
    assert pii.find_personal(docs.limit(0), lexicon).count() == 0
    whole = pii.redacted(docs, lexicon).collect()
    assert len(whole) == len(rows) and [r.text for r in whole if r.doc_id is None] == ["[PERSON]"]
    assert {r.text for r in whole if r.doc_id == sample} == {redacted[sample]}


def test_mixture_of_votes():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.4
    votes = np.zeros((4000, pii.VOTES), int)
    for k, (hit, miss) in enumerate([(0.8, 0.05), (0.7, 0.1), (0.6, 0.02), (0.7, 0.03), (0.8, 0.1)]):
        votes[:, k] = np.where(r.random(4000) < np.where(truth, hit, miss), 1, 0)
    prior, tables = pii.estimate(votes, np.ones(4000))
    assert abs(prior - 0.4) < 0.1 and ((pii.posterior(votes, prior, tables) > 0.5) == truth).mean() > 0.9


# --- the queries over the smallest tables ------------------------------------


@pytest.mark.parametrize("name", ["p1_text", "p2_files", "p3_files", "p4_pieces", "p7_text"])
def test_queries_run(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_boundaries_equal_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW chunks AS SELECT * FROM '{data}/chunks.parquet'")
    want = {tuple(r) for r in con.sql(queries.SQL["p4_found"]).fetchall()}
    assert {(r.chunk_id, r.boundary) for r in queries.p4_found(spark, data).collect()} == want
