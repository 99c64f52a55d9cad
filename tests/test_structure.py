"""Sections, blocks, merging, contents, links, dedup, pipelines and sinks."""

import random

import pytest

from pyspark.sql import functions as F

from quillspark.operators import annotate, block_store, blocks, evaluate, hamming, links, merge, sections, toc
from quillspark.plans import pipelines
from quillspark.sources import readers, sinks
from quillspark.streaming import incremental


def test_markdown_sections(spark):
    doc = "intro\n# A\ntext\n### C\nx\n## B\n```\n# no heading\n```\n### D\ny\n##### five"
    frame = spark.createDataFrame([(1, doc), (2, "plain"), (3, None), (4, "")], "doc_id int, markdown string")
    got = [(r.doc_id, r.section_header, r.section_level, r.parent_section, r.top_header) for r in sections.markdown_sections(frame).orderBy("doc_id", "section_idx").collect()]
    assert got == [(1, None, None, None, None), (1, "A", 1, None, "A"), (1, "C", 3, None, "A"), (1, "B", 2, "A", "A"), (1, "D", 3, "B", "A"), (2, None, None, None, None), (4, None, None, None, None)]
    parts = sections.markdown_sections(frame.where("doc_id = 1")).orderBy("section_idx").collect()
    assert "\n".join(p.section_content for p in parts) == doc
    assert [p.char_start for p in parts] == [sum(len(q.section_content) for q in parts[:i]) for i in range(len(parts))]


def test_numeric_sections(spark):
    frame = spark.createDataFrame([(1, "1 One\na\n1.1 Two\nb\n2.1.1 Deep\n01 Again")], "doc_id int, markdown string")
    got = [(r.section_header, r.section_level, r.parent_section, r.top_header) for r in sections.numeric_sections(frame).orderBy("section_idx").collect()]
    assert got == [("1. One", 1, None, "1. One"), ("1.1. Two", 2, "1. One", "1. One"), ("2.1.1. Deep", 3, "1.1. Two", "1. One"), ("1. Again", 1, None, "1. Again")]


def test_blocks():
    got = blocks.find_blocks("before\n```\ncode\n```\nmid $$x$$\n| a |\n|--|\n| 1 |\nend")
    assert [(b[0], b[1]) for b in got] == [("before", "prose"), ("```\ncode\n```", "code"), ("mid", "prose"), ("$$x$$", "math"), ("| a |\n|--|\n| 1 |\n", "table"), ("end", "prose")]
    assert [b[1] for b in blocks.find_blocks("| a | b |\n|---|---|\n| 1 | 2 |\n")] == ["prose"]
    assert [b[1] for b in blocks.find_blocks("```\n$$x$$\n```")] == ["code", "math", "prose"]
    assert blocks.find_blocks(None) == [] and blocks.find_blocks("") == [("", "prose", 0, 0)] and blocks.find_blocks(" \n") == [(" \n", "prose", 0, 2)]
    assert blocks.find_blocks("  hello \n") == [("hello", "prose", 0, 9)]
    assert [b[1] for b in blocks.find_blocks("\\begin{align} x \\} y}\\end{align} so")] == ["math", "prose"]


def test_splitters(spark):
    one = lambda column, t: spark.createDataFrame([(t,)], "t string").select(column(F.col("t")).alias("v")).first().v
    lines = one(lambda c: blocks.split_lines(c, 5), "a b c\nd e\nf g h i\nj")
    assert "\n".join(lines) == "a b c\nd e\nf g h i\nj" and len(lines) > 1
    table = one(lambda c: blocks.split_table(c, 14), "| h |\n|--|\n" + "\n".join(f"| {i} |" for i in range(6)))
    assert len(table) > 1 and all(p.startswith("| h |\n|--|\n") for p in table) and sum(p.count("\n") - 1 for p in table) == 6
    assert one(lambda c: blocks.split_sentences_sum(c, 4), "One two. Three four! Five six? Seven") == ["One two. Three four!", "Five six? Seven"]
    hard = one(lambda c: blocks.split_sentences_hard(c, 5), "Short one. " + "x" * 50 + " ```a. b. c``` end.")
    assert all(len(p) <= 20 for p in hard) and "".join(hard).count("x") == 50
    assert one(lambda c: blocks.split_sentences_hard(c, 5), "") == []
    pieces = blocks.split_recursive("\n\n".join(f"para {i} " + "word " * 20 for i in range(9)), 60, 0, lambda t: len(t.split()))
    assert all(len(p.split()) <= 60 for p in pieces) and sum(len(p.split()) for p in pieces) == 9 * 22


CHUNK = "doc_id int, n int, content string, section_header string, content_type string, estimated_tokens int"


def test_merge_short(spark):
    rows = [
        (1, 0, "a", "S", "prose", 1), (1, 1, "b", "S", "prose", 1), (1, 2, "c", "S", "code", 60), (1, 3, "d", "T", "code", 1), (1, 4, "e", "U", "code", 1),
        (2, 0, "x", "Abstract", "prose", 2), (2, 1, "y", None, "prose", 2), (3, 0, "z", "S", "prose", 400), (3, 1, "w", "S", "prose", 1),
    ]
    got = merge.merge_short(spark.createDataFrame(rows, CHUNK), "doc_id", ["n"], 500, 50).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.content, r.section_header) for r in got] == [
        (1, 0, "a\n\nb", "S"), (1, 1, "c", "S"), (1, 2, "d", "T"), (1, 3, "e", "U"), (2, 0, "x\n\ny", "Abstract"), (3, 0, "z", "S"), (3, 1, "w", "S"),
    ]


def test_join_short_and_annotations(spark):
    rows = [(1, 0, "# Head", "Head", 100, [("r1", "one"), (None, "two")]), (1, 1, "body", "Next", 100, [("r1", "dup"), (None, "three"), ("r2", "four")]), (1, 2, "tail", None, 1, [])]
    frame = spark.createDataFrame(rows, "doc_id int, n int, content string, section_header string, estimated_tokens int, notes array<struct<self_ref:string,caption:string>>")
    got = merge.join_short(frame, "doc_id", ["n"], 50, annotations="notes").orderBy("chunk_index").collect()
    assert [(r.content, r.section_header, [a.caption for a in r.notes]) for r in got] == [("# Head\n\nbody\n\ntail", None, ["one", "two", "three", "four"])]


def test_contents(spark):
    text = "# T\n\n## Table of Contents\n- a ... 3\n- b\n\n## Body\nText"
    frame = spark.createDataFrame([(text,)], "t string")
    row = frame.select(toc.contents(F.col("t")).alias("c"), toc.without_contents(F.col("t")).alias("w"), toc.contents(F.col("t"), True).alias("h")).first()
    assert row.c == "## Table of Contents\n- a ... 3\n- b\n" and row.w == "# T\n\n\n## Body\nText" and row.h == "## Table of Contents"


def test_contents_entries(spark):
    table = "| CHAPTER 1 ...... 1 |\n|---|\n| 1.1. Scope .... 2 |\n| 1.1.1 Deep .... 4 |\n| INTRODUCTION |\n| ordinary | row |"
    listed = "- Abstract\n- Domain & Tools\n- -Inner .... 7\n- - Other"
    frame = spark.createDataFrame([(1, table), (2, listed), (3, None)], "doc_id int, t string")
    got = [(r.doc_id, r.title, r.page, r.level, r.numeric_id, r.parent_idx, r.full_path) for r in toc.parsed(frame, "t").orderBy("doc_id", "entry_no").collect()]
    assert got[:3] == [(1, "CHAPTER 1", 1, 0, "1", None, "CHAPTER 1"), (1, "Scope", 2, 2, "1.1", 0, "CHAPTER 1 > Scope"), (1, "Deep", 4, 3, "1.1.1", 1, "CHAPTER 1 > Scope > Deep")]
    assert [g[1:] for g in got if g[0] == 2] == [
        ("Abstract", None, 0, None, None, "Abstract"), ("Domain & Tools", None, 0, None, None, "Domain & Tools"),
        ("Inner", 7, 1, None, 1, "Domain & Tools > Inner"), ("Other", None, 1, None, 1, "Domain & Tools > Other"),
    ]


def test_contents_enrich(spark):
    flat = spark.createDataFrame([(1, 0, "Scope", 1, "1", None, "Scope"), (1, 1, "Method", 1, "2", None, "Method"), (1, 2, "Scope", 2, "2.1", "2", "Method > Scope")], "doc_id int, entry_no int, title string, level int, numeric_id string, parent_id string, full_path string")
    chunks = spark.createDataFrame([(1, 0, "Scope"), (1, 1, "2. Method"), (1, 2, "meth"), (1, 3, ""), (1, 4, None), (1, 5, "zzz")], "doc_id int, n int, section_header string")
    got = {r.n: r.toc_full_path for r in toc.enriched(chunks, toc.lookup(flat), "doc_id").collect()}
    assert got == {0: "Method > Scope", 1: "Method", 2: "Method", 3: None, 4: None, 5: None}


def test_annotations(spark):
    md = "aa #/pictures/0 bb <!-- image --> cc"
    frame = spark.createDataFrame([(0, "#/pictures/0", None), (1, None, "BB"), (0, None, "nowhere"), (5, None, None)], "i int, r string, c string")
    got = [r.p for r in frame.select(annotate.position(F.lit(md), F.col("r"), F.col("c"), F.col("i")).alias("p")).collect()]
    assert got == [3, 16, md.index("<!--"), None]
    notes = spark.createDataFrame([(1, 0, None, None, 7), (1, 1, None, "cap", None), (1, 2, None, "none", None)], "doc_id int, annotation_no int, self_ref string, caption string, pos int")
    chunks = spark.createDataFrame([(1, 0, "abc", 0, 5), (1, 1, "the CAP here", 5, 17)], "doc_id int, chunk_index int, content string, char_start int, char_end int")
    assert {r.annotation_no: r.chunk_index for r in annotate.placed(notes, chunks).collect()} == {0: 1, 1: 1, 2: None}


def test_links(spark):
    rows = links.linked(links.with_ids(spark.createDataFrame([("f", i) for i in range(4)], "file_id string, chunk_index int")), "file_id", ["chunk_index"]).orderBy("chunk_index").collect()
    assert rows[0].prev_chunk_id == "" == rows[3].next_chunk_id and all(a.next_chunk_id == b.chunk_id and b.prev_chunk_id == a.chunk_id for a, b in zip(rows, rows[1:], strict=False))
    assert len({r.chunk_id for r in rows}) == 4


def test_hamming_classes_against_brute_force(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(30)]
    values = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(8)] + [base[0]] * 5
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([*enumerate(signed), (9999, None), (None, 5)], "id long, fp long")
    members, pairs = hamming.near_classes(frame, "id", "fp")
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = {(first[a], first[b], (a ^ b).bit_count()) for a in first for b in first if first[a] < first[b] and (a ^ b).bit_count() <= 3}
    assert {tuple(x) for x in pairs.select("class_a", "class_b", "distance").collect()} == want
    assert {x.id: x.class_id for x in members.collect()} == {i: first[v] for i, v in enumerate(values)}
    kept = []
    for v in values:
        if all((v ^ k).bit_count() > 3 for k in kept):
            kept.append(v)
    status = {x.id: x.status for x in hamming.greedy_keep(frame, "id", "fp", "id").collect()}
    assert {i for i, s in status.items() if s == "kept"} == {first[k] for k in kept}


def test_rounds_and_one_task_settle_alike(spark, monkeypatch):
    r = random.Random(3)
    values = [r.getrandbits(6) for _ in range(200)]  # one dense knot of 64 fingerprints
    frame = spark.createDataFrame(list(enumerate(values)), "id long, fp long")
    status = lambda: {x.id: x.status for x in hamming.greedy_keep(frame, "id", "fp", "id").collect()}
    one_task = status()
    monkeypatch.setattr(hamming, "FEW_LINKS", 0)
    assert status() == one_task and "kept" in one_task.values()


def test_keys_grow_where_a_group_is_hot(spark, monkeypatch):
    monkeypatch.setattr(hamming, "CROWDED", 4)
    r = random.Random(2)
    values = [0x1234567800000000 | r.getrandbits(32) for _ in range(150)]  # all share half of their bits
    values += [v ^ (1 << r.randrange(32)) for v in values[:40]]
    frame = spark.createDataFrame(list(enumerate(dict.fromkeys(values))), "id long, fp long")
    distinct = list(dict.fromkeys(values))
    want = {(i, j) for i, a in enumerate(distinct) for j, b in enumerate(distinct) if i < j and (a ^ b).bit_count() <= 3}
    assert {(x.class_a, x.class_b) for x in hamming.near_classes(frame, "id", "fp")[1].collect()} == want


DOCS = [
    ("/in/a.txt", "# Report\n\n## Table of Contents\n1. Scope .... 1\n\n## Scope\n" + "The first sentence is here. " * 12 + "\n\n## Method\n" + "Another sentence follows it. " * 12, 1),
    ("/in/b.txt", "# Report\n\n## Table of Contents\n1. Scope .... 1\n\n## Scope\n" + "The first sentence is here. " * 12 + "\n\n## Method\n" + "Another sentence follows it. " * 12, 2),
    ("/in/c.txt", "1 Start\n" + "Something else entirely stands in this text. " * 10, 3),
    ("/in/d.txt", None, 4),
]
DOC = "path string, markdown string, seq long"


def test_main_pipeline(spark):
    files, chunks = pipelines.process(spark.createDataFrame(DOCS, DOC))
    run = {r.file: (r.status, r.chunks > 0) for r in pipelines.results(files, chunks).collect()}
    assert run == {"/in/a.txt": ("success", True), "/in/b.txt": ("skipped", False), "/in/c.txt": ("success", True), "/in/d.txt": ("failed", False)}
    rows = chunks.collect()
    assert any(r.toc_full_path == "Scope" for r in rows) and all(r.evaluation.reason for r in rows)
    assert {r.status: r.n for r in pipelines.status_counts(pipelines.results(files, chunks)).collect()} == {"success": 2, "skipped": 1, "failed": 1}


def test_layout_and_page_pipelines(spark):
    docs = spark.createDataFrame([(f"f{i}", d[1], "t") for i, d in enumerate(DOCS[:3])], "file_id string, markdown string, title string")
    notes = spark.createDataFrame([("f0", 0, None, "first sentence", ["a picture"])], "file_id string, annotation_no int, self_ref string, caption string, descriptions array<string>")
    rows = pipelines.process_layout(docs, notes).orderBy("file_id", "chunk_index").collect()
    assert rows[0].chunk_id == "f0-1" and rows[0].prev_chunk_id is None and sum(len(r.image_annotations) for r in rows) == 1
    pages = pipelines.process_pages(docs).collect()
    assert {r.chunk_id for r in pages} >= {"1"} and all(r.title == "t" for r in pages)


def test_one_run_equals_two(spark, tmp_path):
    frame = spark.createDataFrame(DOCS, DOC)
    for name, parts in (("one", ["true"]), ("two", ["seq <= 1", "seq > 1"])):
        for part in parts:
            incremental.ingest(frame.where(part), f"{tmp_path}/{name}/files", f"{tmp_path}/{name}/chunks")
    ids = lambda name: {r.chunk_id for r in spark.read.parquet(f"{tmp_path}/{name}/chunks").collect()}
    assert ids("one") == ids("two") != set()


def test_stream(spark, tmp_path):
    spark.createDataFrame(DOCS, DOC).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(DOC).parquet(f"{tmp_path}/in")
    incremental.start(stream, f"{tmp_path}/files", f"{tmp_path}/chunks", f"{tmp_path}/state").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/files").count() == 2


def test_tables_round_trip(spark, tmp_path):
    files, chunks = pipelines.process(spark.createDataFrame(DOCS, DOC))
    table = sinks.chunks_table(chunks)
    sinks.append(table.withColumn("content", F.concat("content", F.lit('\n"quoted", \\ back'))), f"{tmp_path}/chunks", "csv")
    back = readers.chunks_csv(spark, f"{tmp_path}/chunks")
    assert back.columns == table.columns and {r.content for r in back.collect()} == {r.content + '\n"quoted", \\ back' for r in table.collect()}
    done = files.where("status = 'ok'").withColumn("metadata", F.create_map(F.lit("title"), F.lit("T")))
    row = sinks.files_table(done).first()
    assert row.title == "T" and row.author == "" and row.encryption == "None"
    assert readers.files_csv(spark, f"{tmp_path}/nothing").count() == 0
    assert sinks.save_chunks(chunks, f"{tmp_path}/out", ("JSONL", "json", "text", "indiv", "xml")) == ["jsonl", "json", "text", "indiv"]
    assert spark.read.json(f"{tmp_path}/out/jsonl").count() == chunks.count()


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.pdf").write_bytes(b"bad")
    assert readers.text_files(spark, f"{tmp_path}/*.txt").first().markdown == "one\ntwo"

    def convert(path, content):
        if content == b"bad":
            raise ValueError("broken")
        return {"markdown": "# x", "annotations": [{"self_ref": "r", "caption": None, "descriptions": ["d1", "d2"]}]}

    got = {r.path[-5:]: r for r in readers.converted_files(spark, str(tmp_path), convert).collect()}
    assert got["b.pdf"].markdown == "# x" and got["c.pdf"].error == "ValueError: broken"
    notes = readers.primary_descriptions(readers.converted_files(spark, str(tmp_path), convert)).collect()
    assert [n.primary_description for n in notes] == ["d1"]
    (tmp_path / "log.txt").write_text('start\n{"chunk_id": "c", "chunk_text": "t", "metadata": {"TAGS": ["a"], "QUESTIONS": ["q"], "ANSWERS": []}}\n')
    assert readers.enrichment_lines(spark, f"{tmp_path}/log.txt").first().metadata.TAGS == ["a"]


def brute_greedy(rows, known=()):
    """Accepted ids and matches of (id, fp) in order, all known being accepted."""
    kept, out = list(known), set()
    for i, v in rows:
        near = {n for n, w in kept if (v ^ w).bit_count() <= 3}
        out |= {(i, n) for n in near}
        if not near:
            kept.append((i, v))
    return {i for i, _ in kept} - {i for i, _ in known}, out


def test_known_are_accepted(spark):
    a, b, n = 0, 0b111, 0b111111  # a and b 3 bits apart, n 3 from b and 6 from a
    known = spark.createDataFrame([("A", a), ("B", b)], "id string, fp long")
    accepted, matches = hamming.judged(spark.createDataFrame([("N", n, 1), ("M", 1 << 40 | 1 << 50 | 1 << 60 | 1 << 20, 2)], "id string, fp long, seq long"), hamming.entries_of(known))
    assert {r.id for r in accepted.collect()} == {"M"} and {tuple(r) for r in matches.collect()} == {("N", "B")}


@pytest.mark.parametrize("halved", [False, True])
def test_store_equals_brute_force_batch_by_batch(spark, tmp_path, monkeypatch, halved):
    if halved:
        monkeypatch.setattr(hamming, "CROWDED", 2)
        monkeypatch.setattr(hamming, "DEPTH", 0)
        monkeypatch.setattr(hamming, "MOST_PAIRS", 20)
    r = random.Random(11)
    base = [r.getrandbits(64) - 2**63 for _ in range(12)]
    rows = [(f"f{i:03}", (base[0] if r.random() < 0.3 else r.choice(base)) ^ sum(1 << k for k in r.sample(range(60), r.choice([0, 0, 1, 2, 3, 4, 6])))) for i in range(180)]
    kept, want = brute_greedy([(i, v % 2**64) for i, v in rows])
    got, names = set(), set()
    for at in range(0, len(rows), 60):
        store = block_store.BlockStore(spark, f"{tmp_path}/fp", bucket_rows=100)  # opened again for each batch
        batch = spark.createDataFrame([(i, v, at + k) for k, (i, v) in enumerate(rows[at : at + 60])], "id string, fp long, seq long").withColumn("mask", F.lit("clash"))
        accepted, matches = block_store.screened(store, batch)
        names |= {x.id for x in accepted.collect()}
        got |= {tuple(x) for x in matches.collect()}
    assert names == kept and got == want and store.buckets > 1
    again, matches = block_store.screened(store, batch)  # a batch that is repeated
    assert {x.id for x in again.collect()} == names & {i for i, _ in rows[120:]}
    one = hamming.keyed(spark.createDataFrame([(base[1],)], "fp long"), hamming.block_masks())
    assert 0 < store.rows_read(one) < store.accepted().count() * 20
    assert block_store.screened(block_store.BlockStore(spark, f"{tmp_path}/none"), batch.limit(0))[1].count() == 0


def test_documents_may_be_cut_for_windows(spark):
    r = random.Random(4)
    words = ["", "w", "w w w. w", "word " * 60]
    rows = [(r.choice(["hot", "hot", "a", None]), i, f"c{i:03}", r.choice(words), r.choice(["S", "S", "T", None, "Abstract", "KEYWORDS"]), r.choice(["prose", "prose", "code"])) for i in range(300)]
    frame = spark.createDataFrame(rows, "file_id string, place int, chunk_id string, content string, section_header string, content_type string").withColumn("estimated_tokens", F.size(F.filter(F.split("content", " "), lambda w: w != "")))
    order = ["place", "chunk_id"]
    same = lambda a, b: sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
    assert same(links.numbered(frame, "file_id", order), links.numbered(frame, "file_id", order, span=7))
    assert same(links.linked(frame, "file_id", order), links.linked(frame, "file_id", order, span=7))
    assert same(links.file_style_ids(frame, "file_id", order), links.file_style_ids(frame, "file_id", order, 7))
    merged = merge.merge_short(frame, "file_id", order, 40, 10)
    assert merged.count() < 300 and same(merged, merge.merge_short(frame, "file_id", order, 40, 10, 7))
    assert same(merge.join_short(frame, "file_id", order, 10), merge.join_short(frame, "file_id", order, 10, span=7))


def test_long_documents_take_time_in_proportion(spark):
    doc = lambda n: "\n".join(f"{'#' * (1 + i % 4)} Head {i}\ntext {i}" for i in range(n))
    frame = spark.createDataFrame([(1, doc(20_000))], "doc_id int, markdown string")
    rows = sections.markdown_sections(frame).drop("markdown").orderBy("section_idx").collect()  # else each row would carry the text
    assert len(rows) == 20_000 and rows[7].parent_section == "Head 6" and rows[-1].char_end == sum(len(r.section_content) for r in rows)


def test_nested_contents(spark):
    import json

    text = "1. Scope .... 1\n1.1 Aim .... 2\n1.2 Range\n2 Method .... 9"
    row = toc.nested(toc.parsed(spark.createDataFrame([(1, text), (2, None)], "doc_id int, t string"), "t")).collect()
    tree = json.loads(row[0].contents)
    assert len(row) == 1 and [(e["title"], [c["title"] for c in e["children"]]) for e in tree] == [("Scope", ["Aim", "Range"]), ("Method", [])] and tree[0]["children"][0]["page"] == 2


def test_roots_and_deep_levels(spark):
    rows = [(1, 0, "A", 1, "1", None), (1, 1, "B", 2, None, None), (2, 0, "X", 11, None, None), (2, 1, "Y", 12, None, None), (2, 2, "Z", 13, None, None)]
    flat = spark.createDataFrame(rows, "file_id int, entry_no int, title string, level int, numeric_id string, parent_id string")
    assert {(r.title, r.parent_title) for r in toc.resolved(flat).collect()} == {("A", None), ("B", None), ("X", None), ("Y", "X"), ("Z", "Y")}


def initial_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_under_all_keys_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([("a", 7, 0), ("b", 6, 1), ("c", 1 << 40, 2)], "id string, fp bigint, seq bigint").coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))  # a table whose size is known
    store = block_store.BlockStore(spark, str(tmp_path / "store"))
    store.append(rows)
    mine = hamming.keyed(rows.withColumn("id", F.lit(None).cast("string")), hamming.block_masks())
    for frame in (store.near(mine), hamming.entries_of(rows)(mine), hamming.pairs_within(mine, halvable=False)):
        assert "Broadcast" not in initial_plan(frame)


def test_annotations_in_all_parts_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([("d", 0, "1 A", "A", None), ("d", 1, "2 B", "none", None)], "doc_id string, annotation_no int, self_ref string, caption string, pos bigint").write.parquet(str(tmp_path / "marks"))
    spark.createDataFrame([("d", 3, "about a", 0, 7), ("d", 4, "b", 7, 8)], "doc_id string, chunk_index int, content string, char_start int, char_end int").write.parquet(str(tmp_path / "chunks"))
    put = annotate.placed(spark.read.parquet(str(tmp_path / "marks")).where("pos is null"), spark.read.parquet(str(tmp_path / "chunks")))
    assert {(r.annotation_no, r.chunk_index) for r in put.collect()} == {(0, 3), (1, None)}
    sides = [x for x in initial_plan(put).split("\n") if "Join" in x and "_part#" in x]
    assert sides and all("SortMergeJoin" in x for x in sides)


def test_keys_of_contents_in_all_parts_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([("d", 0, "Scope", 1, "1", None, "Scope"), ("d", 1, "Method", 1, "2", None, "Method")], "doc_id string, entry_no int, title string, level int, numeric_id string, parent_id string, full_path string").write.parquet(str(tmp_path / "toc"))
    spark.createDataFrame([("d", 0, "1. Scope"), ("d", 1, "METH"), ("d", 2, "zzz")], "doc_id string, n int, section_header string").write.parquet(str(tmp_path / "chunks"))
    keys = toc.lookup(spark.read.parquet(str(tmp_path / "toc")))
    put = toc.enriched(spark.read.parquet(str(tmp_path / "chunks")), keys, "doc_id")
    assert {(r.n, r.toc_full_path) for r in put.collect()} == {(0, "Scope"), (1, "Method"), (2, None)}
    sides = [x for x in initial_plan(put).split("\n") if "Join" in x and ("_part#" in x or "Inner" in x)]
    assert sides and all("SortMergeJoin" in x for x in sides)
