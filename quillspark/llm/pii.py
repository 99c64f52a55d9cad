"""Problem 7: personal information in free text, found and replaced.

Weak supervision. One pass over the texts gives candidate spans with the
votes of regex and context labelers (``pii_spans.py``). Labelers of the
gazetteer add votes from counts over the whole corpus: words that follow
many given names, words that come before many such surnames, words that are
also written in lower case; words that stand before numbers of one kind. How often each labeler votes and errs is
estimated by expectation-maximisation over the counts of vote patterns (a
few thousand at most, whatever the corpus), separately for each kind. The
posteriors train a logistic span classifier on votes, context and shape;
it decides, and of overlapping spans the likelier stays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .pii_spans import DIMENSIONS, KINDS, STREETS_DE, STREETS_EN, STREETS_ES, STREETS_FR, spans

VOTES = 8
#: Spans of each kind on which the final classifier is trained (a hash sample).
TRAINED_ON = 5_000
#: A word speaks for a kind of number if this share of the numbers after it are of that kind; words at most.
CONTEXT, MOST_CONTEXT = 0.5, 2_000
#: Rounds of expectation-maximisation and of the classifier's descent.
ROUNDS, STEPS = 60, 150
#: Share of the votes against, silent and for, of spans that are not and that are personal.
PRIOR = np.array([[0.45, 0.53, 0.02], [0.02, 0.53, 0.45]])
ANCHOR = 0.1
#: Vote patterns that may be read to the driver; 3 ** VOTES for each kind is the bound.
MOST_PATTERNS = len(KINDS) * 3**VOTES
#: Lexicon rows that may be sent to the executors.
MOST_WORDS = 100_000
#: A word is a surname if it follows this many given names, a given name if it precedes this many surnames.
PARTNERS = 2

_NAMES = ["doc_id", "kind", "start_pos", "end_pos", "a", "b", "votes", "features"]
_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
_CANDIDATE = "doc_id bigint, kind string, start_pos int, end_pos int, a string, b string, votes array<int>, features array<int>"


def candidates(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """All candidate spans of ``documents.text`` with the local votes; null and empty texts have none."""
    words = lexicon.select("word", "kind").where("word is not null").limit(MOST_WORDS + 1).collect()
    if len(words) > MOST_WORDS:
        raise ValueError("the lexicon is too large to send to every executor")
    given = frozenset(r.word for r in words if r.kind == "given_name")
    common = frozenset(r.word.lower() for r in words if r.kind == "common")
    streets = {r.word for r in words if r.kind == "street_word"} | {*STREETS_EN, *STREETS_FR, *STREETS_DE, *STREETS_ES}
    pattern = "|".join(sorted(map(re.escape, streets), key=len, reverse=True))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = re.compile(pattern, re.I)
        for batch in batches:
            rows = [(doc, *span) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for span in spans(text, given, common, known)]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

    filled = docs.where("doc_id is not null and length(text) > 0").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return filled.mapInArrow(find, _CANDIDATE)


def lower_case_words(docs: DataFrame) -> DataFrame:
    """``(word, n_lower)``: documents that hold a word in lower case, standing alone."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<=[\s(])\p{Ll}{3,}(?=[\s,;:!?)]|\.\s)"), F.lit(0)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n_lower"))


def add_names(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Person candidates with the two votes of the learned gazetteers."""
    persons = found.where("kind = 'person'")
    pairs = persons.groupBy("a", "b").agg(F.count("*").alias("n"), F.max(F.col("votes")[0]).alias("listed"), F.count_if(F.col("votes")[2] < 0).alias("articles"))
    lower = cut(lower_case_words(docs))
    last = pairs.where("b != ''").groupBy("b").agg(F.count_if(F.col("listed") > 0).alias("givens"), F.sum("n").alias("n"), F.sum("articles").alias("articles"))
    last = last.join(lower, F.lower("b") == F.col("word"), "left").select(
        "b", "givens", ((F.coalesce("n_lower", F.lit(0)) * 4 >= F.col("n")) | (F.col("articles") * 4 >= F.col("n"))).alias("b_common")
    )
    last = cut(last.select("b", "b_common", ((F.col("givens") >= PARTNERS) & ~F.col("b_common")).alias("surname")))
    first = pairs.where("a != ''").join(last, "b").groupBy("a").agg(
        F.max("listed").alias("listed"), F.count_if("surname").alias("surnames"), F.sum("n").alias("n"), F.count("*").alias("all")
    )
    learned = (F.col("surnames") >= PARTNERS) & (F.col("surnames") * 2 >= F.col("all"))
    first = first.join(lower, F.lower("a") == F.col("word"), "left").select(
        "a", ((F.coalesce("n_lower", F.lit(0)) * 4 >= F.col("n")) & (F.col("listed") < 1)).alias("a_common"), ((F.col("listed") > 0) | learned).alias("given")
    )
    first = cut(first)
    # titled names and initials have no given name, some no surname: the empty word is joined with nothing, lest it be one hot key
    none = lambda df, *names: df.select("*", *[F.lit(None).cast("boolean").alias(n) for n in names])
    voted = persons.where("b != ''").join(last, "b", "left").unionByName(none(persons.where("b = ''"), "b_common", "surname"))
    voted = voted.where("a != ''").join(first, "a", "left").unionByName(none(voted.where("a = ''"), "a_common", "given"))
    vote = lambda yes, no: F.when(F.col(no), F.lit(-1)).when(F.col(yes), F.lit(1)).otherwise(F.lit(0))
    votes = F.concat(F.array(vote("given", "a_common")), F.slice("votes", 2, 5), F.array(vote("surname", "b_common"), F.lit(0)))
    return voted.select("doc_id", "kind", "start_pos", "end_pos", votes.alias("votes"), "features")


def _weights(rows: DataFrame) -> dict[str, tuple[float, np.ndarray]]:
    """Per kind, prior and vote tables by EM over the counts of vote patterns."""
    patterns = rows.groupBy("kind", "votes").agg(F.count("*").alias("n")).limit(MOST_PATTERNS).toPandas()
    return {kind: estimate(np.array(mine["votes"].tolist(), int), mine["n"].to_numpy(float)) for kind, mine in patterns.groupby("kind")}


def add_context(numbers: DataFrame) -> DataFrame:
    """Candidates of numbers with context votes by words learned from the corpus as well as by those of the lists.

    The other labelers (form, lists) give each vote pattern a posterior by
    EM; a word before numbers is for a kind if ``CONTEXT`` of its numbers at
    least, at the lower bound of its 95 % interval, are of that kind.
    """
    models = _weights(numbers)
    seen = numbers.select("kind", "votes", F.explode(F.array_distinct(F.split("a", " "))).alias("word")).where("length(word) > 1").groupBy("kind", "word", "votes").agg(F.count("*").alias("n"))

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for kind, rows in frame.groupby("kind"):
                yield rows[["kind", "word", "n"]].assign(held=posterior(np.array(rows["votes"].tolist(), int), *models[kind]) * rows["n"])

    rated = seen.mapInPandas(rate, "kind string, word string, n bigint, held double").groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    p, n, z = F.col("held") / F.col("n"), F.col("n"), 1.96
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    words = rated.where(low >= CONTEXT).orderBy(F.desc("held"), "kind", "word").limit(MOST_CONTEXT).collect()
    learned = {kind: F.array(*[F.lit(r.word) for r in words if r.kind == kind]).cast("array<string>") for kind in ("phone", "id_number")}
    meets = lambda kind: F.arrays_overlap(F.split("a", " "), learned[kind])
    phone, ident = meets("phone") & ~meets("id_number"), meets("id_number") & ~meets("phone")
    vote = lambda i, on, value: F.when(on, F.lit(value)).otherwise(F.get("votes", F.lit(i)))
    for_phone = F.concat(F.slice("votes", 1, 2), F.array(vote(2, phone, 1), F.get("votes", F.lit(3)), vote(4, ident, -1)), F.slice("votes", 6, VOTES - 5))
    for_ident = F.concat(F.array(vote(0, ident, 1)), F.slice("votes", 2, 2), F.array(vote(3, phone, -1)), F.slice("votes", 5, VOTES - 4))
    return numbers.withColumn("votes", F.when(F.col("kind") == "phone", for_phone).otherwise(for_ident))


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Prior and, for each class, labeler and vote, log-probabilities: a mixture of two independent vote tables by EM.

    ``PRIOR`` keeps the classes from trading places: it stands for as many
    votes as ``ANCHOR`` of the spans, of labelers that seldom vote falsely.
    """
    onehot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    total = patterns.sum(1)
    weight = np.where(total > 0, 0.9, np.where(total < 0, 0.05, 0.3))
    anchor = ANCHOR * counts.sum() * PRIOR
    for _ in range(ROUNDS):
        tables = []
        for w, held in zip((1 - weight, weight), anchor, strict=True):
            mass = np.einsum("p,plv->lv", w * counts, onehot) + 0.1 + held
            tables.append(np.log(mass / mass.sum(1, keepdims=True)))
        prior = np.clip((weight * counts).sum() / max(counts.sum(), 1), 1e-3, 1 - 1e-3)
        score = np.einsum("plv,clv->pc", onehot, np.array(tables)) + np.log([1 - prior, prior])
        weight = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))
    return float(prior), np.array(tables)


def posterior(patterns: np.ndarray, prior: float, tables: np.ndarray) -> np.ndarray:
    onehot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    score = np.einsum("plv,clv->pc", onehot, tables) + np.log([1 - prior, prior])
    return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))


def _columns(votes: np.ndarray, features: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ones in the classifier's design: votes, then features, then the constant."""
    n = len(votes)
    rows = [np.repeat(np.arange(n), VOTES), np.repeat(np.arange(n), [len(f) for f in features]), np.arange(n)]
    cols = [(votes + 1 + 3 * np.arange(VOTES)).ravel(), 3 * VOTES + np.concatenate([np.asarray(f, np.int64) for f in features]), np.full(n, 3 * VOTES + DIMENSIONS)]
    return np.concatenate(rows), np.concatenate(cols).astype(np.int64)


def train(votes: np.ndarray, features: list[list[int]], target: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by adaptive descent."""
    size = 3 * VOTES + DIMENSIONS + 1
    weights, sums = np.zeros(size), np.full(size, 1e-8)
    if len(votes) == 0:
        return weights
    rows, cols = _columns(votes, features)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights[cols], len(votes)), -30, 30)))
        slope = np.bincount(cols, (p - target)[rows], size) / len(votes) + 1e-5 * weights
        sums += slope**2
        weights -= 0.3 * slope / np.sqrt(sums)
    return weights


def score(votes: np.ndarray, features: list[list[int]], weights: np.ndarray) -> np.ndarray:
    rows, cols = _columns(votes, features)
    return np.bincount(rows, weights[cols], len(votes))


def _sample(voted: DataFrame, sizes: dict[str, int]) -> pd.DataFrame:
    """Up to ``TRAINED_ON`` spans of each kind, those of lowest hash: a threshold from the kind's count lets about so many pass, whatever the data."""
    lot = F.pmod(F.xxhash64("doc_id", "start_pos"), F.lit(1 << 30))
    most = {kind: min(1 << 30, math.ceil((1 << 30) * 1.1 * TRAINED_ON / max(n, 1))) for kind, n in sizes.items()}
    if not most:
        return pd.DataFrame({"kind": [], "votes": [], "features": []})
    below = reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(most[k])), most, F.when(F.lit(False), 0))
    passed = voted.withColumn("lot", lot).where(F.col("lot") < below).select("kind", "votes", "features", "lot", "doc_id", "start_pos", "end_pos")
    rows = passed.limit(2 * TRAINED_ON * len(KINDS)).toPandas()
    return rows.sort_values(["lot", "doc_id", "start_pos", "end_pos"]).groupby("kind").head(TRAINED_ON)


def find_personal(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(doc_id, kind, start_pos, end_pos)`` of every span judged personal; positions count code points from 0.

    Null, empty and blank texts have no row; repeated rows of a document
    count once; rows without id are left out. Other columns are ignored.
    """
    found = cut(candidates(docs, lexicon))
    columns = ["doc_id", "kind", "start_pos", "end_pos", "votes", "features"]
    numbers = "kind in ('phone', 'id_number')"
    voted = found.where(f"kind != 'person' and not {numbers}").select(columns).unionByName(add_context(found.where(numbers)).select(columns))
    voted = cut(voted.unionByName(add_names(found, docs)).distinct())
    patterns = voted.groupBy("kind", "votes").agg(F.count("*").alias("n")).limit(MOST_PATTERNS).toPandas()
    sampled = _sample(voted, patterns.groupby("kind")["n"].sum().to_dict())
    models = {}
    for kind in KINDS:
        mine = patterns[patterns["kind"] == kind]
        if len(mine) == 0:
            continue
        prior, tables = estimate(np.array(mine["votes"].tolist(), int), mine["n"].to_numpy(float))
        sample = sampled[sampled["kind"] == kind]
        votes = np.array(sample["votes"].tolist(), int)
        models[kind] = train(votes, sample["features"].tolist(), posterior(votes, prior, tables))
    if not models:
        return voted.select("doc_id", "kind", "start_pos", "end_pos")

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for kind, rows in frame.groupby("kind"):
                s = score(np.array(rows["votes"].tolist(), int), rows["features"].tolist(), models[kind])
                out = rows[["doc_id", "kind", "start_pos", "end_pos"]].assign(score=s)
                yield out[s > 0]

    judged = voted.mapInPandas(judge, "doc_id bigint, kind string, start_pos int, end_pos int, score double")
    return _likeliest(judged)


def _likeliest(judged: DataFrame) -> DataFrame:
    """Of spans of a document that run into each other, the one with the highest score."""
    earlier = W.partitionBy("doc_id").orderBy("start_pos", "end_pos", "kind").rowsBetween(W.unboundedPreceding, -1)
    run = W.partitionBy("doc_id").orderBy("start_pos", "end_pos", "kind")
    fresh = F.when(F.coalesce(F.max("end_pos").over(earlier), F.lit(-1)) <= F.col("start_pos"), 1).otherwise(0)
    runs = judged.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(run))
    best = F.max_by(F.struct("kind", "start_pos", "end_pos"), F.struct("score", F.col("end_pos") - F.col("start_pos"), "kind"))
    return runs.groupBy("doc_id", "run").agg(best.alias("r")).select("doc_id", "r.kind", "r.start_pos", "r.end_pos")


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with every span of ``found`` replaced by ``[KIND]``; all other text unchanged, null texts null. Ids are those of ``found``."""
    per_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("_spans"))
    joined = docs.select("doc_id", "text").join(per_doc, "doc_id", "left")
    return joined.select("doc_id", _replaced(F.col("text"), F.col("_spans")).alias("text"))


def redacted(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(doc_id, text)`` without personal information, one row out for each row in.

    Rows with a null doc_id are searched too, under an id made from their text.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias("doc_id"), "text", F.col("doc_id").isNull().alias("_none"))
    found = find_personal(keyed, lexicon)
    per_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("_spans"))
    joined = keyed.join(per_doc, "doc_id", "left")
    return joined.select(F.when(~F.col("_none"), F.col("doc_id")).alias("doc_id"), _replaced(F.col("text"), F.col("_spans")).alias("text"))


def _replaced(text: Column, marks: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda acc, m: F.struct(
        m["end_pos"].alias("at"),
        F.concat(acc["parts"], F.array(text.substr(acc["at"] + 1, m["start_pos"] - acc["at"]), F.concat(F.lit("["), F.upper(m["kind"]), F.lit("]")))).alias("parts"),
    )
    finish = lambda acc: F.concat(F.array_join(acc["parts"], ""), text.substr(acc["at"] + 1, F.length(text)))
    return F.when(marks.isNull(), text).otherwise(F.aggregate(marks, start, step, finish))
