"""Problem 2: statistics of text quality for chunks and files, and the kind of text.

A mixture of Gaussians is fitted to the standardized statistics of all
chunks by expectation-maximisation: in each round every partition sends the
sums of its responsibilities, values and products (one row of fixed size),
until the log-likelihood a chunk gains less than ``GAIN``. Components are
named by inspected examples: short texts of each kind, written after looking
at the corpus and scored like any chunk; a component takes the name of the
kind whose examples it holds. The components decide the kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .line_roles import STATISTICS, statistics

#: Gaussians of the mixture, rounds at most, and the gain in log-likelihood a chunk below which rounds end.
COMPONENTS, ROUNDS, GAIN = 20, 30, 0.01
#: Added to the variances of standardized values.
RIDGE = 0.05
#: Lexicon rows that may be sent to the executors.
MOST_WORDS = 100_000
KINDS = ("prose", "list", "table", "junk", "code")

#: Inspected examples, from which components get their names.
EXAMPLES = {
    "prose": [
        "The committee met in the old library. It was not clear whether the reports had been read by all, but the debate went on until noon.\nNobody wanted to leave before the vote, and so they stayed.",
        "Dans ce cas, le texte est très court, mais il dit ce que la lettre ne dit pas. On ne sait pas pourquoi les pages sont vides.",
        "Es ist nicht so, dass die Tage im Winter länger sind. Der Weg zu den Dörfern war auch für die Kinder nicht schwer, wenn sie früh am Morgen gingen.",
        "so what we have here is a kind of filter and it takes all the values that come in and then you know it sorts them by size which is what you would want in this case",
        "“No,” she said, “this is not the key to the house.” He looked at it again, and then at the door. It had been there for years.",
        "The mean was 40.86 ± 0.38 (n = 268, p < 0.05), and the rate reached 54.0% in 6 of the 88 cases that were observed in the second year.",
    ],
    "list": [
        "- oak chairs\n- a small lamp\n- two tables\n- curtains\n- wool carpet\n- old mirror",
        "1. Introduction\n2. Methods\n3. Results\n4. Discussion\n5. Summary",
        "1.1 Overview ........ 3\n1.2 Materials .............. 7\n2.1 Field work ........... 12\n2.2 Analysis ....... 19",
        "[1] A. Meyer. On the growth of trees. 1999, pp. 1-12.\n[2] B. Laurent. Rivers and lakes. 2004, pp. 20-31.\n[3] C. Diaz. Maps of the coast. 2011, pp. 7-9.",
        "Oak\nMaple tree\nBirch\nLinden of the park\nWillow",
        "anchor: iron hook\nbuoy: floating mark\nkeel: lower beam\nmast: upright pole",
    ],
    "table": [
        "| Year | Rain | Sun |\n|---|---|---|\n| 1990 | 23.5 | 12 |\n| 1991 | 19.0 | 14 |",
        "Town;Height;People\nAvel;120;3400\nBrun;88;990\nCole;310;12000",
        "<tr><td>Town</td><td>Height</td></tr>\n<tr><td>Avel</td><td>120</td></tr>\n<tr><td>Brun</td><td>88</td></tr>",
        "Town      Height    People\nAvel      120       3400\nBrun      88        990\nCole      310       12000",
        "Town\tHeight\tPeople\nAvel\t120\t3400\nBrun\t88\t990",
    ],
    "junk": [
        "(cid:12)(cid:44)(cid:101) (cid:7)(cid:63)(cid:18) (cid:90)(cid:33)(cid:51) (cid:8)",
        "sample sample sample sample sample sample sample sample sample sample sample sample sample sample",
        "Gur pbzzvggrr zrg va gur byq yvoenel. Vg jnf abg pyrne jurgure gur ercbegf unq orra ernq ol nyy.",
        "�h� c□m¤itt□e m�t i¤ th□ o¤d l�brar□. □t w�s n¤t c□ear w¤eth□r t�e r□ports h¤d be□n re�d",
        "]{;-=_!%[}>^&*@#~|+<'/:?{;]-=!%^*(@#~_+[}<>'\"/|?:;{-]=_!%^&*#~@+",
        "aGVsbG8gd29ybGQhIHRoaXMgaXMgYSB0ZXN0IG9mIHRoZSBlbmNvZGluZyBzeXN0ZW0gd2l0aCBsb25nIGxpbmVz4hWqpFAzPJUO",
        "Wibo fatun rekalo. Sumipad vokela ginor hupat delino. Rafoki tumela bisod kanure pilofa wexat jomidu.",
    ],
    "code": [
        "def area(width, height):\n    return width * height\nfor row in rows:\n    total += row.size\nimport tools",
        "```\nSELECT town, count(*) FROM places GROUP BY town\nconst size = build(\"x\");\n```",
        "$$ x_{1} = \\frac{a + b}{\\sum_i c_i} $$\n$$ y_{2} = \\frac{a - b}{\\sum_i d_i} $$",
    ],
}


def common_words(lexicon: DataFrame) -> frozenset[str]:
    words = lexicon.where("kind = 'common' and word is not null").select("word").limit(MOST_WORDS + 1).collect()
    if len(words) > MOST_WORDS:
        raise ValueError("the lexicon is too large to send to every executor")
    return frozenset(r[0].lower() for r in words)


def chunk_statistics(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(chunk_id, file_id, *STATISTICS)`` of every row; null and blank contents give zeros."""
    common = common_words(lexicon)

    names = ["chunk_id", "file_id", *STATISTICS]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t, common) for t in batch.column(2).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, values.T.copy())], names=names)

    columns = ", ".join(f"{s} double" for s in STATISTICS)
    return chunks.select("chunk_id", "file_id", F.coalesce("content", F.lit("")).alias("content")).mapInArrow(measure, f"chunk_id string, file_id string, {columns}")


def _scaled(values: np.ndarray) -> np.ndarray:
    """Values with the long-tailed ones as logarithms."""
    out = values.copy()
    out[:, 0] = np.log1p(out[:, 0])
    out[:, 1] = np.log1p(out[:, 1])
    return out


class Mixture:
    """Weights, means and covariances of Gaussians over standardized statistics."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, means: np.ndarray) -> None:
        k, d = means.shape
        self.history: list[float] = []  # log-likelihood a chunk, by round
        self.centre, self.spread, self.means = centre, spread, means
        self.weights, self.covariances = np.full(k, 1 / k), np.repeat(np.eye(d)[None] * 0.5, k, 0)

    def standard(self, values: np.ndarray) -> np.ndarray:
        return (_scaled(values) - self.centre) / self.spread

    def densities(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of weight times density, but for a constant."""
        logs = []
        for w, m, c in zip(self.weights, self.means, self.covariances, strict=True):
            low = np.linalg.cholesky(c)
            y = np.linalg.solve(low, (x - m).T)
            logs.append(np.log(w + 1e-12) - 0.5 * (y**2).sum(0) - np.log(np.diag(low)).sum())
        return np.array(logs).T

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        logs = self.densities(x)
        r = np.exp(logs - logs.max(1, keepdims=True))
        return r / r.sum(1, keepdims=True)

    def moments(self, x: np.ndarray) -> np.ndarray:
        """Sums over rows, end to end: responsibilities, values, products, log-likelihood, rows."""
        logs = self.densities(x)
        top = logs.max(1, keepdims=True)
        r = np.exp(logs - top)
        total = r.sum(1, keepdims=True)
        r /= total
        products = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        return np.concatenate([r.sum(0), (r.T @ x).ravel(), (r.T @ products).ravel(), [float((np.log(total) + top).sum()), float(len(x))]])

    def update(self, sums: np.ndarray) -> None:
        k, d = self.means.shape
        n, first, second = sums[:k], sums[k : k + k * d].reshape(k, d), sums[k + k * d : -2].reshape(k, d, d)
        held = np.maximum(n, 1e-6)[:, None]
        live = n > d + 1
        means = first / held
        spread = second / held[:, :, None] - means[:, :, None] * means[:, None, :] + RIDGE * np.eye(d)
        self.means = np.where(live[:, None], means, self.means)
        self.covariances = np.where(live[:, None, None], spread, self.covariances)
        self.weights = np.maximum(n, 1e-6) / np.maximum(n, 1e-6).sum()


def examples(common: frozenset[str]) -> tuple[np.ndarray, list[str]]:
    rows = [(kind, statistics(t, common)) for kind, texts in EXAMPLES.items() for t in texts]
    return np.array([v for _, v in rows]), [k for k, _ in rows]


def fit(measured: DataFrame, common: frozenset[str]) -> Mixture:
    """The mixture of all measured chunks that have words or characters; started from the examples."""
    filled = measured.where("n_words > 0 or symbol_ratio > 0").select(*STATISTICS)
    logged = [F.log1p(s) if s in ("n_words", "mean_word_length") else F.col(s) for s in STATISTICS]
    seen = filled.agg(*[f(c) for c in logged for f in (F.avg, F.stddev_pop)]).first()
    centre = np.array([v or 0.0 for v in seen[0::2]])
    spread = np.array([max(v or 0.0, 1e-3) for v in seen[1::2]])
    values, kinds = examples(common)
    turns = [[i for i, k in enumerate(kinds) if k == kind] for kind in KINDS]
    order = [t[j] for j in range(max(map(len, turns))) for t in turns if j < len(t)]  # one of each kind in turn
    mixture = Mixture(centre, spread, ((_scaled(values) - centre) / spread)[order[:COMPONENTS]])
    filled = filled.repartition(max(1, filled.sparkSession.sparkContext.defaultParallelism)) if filled.rdd.getNumPartitions() == 1 else filled
    before = -np.inf
    for _ in range(ROUNDS):

        def send(frames: Iterator[pd.DataFrame], model: Mixture = mixture) -> Iterator[pd.DataFrame]:
            parts = [model.moments(model.standard(frame.to_numpy(float))) for frame in frames if len(frame)]
            if parts:
                yield pd.DataFrame({"sums": [np.sum(parts, 0)]})

        parts = filled.mapInPandas(send, "sums array<double>").select(F.posexplode("sums").alias("at", "v"))
        sums = {r.at: r.v for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect()}  # one row a sum, whatever the data
        if not sums:
            break
        total = np.array([sums[i] for i in range(len(sums))])
        mixture.update(total)
        mixture.history.append(total[-2] / total[-1])
        if mixture.history[-1] - before < GAIN:
            break
        before = mixture.history[-1]
    return mixture


def named(mixture: Mixture, common: frozenset[str]) -> np.ndarray:
    """Share of each kind of ``KINDS`` in each component, by the examples it holds.

    A component without any takes the kind that its mean gives most of the
    characters to (list, table, code), else that of the nearest example.
    """
    values, kinds = examples(common)
    x = mixture.standard(values)
    r = mixture.responsibilities(x)
    shares = np.array([r[[k == kind for k in kinds]].mean(0) for kind in KINDS]).T
    roles = {f"{k}_share": k for k in ("list", "table", "code")}
    for c in range(len(shares)):
        if shares[c].sum() < 0.05:
            mean = dict(zip(STATISTICS, mixture.means[c] * mixture.spread + mixture.centre, strict=True))
            away = ((np.linalg.solve(np.linalg.cholesky(mixture.covariances[c]), (x - mixture.means[c]).T)) ** 2).sum(0)
            most = max(roles, key=mean.__getitem__)
            shares[c] = [kind == (roles[most] if mean[most] > 0.5 else kinds[int(away.argmin())]) for kind in KINDS]
    return shares / shares.sum(1, keepdims=True)


def settled(guess: str, s: dict[str, float]) -> str | None:
    """The kind by what makes up most of the characters, without the mixture, for one text alone; None for blank.

    ``guess`` is what to take where the shares leave it open. The repair of
    scans selects prose by it; the kinds of this module do not rest on it.
    """
    if s["n_words"] == 0 and s["symbol_ratio"] == 0 and s["odd_share"] == 0 and s["table_share"] == 0 and s["list_share"] == 0 and s["code_share"] == 0:
        return None
    filler = s["distinct_share"] < 0.2 and s["distinct_share"] * max(s["n_words"], 8) <= 8
    for kind in ("list", "table", "code"):
        if s[f"{kind}_share"] > (0.4 if guess == kind else 0.5) and not (filler and kind == "list") and not (kind == "table" and s["symbol_ratio"] > 0.6 and s["common_share"] < 0.3):
            return kind
    strange = s["n_words"] >= 6 and s["common_share"] < 0.08 and s["foreign_share"] < 0.3 and s["list_share"] + s["table_share"] + s["code_share"] < 0.3
    garbled = s["odd_share"] > 0.08 or s["token_length"] > 18 and s["foreign_share"] < 0.3 or s["symbol_ratio"] > 0.5 and s["code_share"] < 0.3
    cipher = strange and (s["vowel_share"] < 0.3 or s["vowel_share"] > 0.55 or s["distinct_share"] > 0.93 or guess == "junk")
    if garbled or filler or cipher or (guess == "junk" and s["odd_share"] > 0.04):
        return "junk"
    return "prose"


def kinds_of_chunks(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(chunk_id, file_id, *STATISTICS, kind)``, repeated rows of a chunk once.

    ``kind``: prose, list, table, junk or code (formulas included), that of
    the likeliest components; null for null and blank contents.
    """
    common = common_words(lexicon)
    measured = cut(chunk_statistics(chunks, lexicon))
    mixture = fit(measured, common)
    names = named(mixture, common)
    marks = [STATISTICS.index(s) for s in ("n_words", "symbol_ratio", "odd_share", "table_share", "list_share", "code_share")]

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                values = frame[list(STATISTICS)].to_numpy(float)
                best = (mixture.responsibilities(mixture.standard(values)) @ names).argmax(1)
                blank = ~values[:, marks].any(1)
                yield frame.assign(kind=[None if empty else KINDS[i] for i, empty in zip(best, blank, strict=True)])

    columns = ", ".join(f"{s} double" for s in STATISTICS)
    return measured.mapInPandas(judge, f"chunk_id string, file_id string, {columns}, kind string").distinct()


def not_prose(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(chunk_id, kind)`` of the chunks that are lists, tables or junk."""
    return kinds_of_chunks(chunks, lexicon).where("kind in ('list', 'table', 'junk')").select("chunk_id", "kind").distinct()


def file_statistics(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Per file over its distinct chunks: counts, statistics weighted by words, and the kind of most words."""
    scored = kinds_of_chunks(chunks, lexicon)
    per_kind = scored.groupBy("file_id", "kind").agg(
        F.count("*").alias("n"), F.sum("n_words").alias("n_words"), *[F.sum(F.col(s) * F.col("n_words")).alias(s) for s in STATISTICS[1:5]]
    )  # kinds of a file, a handful of rows, so a file of a third of all chunks is no burden
    total = F.sum("n_words")
    return per_kind.groupBy("file_id").agg(
        F.sum("n").alias("n_chunks"), total.alias("n_words"), *[(F.sum(s) / F.when(total > 0, total)).alias(s) for s in STATISTICS[1:5]],
        F.max_by("kind", F.struct("n_words", "n", "kind")).alias("kind"),
    )
