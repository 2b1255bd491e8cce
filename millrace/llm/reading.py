"""Problem 10: reading level from the acquisition grades of a document's known words."""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)")
BREAK = re.compile(r"[\n\r\v\f\x1c-\x1e\x85  ]")
MARK = re.compile(r"^(?:[-*+>•]|\d+[.)])\s+")
PURE = re.compile(r"^[\"'(\[“‘*_]*[^\W\d_]+(?:['’\-][^\W\d_]+)*[\"')\]”’*_]*[,.;:!?…]*[\"')”’]*$")
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
QUANTILES = np.array([0.1, 0.25, 0.5, 0.65, 0.75, 0.8, 0.85, 0.9, 0.95, 0.98])
# Common function words of English and of other languages in Latin letters.
FUNCTION_WORDS = {
    "en": "the of and a to that is it this for each one when but as by so with or be its an while if which from at are was".split(),
    "de": "der die das und ist nicht ein eine den dem des zu mit auf sich von wird dass wenn aber im weil bevor".split(),
    "fr": "le la les et est une des du que qui dans pour pas ne sur ce cette au avec se mais où car".split(),
    "es": "el la los las y es una de que se por con para del este esta al cuando pero lo su sin".split(),
    "it": "il lo la gli le e di che un una per non con del della è sono si nel alla anche come più dal".split(),
    "pt": "o os as e de que um uma para não com do da no na em é são por mais dos das ao como".split(),
    "nl": "de het een en van ik te dat die in op zijn niet aan met voor er maar om hij ze ook naar werd door".split(),
    "sv": "och att det som en på är av för med den till inte om ett men har jag de sig från så".split(),
    "da": "og at det en den til er som på de med han af for ikke der var et har om jeg men".split(),
    "fi": "ja on ei se että oli hän mutta ovat kun niin myös joka mukaan sekä tai olla ole".split(),
    "pl": "i w nie na się że do z jest to jak za od po ale przez dla są być który oraz".split(),
    "cs": "a se v na je že s z do o i to jako za by ale pro po jsou které jeho".split(),
    "hu": "a az és hogy nem is egy ez volt meg de csak ha mint vagy már még minden".split(),
    "ro": "și de la în a cu nu o că pe un din este care pentru mai se sau au fost".split(),
    "tr": "ve bir bu da de için ile çok olarak daha gibi olan ama kadar sonra her en mi".split(),
    "id": "yang dan di itu dengan untuk tidak ini dari dalam akan pada juga saya ke karena ada adalah".split(),
}
_ENGLISH = frozenset(FUNCTION_WORDS["en"])
_OTHERS = {k: frozenset(v) - _ENGLISH for k, v in FUNCTION_WORDS.items() if k != "en"}


def running_words(text: str | None) -> list[str]:
    """The words, in lower case, of a text's running prose; none where prose isn't most of what stands outside code blocks.

    Fenced blocks, headings, comments and lines that are not mostly plain words (code, logs, tables, records) don't count.
    """
    if not text:
        return []
    kept, of_prose, whole = [], 0, 0
    for line in BREAK.split(FENCE.sub("\n", text)):
        line = line.strip()
        if not line or line.startswith(("# ", "## ", "### ", "#### ")):
            continue
        whole += len(line)
        if line.startswith(("#", "//", "/*", '"""', "'''")):
            continue
        line = MARK.sub("", line)
        tokens = line.split()
        if len(tokens) >= 3 and sum(map(bool, map(PURE.match, tokens))) >= 0.75 * len(tokens) and (len(tokens) >= 8 or re.search(r"[.!?…]", line)):
            kept.append(line)
            of_prose += len(line)
    return WORD.findall(" ".join(kept).lower()) if of_prose >= 0.5 * whole and kept else []


def english(words: list[str], known: float) -> bool:
    """Whether words are English: no other language's function words are more frequent; terse texts by their share of known words."""
    if not words:
        return False
    counts = Counter(words)
    own = sum(n for w, n in counts.items() if w in _ENGLISH) / len(words)
    other = max(sum(counts[w] for w in v) for v in _OTHERS.values()) / len(words)
    return own > other and own >= 0.04 or other < 0.03 and known >= 0.5


@dataclass
class Model:
    """Grades of words, and for each of the levels 2 to 5 the weights by which quantiles of grades tell whether it is reached."""

    grades: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((4, len(QUANTILES) + 2)))
    middle: float = 3.0

    def features(self, words: list[str]) -> np.ndarray:
        grades = [g for w in words if (g := self.grades.get(w)) is not None] or [self.middle]
        return np.concatenate([np.quantile(grades, QUANTILES) - 3, [np.mean(grades) - 3, 1.0]])

    def reached(self, words: list[str]) -> np.ndarray:
        """The probabilities that levels 2 to 5 are reached."""
        return 1 / (1 + np.exp(-np.clip(self.weights @ self.features(words), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps; the last column, the constant, goes free."""
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: list[tuple[list[str], float]], ridge: float = 0.1) -> Model | None:
    """The model of (words, level) pairs, in any order; null without any.

    A word's acquisition grade is the mean level under its distribution of relative frequency over the levels, each level weighing the
    same. Quantiles of a document's known-word grades are calibrated, for each of the levels 2 to 5, to the probability that the document
    reaches it.
    """
    labelled = sorted(((w, y) for w, y in labelled if w and y == y), key=lambda p: (p[1], p[0]))
    if not labelled:
        return None
    model = Model(middle=float(np.mean([y for _, y in labelled])))
    by_level: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(5))
    total = np.zeros(5)
    for words, y in labelled:
        k = int(np.clip(np.floor(y + 0.5), 1, 5)) - 1
        total[k] += 1
        for w, n in Counter(words).items():
            by_level[w][k] += n / len(words)
    for w, c in by_level.items():
        rate = c / np.maximum(total, 1)
        rate = rate + 0.02 * rate.mean()
        model.grades[w] = float((rate * np.arange(1, 6)).sum() / rate.sum())
    x = np.array([model.features(w) for w, _ in labelled])
    y = np.array([v for _, v in labelled], float)
    model.weights = np.array([logistic(x, np.clip(y - k + 1, 0, 1), ridge) for k in range(2, 6)])
    return model


def train(documents: DataFrame, labels: DataFrame, most: int = 20_000) -> Model | None:
    """The model of the labelled documents; at most ``most`` of them, taken by a hash of doc_id, bound the fit.

    Several ratings of a document count as their mean. Ratings that are null or of no document, and documents without running text, count for nothing.
    """
    mean = labels.filter("level IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg(F.greatest(F.lit(1), F.least(F.lit(5), F.col("level")))).alias("level"))
    some = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``most`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(running_words(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column(1)], names=["words", "level"])

    got = rows.select("text", "level").mapInArrow(run, "words STRING, level DOUBLE").toArrow()
    return fit([(w.split(), y) for w, y in zip(got["words"].to_pylist(), got["level"].to_pylist())])


def levels(documents: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """(doc_id, level, score, n_words) of every document whose running text is English prose, by its text alone.

    Null, empty and blank texts, code, logs and other languages have no row; without any label, level and score are null.
    Repeated rows stay. The model's vocabulary is bounded by the ``most`` documents it is fitted on, and broadcast.
    """
    model = train(documents, labels, most)
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    held: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(pickle.loads(shared.value))
        model = held[0]
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = running_words(text)
                known = sum(w in model.grades for w in words) / len(words) if words and model else 0.0
                if english(words, known):
                    p = model.reached(words) if model else None
                    out.append((doc, None if p is None else 1 + int((p >= 0.5).sum()), None if p is None else 1 + float(p.sum()), len(words)))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.int64()))], names=["doc_id", "level", "score", "n_words"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id BIGINT, level INT, score DOUBLE, n_words BIGINT")


def demanding(documents: DataFrame, labels: DataFrame, least: int = 4, words: int = 40) -> DataFrame:
    """(doc_id) of the English prose of at least ``words`` words at level ``least`` or above."""
    return levels(documents, labels).filter((F.col("level") >= least) & (F.col("n_words") >= words)).select("doc_id")


def profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents and words at each level."""
    return levels(documents, labels).groupBy("level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))
