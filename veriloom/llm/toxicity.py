"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, fold, in_batches, text_batches, texts_of

#: Positive and unlabelled documents that training uses at most, about; picked by the hash of the id.
POSITIVES, UNLABELLED = 4000, 16000
#: Words that are features, a bound on the model's size: those that positives have most beyond chance.
FEATURES = 1000
#: Lengths of the beginnings of words that are features too; words whose parts a worker keeps at most.
BEGINNINGS, CACHE_WORDS = (3, 4, 5, 6, 7), 100_000
#: A word is a feature only if at least so many positive documents have it.
LEAST_DOCUMENTS = 5
STEPS, STEP, DECAY = 600, 0.05, 5e-5
#: Where the estimated risk of the negatives falls below -SLACK, the step reverses it (non-negative risk).
SLACK = 0.0

_WORD = re.compile(r"\w+")


class Parts(dict):
    """Of each word the word itself and its beginnings, which stand for its inflected and compound forms; kept for CACHE_WORDS words."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        out = (word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n])
        if len(self) < CACHE_WORDS:
            self[word] = out
        return out


def distinct_words(text: str, parts: Parts) -> set[str]:
    """The words of a text and their beginnings."""
    return set(chain.from_iterable(map(parts.__getitem__, set(_WORD.findall(text.lower())))))


class Risk:
    """The estimated risk of a linear classifier over the presence of features, from positive and unlabelled rows.

    With losses l+ = 1 - s and l- = s of the classifier's probability s, bounded so that no row outweighs the others, it
    is prior * P[l+] + max(0, U[l-] - prior * P[l-]): unlabelled rows count as negatives, corrected by the share `prior`
    of positives among them.
    """

    def __init__(self, rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float):
        self.flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.n_features, self.prior = len(rows), n_features, prior
        # A row's weight in P if it is positive, in U if it isn't.
        self.p, self.u = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())

    def at(self, params: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """prior * P[l+], the rest before it is cut at 0, and the slopes of both."""
        margin = np.bincount(self.row, params[:-1][self.flat], minlength=self.n) + params[-1]
        s = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        rest = self.u - self.prior * self.p
        return self.prior * float(self.p @ (1 - s)), float(rest @ s), self._slope(-self.prior * self.p * s * (1 - s)), self._slope(rest * s * (1 - s))

    def _slope(self, by_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.flat, by_row[self.row], minlength=self.n_features), by_row.sum())


def train(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that make the risk small: steps over all rows (Adam), since a few positives in a part of them would make its estimate negative by chance."""
    if positive.all() or not positive.any():
        return np.zeros(n_features), -30.0
    risk = Risk(rows, positive, n_features, prior)
    params = np.append(np.zeros(n_features), np.log(prior / (1 - prior)))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, STEPS + 1):
        _, negative, up, down = risk.at(params)
        slope = up + down if negative >= -SLACK else -down
        slope[:-1] += DECAY * params[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        params -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params[:-1], float(params[-1])


class Model:
    """Words with weights, and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[str], parts: Parts) -> np.ndarray:
        get, known = self.weights.get, self.weights.keys()
        # In one order, so that sums agree between processes.
        out = np.array([sum(map(get, sorted(known & distinct_words(t, parts)))) for t in texts]) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _presence(sample: DataFrame) -> DataFrame:
    """word, p, u: how many positive and unlabelled documents have a word; all have the empty one."""
    schema = pa.schema([("word", pa.string()), ("p", pa.int64()), ("u", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts()
        for batch in text_batches(batches, "text"):
            counts: dict[str, list[int]] = {}
            for t, positive in zip(texts_of(batch, "text"), batch.column(1).to_pylist(), strict=True):
                for word in ("", *distinct_words(t, parts)):
                    counts.setdefault(word, [0, 0])[0 if positive else 1] += 1
            yield emit(schema, word=list(counts), p=[x for x, _ in counts.values()], u=[x for _, x in counts.values()])

    return in_batches(sample, run, "word string, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _features(sample: DataFrame, words: list[str]) -> DataFrame:
    """positive, ids: the features that each sampled document has."""
    schema = pa.schema([("positive", pa.bool_()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts = {w: k for k, w in enumerate(words)}, Parts()
        for batch in text_batches(batches, "text"):
            ids = [sorted(place[w] for w in place.keys() & distinct_words(t, parts)) for t in texts_of(batch, "text")]
            yield emit(schema, positive=batch.column(1), ids=ids)

    return in_batches(sample, run, "positive boolean, ids array<int>")


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model:
    """A model from documents with a toxic label of 1 and from the other documents as unlabelled text.

    docs: doc_id, text; labels: doc_id, toxic. Every label counts for the class prior, the share of 1 among the
    labelled. The classifier is fitted on bounded samples, picked by the hash of the id: about `positives` documents
    labelled 1 and `unlabelled` of all documents but those. Word statistics of the samples are summed in Spark; the
    driver gets the bounded features of the bounded samples.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.agg(F.count("*").alias("all"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")).head()
    if not n["toxic"]:
        return Model({}, -30.0)
    # A prior of 0 or 1 has no odds.
    prior = min(max(n["toxic"] / n["all"], 1e-6), 1 - 1e-6)
    total = docs.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("pu")), F.lit(1 << 20))
    chosen = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    toxic = known.where("toxic = 1").select("doc_id").where(place < F.lit(int((1 << 20) * min(1.0, positives / n["toxic"])) + 1))
    # About `positives` ids, so the texts needn't be shuffled; beyond twice that the join may shuffle.
    toxic = F.broadcast(toxic) if toxic.count() <= 2 * positives else toxic
    chosen_p = chosen.join(toxic, "doc_id", "left_semi").select("text", F.lit(True).alias("positive"))
    others = chosen.where(place < F.lit(int((1 << 20) * min(1.0, unlabelled / max(total, 1))) + 1))
    chosen_u = others.select("text", F.lit(False).alias("positive"))
    sample = chosen_p.union(chosen_u)
    counts = _presence(sample)
    drawn = F.broadcast(counts.where("word = ''").select(F.col("p").alias("all_p"), F.col("u").alias("all_u")))  # one row
    seen = counts.where((F.col("p") >= LEAST_DOCUMENTS) & (F.col("word") != "")).crossJoin(drawn)
    # How far the positives that have a word exceed what the unlabelled share gives, in standard deviations.
    due = F.col("u") * F.col("all_p") / F.greatest("all_u", F.lit(1))
    tell = (F.col("p") - due) / F.sqrt(due + 1)
    words = [r["word"] for r in seen.orderBy(tell.desc(), "word").limit(features).collect()]  # at most `features`
    got = _features(sample, words).toArrow()
    rows = [np.asarray(x, np.int64) for x in got["ids"].to_pylist()]
    positive = got["positive"].to_numpy()
    # The order of the rows must not matter.
    order = sorted(range(len(rows)), key=lambda k: (positive[k], rows[k].tobytes()))
    weights, bias = train([rows[k] for k in order], positive[order].astype(bool), len(words), prior)
    return Model({w: float(x) for w, x in zip(words, weights, strict=True)}, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxicity of every whole text: doc_id, score (0 to 1), predicted (1 from a score of 0.5 on). A map over the rows; the model has a bounded size.

    Null and empty texts have the model's bias alone; a null id stays null; repeated rows each have a row; an empty
    table gives no rows; a very long text is scored whole, in a batch of its own; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast({"weights": model.weights, "bias": model.bias})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = Model(**shared.value), Parts()
        for batch in text_batches(batches, "text"):
            s = own.scores(texts_of(batch, "text"), parts)
            yield emit(schema, doc_id=batch.column(0), score=s, predicted=(s >= 0.5).astype(np.int32))

    return in_batches(src, run, "doc_id long, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    return fold(F.col(id_col), 5) == 0
