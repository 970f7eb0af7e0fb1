"""Language ID by prediction by partial matching: per-language byte context trees under frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import emit, fold, in_batches, joined, range_sums, text_batches, texts_of

#: Bytes of context at most.
ORDER = 3
#: A language learns from about so many documents at most, picked by the hash of their id.
DOCS_PER_LANG = 1500
#: Positions that are scored at once, and bytes of code lengths that a worker keeps at most.
POSITIONS, CACHE_BYTES = 1 << 20, 32 << 20
#: Documents that score lower are rejected by keep_known.
LEAST_SCORE = 0.5

UNKNOWN = "und"
_PAD = b"\n" * ORDER


@dataclass
class Trees:
    """Each language's tree, whole: all contexts of 0 to ORDER bytes that its sample has, as sorted arrays by length.

    node[k]: the contexts of k bytes with a byte after them, as language << 32 | bytes; prob[k]: that byte's probability.
    context[k]: the contexts themselves; escape[k]: what the next shorter context's probability of another byte is multiplied by.
    """

    langs: list[str]
    node: list[np.ndarray]
    prob: list[np.ndarray]
    context: list[np.ndarray]
    escape: list[np.ndarray]

    def __post_init__(self):
        self._grams, self._bits = np.zeros(0, np.uint32), np.zeros((len(self.langs), 0), np.float32)

    def shared(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def gram_bits(self, grams: np.ndarray) -> np.ndarray:
        """[language, gram] code length of the last byte of each gram (ORDER + 1 bytes) after the others."""
        out = np.empty((len(self.langs), len(grams)), np.float32)
        for j in range(len(self.langs)):
            key = grams.astype(np.int64)
            p = np.full(len(grams), 1 / 256)
            for k in range(ORDER + 1):
                p = p * _found(self.context[k], self.escape[k], _tail(key >> 8, k) | j << 32, 1.0)
                own = _found(self.node[k], self.prob[k], _tail(key, k + 1) | j << 32, 0.0)
                p = np.where(own > 0, own, p)
            out[j] = -np.log2(np.maximum(p, 1e-30))
        return out

    def _known_bits(self, grams: np.ndarray) -> np.ndarray:
        """gram_bits of distinct sorted grams, kept for the next batch."""
        new = np.setdiff1d(grams, self._grams, assume_unique=True)
        if len(new):
            if (len(self._grams) + len(new)) * 4 * (1 + len(self.langs)) > CACHE_BYTES:
                self._grams, self._bits, new = grams, self.gram_bits(grams), new[:0]
            all_grams = np.concatenate([self._grams, new])
            order = np.argsort(all_grams)
            self._bits = np.concatenate([self._bits, self.gram_bits(new)], axis=1)[:, order]
            self._grams = all_grams[order]
        return self._bits[:, np.searchsorted(self._grams, grams)]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        data, starts, ends = joined(texts, _PAD)
        out = np.zeros((len(texts), len(self.langs)))
        starts, ends = starts - ORDER, ends - ORDER
        for a in range(0, len(data) - ORDER, POSITIONS):
            b = min(a + POSITIONS, len(data) - ORDER)
            gram = np.zeros(b - a, np.uint32)
            for k in range(ORDER + 1):
                gram = gram << np.uint32(8) | data[a + k : b + k]
            distinct, at = np.unique(gram, return_inverse=True)
            bits = self._known_bits(distinct)
            first, last = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b))
            low, high = np.clip(starts[first:last] - a, 0, b - a), np.clip(ends[first:last] - a, 0, b - a)
            for j in range(len(self.langs)):
                out[first:last, j] += range_sums(bits[j][at], low, high)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior probability of it under equal priors, and bits a byte."""
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        blobs = [t.encode() for t in texts]
        bits = self.code_lengths(blobs)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        none = np.array([not any(map(str.isalpha, t)) for t in texts])
        return [UNKNOWN if x else self.langs[k] for k, x in zip(best, none, strict=True)], np.where(none, 0.0, score), least / np.maximum([len(b) for b in blobs], 1)


def _grams(data: DataFrame) -> DataFrame:
    """lang, gram (ORDER+1 bytes as an integer), n: counts over all texts, summed in Spark."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            langs = np.array(batch.column(0).to_pylist())
            texts = texts_of(batch, "text")
            for lang in np.unique(langs):
                blobs = [t.encode() for t, x in zip(texts, langs, strict=True) if x == lang]
                raw, starts, ends = joined(blobs, _PAD)
                raw = raw.astype(np.int64)
                gram = np.zeros(len(raw) - ORDER, np.int64)
                for k in range(ORDER + 1):
                    gram = gram << 8 | raw[k : len(raw) - ORDER + k]
                # Pads aren't text: keep the grams whose last byte lies in one.
                inside = np.zeros(len(raw) + 1, np.int64)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                got, n = np.unique(gram[np.cumsum(inside)[ORDER:-1] > 0], return_counts=True)
                yield emit(schema, lang=[lang] * len(got), gram=got, n=n)

    return in_batches(data, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tail(code: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes."""
    return code & ((1 << 8 * n) - 1)


def _found(keys: np.ndarray, values: np.ndarray, want: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(want), otherwise)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], otherwise)


def build_trees(langs: np.ndarray, grams: np.ndarray, n: np.ndarray) -> Trees:
    """Trees from gram counts. A context's symbols share n / (n + distinct) of its probability, the rest escapes to the next shorter context, renormalised over the symbols not seen here; the shortest escapes to all 256 bytes alike."""
    names = sorted(set(langs.tolist()))
    lang = np.searchsorted(names, langs).astype(np.int64) << 32 if names else np.zeros(0, np.int64)
    trees = Trees(names, [], [], [], [])
    below = None
    for k in range(ORDER + 1):
        node, at = np.unique(lang | _tail(grams, k + 1), return_inverse=True)
        count = np.bincount(at, n, minlength=len(node))
        head = node >> 32 << 32
        context, of = np.unique(head | _tail(node, k + 1) >> 8, return_inverse=True)
        size, kinds = np.bincount(of, count, minlength=len(context)), np.bincount(of, minlength=len(context))
        # What the shorter context gives the symbols seen here: all of them were seen there.
        low = np.full(len(node), 1 / 256) if below is None else _found(*below, head | _tail(node, k), 0.0)
        rest = 1 - np.bincount(of, low, minlength=len(context))
        escape = np.where(rest > 1e-12, kinds / np.maximum(rest, 1e-12), 0) / np.maximum(size + kinds, 1e-30)
        prob = count / np.maximum(size + kinds, 1e-30)[of]
        below = node, prob
        for to, x in ((trees.node, node), (trees.prob, prob), (trees.context, context), (trees.escape, escape)):
            to.append(x)
    return trees


def learn(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Trees:
    """Trees from the rows of docs that have a text and a language.

    A bounded sample: about docs_per_lang documents of each language, picked by the hash of the id, whole texts.
    The gram counts are summed in Spark; the driver gets one row for each distinct gram of the sample.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return build_trees(np.zeros(0, str), np.zeros(0, np.int64), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_per_lang / n))])
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(1 << 20) * share[F.col("lang")])
    got = _grams(picked.select("lang", "text")).toArrow()
    order = np.lexsort((got["gram"].to_numpy(), np.array(got["lang"].to_pylist())))
    return build_trees(np.array(got["lang"].to_pylist())[order], got["gram"].to_numpy()[order], got["n"].to_numpy()[order].astype(np.float64))


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: the id, lang_pred, score (posterior probability, 0 to 1) and bits_per_byte.

    The trees hold every context of the bounded samples and no empty cells, and go to all tasks; a map over the rows, no shuffle.
    ``und`` with score 0 if a text is null or has no letter or nothing was learned; ties go to the smaller
    language; a null id stays null; repeated rows each have a row; an empty table gives no rows; a very long text is
    scored whole, a stretch at a time; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(trees.shared())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(**shared.value)
        for batch in text_batches(batches, "text"):
            lang, score, bits = model.predict(texts_of(batch, "text"))
            yield emit(schema, doc_id=batch.column(0), lang_pred=lang, score=score, bits_per_byte=bits)

    return in_batches(src, run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def keep_known(docs: DataFrame, trees: Trees, least_score: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text has no known language or whose score is under least_score; columns as they are, whatever their names.

    Null and empty texts and texts without a letter go, null ids stay; repeated rows stay or go together; an empty table
    gives no rows, and without a learned language none stays; a very long text is scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees.shared())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(**shared.value)
        for batch in text_batches(batches, text_col):
            lang, score, _ = model.predict(texts_of(batch, text_col))
            yield batch.filter(pa.array([x != UNKNOWN and s >= least_score for x, s in zip(lang, score.tolist(), strict=True)], pa.bool_()))

    return in_batches(docs, run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return fold(F.col(id_col), 3) == 1


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows that the query may learn from."""
    return docs.where(~F.coalesce(held_out(), F.lit(False)))
