"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon (words and word beginnings that stand in toxic texts and hardly in others), the trees and the calibration
are learned from a bounded sample of labelled documents: at most TRAIN_ROWS, those with the smallest hashes of their
ids, never those whose crc32(doc_id as text) mod 5 is 0. The calibration is cross-fitted: every learned document is scored by a
lexicon and trees that have not seen its quarter of the sample; the lexicon and trees that score are learned from all of it.
Scoring is one scan without a shuffle over every whole text.

Defined cases: a null text counts as empty; empty texts get the score of a text without words; any length is read whole;
repeated rows give repeated results; repeated labels of one document count as one, the largest; labels that are null or
neither 0 nor 1 are left out; of labelled rows that repeat a doc_id the smallest text is learned; without labels of both kinds every score is the share of toxic ones (0 without labels);
an empty table gives no rows; columns other than doc_id and text are carried through or ignored, never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.llm.common import LOWER, doc_texts, saved, span_hashes, spans, table, text_runs

TRAIN_ROWS, LEXICON_SIZE, NEAR_WORDS, FOLDS = 20_000, 512, 5, 4
PREFIXES = (4, 5, 6)
#: Words that address the reader, in four languages.
SECOND_PERSON = (
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos vôtre du dich dir dein deine deinen deinem euch euer eure "
    "tú ti tus usted ustedes vosotros vuestro vuestra"
).split()
#: Characters that stand for letters in disguised words.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FEATURES = ["hits_share", "log_hits", "log_disguised_hits", "hits_near_you_share", "you_share", "capitals_share", "all_capitals_share", "shout_share", "punctuation_share", "disguised_share", "stretched_share", "log_words"]

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x24, 0x40, *range(0x80, 0x100)]] = True
_PLAIN = LOWER.copy()
for _a, _b in DISGUISES.items():
    _PLAIN[ord(_a)] = ord(_b)
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = 1
_SIGN = np.zeros(256, np.int64)
_SIGN[[ord(c) for c in DISGUISES]] = 1
_SHOUT = np.zeros(256, np.int64)
_SHOUT[[0x21, 0x3F]] = 1
_POINT = np.zeros(256, np.int64)
_POINT[[*range(0x21, 0x30), *range(0x3A, 0x40), *range(0x5B, 0x60), *range(0x7B, 0x7F)]] = 1


def _word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


_YOU = np.sort(np.array([_word_hash(w) for w in SECOND_PERSON], np.uint64))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    full: np.ndarray  # hashes of the lower-cased words
    plain: np.ndarray  # and with disguises undone
    low: np.ndarray  # lower-cased bytes
    undone: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        starts, ends = spans(_WORD[data], offsets)
        low, undone = LOWER[data], _PLAIN[data]
        return cls(starts, ends, np.searchsorted(offsets, starts, side="right") - 1, span_hashes(low, starts, ends), span_hashes(undone, starts, ends), low, undone)

    def beginnings(self, plain: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which words, hashes of their first bytes, told apart from whole words)."""
        for n in PREFIXES:
            which = np.flatnonzero(self.ends - self.starts > n)
            yield which, span_hashes(self.undone if plain else self.low, self.starts[which], self.starts[which] + n) ^ np.uint64(n)


def feature_rows(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    w = Words.of(data, offsets)
    hit, disguised = _among(w.full, lexicon), _among(w.plain, lexicon)
    for which, hashes in w.beginnings(False):
        hit[which] |= _among(hashes, lexicon)
    for which, hashes in w.beginnings(True):
        disguised[which] |= _among(hashes, lexicon)
    disguised &= ~hit
    any_hit = np.flatnonzero(hit | disguised)
    you = np.flatnonzero(_among(w.full, _YOU))
    near = np.zeros(len(any_hit), bool)
    if len(you):
        at = np.searchsorted(you, any_hit)
        for k in (np.minimum(at, len(you) - 1), np.maximum(at - 1, 0)):
            near |= (np.abs(you[k] - any_hit) <= NEAR_WORDS) & (w.doc[you[k]] == w.doc[any_hit])

    def per_doc(which: np.ndarray) -> np.ndarray:
        return np.bincount(which, minlength=n)[:n].astype(float)

    def summed(marks: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(marks)])

    def of_bytes(marks: np.ndarray) -> np.ndarray:
        return np.diff(summed(marks)[offsets]).astype(float)

    def of_words(marks: np.ndarray) -> np.ndarray:
        total = summed(marks)
        return total[w.ends] - total[w.starts]

    capitals, letters, signs, length = of_words(_CAPITAL[data]), of_words(_LETTER[data]), of_words(_SIGN[data]), w.ends - w.starts
    same = np.zeros(len(data), np.int64)
    if len(data) > 2:
        same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    stretched = of_words(same) > 0
    words, size = per_doc(w.doc), np.maximum(np.diff(offsets), 1).astype(float)
    many = np.maximum(words, 1)
    hits, hidden = per_doc(w.doc[hit]), per_doc(w.doc[disguised])
    return np.stack(
        [
            (hits + hidden) / many, np.log1p(hits + hidden), np.log1p(hidden), per_doc(w.doc[any_hit[near]]) / np.maximum(hits + hidden, 1),
            per_doc(w.doc[you]) / many, of_bytes(_CAPITAL[data]) / np.maximum(of_bytes(_LETTER[data]), 1),
            per_doc(w.doc[(capitals == length) & (length > 1)]) / many, of_bytes(_SHOUT[data]) / size, of_bytes(_POINT[data]) / size,
            per_doc(w.doc[(letters > 0) & (signs > 0)]) / many, per_doc(w.doc[stretched & (letters > 0)]) / many, np.log1p(words),
        ],
        axis=1,
    )


@dataclass
class Boosted:
    """Depth-wise trees of fixed depth over binned features, fitted to the logistic loss."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    start: float = 0.0
    borders: list = field(default_factory=list)
    trees: list = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x[:, j], side="left") for j, b in enumerate(self.borders)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.borders = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins)[:-1])) for c in x.T]
        binned, width = self._binned(x), self.bins + 1
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            gradient, weight = y - p, p * (1 - p)
            leaf = np.zeros(len(y), np.int64)
            splits = []
            for level in range(self.depth):
                n, best = 1 << level, None
                best = np.full(n, 1e-9)
                chosen = np.zeros((n, 2), np.int64)
                chosen[:, 1] = width
                for j in range(x.shape[1]):
                    at = leaf * width + binned[:, j]
                    g = np.cumsum(np.bincount(at, gradient, n * width).reshape(n, width), axis=1)
                    h = np.cumsum(np.bincount(at, weight, n * width).reshape(n, width), axis=1)
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                    k = np.argmax(gain, axis=1)
                    top = gain[np.arange(n), k]
                    better = top > best
                    best = np.where(better, top, best)
                    chosen[better] = np.stack([np.full(n, j), k], 1)[better]
                splits.append(chosen)
                leaf = leaf * 2 + (binned[np.arange(len(y)), chosen[leaf, 0]] > chosen[leaf, 1])
            n = 1 << self.depth
            value = self.rate * np.bincount(leaf, gradient, n) / (np.bincount(leaf, weight, n) + 1)
            raw += value[leaf]
            self.trees.append((splits, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out, rows = self._binned(x), np.full(len(x), self.start), np.arange(len(x))
        for splits, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for chosen in splits:
                leaf = leaf * 2 + (binned[rows, chosen[leaf, 0]] > chosen[leaf, 1])
            out += value[leaf]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit: pool adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, at = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][2] += at
    return np.array([at / n for _, n, at in blocks]), np.array([s / n for s, n, _ in blocks])


@dataclass
class Model:
    lexicon: np.ndarray
    prior: float
    trees: Boosted | None = None
    knots: tuple | None = None

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(rows), self.prior)
        raw = self.trees.raw(rows)
        # a thousandth keeps the trees' order where the calibration is level
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, toxic, text, fold (by a hash of the id) of at most ``most`` labelled documents that are not held out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    # bounded by ``most``, so it can be broadcast
    chosen = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return doc_texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int"))


def word_counts(train: DataFrame) -> DataFrame:
    """key, pos, neg (lists by fold): how many toxic and other texts of each fold have a word or beginning."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            marks, folds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("toxic", "fold"))
            for first, _, data, offsets in text_runs(batch.column("text")):
                w = Words.of(data, offsets)
                h, d = [w.full], [w.doc]
                for which, hashes in w.beginnings(False):
                    h.append(hashes)
                    d.append(w.doc[which])
                pairs = np.unique(np.stack([np.concatenate(d).astype(np.uint64), np.concatenate(h)], 1), axis=0)
                doc = first + pairs[:, 0].astype(np.int64)
                found.append((pairs[:, 1], folds[doc] * 2 + marks[doc]))
        if found:
            keys, kinds = (np.concatenate(x) for x in zip(*found))
            unique, code = np.unique(keys, return_inverse=True)
            table = np.bincount(code * 2 * FOLDS + kinds, minlength=len(unique) * 2 * FOLDS).reshape(-1, 2 * FOLDS)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), *(pa.array(table[:, i]) for i in range(2 * FOLDS))], names)

    names = ["key", *(f"{k}{f}" for f in range(FOLDS) for k in ("neg", "pos"))]
    found = train.select("toxic", "fold", "text").mapInArrow(count, ", ".join(f"{c} long" for c in names)).groupBy("key").agg(*(F.sum(c).alias(c) for c in names[1:]))
    return found.select("key", *(F.array(*(F.col(f"{k}{f}") for f in range(FOLDS))).alias(k) for k in ("pos", "neg")))


def lexicon_of(counts: DataFrame, without: int | None = None, size: int = LEXICON_SIZE, least: int = 5, precision: float = 0.9) -> np.ndarray:
    """Hashes of the words and beginnings that most toxic texts have and few others; texts of the fold ``without`` are left out."""
    folds = [f for f in range(FOLDS) if f != without]
    pos, neg = (sum((F.col(k)[f] for f in folds[1:]), F.col(k)[folds[0]]) for k in ("pos", "neg"))
    top = counts.select("key", pos.alias("pos"), neg.alias("neg")).where((F.col("pos") >= least) & (F.col("pos") >= precision * (F.col("pos") + F.col("neg")))).orderBy(F.desc(F.col("pos") - 9 * F.col("neg")), "key").limit(size)
    return np.sort(np.array([r.key for r in top.collect()], np.int64).view(np.uint64))


def with_features(docs: DataFrame, lexicon: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` and FEATURES of every row."""
    schema = ", ".join([f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} double" for c in FEATURES])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [feature_rows(data, offsets, lexicon) for _, _, data, offsets in text_runs(batch.column("text"))]
            x = np.concatenate(rows) if rows else np.empty((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x[:, j]) for j in range(x.shape[1]))], keep + FEATURES)

    return docs.select(*keep, "text").mapInArrow(scan, schema)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    train = saved(training_rows(docs, labels, most), "toxicity")
    counts = saved(word_counts(train), "toxicity-words")

    def learned(lexicon: np.ndarray) -> pd.DataFrame:
        return with_features(train, lexicon, ["doc_id", "toxic", "fold"]).orderBy("doc_id").toPandas()  # at most ``most`` rows

    lexicon = lexicon_of(counts)
    rows = learned(lexicon)
    y, fold = rows["toxic"].to_numpy(float), rows["fold"].to_numpy()
    prior = float(y.mean()) if len(y) else 0.0
    if not 0 < prior < 1:
        return Model(lexicon, prior)
    trees, raw, seen = Boosted().fit(rows[FEATURES].to_numpy(), y), np.zeros(len(y)), np.zeros(len(y), bool)
    for f in range(FOLDS):
        rest, own = fold != f, fold == f
        if own.any() and 0 < y[rest].mean() < 1:
            x = learned(lexicon_of(counts, f))[FEATURES].to_numpy()
            raw[own], seen[own] = Boosted().fit(x[rest], y[rest]).raw(x[own]), True
    if not seen.any():  # one toxic or one other text only
        raw, seen = trees.raw(rows[FEATURES].to_numpy()), np.ones(len(y), bool)
    return Model(lexicon, prior, trees, isotonic(raw[seen], y[seen]))


def with_scores(docs: DataFrame, model: Model, name: str = "toxicity_score") -> DataFrame:
    """``docs`` with all its columns and one more; one scan, no shuffle."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            rows = [judge.scores(feature_rows(data, offsets, judge.lexicon)) for _, _, data, offsets in text_runs(batch.column(text))]
            score = pa.array(np.concatenate(rows) if rows else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])

    return docs.mapInArrow(scan, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_scores(doc_texts(docs), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))
