"""Language-model scores by masked pseudo-likelihood.

A small network predicts every token from the two tokens on each side of it, never from the token itself; a
document's score is the sum of its tokens' conditional log-probabilities. The vocabulary is the corpus's own, every word of
it: the network knows the FREQUENT most frequent words over all documents and HASHED classes of the others; a word of a
class has the probability of its class times its share of the class's occurrences, count(word) / count(class). The counts
of all words stay a table. Those of the most frequent words, HELD at most, go to every task; what documents hold of the
others is joined with the table by the word's hash. The network (position-wise embeddings, tanh, a
two-level softmax over groups of GROUP tokens) is trained here, over all tokens of all documents: documents are dealt over
parts of about TOKENS_A_PART tokens by a hash of their id and text, and put in that hash's order. In each round every part
starts from the common parameters, makes steps over its own documents, and the parameters are averaged in proportion to
tokens. Averages are taken block by block in two levels, in a fixed order, so that only the finished network, of a fixed
size, reaches the driver. The result does not depend on how the table is partitioned.

Defined cases: a null or wordless text has no tokens, log-likelihood 0 and a null mean; any length is read whole;
repeated rows count and train as often as they occur and give repeated results; equally frequent words are taken in the
order of their hashes; words are told apart by 64-bit hashes; a word that the training documents lack counts as one
occurrence, and a class that they lack too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import LOWER, doc_texts, mix, saved, span_hashes, spans, table, text_runs

FREQUENT, HASHED, GROUP, SIZE, SIDE, ROUNDS = 3072, 1024, 64, 24, 2, 1
BATCH, RATE, BLOCKS, TOKENS_A_PART = 4096, 0.08, 16, 2_000_000
#: Words whose counts are sent to every task; the counts of the others are joined.
HELD = 65_536
#: Bound of logits either way.
LIMIT = 40.0
VOCABULARY = FREQUENT + HASHED
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets by text)."""
    starts, ends = spans(_WORD[data], offsets)
    return span_hashes(LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def class_of(words: np.ndarray) -> np.ndarray:
    return (mix(words) % np.uint64(HASHED)).astype(np.int64)


class Vocabulary:
    """``frequent``, hashes of the most frequent words, most frequent first; ``held`` and ``held_n``, hashes in their order and
    counts of words whose counts every task gets; ``rest``, the table (key, n) of the other words that occur more than once;
    ``class_n``, occurrences by class; ``tokens``, of all words."""

    def __init__(self, counts: DataFrame):
        size = F.floor(F.log2("n") * 8)
        self.tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        self.frequent = self._hashes([r.key for r in counts.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()])
        least, words = 0, 0  # sizes from least on make up HELD words at most
        for r in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
            words += r["count"]
            if words > HELD:
                least = r["size"] + 1
                break
        held = counts.where(size >= least).collect()
        keys, n = self._hashes([r.key for r in held]), np.array([r.n for r in held], np.int64)
        order = np.argsort(keys)
        self.held, self.held_n = keys[order], n[order]
        self.rest = counts.where((size < least) & (F.col("n") > 1))

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(HASHED, np.int64)
            for batch in batches:
                np.add.at(total, class_of(batch.column("key").to_numpy().view(np.uint64)), batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(range(HASHED), pa.int32()), pa.array(total)], ["class", "n"])

        rare = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(int(k),) for k in self.frequent.view(np.int64)], "key long")), "key", "left_anti")
        self.class_n = np.zeros(HASHED, np.int64)
        for r in rare.mapInArrow(totals, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
            self.class_n[r["class"]] = r.n

    @staticmethod
    def _hashes(keys: list[int]) -> np.ndarray:
        return np.array(keys, np.int64).view(np.uint64)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts all words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added():
            keys, n = (np.concatenate(x) for x in zip(*held))
            unique, code = np.unique(keys, return_inverse=True)
            return unique, np.bincount(code, n, len(unique)).astype(np.int64)

        for batch in batches:
            for _, _, data, offsets in text_runs(batch.column("text")):
                u, n = np.unique(word_hashes(data, offsets)[0], return_counts=True)
                held.append((u, n))
                size += len(u)
                if size > 1_000_000:
                    u, n = added()
                    held, size = [(u, n)], len(u)
                    if size > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["key", "n"])
                        held, size = [], 0
        if held:
            u, n = added()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["key", "n"])

    counts = doc_texts(docs).select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return Vocabulary(saved(counts, "words"))


class Network:
    """Parameters in one flat vector."""

    SHAPES = {
        "e": (2 * SIDE, VOCABULARY + 1, SIZE),  # the last row stands for places beyond the text
        "b": (SIZE,),
        "w1": (SIZE, VOCABULARY // GROUP),
        "b1": (VOCABULARY // GROUP,),
        "w2": (VOCABULARY // GROUP, SIZE, GROUP),
        "b2": (VOCABULARY // GROUP, GROUP),
    }

    def __init__(self, flat: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for s in self.SHAPES.values()]
        if flat is None:
            flat = (np.random.default_rng(3).standard_normal(sum(sizes)) * 0.1).astype(np.float32)
        self.flat = flat.astype(np.float32).copy()
        for (name, shape), part in zip(self.SHAPES.items(), np.split(self.flat, np.cumsum(sizes)[:-1])):
            setattr(self, name, part.reshape(shape))

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        h = np.take(self.e[0], context[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            h += np.take(self.e[k], context[:, k], axis=0)
        h += self.b
        return np.tanh(h, out=h)

    @staticmethod
    def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exponentials of logits, their sums by row); logits are bounded by LIMIT, in place."""
        np.clip(x, -LIMIT, LIMIT, out=x)
        e = np.exp(x)
        return e, e @ np.ones(x.shape[1], x.dtype)

    def _inner_logits(self, h: np.ndarray, group: np.ndarray, groups: list[tuple[int, slice]]) -> np.ndarray:
        """Logits of the tokens within each row's group; rows lie in the order of their groups."""
        out = np.empty((len(h), GROUP), np.float32)
        for g, own in groups:
            np.matmul(h[own], self.w2[g], out=out[own])
        out += self.b2[group]
        return out

    @staticmethod
    def _groups(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """(an order that puts the rows of a group together, each group with its rows in that order)."""
        order = np.argsort(group.astype(np.int16), kind="stable")
        ends = np.searchsorted(group[order], np.arange(VOCABULARY // GROUP), side="right")
        starts = np.append(0, ends[:-1])
        return order, [(g, slice(a, z)) for g, (a, z) in enumerate(zip(starts.tolist(), ends.tolist())) if z > a]

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, groups = self._groups(target // GROUP)
        h, t = self._hidden(context[order]), target[order]
        group, within, row = t // GROUP, t % GROUP, np.arange(len(t))
        part = np.zeros(len(t), np.float32)
        for x, at in ((h @ self.w1 + self.b1, group), (self._inner_logits(h, group, groups), within)):
            total = self._exponentials(x)[1]
            part += x[row, at] - np.log(total)
        out = np.empty_like(part)
        out[order] = part
        return out

    def slopes(self, context: np.ndarray, target: np.ndarray) -> dict[str, list[tuple]]:
        """The gradient of the mean log-probability: by parameter (place, slope) for the places where it is not zero."""
        order, groups = self._groups(target // GROUP)
        context, t, n = context[order], target[order], len(target)
        h, group, within, row = self._hidden(context), t // GROUP, t % GROUP, np.arange(n)
        ones = np.ones(n, np.float32)

        def of_logits(x: np.ndarray, at: np.ndarray) -> np.ndarray:
            e, total = self._exponentials(x)
            e *= (-1 / (n * total))[:, None]
            e[row, at] += np.float32(1 / n)
            return e

        d1, d2 = of_logits(h @ self.w1 + self.b1, group), of_logits(self._inner_logits(h, group, groups), within)
        out: dict[str, list[tuple]] = {"w1": [(..., h.T @ d1)], "b1": [(..., ones @ d1)], "w2": [], "b2": [], "e": []}
        dh = d1 @ self.w1.T
        for g, own in groups:
            out["w2"].append((g, h[own].T @ d2[own]))
            out["b2"].append((g, ones[own] @ d2[own]))
            dh[own] += d2[own] @ self.w2[g].T
        dh *= 1 - h**2
        out["b"] = [(..., ones @ dh)]
        for k in range(2 * SIDE):
            by = np.argsort(context[:, k].astype(np.int16), kind="stable")
            column = context[by, k]
            first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
            out["e"].append(((k, column[first]), np.add.reduceat(dh[by], first, axis=0)))
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> Network:
        """As ``slopes``, in one flat vector."""
        out = Network(np.zeros_like(self.flat))
        for name, parts in self.slopes(context, target).items():
            for at, slope in parts:
                getattr(out, name)[at] = slope
        return out

    def step(self, squares: Network, context: np.ndarray, target: np.ndarray) -> None:
        """One step of Adagrad; ``squares`` sums up the squares of slopes."""
        for name, parts in self.slopes(context, target).items():
            own, sums = getattr(self, name), getattr(squares, name)
            for at, slope in parts:
                seen = sums[at] + slope * slope
                sums[at] = seen
                own[at] += RATE * slope / np.sqrt(seen)


class Tokens:
    """Token ids and contexts of the words of runs of texts."""

    def __init__(self, frequent: np.ndarray):
        self.order = np.argsort(frequent)
        self.sorted = frequent[self.order]

    def ids(self, words: np.ndarray) -> np.ndarray:
        ids = FREQUENT + class_of(words)
        if len(self.sorted):
            k = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
            ids = np.where(self.sorted[k] == words, self.order[k], ids)
        return ids

    def of(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(contexts, tokens) of words with their offsets by text."""
        ids = self.ids(words)
        return self.contexts(ids, at), ids

    @staticmethod
    def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        context = np.full((len(ids), 2 * SIDE), VOCABULARY, np.int64)
        for column, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
            a, b = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
            if len(ids) > abs(step):
                context[a, column] = np.where(text[a] == text[b], ids[b], VOCABULARY)
        return context


class Shares:
    """Of words that belong to classes: the logarithms of their shares, as far as the counts are held."""

    def __init__(self, held: np.ndarray, held_n: np.ndarray, class_n: np.ndarray):
        self.held, self.log_n, self.log_class = held, np.log(held_n), np.log(np.maximum(class_n, 1))

    def of(self, words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a logarithm by word, places of the words whose own logarithm of their count is still to be added)."""
        out, own = np.zeros(len(words)), np.flatnonzero(ids >= FREQUENT)
        out[own] = -self.log_class[ids[own] - FREQUENT]
        if not len(self.held):
            return out, own
        k = np.minimum(np.searchsorted(self.held, words[own]), len(self.held) - 1)
        known = self.held[k] == words[own]
        out[own[known]] += self.log_n[k[known]]
        return out, own[~known]


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """part, place, ids: the tokens of every document with words, dealt over parts; place orders the documents of a part."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.frequent)
    parts = max(1, -(-vocabulary.tokens // TOKENS_A_PART))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column("text")):
                words, at = word_hashes(data, offsets)
                ids = tokens.ids(words).astype("<u2")
                keep = pa.array(np.diff(at) > 0)
                out = pa.array([ids[a:z].tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("part").slice(first, end - first), batch.column("place").slice(first, end - first), out], ["part", "place", "ids"]).filter(keep)

    place = F.xxhash64("doc_id", "text")
    rows = doc_texts(docs).select(F.pmod(place, F.lit(parts)).alias("part"), place.alias("place"), "text")
    return rows.mapInArrow(encode, "part long, place long, ids binary")


def train_round(parts: DataFrame, start: Network) -> Network:
    shared = parts.sparkSession.sparkContext.broadcast(start.flat)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        net, squares = Network(shared.value), Network(np.full(len(shared.value), 1e-6, np.float32))
        ids = [np.frombuffer(x, "<u2") for _, x in sorted(zip(pdf["place"], pdf["ids"]))]
        ends = np.cumsum([len(x) for x in ids])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        first = 0
        while first < len(ids):  # documents of about 64 batches at a time
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + 64 * BATCH)))
            t = np.concatenate(ids[first:last]).astype(np.int64)
            held.append((Tokens.contexts(t, np.append(0, np.cumsum([len(x) for x in ids[first:last]]))), t))
            c, t = (np.concatenate(x) for x in zip(*held))
            whole = len(t) if last == len(ids) else len(t) // BATCH * BATCH
            for i in range(0, whole, BATCH):
                net.step(squares, c[i : i + BATCH], t[i : i + BATCH])
            held, first = [(c[whole:], t[whole:])], last
        blocks = np.array_split(net.flat.astype("<f4"), BLOCKS)
        return pd.DataFrame({"block": np.arange(BLOCKS, dtype=np.int32), "tokens": int(ends[-1]), "numbers": [x.tobytes() for x in blocks]})

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(zip(pdf["numbers"], pdf["tokens"]))  # sums of floats depend on their order
        weight = sum(float(w) for _, w in pairs)
        total = sum(np.frombuffer(x, "<f4").astype(float) * w for x, w in pairs)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "tokens": [int(weight)], "numbers": [(total / weight).astype("<f4").tobytes()]})

    schema = "block int, tokens long, numbers binary"
    trained = parts.groupBy("part").applyInPandas(local, schema)
    halfway = trained.groupBy("block", F.pmod(F.xxhash64("numbers"), F.lit(32))).applyInPandas(average, schema)
    rows = halfway.groupBy("block").applyInPandas(average, schema).collect()  # BLOCKS rows of a fixed size
    if not rows:
        return start
    return Network(np.concatenate([np.frombuffer(r.numbers, "<f4") for r in sorted(rows, key=lambda r: r.block)]))


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, Network]:
    words, net = vocabulary(docs), Network()
    parts = saved(encoded(docs, words), "tokens") if words.tokens else None
    for _ in range(rounds if words.tokens else 0):
        net = train_round(parts, net)
    return words, net


def score(docs: DataFrame, vocabulary: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.frequent, vocabulary.held, vocabulary.held_n, vocabulary.class_n, net.flat))
    names = ["row", "doc_id", "n_tokens", "total", "key", "n"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each document, under a key that stands for no word, and one for each of its words whose count is not held."""
        frequent, *counts, flat = shared.value
        tokens, shares, model = Tokens(frequent), Shares(*counts), Network(flat)
        for batch in batches:
            row = batch.column("row").to_numpy()
            for first, end, data, offsets in text_runs(batch.column("text")):
                words, at = word_hashes(data, offsets)
                c, t = tokens.of(words, at)
                logs, open_ = shares.of(words, t)
                for i in range(0, len(t), BATCH):
                    logs[i : i + BATCH] += model.log_probabilities(c[i : i + BATCH], t[i : i + BATCH])
                total = np.diff(np.concatenate([[0.0], np.cumsum(logs)])[at])
                own, keys = row[first:end], mix(row[first:end].view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("doc_id").slice(first, end - first), pa.array(np.diff(at).astype(np.int64)), pa.array(total), pa.array(keys), pa.array(np.zeros(end - first, np.int64))], names)
                if len(open_):
                    text, words = np.searchsorted(at, open_, side="right") - 1, words[open_]
                    order = np.lexsort((words, text))
                    text, words = text[order], words[order]
                    start = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (words[1:] != words[:-1])))
                    n, none = np.diff(np.append(start, len(text))), pa.nulls(len(start), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(own[text[start]]), none, none, pa.array(np.zeros(len(start))), pa.array(words[start].view(np.int64)), pa.array(n)], names)

    rows = doc_texts(docs).withColumn("row", F.monotonically_increasing_id())
    parts = rows.mapInArrow(judge, "row long, doc_id long, n_tokens long, total double, key long, n long")
    logs = vocabulary.rest.select("key", F.ln("n").alias("log_n"))
    sums = parts.join(logs, "key", "left").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum(F.col("total") + F.col("n") * F.coalesce("log_n", F.lit(0.0))).alias("log_likelihood"))
    return sums.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *train(docs))
