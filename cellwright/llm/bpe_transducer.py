"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

All documents' pre-tokens are counted; the most frequent ones (a bounded number, the size of the lexicon) are merged once
and compiled into a minimal acyclic automaton that shares prefixes and suffixes. Numbers on its arcs add up to a word's
place in the table of id outputs. The automaton has a bounded size, is broadcast as bytes, and every task maps it into
memory from a file that it unlinks at once. Words outside it are merged exactly.

Defined cases: a null text counts as empty and has no ids; the special tokens' strings become their ids, as the library's
default does; any length is encoded whole; repeated rows give repeated results; an empty table gives no rows; other
columns are ignored. Bytes that are no valid UTF-8 after decoding become U+FFFD.
"""

from __future__ import annotations

import hashlib
import io
import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.bpe import Bpe, Encoder
from cellwright.llm.common import doc_texts, number_spans, saved, table, text_runs

LEXICON_WORDS = 32_768


class Transducer:
    """A minimal acyclic automaton over sorted byte strings; arcs carry the number of words that stand before theirs."""

    FIELDS = ("arc_keys", "arc_targets", "arc_numbers", "final", "id_start", "ids")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: list[bytes], outputs: list[np.ndarray]) -> Transducer:
        """words: sorted, no repeats. Incremental minimisation: finished states are looked up by final flag and arcs."""
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}

        def settle(path: list[tuple[int, int]], keep: int) -> None:
            while len(path) > keep:
                parent, byte = path.pop()
                child = arcs[parent][byte]
                key = (final[child], tuple(arcs[child].items()))
                arcs[parent][byte] = register.setdefault(key, child)

        path: list[tuple[int, int]] = []
        previous = b""
        for word in words:
            common = next((i for i, (a, b) in enumerate(zip(word, previous)) if a != b), min(len(word), len(previous)))
            settle(path, common)
            state = arcs[path[-1][0]][path[-1][1]] if path else 0
            for byte in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[state][byte] = len(arcs) - 1
                path.append((state, byte))
                state = len(arcs) - 1
            final[state] = True
            previous = word
        settle(path, 0)
        number: dict[int, int] = {}
        order, stack = [], [0]
        while stack:  # states after all that they lead to
            s = stack[-1]
            rest = [t for t in arcs[s].values() if t not in number]
            if rest:
                stack.extend(rest)
                continue
            stack.pop()
            if s not in number:
                number[s] = final[s] + sum(number[t] for t in arcs[s].values())
                order.append(s)
        name = {s: i for i, s in enumerate(reversed(order))}
        rows = []
        for s, i in name.items():
            before = int(final[s])
            for byte in sorted(arcs[s]):
                rows.append((i << 8 | byte, name[arcs[s][byte]], before))
                before += number[arcs[s][byte]]
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        ends = np.zeros(len(name), np.uint8)
        for s, i in name.items():
            ends[i] = final[s]
        lengths = np.array([len(x) for x in outputs], np.int64)
        return cls(arc_keys=table[:, 0].copy(), arc_targets=table[:, 1].copy(), arc_numbers=table[:, 2].copy(), final=ends, id_start=np.concatenate([[0], np.cumsum(lengths)]), ids=np.concatenate(outputs).astype(np.int32) if outputs else np.empty(0, np.int32))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        for k in self.FIELDS:
            np.save(out, getattr(self, k))
        return out.getvalue()

    @classmethod
    def mapped(cls, raw: bytes) -> Transducer:
        """Maps the arrays from an unlinked file of this task."""
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        arrays, at = {}, io.BytesIO(raw)
        for k in cls.FIELDS:
            version = np.lib.format.read_magic(at)
            shape, _, dtype = np.lib.format.read_array_header_1_0(at) if version == (1, 0) else np.lib.format.read_array_header_2_0(at)
            n = int(np.prod(shape))
            arrays[k] = np.frombuffer(m, dtype, n, at.tell())
            at.seek(n * dtype.itemsize, 1)
        return cls(**arrays)

    def lookup(self, words: list[bytes]) -> list[np.ndarray | None]:
        """The ids of each word in the lexicon, None for others; all words step through the automaton together."""
        n = len(words)
        if not len(self.arc_keys):
            return [None] * n
        lengths = np.fromiter(map(len, words), np.int64, n)
        begin = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8)
        state, number, live, j = np.zeros(n, np.int64), np.zeros(n, np.int64), np.flatnonzero(lengths > 0), 0
        accepted = np.zeros(n, bool)
        while len(live):
            key = state[live] << 8 | flat[begin[live] + j]
            at = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            on = self.arc_keys[at] == key
            live, at = live[on], at[on]
            state[live] = self.arc_targets[at]
            number[live] += self.arc_numbers[at]
            j += 1
            done = lengths[live] == j
            ended = live[done]
            accepted[ended] = self.final[state[ended]] > 0
            live = live[~done]
        where = self.id_start
        return [self.ids[where[k] : where[k + 1]] if ok else None for ok, k in zip(accepted.tolist(), number.tolist())]


def word_counts(docs: DataFrame, bpe: Bpe, flush: int = 500_000) -> DataFrame:
    """word (binary), n over all documents; every task adds up its own counts before the shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bpe)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = shared.value, {}

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for _, _, data, offsets in text_runs(batch.column("text")):
                starts, stops, special, _ = tables.pretokens(data, offsets)
                starts, stops = starts[special < 0], stops[special < 0]
                if not len(starts):
                    continue
                codes, first = number_spans(data, starts, stops)
                raw = data.tobytes()
                for i, j, n in zip(starts[first].tolist(), stops[first].tolist(), np.bincount(codes).tolist()):
                    word = raw[i:j]
                    held[word] = held.get(word, 0) + n
                if len(held) > flush:
                    yield counted()
        if held:
            yield counted()

    return doc_texts(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, bpe: Bpe, size: int = LEXICON_WORDS) -> Transducer:
    """The ``size`` most frequent words of all documents, ties by word.

    A histogram of the counts' orders of magnitude tells from which count on words are wanted, so that hardly more than
    ``size`` words leave the tasks.
    """
    counts = saved(word_counts(docs, bpe).withColumn("magnitude", F.floor(F.log2("n") * 8).cast("int")), "words")
    least, above = 0, 0
    for r in counts.groupBy("magnitude").count().orderBy(F.desc("magnitude")).collect():  # a few hundred rows at most
        least, above = r.magnitude, above + r["count"]
        if above >= size:
            break
    top = counts.where(F.col("magnitude") >= least).orderBy(F.desc("n"), "word").limit(size).select("word")
    words = sorted(r.word.encode() for r in top.collect())
    return Transducer.build(words, bpe.merge(words))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, bpe: Bpe, lexicon: Transducer) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every document."""
    return _encoded(docs, bpe, lexicon, "doc_id long, ids binary", lambda tables, ids: (ids.astype("<u4").tobytes(),))


def digests(docs: DataFrame, bpe: Bpe, lexicon: Transducer) -> DataFrame:
    """doc_id, number of ids, digests of the ids and of the text decoded from them."""

    def row(tables: Bpe, ids: np.ndarray) -> tuple:
        raw = tables.decode_bytes(ids)[0].tobytes().decode("utf-8", "replace").encode()
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()

    return _encoded(docs, bpe, lexicon, SCHEMA, row)


def _encoded(docs: DataFrame, bpe: Bpe, lexicon: Transducer, schema: str, row) -> DataFrame:
    context = docs.sparkSession.sparkContext
    shared, arcs = context.broadcast(bpe), context.broadcast(lexicon.to_bytes())
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*[(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        encoder = Encoder(tables, Transducer.mapped(arcs.value))
        for batch in batches:
            out = [row(tables, ids) for ids in encoder.documents(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * (len(types) - 1), types[1:]))], list(names))

    return doc_texts(docs).mapInArrow(encode, schema)


def op10_bpe_transducer(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs, bpe = table(spark, sf_dir, "documents"), Bpe(path)
    return digests(docs, bpe, build_lexicon(docs, bpe))
