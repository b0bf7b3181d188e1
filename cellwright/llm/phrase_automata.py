"""Phrase collocations by language: counts of all n-grams of up to three words in weighted acyclic automata.

A task lexes its texts, sorts the n-grams of a shard of them, and builds the shard's automaton: arcs carry symbols (a word with
its language), accepted paths carry their counts, and equal last states are kept once. Paths are ordered by their symbols'
bytes, so an automaton can be cut into slices at any path. Cuts that all tasks share, taken from a sample of positions, make
ranges of about RANGE_BYTES of text each; a range may begin inside a prefix, so a very common word or word pair is spread over
as many ranges as it needs. Beyond RANGES ranges each is dealt over parts by a hash of its paths.

The slices of a range meet and are united: weights of equal paths are summed. Paths below ``least`` occurrences are dropped
then, since a candidate's parts occur at least as often as it does. For the parts of its candidates, every range sends request
automata to the ranges that the parts belong to, each part once; a request carries how often the longest candidate around it
occurs, united by maximum. There the requests are composed with the counts, and the answers go back as automata.

The lowest cut of a candidate counts. Scores are exact: 64-bit numbers where all products fit, else Python's integers. Every
range keeps its first ``top`` candidates a language, and these are ranked in two levels.

Defined cases: a null text is empty; a null language is ``und``; texts of any length are read whole, shards of long ones
overlap by two words; repeated rows count each; of equal scores and counts the smaller phrase comes first; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.common import LOWER, mix, number_spans, saved, span_hashes, spans, table, text_runs

LEAST, TOP, COVER_PERCENT, SCALE = 10, 2000, 50, 1_000_000
#: Bytes of text of a shard and of a range; words of a shard at most; ranges at most.
SHARD_BYTES, RANGE_BYTES, SHARD_WORDS, RANGES = 4 << 20, 8 << 20, 1 << 20, 8192
#: Sampled positions a range, and bytes a word for the estimate of how many rows hold them.
POSITIONS, WORD_BYTES = 50, 6

BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
NO_WORD = BREAKS.copy()
NO_WORD[[0x20, 0x09]] = True
_WIDTHS = ("<u1", "<u2", "<u4", "<u8")


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers that are not negative, each in the narrowest width."""
    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = next(i for i in range(4) if top < 1 << (8 << i))
        out += [struct.pack("<BQ", kind, len(a)), a.astype(_WIDTHS[kind]).tobytes()]
    return b"".join(out)


def _unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n = struct.unpack_from("<BQ", data, at)
        out.append(np.frombuffer(data, _WIDTHS[kind], n, at + 9))
        at += 9 + (n << kind)
    return out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _found(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted number in an ordered array, -1 where it is missing."""
    at = np.searchsorted(ordered, wanted)
    if not len(ordered):
        return np.full(len(wanted), -1)
    return np.where(ordered[np.minimum(at, len(ordered) - 1)] == wanted, at, -1)


class Automaton:
    """Accepted paths of one to three symbols, each with a weight.

    Digits are 1 + the place of a symbol in ``symbols`` (sorted bytes), 0 for none. Stored weights are 1 + the weight of an
    accepted path, 0 where a path is only the beginning of others. Arcs of the first level are ordered by digit; ``below``
    counts the arcs under each. An arc of the second level leads to a last state (0: none), which has arcs of its own.
    """

    def __init__(self, symbols: list[bytes], first: np.ndarray, weight1: np.ndarray, below: np.ndarray, second: np.ndarray, weight2: np.ndarray, state: np.ndarray, size: np.ndarray, third: np.ndarray, weight3: np.ndarray):
        self.symbols = symbols
        self.arrays = (first, weight1, below, second, weight2, state, size, third, weight3)

    def wide(self) -> list[np.ndarray]:
        """The arrays in 64 bits; they are kept as narrow as they were stored."""
        return [x.astype(np.int64) for x in self.arrays]

    @classmethod
    def build(cls, symbols: list[bytes], digits: np.ndarray, weights: np.ndarray) -> Automaton:
        """From different paths in ascending order (rows of three digits); symbols that no path uses are left out."""
        used = np.unique(digits)
        used = used[used > 0]
        digits = np.where(digits > 0, np.searchsorted(used, digits) + 1, 0)
        d1, d2, d3 = digits.T
        new = _runs(d1)
        at1 = np.cumsum(new) - 1
        first, weight1 = d1[new], np.zeros(int(new.sum()), np.int64)
        weight1[at1[d2 == 0]] = weights[d2 == 0] + 1
        two = np.flatnonzero(d2 > 0)
        new = _runs(at1[two], d2[two])
        at2 = np.cumsum(new) - 1
        second, below = d2[two][new], np.bincount(at1[two][new], minlength=len(first))
        weight2, short = np.zeros(len(second), np.int64), d3[two] == 0
        weight2[at2[short]] = weights[two[short]] + 1
        three = two[~short]
        state, size, third, weight3 = cls._states(at2[~short], np.stack([d3[three], weights[three] + 1], 1), len(second))
        return cls([symbols[i - 1] for i in used.tolist()], first, weight1, below, second, weight2, state, size, third, weight3)

    @staticmethod
    def _states(owner: np.ndarray, arcs: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Last states, equal ones once: the state of each of n owners, the number of arcs of each state, and all arcs."""
        state, start = np.zeros(n, np.int64), np.flatnonzero(_runs(owner)) if len(owner) else np.empty(0, np.int64)
        size = np.diff(np.append(start, len(owner)))
        one = start[size == 1]
        lone, number = np.unique(arcs[one], axis=0, return_inverse=True) if len(one) else (arcs[:0], one)
        state[owner[one]] = number.reshape(-1) + 1
        known: dict[bytes, int] = {}
        kept, sizes = [lone], [1] * len(lone)
        arcs = np.ascontiguousarray(arcs)
        for i, k in zip(start[size > 1].tolist(), size[size > 1].tolist()):
            name = arcs[i : i + k].tobytes()
            if name not in known:
                known[name] = len(sizes) + 1
                kept.append(arcs[i : i + k])
                sizes.append(k)
            state[owner[i]] = known[name]
        kept = np.concatenate(kept)
        return state, np.array(sizes, np.int64), kept[:, 0], kept[:, 1]

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """(digits, weights) of all accepted paths, in no order."""
        first, weight1, below, second, weight2, state, size, third, weight3 = self.wide()
        under = np.repeat(first, below)
        start = np.append(0, np.cumsum(size))
        has = np.flatnonzero(state)
        many = size[state[has] - 1]
        arc = np.arange(many.sum()) + np.repeat(start[state[has] - 1] - np.cumsum(many) + many, many)
        a, b = weight1 > 0, weight2 > 0
        none1, none2 = np.zeros(int(a.sum()), np.int64), np.zeros(int(b.sum()), np.int64)
        digits = np.concatenate([np.stack([first[a], none1, none1], 1), np.stack([under[b], second[b], none2], 1), np.stack([np.repeat(under[has], many), np.repeat(second[has], many), third[arc]], 1)])
        return digits, np.concatenate([weight1[a], weight2[b], weight3[arc]]) - 1

    def weights_of(self, digits: np.ndarray) -> np.ndarray:
        """The weight of each path (rows of digits of this automaton's symbols; below 0: no such symbol), -1 if not accepted."""
        first, weight1, below, second, weight2, state, size, third, weight3 = self.wide()
        m = len(self.symbols) + 1
        d1, d2, d3 = digits.T
        at1 = _found(first, d1)
        out = np.where(at1 >= 0, weight1[np.maximum(at1, 0)] if len(weight1) else 0, 0)
        further = np.flatnonzero((d2 != 0) & (at1 >= 0))
        out[d2 != 0] = 0
        at2 = _found(np.repeat(np.arange(len(first)), below) * m + second, np.where(d2[further] > 0, at1[further] * m + d2[further], -1))
        further, at2 = further[at2 >= 0], at2[at2 >= 0]
        last = d3[further] != 0
        out[further[~last]] = weight2[at2[~last]]
        further, at2 = further[last & (d3[further] > 0)], at2[last & (d3[further] > 0)]
        if len(further):
            start = np.repeat(np.arange(1, len(size) + 1), size) * m + third
            order = np.argsort(start, kind="stable")
            at3 = _found(start[order], state[at2] * m + d3[further])
            out[further[at3 >= 0]] = weight3[order[at3[at3 >= 0]]]
        return out - 1

    def to_bytes(self) -> bytes:
        lengths = np.array([len(s) for s in self.symbols], np.int64)
        return _packed(lengths, np.frombuffer(b"".join(self.symbols), np.uint8), *self.arrays)

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        lengths, text, *arrays = _unpacked(data)
        ends, text = np.cumsum(lengths, dtype=np.int64).tolist(), text.tobytes()
        return cls([text[i:j] for i, j in zip([0, *ends], ends)], *arrays)


def _common(automata: list[Automaton]) -> tuple[list[bytes], list[np.ndarray]]:
    """The sorted symbols of all automata, and by automaton the new digit of each old one (0 stays)."""
    lists = [a.symbols for a in automata]
    ends = np.cumsum([len(s) for x in lists for s in x], dtype=np.int64)
    data = np.frombuffer(b"".join(s for x in lists for s in x), np.uint8)
    if not len(ends):
        return [], [np.zeros(1, np.int64) for _ in lists]
    codes, first = number_spans(data, np.append(0, ends[:-1]), ends)
    every = [s for x in lists for s in x]
    distinct = [every[i] for i in first.tolist()]
    order = sorted(range(len(distinct)), key=distinct.__getitem__)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    parts = np.split(rank[codes], np.cumsum([len(x) for x in lists])[:-1])
    return [distinct[i] for i in order], [np.append(0, p) for p in parts]


#: Below so many symbols a path is packed into one number.
PACKED = 1 << 21


def _merged(digits: np.ndarray, weights: np.ndarray, how: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """Different paths in ascending order, the weights of equal ones put together."""
    order = np.lexsort(digits.T[::-1])
    digits, weights = digits[order], weights[order]
    new = np.flatnonzero(_runs(*digits.T)) if len(digits) else np.empty(0, np.int64)
    return digits[new], how.reduceat(weights, new) if len(new) else weights


def united(automata: list[Automaton], how: np.ufunc = np.add, least: int = 0) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(symbols, digits, weights) of the union in ascending order, weights of equal paths summed (or joined by another function).

    Paths whose joined weight is below ``least`` are left out.
    """
    symbols, maps = _common(automata)
    m = len(symbols) + 1
    if m >= PACKED:
        both = [(own[d], w) for own, (d, w) in zip(maps, (a.paths() for a in automata))]
        digits, weights = _merged(np.concatenate([d for d, _ in both]), np.concatenate([w for _, w in both]), how)
        return symbols, digits[weights >= least], weights[weights >= least]
    keys, parts = [], []
    for own, a in zip(maps, automata):
        d, w = a.paths()
        keys.append((own[d[:, 0]] * m + own[d[:, 1]]) * m + own[d[:, 2]])
        parts.append(w.astype(np.uint32) if int(w.max(initial=0)) < 1 << 32 else w)  # narrow until they are joined
    keys, weights = np.concatenate(keys), np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    new = np.flatnonzero(_runs(keys))
    keys, weights = keys[new], how.reduceat(weights, new, dtype=np.int64) if len(new) else weights.astype(np.int64)
    keys, weights = keys[weights >= least], weights[weights >= least]
    return symbols, np.stack([keys // (m * m), keys // m % m, keys % m], 1), weights


class Cuts:
    """Where ranges begin (sorted paths, tuples of symbols), and over how many parts each range is dealt."""

    def __init__(self, paths: list[tuple[bytes, ...]], deals: int):
        self.paths, self.deals = paths, deals

    @property
    def parts(self) -> int:
        return (len(self.paths) + 1) * self.deals

    def slices(self, symbols: list[bytes], keys: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, Automaton]]:
        """(part, automaton) of the paths, which are given packed, in ascending order."""
        m, at = len(symbols) + 1, []
        for path in self.paths:  # the first key that is not below the path
            bound, exact = 0, True
            for s in path:
                i = bisect_left(symbols, s) if exact else 0
                bound = bound * m + (i + 1 if exact else 0)
                exact = exact and i < m - 1 and symbols[i] == s
            at.append(bound * m ** (3 - len(path)))
        at = np.searchsorted(keys, np.array(at, np.int64)).tolist()
        hashes = None
        if self.deals > 1:
            ends = np.cumsum([len(s) for s in symbols], dtype=np.int64)
            of = np.append(np.uint64(0), span_hashes(np.frombuffer(b"".join(symbols), np.uint8), np.append(0, ends[:-1]), ends))
            hashes = mix(mix(mix(of[keys // (m * m)]) + of[keys // m % m]) + of[keys % m]) % np.uint64(self.deals)
        bounds = [0, *at, len(keys)]
        for r, (low, high) in enumerate(zip(bounds, bounds[1:])):
            if low == high:
                continue
            own, w = keys[low:high], weights[low:high]
            for deal in range(self.deals) if hashes is None else np.unique(hashes[low:high]).tolist():
                here = slice(None) if hashes is None else hashes[low:high] == deal
                k = own[here]
                yield r * self.deals + deal, Automaton.build(symbols, np.stack([k // (m * m), k // m % m, k % m], 1), w[here])


class Lexed:
    """Words of a run of texts: lower-cased bytes, starts, ends, the piece and the language of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[bytes]):
        self.data = LOWER[data]
        self.starts, self.ends = spans(~NO_WORD[data], offsets)
        text = np.searchsorted(offsets, self.starts, side="right") - 1
        self.piece = np.cumsum(BREAKS[data], dtype=np.int32)[self.starts] + text if len(self.starts) else text
        self.names = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.names)}
        self.lang = np.array([number[x] for x in langs], np.int64)[text] if len(text) else text

    def __len__(self) -> int:
        return len(self.starts)

    def symbol(self, i: int) -> bytes:
        return self.names[self.lang[i]] + b"\xff" + self.data[self.starts[i] : self.ends[i]].tobytes()  # 0xFF is in no text

    def ngrams(self, low: int, high: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(symbols, packed keys, counts) of the n-grams that start at words low to high - 1."""
        end = min(high + 2, len(self))
        codes, first = number_spans(self.data, self.starts[low:end], self.ends[low:end])
        both, first, place = np.unique(self.lang[low:end] * len(first) + codes, return_index=True, return_inverse=True)
        names = [self.symbol(low + i) for i in first.tolist()]
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        d, piece = rank[place.reshape(-1)], self.piece[low:end]
        n, m = high - low, len(names) + 1
        pair = np.flatnonzero(piece[: end - low - 1][:n] == piece[1:][:n])
        triple = pair[pair + 2 < end - low]
        triple = triple[piece[triple] == piece[triple + 2]]
        keys = np.concatenate([d[:n] * m * m, (d[pair] * m + d[pair + 1]) * m, (d[triple] * m + d[triple + 1]) * m + d[triple + 2]])
        keys, counts = np.unique(keys, return_counts=True)
        return [names[i] for i in order], keys, counts


def lexed_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Lexed]:
    """Whole texts in shards of about SHARD_BYTES; a longer text is a shard of its own."""
    held, size = [], 0

    def flush() -> Lexed:
        at, offsets = 0, []
        for data, own, _ in held:
            offsets.append(own[:-1] + at)
            at += len(data)
        return Lexed(np.concatenate([d for d, _, _ in held]), np.append(np.concatenate(offsets), at), [x for _, _, langs in held for x in langs])

    for batch in batches:
        for k in range(0, batch.num_rows, 512):  # bounded copies of texts
            rows = batch.slice(k, 512)
            names = [("und" if x is None else x).encode() for x in rows.column("lang").to_pylist()]
            for first, end, data, offsets in text_runs(rows.column("text")):
                held.append((data, offsets, names[first:end]))
                size += len(data)
                if size >= SHARD_BYTES:
                    shard = flush()
                    held, size = [], 0
                    yield shard
                    del shard
    if held:
        yield flush()


def shared_cuts(texts: DataFrame) -> Cuts:
    """Cuts for all tasks, from a sample of positions; they deal the work out and change no result."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first().n
    ranges = min(max(1, math.ceil(size / RANGE_BYTES)), RANGES)
    deals = max(1, math.ceil(size / RANGE_BYTES / RANGES))
    if ranges == 1:
        return Cuts([], deals)
    wanted, words = POSITIONS * ranges, size / WORD_BYTES
    share = min(1.0, 50 * wanted / words)
    step = max(1, int(share * words / wanted))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for lexed in lexed_shards(batches):
            out = []
            for i in range(-seen % step, len(lexed), step):
                j = i + 1
                while j < min(i + 3, len(lexed)) and lexed.piece[j] == lexed.piece[i]:
                    j += 1
                out.append([lexed.symbol(k) for k in range(i, j)])
            seen += len(lexed)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], ["path"])

    sample = (texts if share == 1.0 else texts.sample(share, seed=1)).mapInArrow(scan, "path array<binary>")
    paths = sorted(tuple(bytes(s) for s in r.path) for r in sample.collect())  # about POSITIONS a range
    picked = [paths[len(paths) * i // ranges] for i in range(1, ranges)] if paths else []
    return Cuts(sorted(set(picked)), deals)


def counted_ranges(texts: DataFrame, cuts: Cuts, least: int) -> DataFrame:
    """part, lang, n, counts: a row with the automaton of each part, and rows with the words a language of each part."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lexed in lexed_shards(batches):
            for low in range(0, len(lexed), SHARD_WORDS):
                parts, slices = [], []
                for part, made in cuts.slices(*lexed.ngrams(low, min(low + SHARD_WORDS, len(lexed)))):
                    parts.append(part)
                    slices.append(made.to_bytes())
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(slices, pa.binary())], ["part", "slice"])

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        slices = [Automaton.from_bytes(x) for x in pdf["slice"]]
        words: dict[bytes, int] = {}
        for a in slices:
            for d, w in zip(a.arrays[0].tolist(), a.arrays[1].tolist()):
                if w:
                    lang = a.symbols[d - 1].partition(b"\xff")[0]
                    words[lang] = words.get(lang, 0) + w - 1
        out = [(part, None, None, Automaton.build(*united(slices, np.add, least)).to_bytes())]
        return pd.DataFrame(out + [(part, lang.decode(), n, None) for lang, n in words.items()], columns=["part", "lang", "n", "counts"]).astype({"n": "Int64"})

    sliced = texts.mapInArrow(shards, "part int, slice binary")
    return saved(sliced.groupBy("part").applyInPandas(unite, "part int, lang string, n long, counts binary"), "ranges")


def _candidates(counts: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Paths of two and three symbols, ascending, with their counts."""
    digits, weights = counts.paths()
    longer = digits[:, 1] > 0
    return _merged(digits[longer], weights[longer], np.add)


def _shift(digits: np.ndarray, k: int, length: int) -> np.ndarray:
    """``length`` digits of every path from the k-th on, as a path."""
    out = np.zeros_like(digits)
    out[:, :length] = digits[:, k : k + length]
    return out


def requests(counts: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(digits, weights): every part of every candidate once, with the count of the most frequent longer candidate around it."""
    digits, weights = _candidates(counts)
    three = digits[:, 2] > 0
    two, own, t, w = digits[~three], np.zeros(int((~three).sum()), np.int64), digits[three], weights[three]
    nothing = np.zeros(len(t), np.int64)
    asked = [(_shift(two, 0, 1), own), (_shift(two, 1, 1), own), (two, own), (_shift(t, 0, 1), nothing), (_shift(t, 2, 1), nothing), (_shift(t, 0, 2), w), (_shift(t, 1, 2), w)]
    return _merged(np.concatenate([d for d, _ in asked]), np.concatenate([x for _, x in asked]), np.maximum)


def _relabelled(symbols: list[bytes], counts: Automaton) -> np.ndarray:
    """By digit of ``symbols`` the digit in ``counts``, -1 where it has no such symbol."""
    place = {s: i for i, s in enumerate(counts.symbols, 1)}
    return np.array([0, *(place.get(s, -1) for s in symbols)], np.int64)


def answer(counts: Automaton, asked: list[Automaton]) -> list[tuple[bytes, bytes]]:
    """Requests composed with the counts: for each, the asked parts' counts, and how often the longest candidate around them occurs."""
    symbols, digits, covers = united(asked, np.maximum)
    around = Automaton.build(symbols, digits, covers)
    out = []
    for a in asked:
        digits, _ = _merged(*a.paths(), np.maximum)
        found = counts.weights_of(_relabelled(a.symbols, counts)[digits])
        cover = around.weights_of(_relabelled(a.symbols, around)[digits])
        met, inside = found >= 0, cover > 0
        out.append((Automaton.build(a.symbols, digits[met], found[met]).to_bytes(), Automaton.build(a.symbols, digits[inside], cover[inside]).to_bytes()))
    return out


def scores(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """floor(SCALE * a * a / (left * right)), exactly: 64 bits where all products fit, else Python's integers."""
    out = np.zeros(len(a), object)
    fits = (a < 1 << 21) & (left < 1 << 31) & (right < 1 << 31)
    out[fits] = (SCALE * a[fits] * a[fits]) // (left[fits] * right[fits])
    for i in np.flatnonzero(~fits).tolist():
        out[i] = SCALE * int(a[i]) * int(a[i]) // (int(left[i]) * int(right[i]))
    return out


def scored(counts: Automaton, answers: list[Automaton], covers: list[Automaton], top: int) -> list[tuple]:
    """(lang, phrase, a, l, r, score) of the range's candidates that no longer one covers, the first ``top`` a language."""
    symbols, digits, weights = united(answers)
    known = Automaton.build(symbols, digits, weights)
    symbols, digits, weights = united(covers)
    around = Automaton.build(symbols, digits, weights)
    digits, a = _candidates(counts)
    to_known = _relabelled(counts.symbols, known)
    cover = around.weights_of(_relabelled(counts.symbols, around)[digits])
    stay = (digits[:, 2] > 0) | (100 * np.maximum(cover, 0) < COVER_PERCENT * a)
    digits, a = digits[stay], a[stay]
    three = digits[:, 2] > 0
    length = np.where(three, 3, 2)
    part = lambda k, n: known.weights_of(to_known[_shift(digits, k, n)])
    left, right = part(0, 1), np.where(three, part(1, 2), part(1, 1))
    score = scores(a, left, right)
    left2, right2 = part(0, 2)[three], part(2, 1)[three]
    second = scores(a[three], left2, right2)
    lower, at = second < score[three], np.flatnonzero(three)
    score[at[lower]], left[at[lower]], right[at[lower]] = second[lower], left2[lower], right2[lower]
    order = sorted(range(len(a)), key=lambda i: (-score[i], -a[i]))
    groups: dict[bytes, list[tuple]] = {}
    names = [s.partition(b"\xff") for s in counts.symbols]
    # equal scores and counts may straddle the end: all of them go on, and the phrase decides later
    for i in order:
        held = groups.setdefault(names[digits[i, 0] - 1][0], [])
        if len(held) < top or (held[-1][5], held[-1][2]) == (int(score[i]), int(a[i])):
            held.append((names[digits[i, 0] - 1][0].decode(), b" ".join(names[d - 1][2] for d in digits[i, : length[i]].tolist()).decode(), int(a[i]), int(left[i]), int(right[i]), int(score[i])))
    return [r for held in groups.values() for r in sorted(held, key=lambda r: (-r[5], -r[2], r[1].encode()))[:top]]


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    texts = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"))
    cuts = shared_cuts(texts)
    both = counted_ranges(texts, cuts, least)
    ranges = both.where("counts IS NOT NULL").select("part", "counts")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, data in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                counts = Automaton.from_bytes(data)
                digits, weights = requests(counts)
                m = len(counts.symbols) + 1  # every symbol occurs ``least`` times in the range's candidates
                out = [(part, origin, a.to_bytes()) for part, a in cuts.slices(counts.symbols, (digits[:, 0] * m + digits[:, 1]) * m + digits[:, 2], weights)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["part", "origin", "asked"])

    def compose(counts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(counts) or not len(asked):
            return pd.DataFrame({"origin": [], "answer": [], "cover": []})
        found = answer(Automaton.from_bytes(counts["counts"].iloc[0]), [Automaton.from_bytes(x) for x in asked["asked"]])
        return pd.DataFrame({"origin": asked["origin"].to_numpy(), "answer": [x for x, _ in found], "cover": [x for _, x in found]})

    def rate(counts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(counts) and len(answers):
            rows = scored(Automaton.from_bytes(counts["counts"].iloc[0]), [Automaton.from_bytes(x) for x in answers["answer"]], [Automaton.from_bytes(x) for x in answers["cover"]], top)
        out = pd.DataFrame(rows, columns=["lang", "phrase", "a", "l", "r", "score"])
        return out.assign(part=int(counts["part"].iloc[0]) if len(counts) else 0)

    asked = ranges.mapInArrow(ask, "part int, origin int, asked binary")
    answers = ranges.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(compose, "origin int, answer binary, cover binary")
    rated = ranges.groupBy("part").cogroup(answers.groupBy("origin")).applyInPandas(rate, "lang string, phrase string, a long, l long, r long, score long, part int")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    groups = max(1, math.isqrt(cuts.parts))
    first = rated.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod("part", F.lit(groups))).orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = both.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH base AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM base),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, 1 AS k, w[i] AS phrase FROM starts UNION ALL
  SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM starts WHERE i + 1 <= len(w) UNION ALL
  SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM starts WHERE i + 2 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND c >= 10),
cuts AS (
  SELECT lang, phrase, k, a, 1 AS cutting, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM cand UNION ALL
  SELECT lang, phrase, k, a, 2, w[1] || ' ' || w[2], w[3] FROM cand WHERE k = 3),
cut AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, cutting, p.c AS l, q.c AS r, CAST(1000000 * a::HUGEINT * a // (p.c::HUGEINT * q.c) AS BIGINT) AS score
  FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = x JOIN f q ON q.lang = cuts.lang AND q.phrase = y),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cutting) = 1),
covered AS (SELECT lang, inner_phrase AS phrase, max(a) AS around FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inner_phrase FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT x.* FROM lowest x LEFT JOIN covered c ON x.lang = c.lang AND x.phrase = c.phrase AND x.k = 2 WHERE c.around IS NULL OR 100 * c.around < 50 * x.a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000"""
