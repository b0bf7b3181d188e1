"""Helpers that the text operators share: Arrow texts as byte arrays, hashes and exact numbers of spans of bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cellwright.session import saved, table  # noqa: F401

#: Texts are worked on in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 18

#: Spans of more bytes are hashed by a digest of the standard library.
LONG_SPAN = 1024
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_TAILS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def doc_texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` of a table of documents; its other columns never matter."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def text_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) for runs of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a little-endian number; places beyond the end hold 0. A view: nothing is copied but ``data``."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, eight bytes a step, each step mixed; equal spans have equal hashes wherever they stand."""
    left = ends - starts
    at, h = eights(data), mix(left.astype(np.uint64) + _FACTOR)
    big = np.flatnonzero(left > LONG_SPAN)
    for i in big.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    live, step = np.flatnonzero((left > 0) & (left <= LONG_SPAN)), 0
    while len(live):
        rest = left[live] - step
        h[live] = mix((h[live] ^ at[starts[live] + step] & _TAILS[np.minimum(rest, 8)]) * _FACTOR)
        live, step = live[rest > 8], step + 8
    return h


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Whether the bytes from a[i] and from b[i] on (of ``other``, eights of other bytes, if given) are the same over length[i]."""
    at, out = eights(data), np.ones(len(a), bool)
    live, step = np.flatnonzero(length > 0 if other is not None else (a != b) & (length > 0)), 0
    other = at if other is None else other
    while len(live):
        rest = length[live] - step
        same = ((at[a[live] + step] ^ other[b[live] + step]) & _TAILS[np.minimum(rest, 8)]) == 0
        out[live[~same]] = False
        live, step = live[same & (rest > 8)], step + 8
    return out


def number_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, first): equal spans get equal numbers, from 0 in order of appearance, and first[number] is where one appears.

    Hashes propose, bytes decide: every span is compared with the first one of its hash.
    """
    codes, unique = pd.factorize(span_hashes(data, starts, ends))
    first = np.empty(len(unique), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    twin, length = first[codes], ends - starts
    if (length == length[twin]).all() and equal_spans(data, starts, starts[twin], length).all():
        return codes, first
    raw, seen = data.tobytes(), {}  # two spans share a hash
    codes = np.array([seen.setdefault(raw[i:j], len(seen)) for i, j in zip(starts.tolist(), ends.tolist())])
    first = np.empty(len(seen), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_ascii()


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes that cross no text's border."""
    n = len(is_word)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    return np.flatnonzero(is_word & (~before | border[:-1])), np.flatnonzero(is_word & (~after | border[1:])) + 1


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text) of the shingles of ``width`` blank-separated, lower-cased words, repeats included.

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    low = LOWER[data]
    starts, ends = spans(~SPACES[data], offsets)
    words = span_hashes(low, starts, ends)
    at = np.searchsorted(starts, offsets)  # words before each text
    n_words = np.diff(at)
    n = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(out_at[-1], np.uint64)
    if len(words) >= width:
        full = np.zeros(len(words) - width + 1, np.uint64)
        k = np.uint64(1)
        for j in range(width):
            full += words[j : j + len(full)] * k
            k = np.uint64((int(k) * 0xD6E8FEB86659FD93) % (1 << 64))
        full = mix(full)
        long = n_words >= width
        take = np.repeat(long, n)
        within = np.arange(out_at[-1]) - np.repeat(out_at[:-1], n)
        out[take] = full[(np.repeat(at[:-1], n) + within)[take]]
    for i in np.flatnonzero((n_words > 0) & (n_words < width)):
        h = np.array([n_words[i]], np.uint64)
        for w in words[at[i] : at[i + 1]]:
            h = mix(h * np.uint64(3) + w)
        out[out_at[i]] = h[0]
    return out, out_at
