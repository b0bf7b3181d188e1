"""Removal of repeated byte strings: every byte inside a string of LENGTH bytes that also starts earlier goes.

Each window of LENGTH bytes picks its anchor, the piece of GRAM bytes in it with the smallest hash (the leftmost of equal
ones); equal windows pick equal anchors at the same place. Neighbouring windows with one anchor form a stretch. Anchors only
deal the work out: what is removed is decided by bytes, between neighbours of a sorted order.

1. Every task counts the anchors of its documents. One that it has met once is asked for in the anchor's bucket, one that it
   has met more often is known to repeat. Stretches whose anchor repeats are open.
2. The bytes of open stretches are sorted, first among those of a task, then among those of an anchor, and the later ones of
   equal neighbours are removed as a whole.
3. The windows of what remains under an anchor, one stretch for each content, are sorted, and the later ones of equal
   neighbours are removed.

Both sorts are deep-shallow: multikey quicksort on words of 8 bytes down to a shallow depth, then a blind trie for each
group that is still tied. Anchors with very many occurrences (HOT of them at most, the most frequent ones) are dealt by the
windows' hashes over several groups.

Defined cases: a null text counts as empty; texts shorter than LENGTH stay whole; any length is read whole; rows without a
doc_id stay whole and repeat nothing; rows that repeat a doc_id and its text are the same document, of which no copy is
earlier; rows that repeat a doc_id with other texts are documents of their own, in the order of the texts' 32-bit hashes; an
empty table gives no rows; other columns are carried through by ``cleaned`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.llm.common import doc_texts, eights, equal_spans, mix, saved, span_hashes, table, text_runs

LENGTH, GRAM = 100, 24
SHALLOW = 16
ENTRIES_A_BUCKET, OCCURRENCES_A_GROUP, HOT = 400_000, 50_000, 1 << 20
#: Stretches that a task holds before it counts or sorts them, and windows that are sorted at a time.
COUNTED, SORTED, WINDOWS = 1_000_000, 200_000, 500_000
ASKED, KNOWN, OPEN, CROWDED = range(4)
_SPAN = np.dtype([("start", "<i4"), ("end", "<i4")])
_STRETCH = np.dtype([("gram", "<u8"), ("start", "<i4"), ("end", "<i4")])
_ASKED = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("mark", "<i4"), ("start", "<i4"), ("length", "<i4")])
_KNOWN = np.dtype([("gram", "<u8"), ("n", "<i8")])
_PLACE = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("mark", "<i4"), ("start", "<i4"), ("length", "<i4"), ("part", "<i4"), ("groups", "<i4")])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, text number, start, end) of a run of texts; starts and ends within the text. ``gram`` is a multiple of 8."""
    n = len(data)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes to the text's end
    valid = left >= length
    if not valid.any():
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    at, words = np.arange(n - gram + 1), eights(data)
    hashes = np.zeros(len(at), np.uint64)
    for k in range(0, gram, 8):
        hashes = mix((hashes ^ words[k : k + len(at)]) * np.uint64(0x9FB21C651E98DF25))
    least = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    least[left[: len(at)] < gram] = np.uint64(2**64 - 1)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: -(width - have)], least[width - have :])
    windows = np.flatnonzero(valid[: len(least)])
    anchor = (least[windows] & np.uint64(2**32 - 1)).astype(np.int64)
    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(windows, prepend=-2) != 1))
    last = np.append(first[1:], len(windows)) - 1
    a, b = windows[first], windows[last] + length
    doc = np.searchsorted(offsets, a, side="right") - 1
    return hashes[anchor[first]], doc, a - offsets[doc], b - offsets[doc]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before them."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _by_doc(docs: np.ndarray, marks: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    order = np.lexsort((marks, docs))
    docs, marks, rows = docs[order], marks[order], rows[order]
    first = np.flatnonzero(_changes(docs, marks))
    return docs[first].tolist(), marks[first].tolist(), [x.tobytes() for x in np.split(rows, first[1:])] if len(first) else []


def _packed(kind: np.dtype, **columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(next(iter(columns.values()))), kind)
    for name, column in columns.items():
        out[name] = column
    return out


def _squeezed(rows: np.ndarray) -> bytes:
    """Rows byte by byte, first all first bytes, then all second ones, compressed: what is shuffled is mostly these."""
    planes = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unsqueezed(raw: bytes, kind: np.dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text, which tells rows with one doc_id apart), text."""
    return doc_texts(docs).withColumn("mark", F.hash("text")).select("doc_id", "mark", "text")


def counted(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """bucket, kind, doc_id, mark, data: what a task asks about and knows of the anchors of a bucket; and open stretches, by document."""
    names = ["bucket", "kind", "doc_id", "mark", "data"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            grams, docs, marks, starts, ends = (np.concatenate(x) for x in zip(*held))
            _, first, code, n = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
            rows: list[tuple] = []
            for kind, part in (
                (ASKED, _packed(_ASKED, gram=grams, doc=docs, mark=marks, start=starts, length=ends - starts)[n[code] == 1]),
                (KNOWN, _packed(_KNOWN, gram=grams[first], n=n)[n > 1]),
            ):
                bucket = (part["gram"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                    rows.append((int(bucket[own[0]]), kind, 0, 0, _squeezed(part[own])))
            own = n[code] > 1
            for doc, mark, data in zip(*_by_doc(docs[own], marks[own], _packed(_STRETCH, gram=grams, start=starts, end=ends)[own])):
                rows.append(((doc ^ mark) % buckets, OPEN, doc, mark, data))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int8(), pa.int64(), pa.int32(), pa.binary()))], names)

        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            for first, _, data, offsets in text_runs(batch.column("text")):
                g, doc, a, b = stretches(data, offsets, length, gram)
                held.append((g, ids[first + doc], marks[first + doc], a, b))
                size += len(g)
                if size > COUNTED:
                    yield flushed()
                    held, size = [], 0
        if size:
            yield flushed()

    return _marked(docs).where("doc_id IS NOT NULL").mapInArrow(scan, "bucket int, kind byte, doc_id long, mark int, data binary")


def answer(most: int):
    """Of one bucket: open stretches by document, and the anchors with more than ``most`` occurrences (CROWDED), by number."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {k: pdf["data"][pdf["kind"] == k] for k in (ASKED, KNOWN)}
        asked = np.concatenate([np.empty(0, _ASKED), *(_unsqueezed(x, _ASKED) for x in parts[ASKED])])
        known = np.concatenate([np.empty(0, _KNOWN), *(_unsqueezed(x, _KNOWN) for x in parts[KNOWN])])
        grams, code = np.unique(np.concatenate([asked["gram"], known["gram"]]), return_inverse=True)
        n = np.bincount(code, np.concatenate([np.ones(len(asked), np.int64), known["n"]]), len(grams)).astype(np.int64)
        asked = asked[n[code[: len(asked)]] > 1]
        docs, marks, data = _by_doc(asked["doc"], asked["mark"], _packed(_STRETCH, gram=asked["gram"], start=asked["start"], end=asked["start"] + asked["length"]))
        through = pdf[pdf["kind"] == OPEN]
        crowd = _packed(_KNOWN, gram=grams, n=n)[n > most]
        return pd.DataFrame({
            "kind": np.array([OPEN] * (len(docs) + len(through)) + [CROWDED] * len(crowd), np.int8),
            "doc_id": np.array(docs + through["doc_id"].tolist() + crowd["n"].tolist(), np.int64),
            "mark": np.array(marks + through["mark"].tolist() + [0] * len(crowd), np.int32),
            "data": data + through["data"].tolist() + [x.tobytes() for x in crowd["gram"]],
        })

    return work


class BlindTrie:
    """Strings of one length: inner nodes keep the place where strings branch and the byte there, leaves equal strings."""

    def __init__(self) -> None:
        self.root = None

    def add(self, string: bytes, number: int) -> None:
        if self.root is None:
            self.root = (string, [number])
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other, numbers = node
        if other == string:
            numbers.append(number)
            return
        apart = int.from_bytes(other, "big") ^ int.from_bytes(string, "big")
        at = len(string) - (apart.bit_length() + 7) // 8
        above, node = None, self.root
        while isinstance(node, list) and node[0] < at:
            above, node = node, node[1][string[node[0]]]
        leaf = (string, [number])
        if isinstance(node, list) and node[0] == at:
            node[1][string[at]] = leaf
            return
        new = [at, {other[at]: node, string[at]: leaf}]
        if above is None:
            self.root = new
        else:
            above[1][string[above[0]]] = new

    def classes(self) -> Iterator[list[int]]:
        """Numbers of equal strings, the strings in order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            elif node:
                yield node[1]


def multikey_quicksort(words: np.ndarray, starts: np.ndarray, group: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, end): places of ``starts`` by group and by ``levels`` words of 8 bytes, and what is still tied in it.

    All parts that are not yet in order are split in three at once, each by the middle of three of its words: smaller ones,
    equal ones, which go on with the next word, and larger ones.
    """
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(_changes(group[order]))
    end, level = np.append(first[1:], len(order)), np.zeros(len(first), np.int64)
    tied: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        last = level == levels
        tied.append((first[last & (end - first > 1)], end[last & (end - first > 1)]))
        on = ~last & (end - first > 1)
        first, end, level = first[on], end[on], level[on]
        if not len(first):
            return order, np.concatenate([f for f, _ in tied]), np.concatenate([e for _, e in tied])
        size = end - first
        part = np.repeat(np.arange(len(first)), size)
        begin = np.cumsum(size) - size
        at = np.arange(len(part)) + (first - begin)[part]
        mine = order[at]
        word = words[starts[mine] + 8 * level[part]].astype(np.uint64)
        pivot = np.sort(np.stack([word[begin], word[begin + size // 2], word[begin + size - 1]]), axis=0)[1]
        less, more = word < pivot[part], word > pivot[part]
        equal = ~(less | more)
        counts = [np.add.reduceat(x.astype(np.int64), begin) for x in (less, equal, more)]
        to = first.copy()
        where = np.empty(len(part), np.int64)
        for x, n in zip((less, equal, more), counts):
            rank = np.cumsum(x)
            rank -= np.repeat(rank[begin] - x[begin], size)
            where[x] = (to[part] + rank - 1)[x]
            to = to + n
        order[where] = mine
        a, b = first + counts[0], first + counts[0] + counts[1]
        first, end, level = np.concatenate([first, a, b]), np.concatenate([a, b, end]), np.concatenate([level, level + 1, level])


def deep_shallow_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): strings by group and bytes, and which of them differ from the one before; strings of one group have one length, ``shallow`` at least."""
    levels = shallow // 8
    order, first, end = multikey_quicksort(eights(data).view(">u8"), starts, group, levels)
    new = np.ones(len(order), bool)
    if not len(first):
        return order, new
    size = end - first
    begin = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(first - begin, size)
    head = np.repeat(order[first], size)
    same = equal_spans(data, starts[order[at]] + 8 * levels, starts[head] + 8 * levels, lengths[order[at]] - 8 * levels)
    new[at] = False
    new[first] = True
    raw = None
    for k in np.flatnonzero(~np.logical_and.reduceat(same, begin)).tolist():  # a trie of more than one leaf
        raw = data.tobytes() if raw is None else raw
        a, z = int(first[k]), int(end[k])
        trie, skip, n = BlindTrie(), 8 * levels, int(lengths[order[a]])
        for i in order[a:z].tolist():
            s = int(starts[i])
            trie.add(raw[s + skip : s + n], i)
        for leaf in trie.classes():
            order[a : a + len(leaf)], new[a] = leaf, True
            a += len(leaf)
    return order, new


def later_ones(order: np.ndarray, new: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which strings have an equal neighbour, in the sorted order, that starts earlier."""
    if not len(order):
        return np.zeros(0, bool)
    by = np.lexsort((places["start"], places["mark"], places["doc"]))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(_changes(*(places[c][by] for c in ("doc", "mark", "start"))))
    first = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(rank[order], first), np.diff(np.append(first, len(order))))
    out = np.empty(len(order), bool)
    out[order] = rank[order] > least
    return out


def later_stretches(places: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which stretches have an earlier copy, their starts in ``data``)."""
    n = places["length"].astype(np.int64)
    starts = np.cumsum(n) - n
    by = np.lexsort((n, places["part"], places["gram"]))
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(_changes(*(places[c][by] for c in ("gram", "part", "length"))))
    return later_ones(*deep_shallow_sort(data, starts, n, group), places), starts


def later_windows(places: np.ndarray, data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(documents, marks, starts) of the windows of these stretches that have an earlier copy among them."""
    count = places["length"].astype(np.int64) - length + 1
    owner = np.repeat(np.arange(len(places)), count)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[owner] + begin
    groups = places["groups"][owner]
    if (groups > 1).any():
        split = np.flatnonzero(groups > 1)
        mine = np.ones(len(owner), bool)
        mine[split] = span_hashes(data, at[split], at[split] + length) % groups[split].astype(np.uint64) == places["part"][owner[split]].astype(np.uint64)
        owner, begin, at = owner[mine], begin[mine], at[mine]
    at_of = places[owner]
    at_of["start"] += begin.astype(np.int32)
    group = np.cumsum(_changes(at_of["gram"], at_of["part"]))
    later = later_ones(*deep_shallow_sort(data, at, np.full(len(at), length), group), at_of)
    return at_of["doc"][later], at_of["mark"][later], at_of["start"][later].astype(np.int64)


def fetched(docs: DataFrame, opened: DataFrame, crowded: tuple[np.ndarray, np.ndarray], buckets: int, length: int) -> DataFrame:
    """bucket, doc_id, mark, places, data: packed bytes of open stretches, one for each content of a task; and (places null) spans of their later copies."""
    names = ["bucket", "doc_id", "mark", "places", "data"]
    shared = docs.sparkSession.sparkContext.broadcast(crowded)  # HOT rows at most

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_groups = shared.value
        held: list[np.ndarray] = []
        pieces: list[np.ndarray] = []
        size = 0

        def sent() -> pa.RecordBatch:
            places, data = np.concatenate(held), np.concatenate(pieces)
            later, starts = later_stretches(places, data)
            spans = _packed(_SPAN, start=places["start"], end=places["start"] + places["length"])
            rows = [((doc ^ mark) % buckets, doc, mark, None, x) for doc, mark, x in zip(*_by_doc(places["doc"][later], places["mark"][later], spans[later]))]
            keep = np.flatnonzero(~later)
            bucket = ((places["gram"][keep] + places["part"][keep].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((places["gram"][keep], bucket))
            keep, bucket = keep[by], bucket[by]
            for own in np.split(keep, np.flatnonzero(np.diff(bucket)) + 1) if len(keep) else []:
                n = places["length"][own].astype(np.int64)
                at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                first = int((int(places["gram"][own[0]]) + int(places["part"][own[0]])) % buckets)
                rows.append((first, 0, 0, _squeezed(places[own]), _squeezed(data[at])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names)

        for batch in batches:
            for doc, mark, text, lists in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text"), batch.column("opened").to_pylist()):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                own = np.concatenate([np.frombuffer(x, _STRETCH) for x in lists])
                groups = np.ones(len(own), np.int64)
                if len(hot):
                    k = np.minimum(np.searchsorted(hot, own["gram"]), len(hot) - 1)
                    groups = np.where(hot[k] == own["gram"], hot_groups[k], 1)
                row, part = np.arange(len(own)), np.zeros(len(own), np.int64)
                if (groups > 1).any():  # one copy for every group that one of its windows belongs to
                    rows, parts = [], []
                    for i in range(len(own)):
                        w = np.arange(own["start"][i], own["end"][i] - length + 1)
                        p = np.unique(span_hashes(raw, w, w + length) % np.uint64(groups[i])) if groups[i] > 1 else np.zeros(1, np.int64)
                        rows.append(np.full(len(p), i))
                        parts.append(p.astype(np.int64))
                    row, part = np.concatenate(rows), np.concatenate(parts)
                n = (own["end"] - own["start"])[row].astype(np.int64)
                held.append(_packed(_PLACE, gram=own["gram"][row], doc=np.full(len(row), doc), mark=np.full(len(row), mark), start=own["start"][row], length=n, part=part, groups=groups[row]))
                pieces.append(raw[np.repeat(own["start"][row] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                size += len(row)
                if size > SORTED:
                    yield sent()
                    held, pieces, size = [], [], 0
        if size:
            yield sent()

    lists = opened.groupBy("doc_id", "mark").agg(F.collect_list("data").alias("opened"))
    return _marked(docs).join(lists, ["doc_id", "mark"]).mapInArrow(fetch, "bucket int, doc_id long, mark int, places binary, data binary")


def sort_bucket(length: int):
    """Spans to remove, by document, of the open stretches of one bucket, and those that tasks have found."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        through = pdf[pdf["places"].isna()]
        pdf = pdf[~pdf["places"].isna()]
        places = np.concatenate([np.empty(0, _PLACE), *(_unsqueezed(x, _PLACE) for x in pdf["places"])])
        data = np.concatenate([np.empty(0, np.uint8), *(_unsqueezed(x, np.dtype(np.uint8)) for x in pdf["data"])])
        later, starts = later_stretches(places, data)
        docs, marks, spans = [places["doc"][later]], [places["mark"][later]], [_packed(_SPAN, start=places["start"], end=places["start"] + places["length"])[later]]
        heads = np.flatnonzero(~later)
        heads = heads[np.lexsort((places["part"][heads], places["gram"][heads]))]
        new = _changes(places["gram"][heads], places["part"][heads])
        alone = new & np.append(new[1:], True)
        heads, new = heads[~alone], new[~alone]
        first = np.flatnonzero(new)
        windows = np.append(0, np.cumsum(places["length"][heads].astype(np.int64) - length + 1))
        a = 0
        while a < len(first):  # whole anchors, about WINDOWS windows at a time
            z = max(a + 1, int(np.searchsorted(windows[first], windows[first[a]] + WINDOWS)))
            own = heads[first[a] : first[z] if z < len(first) else len(heads)]
            d, m, s = later_windows(places[own], data, starts[own], length)
            by = np.lexsort((s, m, d))
            d, m, s = d[by], m[by], s[by]
            cut = np.flatnonzero(_changes(d, m) | np.append(True, s[1:] > s[:-1] + length)[: len(s)])
            docs.append(d[cut])
            marks.append(m[cut])
            spans.append(_packed(_SPAN, start=s[cut], end=s[np.append(cut[1:], len(s)) - 1] + length if len(s) else s))
            a = z
        ids, keys, packed = _by_doc(np.concatenate(docs), np.concatenate(marks), np.concatenate(spans))
        return pd.DataFrame({"doc_id": np.append(ids, through["doc_id"]).astype(np.int64), "mark": np.append(keys, through["mark"]).astype(np.int32), "data": packed + through["data"].tolist()})

    return work


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, mark, spans (array of packed start and end pairs, unmerged) of the documents that lose bytes."""
    size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    buckets = max(24, math.ceil(2 * size / (length - gram + 2) / ENTRIES_A_BUCKET))
    asked = counted(docs, buckets, length, gram).groupBy("bucket").applyInPandas(answer(OCCURRENCES_A_GROUP), "kind byte, doc_id long, mark int, data binary")
    answered = saved(asked, "opened")
    crowd = answered.where(F.col("kind") == CROWDED).orderBy(F.desc("doc_id"), "data").limit(HOT).select("doc_id", "data").collect()
    grams, n = np.array([int.from_bytes(r.data, "little") for r in crowd], np.uint64), np.array([r.doc_id for r in crowd], np.int64)
    by = np.argsort(grams)
    opened = answered.where(F.col("kind") == OPEN).drop("kind")
    seen = fetched(docs, opened, (grams[by], -(-n[by] // OCCURRENCES_A_GROUP)), buckets, length)
    found = seen.groupBy("bucket").applyInPandas(sort_bucket(length), "doc_id long, mark int, data binary")
    return found.groupBy("doc_id", "mark").agg(F.collect_list("data").alias("spans"))


def _kept(raw: np.ndarray, spans: list[bytes] | None) -> tuple[bytes, int]:
    """(remaining bytes, number of maximal removed runs)."""
    if not spans:
        return raw.tobytes(), 0
    s = np.concatenate([np.frombuffer(x, _SPAN) for x in spans])
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, s["start"], 1)
    np.add.at(edge, np.minimum(s["end"], len(raw)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return raw[~gone].tobytes(), int((gone & ~np.append(False, gone[:-1])).sum())


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    own = spans.select(F.col("doc_id").alias("removed_doc_"), F.col("mark").alias("removed_mark_"), F.col("spans").alias("removed_spans_"))
    return docs.join(own, (docs["doc_id"].cast("long") == F.col("removed_doc_")) & (F.hash(docs["text"].cast("string")) == F.col("removed_mark_")), "left").drop("removed_doc_", "removed_mark_")


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with all columns, repeated strings cut out of ``text``; half characters at the cuts are dropped."""
    joined = _with_spans(docs, repeated_spans(docs, length))
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, lists in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if lists and texts[i]:
                    texts[i] = _kept(np.frombuffer(texts[i].encode(), np.uint8), lists)[0].decode("utf-8", "ignore")
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.mapInArrow(cut, T.StructType(docs.schema.fields))


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text, lists in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.empty(0, np.uint8)
                rest, runs = _kept(raw, lists)
                for column, value in zip(out, (len(raw), len(raw) - len(rest), runs, hashlib.sha256(rest).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names)

    return _with_spans(doc_texts(docs), repeated_spans(docs, length)).mapInArrow(digest, SCHEMA)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


#: All windows grouped; only small tables are meant for it.
ORACLE = r"""
WITH bytes AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
pieces AS (SELECT doc_id, n, 512 * c AS base, substring(h, 1024 * c + 1, 1222) AS h FROM (SELECT *, unnest(range((n + 412) // 512)) AS c FROM bytes)),
windows AS (SELECT doc_id, base + j AS start, substring(h, 2 * j + 1, 200) AS w FROM (SELECT *, unnest(range(least(512, n - 99 - base))) AS j FROM pieces)),
again AS (SELECT unnest(list((doc_id, start) ORDER BY doc_id, start)[2:]) AS p FROM windows GROUP BY w HAVING count(*) > 1),
marked AS (SELECT p[1] AS doc_id, p[2] AS start FROM again),
begun AS (SELECT *, CASE WHEN start <= 100 + lag(start) OVER o THEN 0 ELSE 1 END AS fresh FROM marked WINDOW o AS (PARTITION BY doc_id ORDER BY start)),
numbered AS (SELECT doc_id, start, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM begun),
runs AS (SELECT doc_id, min(start) AS a, max(start) + 100 AS b FROM numbered GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substring(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head FROM cuts JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)"""
