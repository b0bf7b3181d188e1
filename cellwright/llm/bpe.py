"""Byte-level BPE over whole arrays of text: pre-tokens by character classes, merges for many words at once.

The vocabulary comes from a tokenizer file of the ``tokenizers`` library (a parameter); its tables have a fixed size,
so they are broadcast. Words are told apart by their bytes.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cellwright.llm.common import equal_spans, number_spans, span_hashes, text_runs

OTHER, LETTER, NUMBER, SPACE = range(4)
_NONE = np.int32(1 << 30)
#: Words of more bytes are merged one at a time by a heap.
WIDE = 48
#: Words that a task remembers before it starts anew.
REMEMBERED = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.cache
def character_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER by code point, from the library's own Unicode tables (the interpreter's are of another version).

    Planes from the fourth on hold no letters, numbers or white space.
    """
    from tokenizers import Regex, pre_tokenizers

    kinds = np.zeros(0x110000, np.uint8)
    points = np.array([c for c in range(0x40000) if not 0xD800 <= c < 0xE000])
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\P{L}+"), (NUMBER, r"\P{N}+"), (SPACE, r"\S+")):
        for _, (i, j) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(every):
            kinds[points[i:j]] = kind
    return kinds


class Bpe:
    """Tables of one vocabulary. Picklable; made once on the driver."""

    def __init__(self, path: str | None = None):
        with open(path or default_path(), encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        pieces = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces |= {i: t.encode() for t, i in self.special.items()}
        size = max(pieces) + 1
        parts = [pieces.get(i, b"") for i in range(size)]
        self.piece_length = np.array([len(p) for p in parts], np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_length)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.byte_id = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        ranks = np.arange(len(keys), dtype=np.int32)
        results = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.by_rank = keys[order], ranks[order], results
        self.classes = character_classes()

    # -- merging ---------------------------------------------------------------------------------------------
    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], _NONE)

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        ranks = self._rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = int(self.by_rank[r]), False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    rank = int(self._rank(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if rank < _NONE:
                        heapq.heappush(heap, (rank, x, ids[x], ids[y]))
        return np.array([x for x, ok in zip(ids, alive) if ok], np.int32)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of every word, by the lowest-ranked pair first, leftmost first among equals."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        first = 0
        while first < len(order):
            w = int(lengths[order[first]])
            if w > WIDE:
                for i in order[first:]:
                    out[i] = self._merge_long(words[i])
                break
            w = min(WIDE, max(4, w + w // 3))
            end = min(int(np.searchsorted(lengths[order], w, side="right")), first + 32768)
            who = order[first:end]
            n = lengths[who]
            ids = np.full((len(who), w), -1, np.int32)
            ids[np.arange(w) < n[:, None]] = self.byte_id[np.frombuffer(b"".join(words[i] for i in who), np.uint8)]
            self._merge_matrix(ids)
            kept = (ids >= 0).sum(1)
            for i, k, row in zip(who.tolist(), kept.tolist(), ids):
                out[i] = row[:k]
            first = end
        return out

    def _merge_matrix(self, out: np.ndarray) -> None:
        rows = np.arange(len(out))
        ids = out.copy()
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        columns = np.arange(ids.shape[1])
        while len(rows):
            at = np.argmin(ranks, axis=1)
            best = ranks[np.arange(len(rows)), at]
            on = best < _NONE
            if not on.all():
                out[rows[~on]] = ids[~on]
                rows, ids, ranks, at, best = rows[on], ids[on], ranks[on], at[on], best[on]
                if not len(rows):
                    break
            r = np.arange(len(rows))
            ids[r, at] = self.by_rank[best]
            shift = np.minimum(columns + (columns > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], ranks.shape[1] - 1), 1)
            ranks[:, -1] = _NONE
            for j in (np.maximum(at - 1, 0), np.minimum(at, ranks.shape[1] - 1)):
                ranks[r, j] = self._rank(ids[r, j], ids[r, j + 1])

    # -- pre-tokens ------------------------------------------------------------------------------------------
    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first bytes of pre-tokens, ends, which special token each is or -1, number of pre-tokens before each text) of a run of texts."""
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(points)
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # first byte of each code point
        at = np.searchsorted(lead, offsets)
        border = np.zeros(n + 1, bool)
        border[at] = True
        border[[0, n]] = True
        fixed = []
        for content, token in self.special.items():
            i = text.find(content)
            while i >= 0:
                j = i + len(content)
                if not border[i + 1 : j].any():
                    fixed.append((i, j, token))
                    i = text.find(content, j)
                else:
                    i = text.find(content, i + 1)
        for i, j, _ in fixed:
            border[[i, j]] = True
        kind = self.classes[points]
        begins = border[:n].copy()
        begins[1:] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(begins)
        ends = np.append(runs[1:], n)
        # white space before something in the same text: its last character stands apart, or with what follows if it is a blank
        s = ends[(kind[runs] == SPACE) & ~border[ends]] if n else runs
        begins[s - 1] = True
        begins[s[points[s - 1] == 0x20]] = False
        # contractions
        q = runs[(points[runs] == 0x27) & (ends - runs == 1) & ~border[ends]] if n else runs
        q = q[begins[q]]
        if len(q):
            a = points[q + 1]
            b = np.where(border[np.minimum(q + 2, n)], 0, points[np.minimum(q + 2, n - 1)])
            short = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            step = np.where(short, 1, np.where(two, 2, 0))
            hit = step > 0
            begins[q[hit] + 1] = False
            cut = q[hit] + 1 + step[hit]
            begins[cut[cut < n]] = True
        for i, j, _ in fixed:
            begins[i:j] = False
            begins[i] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], n)
        special = np.full(len(starts), -1, np.int32)
        for i, _, token in fixed:
            special[np.searchsorted(starts, i)] = token
        return lead[starts], lead[stops], special, np.searchsorted(starts, at)

    # -- decoding --------------------------------------------------------------------------------------------
    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, end of each id in them)."""
        length = self.piece_length[ids]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        at = np.repeat(self.piece_start[ids] - (end - length), length) + np.arange(total)
        return self.piece_bytes[at], end


class Encoder:
    """Encodes runs of texts in one task; remembers words, looks new ones up in a lexicon, if given, and merges the rest."""

    def __init__(self, bpe: Bpe, lexicon=None):
        self.bpe, self.lexicon = bpe, lexicon
        self.from_lexicon = self.merged = 0
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}  # by hash; the bytes of a row tell whether it is the word meant
        self.rows = self.spelled = 0
        self.bytes, self.spelling, self.letters = np.zeros(1 << 16, np.uint8), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.filled = np.zeros(4096, np.int32), 0

    def _learn(self, words: list[bytes]) -> None:
        """Takes words in as the next rows."""
        found = self.lexicon.lookup(words) if self.lexicon is not None else [None] * len(words)
        missing = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(missing, self.bpe.merge([words[i] for i in missing])):
            found[i] = ids
        self.merged += len(missing)
        self.from_lexicon += len(words) - len(missing)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate(found)
        base, need = self.rows, self.filled + len(flat)
        while len(self.start) < base + len(found):
            self.start, self.length, self.spelling, self.letters = (np.resize(x, 2 * len(x)) for x in (self.start, self.length, self.spelling, self.letters))
        while len(self.ids) < need:
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.start[base : base + len(found)] = self.filled + np.cumsum(lengths) - lengths
        self.length[base : base + len(found)] = lengths
        self.ids[self.filled : need] = flat
        self.filled = need
        letters = np.fromiter(map(len, words), np.int64, len(words))
        end = self.spelled + int(letters.sum())
        while len(self.bytes) < end + 8:
            self.bytes = np.resize(self.bytes, 2 * len(self.bytes))
        self.bytes[self.spelled : end] = np.frombuffer(b"".join(words), np.uint8)
        self.spelling[base : base + len(words)], self.letters[base : base + len(words)] = self.spelled + np.cumsum(letters) - letters, letters
        self.rows, self.spelled = base + len(words), end

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text)."""
        starts, stops, special, at = self.bpe.pretokens(data, offsets)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        codes, first = number_spans(data, starts, stops)
        if self.rows + len(first) > REMEMBERED:
            self._forget()
        starts, stops = starts[first], stops[first]
        hashes = span_hashes(data, starts, stops).tolist()
        rows = np.array([self.known.get(h, -1) for h in hashes], np.int64)
        old = np.flatnonzero(rows >= 0)
        held, n = rows[old], (stops - starts)[old]
        spelled = np.ndarray(len(self.bytes) - 7, "<u8", self.bytes, 0, (1,))
        same = n == self.letters[held]
        same &= equal_spans(data, starts[old], self.spelling[held], np.where(same, n, 0), spelled)
        rows[old[~same]] = -1  # another word with this hash
        new = np.flatnonzero(rows < 0)
        if len(new):
            raw = data.tobytes()
            rows[new] = np.arange(self.rows, self.rows + len(new))
            self._learn([raw[i:j] for i, j in zip(starts[new].tolist(), stops[new].tolist())])
            self.known.update((hashes[i], r) for i, r in zip(new.tolist(), rows[new].tolist()))
        row = rows[codes]
        length, begin = self.length[row], self.start[row]
        for i in np.flatnonzero(special >= 0):
            length[i] = 1
        end = np.cumsum(length)
        ids = self.ids[np.repeat(begin - (end - length), length) + np.arange(end[-1])]
        for i in np.flatnonzero(special >= 0):
            ids[end[i] - 1] = special[i]
        return ids, np.append(0, end)[at]

    def documents(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow column, in order."""
        for _, _, data, offsets in text_runs(column):
            ids, at = self.run(data, offsets)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                yield ids[a:b]
