"""Phrase collocations in weighted automata against brute force, with the awkward cases they define."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from cellwright.llm import phrase_automata
from cellwright.llm.phrase_automata import Automaton

EXTRA = "doc_id long, text string, lang string, part int, counts binary, n long, rank int, score double"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, lang, 1, None, 2, 3, 0.5) for i, (t, lang) in enumerate(texts)], EXTRA).repartition(3)


def brute(texts, least, top):
    f, words, blanks = {}, Counter(), "\t"
    for text, lang in texts:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        own = f.setdefault(lang, Counter())
        for piece in text.split("\n"):
            w = [x for x in piece.replace(blanks, " ").split(" ") if x]
            words[lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = []
        for p, a in own.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and c >= least and 100 * c >= 50 * a for q, c in own.items()):
                continue
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    stock = ["the", "The", "of", "a", "xx", "Été", "b.c", "new", "york", "city", "日本", "w\x00z", "\xa0"]
    out = [(None, "en"), ("", None), (" \t\n", "de"), ("...", "fr"), ("lone", None)]
    for i in range(300):
        n = rng.choice((3, 20, 60))
        w = [rng.choice(stock) if rng.random() < 0.7 else f"r{rng.randrange(300)}" for _ in range(n)]
        text = "".join(x + rng.choice((" ", " ", " ", "\t", "  ", ". ", "\n", ",")) for x in w)
        out.append((text + (" New  York City" if i % 3 else ""), rng.choice(("en", "en", "de", None, "", "a b\xff"))))
    return out + out[20:60] + [("hot pair " * 3000 + "tail", "en"), (" ".join(f"hot pair v{i}" for i in range(2000)), "en")]


@pytest.mark.parametrize(("range_bytes", "ranges"), [(1 << 24, 8192), (3000, 8192), (3000, 5)])
def test_phrases_equal_brute_force(spark, monkeypatch, texts, range_bytes, ranges):
    """In one range, in many, and in few ranges that are dealt over parts."""
    monkeypatch.setattr(phrase_automata, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(phrase_automata, "RANGES", ranges)
    df = docs_of(spark, texts)
    for least, top in ((10, 2000), (2, 7)):
        assert sorted(tuple(r) for r in phrase_automata.collocations(df, least, top).collect()) == brute(texts, least, top)
    if range_bytes == 3000:
        cuts = phrase_automata.shared_cuts(df.select("lang", "text"))
        assert cuts.parts > 8 and (cuts.deals > 1) == (ranges == 5)


def test_shards_overlap_and_empty_tables(spark, texts):
    data = np.frombuffer(b"a b c. d e a b c a", np.uint8)
    lexed = phrase_automata.Lexed(data, np.array([0, 10, len(data)]), [b"x", b"x"])

    def counted(low, high):
        symbols, keys, counts = lexed.ngrams(low, high)
        m = len(symbols) + 1
        return {tuple(symbols[i - 1] for i in (k // m // m, k // m % m, k % m) if i): c for k, c in zip(keys.tolist(), counts.tolist())}

    whole, apart = counted(0, len(lexed)), Counter()
    for low in range(0, len(lexed), 2):
        apart.update(counted(low, min(low + 2, len(lexed))))
    assert dict(apart) == whole and whole[b"x\xffa", b"x\xffb"] == 2
    assert phrase_automata.collocations(docs_of(spark, texts).limit(0)).count() == 0
    assert phrase_automata.collocations(docs_of(spark, [(None, None), ("", "en")])).count() == 0


def test_automata_keep_and_look_up_paths():
    rng = random.Random(4)
    symbols = sorted(f"s{i}".encode() for i in range(12))
    for _ in range(40):
        paths = {tuple([rng.randrange(1, 13) for _ in range(k)] + [0] * (3 - k)): rng.choice((0, 1, 1, 1, 2, 5 * 10**12)) for k in (rng.randrange(1, 4) for _ in range(rng.randrange(0, 90)))}
        digits = np.array(sorted(paths), np.int64).reshape(-1, 3)
        weights = np.array([paths[tuple(d)] for d in digits.tolist()], np.int64)
        made = Automaton.from_bytes(Automaton.build(symbols, digits, weights).to_bytes())
        d, w = made.paths()
        assert {tuple(made.symbols[i - 1] if i else b"" for i in r): x for r, x in zip(d.tolist(), w.tolist())} == {tuple(symbols[i - 1] if i else b"" for i in k): v for k, v in paths.items()}
        place = {s: i for i, s in enumerate(made.symbols, 1)}
        asked = [tuple([rng.randrange(1, 13) for _ in range(k)] + [0] * (3 - k)) for k in (rng.randrange(1, 4) for _ in range(60))] + list(paths)
        own = np.array([[place.get(symbols[i - 1], -1) if i else 0 for i in r] for r in asked], np.int64)
        assert made.weights_of(own).tolist() == [paths.get(r, -1) for r in asked]
        more = [{k: v for k, v in paths.items() if rng.random() < 0.6} for _ in range(3)]
        parts = [Automaton.build(symbols, np.array(sorted(m), np.int64).reshape(-1, 3), np.array([m[k] for k in sorted(m)], np.int64)) for m in more]
        union, d, w = phrase_automata.united(parts)
        total: Counter = Counter()
        for m in more:
            for k, v in m.items():
                total[tuple(symbols[i - 1] for i in k if i)] += v
        assert {tuple(union[i - 1] for i in r if i): x for r, x in zip(d.tolist(), w.tolist())} == dict(total)


def test_many_symbols_are_united_unpacked(monkeypatch):
    made = [Automaton.build([b"a", b"b"], np.array([[1, 0, 0], [1, 2, 0], [2, 1, 1]]), np.array([1, 2, k])) for k in (3, 2**40)]
    want = phrase_automata.united(made, np.add, 4)
    monkeypatch.setattr(phrase_automata, "PACKED", 2)
    assert [x.tolist() if hasattr(x, "tolist") else x for x in phrase_automata.united(made, np.add, 4)] == [x.tolist() if hasattr(x, "tolist") else x for x in want]
    assert want[2].tolist() == [4, 3 + 2**40]


def test_equal_endings_are_kept_once():
    symbols = [b"a", b"b", b"c", b"d"]
    paths = np.array([[i, k, x] for i in (1, 2, 3) for k in (1, 2) for x in (3, 4)], np.int64)
    made = Automaton.build(symbols, paths, np.ones(len(paths), np.int64))
    assert len(made.arrays[6]) == 1 and len(made.arrays[7]) == 2


def test_scores_pass_64_bits():
    a, b = np.array([10, 3 * 10**12, 2**40, 2**21]), np.array([20, 5 * 10**12, 2**45, 2**21])
    assert phrase_automata.scores(a, b, b).tolist() == [10**6 * int(x) * int(x) // (int(y) * int(y)) for x, y in zip(a, b)]
