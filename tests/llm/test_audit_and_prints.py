"""SimHash near-duplicates and the audit of filters against brute force, with the awkward cases each defines."""

from __future__ import annotations

import random
from fractions import Fraction
from itertools import combinations, permutations

import numpy as np
import pytest
import xxhash

from cellwright.llm import filter_audit, simhash_dedup

#: Columns beside those of documents, with names that operators use themselves.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, fp long, part string, key long, n long, digest string, label long, fails int"


def rows(spark, texts, langs=("en",)):
    return spark.createDataFrame([(i, t, langs[k % len(langs)], "s", 1, 2, "p", 3, 4, "d", 5, 6) for k, (i, t) in enumerate(texts)], EXTRA).repartition(3)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = prose(rng, 300)
    out = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one two"), (5, "ONE  two"), (6, "É b c d"), (7, prose(rng, 30_000)), (8, "no break a b c"), (None, base), (None, "alone " * 9)]
    out += [(20 + i, base) for i in range(5)]
    for i in range(60):
        w = base.split()
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        out.append((40 + i, (" " if i % 2 else "\n").join(w)))
    out += [(200 + i, prose(rng, rng.randrange(1, 90))) for i in range(40)]
    return out + [(20, base), (21, "another text under a used id")]


# -- 11 -----------------------------------------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], radius: int) -> dict[int, int]:
    """By fingerprint the smallest one that it is connected with."""
    top = {p: p for p in prints}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations(sorted(top), 2):
        if (a ^ b).bit_count() <= radius:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return {p: root(p) for p in top}


def test_simhash_equals_brute_force(spark, texts):
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash_dedup.near_duplicate_classes(rows(spark, texts)).collect()), key=repr)
    prints = [(i, plain_fingerprint(t)) for i, t in texts]
    top = components([p for _, p in prints], simhash_dedup.RADIUS)
    smallest: dict[int, int] = {}
    for i, p in prints:
        if i is not None:
            smallest[top[p]] = min(i, smallest.get(top[p], i))
    assert got == sorted(((i, p, smallest.get(top[p])) for i, p in prints), key=repr)
    assert len({c for _, _, c in got}) < len(prints) - 40  # near copies are found
    assert simhash_dedup.near_duplicate_classes(rows(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [4, 10**9])
def test_every_link_within_the_radius(spark, monkeypatch, crowded):
    """Random codes, codes of a dense ball, and chains of codes; crowded shards are dealt out by further bits."""
    monkeypatch.setattr(simhash_dedup, "CROWDED", crowded)
    rng = random.Random(9)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    centre, codes = rng.getrandbits(64), [rng.getrandbits(64) for _ in range(150)]
    codes += [flip(centre, rng.randrange(0, 9)) for _ in range(150)]
    for _ in range(60):
        codes.append(flip(codes[-1], rng.choice((4, 4, 5))))
    codes = list(dict.fromkeys(codes))
    df = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash_dedup.near_links(df).collect()]
    top = {c: c for c in codes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    assert {c: root(c) for c in codes} == components(codes, 4)


def test_trees_find_what_a_scan_finds():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 1 << 12, 900).astype(np.uint64))
    starts = np.array([0, 1, 40, 300])
    forest, runs = simhash_dedup.Forest(codes, starts), [*starts.tolist(), len(codes)]
    found = set(zip(*(x.tolist() for x in forest.links(np.arange(len(codes)), 2))))
    assert found == {(j, i) for a, b in zip(runs, runs[1:]) for i, j in combinations(range(a, b), 2) if int(codes[i] ^ codes[j]).bit_count() <= 2}


def test_blocks_cover_the_radius():
    for pick in (2, 3):
        for blocks, taken, size in simhash_dedup.levels(4, pick):
            assert blocks - 4 == taken
        assert simhash_dedup.levels(4, pick)[0][0] * simhash_dedup.levels(4, pick)[0][2] >= 64


# -- 13 -----------------------------------------------------------------------------------------------------------


def failing(text: str, first: bool) -> str:
    w, blanks = [], " \t\n\x0b\x0c\r"
    for c in text:
        if c in blanks:
            w.append("")
        elif w:
            w[-1] += c
        else:
            w = [c]
    w = [x for x in w if x]
    return "".join(x for x, f in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), not first)) if f)


def test_audit_equals_brute_force(spark, texts):
    texts = [*texts, (300, "Aa " * 250), (301, "x# " + prose(random.Random(1), 250)), (302, "Aa " * 250), (303, "É" * 100 + "ABC"), (303, "É" * 100 + "ABCD"), (299, "Aa " * 250), (299, "Aa " * 250)]
    langs = ("en", None, "de")
    labels = [(20, 1, 0), (20, 0, 1), (300, 1, 1), (302, 1, None), (299, None, 1), (None, 1, 1), (9999, 1, 1), (205, 1, 0)]
    docs, marks = rows(spark, texts, langs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(filter_audit.failures(docs, marks)).collect()}
    smallest: dict[str, int] = {}
    for i, t in texts:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good, bad = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    kept = [(langs[k % 3] or "", failing(t or "", i is None or i == smallest[t or ""]), i in good and i is not None, i in bad and i is not None) for k, (i, t) in enumerate(texts)]
    want = {}
    for part in {p for p, *_ in kept}:
        share = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            here = [x for x in kept if x[0] == part]
            for step, x in enumerate(order, 1):
                left, gone = [r for r in here if x not in r[1]], [r for r in here if x in r[1]]
                every = [r for r in kept if r[0] == part and x in r[1]]
                want[part, order, step] = [len(left), len(gone), len(every) - len(gone), sum(r[1] == x for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                share[x] += len(gone)
                here = left
        for (p, order, step), values in want.items():
            if p == part:
                values.append(share[order[step - 1]])
    assert got == {k: tuple(v) for k, v in want.items()}
    assert filter_audit.audit(filter_audit.failures(docs.limit(0), marks.limit(0))).count() == 0


def test_shares_are_exact():
    rng = random.Random(2)
    for n in (1, 2, 3, 4, 5):
        fails, counts = list(range(1 << n)), [rng.randrange(10**15) for _ in range(1 << n)]
        v = filter_audit.coalition_removals(fails, counts, n)
        orders = list(permutations(range(n)))
        want = [Fraction(0)] * n
        for order in orders:
            before = 0
            for i in order:
                want[i] += Fraction(v[before | 1 << i] - v[before], len(orders))
                before |= 1 << i
        assert filter_audit.shapley_shares(v, n) == want
