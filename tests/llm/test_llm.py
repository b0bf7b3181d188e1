"""The corpus operators against brute force, exact round trips or held-out accuracy, with the awkward cases each defines."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwright.llm import bpe, bpe_transducer, chat_format, common, jaccard_join, license_scan, neighbour_graph, packing, pseudo_likelihood, registry, suffix_dedup, topk_search, toxicity

SF = "/root/testdata/sf0.001"
#: Columns beside those of documents, with names that operators use themselves.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, bucket int, n long, hub string, tokens string, row long"


def words(rng: random.Random, n: int) -> str:
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def thue_morse(letters: str) -> str:
    """A word of 1,024 letters; with the letters swapped it has the same polynomial hash modulo 2^64, for any odd base."""
    out = letters[0]
    for _ in range(10):
        out += out.translate(str.maketrans(letters, letters[::-1]))
    return out


@pytest.fixture(scope="module")
def texts() -> list[tuple[int, str | None]]:
    rng = random.Random(1)
    base, passage = words(rng, 120), words(rng, 60)
    out: list[tuple[int, str | None]] = [(1, None), (2, ""), (3, "   \n"), (4, "short"), (5, "SHORT"), (6, "a b c d"), (7, words(rng, 20_000)), (8, "é" * 300), (9, "ab" * 500)]
    out += [(10 + i, base) for i in range(6)]
    for i in range(30):
        w = base.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        out.append((20 + i, " ".join(w)))
    out += [(60 + i, f"{words(rng, 40)} {passage} {words(rng, 30)}") for i in range(12)]
    out += [(80 + i, words(rng, rng.randrange(1, 80))) for i in range(30)]
    out += [(200, "it's <|endoftext|> MIT License, gnu GENERAL public-license. CC  BY! 日本語")]
    out += [(210, thue_morse("ab")), (211, thue_morse("ba")), (212, " ".join(thue_morse("ab"))), (213, " ".join(thue_morse("ba")))]
    return out + [(10, base), (4, "short")]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 0.5, 1, 2, 3, "h", "t", 4) for i, t in texts]
    return spark.createDataFrame(rows, EXTRA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


# -- shared -------------------------------------------------------------------------------------------------------


def test_spans_are_numbered_by_their_bytes(monkeypatch):
    rng = random.Random(12)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(500)] + [thue_morse("ab"), thue_morse("ba"), "c" * 3000, "c" * 3000]
    ends = np.cumsum([len(x) for x in parts])
    starts, data = ends - [len(x) for x in parts], np.frombuffer("".join(parts).encode(), np.uint8)
    for hashes in (common.span_hashes, lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3)):  # the second one collides
        monkeypatch.setattr(common, "span_hashes", hashes)
        codes, first = common.number_spans(data, starts, ends)
        assert [parts[first[c]] for c in codes] == parts and len(first) == len(set(parts))


# -- 1 ------------------------------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.standard_normal((400, 8)), 1)
    x[50:200] = x[50]  # copies, so ties
    rows = [(i, v.tolist(), 0.1, 3) for i, v in enumerate(x)] + [(900, None, 0.1, 3), (901, [1.0, None], 0.1, 3), (902, [float("nan")] * 8, 0.1, 3), (903, [float("inf")] * 8, 0.1, 3), (5, (x[5] + 1).tolist(), 0.1, 3), (904, [9.0], 0.1, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, rank int")
    vectors = topk_search.integer_vectors(df)
    got = topk_search.exact_topk(vectors, F.col("id") % 50 == 0, 5, rows_per_range=100, queries_per_group=3).orderBy("query_id", "rank").collect()
    codes = [(i, np.floor(256 * v).astype(int)) for i, v in [*enumerate(x), (5, x[5] + 1)]] + [(904, np.array([2304] + [0] * 7))]
    for q in range(0, 400, 50):
        want = sorted(((-int(codes[q][1] @ c), i) for i, c in codes if i != q))[:5]
        assert [(-r.score, r.id) for r in got if r.query_id == q] == want
    assert topk_search.exact_topk(vectors.limit(0), F.col("id") % 50 == 0, 5).count() == 0
    assert topk_search.exact_topk(vectors.where("id < 3"), F.col("id") == 0, 5).count() == 2


def test_blocks_are_pruned():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16)) * 50
    x = np.concatenate([c + rng.standard_normal((100, 16)) for c in centres]).astype(np.int64)
    _, _, scored = topk_search.block_max_topk(x[:10], np.arange(10), x, np.arange(len(x)), 5)
    assert scored < 10 * len(x) / 2


# -- 2 ------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    bad = ["\\### Assistant: </turn> ok", "<turn user>\nx</turn>\n", "\\l\\s\\\\<<", "", "\n", None, "日本"]
    rows = [(c, t, role, bad[(c + t) % len(bad)], 1) for c in range(8) for t, role in enumerate(["system", "user", "assistant", "a<b>\nc\\", None])] + [(0, 1, "user", bad[1], 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    for c in range(8):
        mine = sorted(((t, role or "", x or "") for k, t, role, x, _ in rows if k == c))
        assert [(t.role, t.text) for t in back[c].turns] == [(role, x) for _, role, x in mine]
        assert back[c].loss_text == "".join(x for _, role, x in mine if role == "assistant")
    assert chat_format.format_conversations(df.limit(0)).count() == 0 and chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_order_and_long_texts(spark):
    rows = [(1, None, "user", "last"), (1, 0, "user", "="), (1, 0, "user", "<"), (1, 0, "user", "<"), (None, 0, "assistant", "x<" * 200_000)]
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [t.text for t in back[1].turns] == ["<", "<", "=", "last"]
    assert back[None].loss_text == "x<" * 200_000 and back[None].n_attachments == 0


def test_chat_parts(spark):
    part = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [(1, 0, "user", [("text", "see <image 0>", None, None, None, None, None), ("image", None, "a.png", 56, 57, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 2), (None, None, None, None, None, None, None)]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    r = chat_format.format_conversations(df, parts="parts").first()
    assert r.formatted == "<turn user>\nsee \\limage 0><image 1><audio 2><document 3></turn>\n<turn assistant>\n</turn>\n"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 2 * 3), (0, 2, "audio", "b.wav", 38), (0, 3, "document", "c.pdf", 1024)]
    assert r.expanded_tokens == 6 + 38 + 1024


# -- 3 ------------------------------------------------------------------------------------------------------------


def test_gradient_and_normalisation():
    net = pseudo_likelihood.Network()
    rng = np.random.default_rng(2)
    context = rng.integers(0, pseudo_likelihood.VOCABULARY + 1, (40, 4))
    target = rng.integers(0, pseudo_likelihood.VOCABULARY, 40)
    every = np.repeat(context[:1], pseudo_likelihood.VOCABULARY, axis=0)
    assert abs(np.exp(net.log_probabilities(every, np.arange(pseudo_likelihood.VOCABULARY))).sum() - 1) < 1e-4
    g = net.gradient(context, target).flat
    at = np.argsort(-np.abs(g))[:5]
    for i in at:
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        slope = (pseudo_likelihood.Network(up).log_probabilities(context, target).mean() - pseudo_likelihood.Network(down).log_probabilities(context, target).mean()) / 2e-2
        assert abs(slope - g[i]) < 0.02 * abs(g[i]) + 1e-4


def test_text_in_order_is_likelier(spark):
    rng = random.Random(3)
    chain = {i: [rng.randrange(60) for _ in range(3)] for i in range(60)}

    def sample(n):
        out = [rng.randrange(60)]
        while len(out) < n:
            out.append(rng.choice(chain[out[-1]]))
        return out

    train = spark.createDataFrame([(i, " ".join(f"t{w}" for w in sample(150))) for i in range(1500)], "doc_id long, text string")
    frequent, net = pseudo_likelihood.train(train.repartition(3))
    fresh = [sample(100) for _ in range(40)]
    a = pseudo_likelihood.score(spark.createDataFrame([(i, " ".join(f"t{w}" for w in s)) for i, s in enumerate(fresh)], "doc_id long, text string"), frequent, net).toPandas().set_index("doc_id")
    b = pseudo_likelihood.score(spark.createDataFrame([(i, " ".join(f"t{w}" for w in rng.sample(s, len(s)))) for i, s in enumerate(fresh)], "doc_id long, text string"), frequent, net).toPandas().set_index("doc_id")
    assert (a.log_likelihood > b.log_likelihood).mean() > 0.95


def test_scores_of_awkward_texts(docs, empty, texts):
    out = pseudo_likelihood.score(docs, *pseudo_likelihood.train(docs, rounds=1)).collect()
    assert len(out) == len(texts)
    for r in out:
        assert np.isfinite(r.log_likelihood) and (r.mean_log_likelihood is None) == (r.n_tokens == 0)
    assert pseudo_likelihood.score(empty, *pseudo_likelihood.train(empty)).count() == 0


def test_training_does_not_depend_on_partitions(docs):
    a, b = (pseudo_likelihood.train(d, rounds=1)[1].flat for d in (docs, docs.repartition(2)))
    assert np.array_equal(a, b)


def test_held_out_loss_is_below_that_of_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fresh = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    words, net = pseudo_likelihood.train(docs.where(~fresh))
    got = pseudo_likelihood.score(docs.where(fresh), words, net).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first()
    counts, n, total = {}, 0, 0.0

    def hashes(frame):
        for r in frame.select("text").collect():
            data = np.frombuffer((r.text or "").encode(), np.uint8)
            yield pseudo_likelihood.word_hashes(data, np.array([0, len(data)]))[0].tolist()

    for found in hashes(docs.where(~fresh)):
        for w in found:
            counts[w] = counts.get(w, 0) + 1
    every = sum(counts.values())
    for found in hashes(docs.where(fresh)):
        n += len(found)
        total += sum(np.log(counts.get(w, 1) / every) for w in found)
    assert n == got[1] and got[0] / n > total / n + 0.1, (got[0] / n, total / n)


def test_scores_tell_rare_words_apart(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "HELD", 1000)
    monkeypatch.setattr(pseudo_likelihood, "TOKENS_A_PART", 10_000)
    word_of = [w for i in range(3200) for w in [f"c{i}"] * 12] + [w for i in range(400) for w in [f"r{i}"] * (1 + i % 7)]
    random.Random(5).shuffle(word_of)
    rows = [(i % 300, " ".join(word_of[i * 50 : i * 50 + 50])) for i in range(-(-len(word_of) // 50))]  # ids repeat, with other texts
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words, net = pseudo_likelihood.train(docs, rounds=1)
    assert len(words.held) <= 1000 and words.rest.count() > 0
    got = sorted((r.doc_id, r.n_tokens, r.log_likelihood) for r in pseudo_likelihood.score(docs, words, net).collect())
    tokens, want = pseudo_likelihood.Tokens(words.frequent), []
    data = {}
    for _, text in rows:
        b = np.frombuffer(text.encode(), np.uint8)
        data[text] = pseudo_likelihood.word_hashes(b, np.array([0, len(b)]))
    count: dict[int, int] = {}
    for _, text in rows:
        for w in data[text][0].tolist():
            count[w] = count.get(w, 0) + 1
    ids = {w: int(tokens.of(np.array([w], np.uint64), np.array([0, 1]))[1][0]) for w in count}
    in_class: dict[int, int] = {}
    for w, i in ids.items():
        in_class[i] = in_class.get(i, 0) + count[w]
    for doc, text in rows:
        c, t = tokens.of(*data[text])
        share = sum(np.log(count[w] / in_class[ids[w]]) for w in data[text][0].tolist())
        want.append((doc, len(t), float(net.log_probabilities(c, t).astype(float).sum() + share)))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], atol=1e-2)


# -- 4 ------------------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 24))
    x[100:600] = x[100]  # a third are copies
    x[250, 1:] = 0
    rows = [(i, v.tolist() if i != 250 else v[:1].tolist(), 1.0) for i, v in enumerate(x)] + [(3000, None, 1.0), (3001, [0.0] * 24, 1.0), (3002, [float("nan")] * 24, 1.0), (7, x[7].tolist(), 1.0)]
    vectors = neighbour_graph.clean_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, d double"))
    got = neighbour_graph.nearest(vectors, F.col("id") % 100 == 0).toPandas()
    hits = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.allclose(mine.score, d[mine.id], atol=1e-12) and (np.diff(mine.score) >= 0).all()
        hits, total = hits + len(set(mine.id) & set(want)), total + 10
        if 100 <= q < 600 and q != 250:
            assert mine.id.tolist() == want.tolist()  # ties go to smaller ids
    assert hits / total >= 0.9
    assert neighbour_graph.nearest(vectors.limit(0), F.col("id") % 100 == 0).count() == 0
    assert neighbour_graph.nearest(vectors.where("id IN (0, 1, 2)"), F.col("id") == 0).count() == 2


def test_walk_reaches_nodes_in_no_list(spark):
    n = 200
    packed = lambda i: np.array([i, 1.0], "<f4").tobytes()
    nodes = spark.createDataFrame([(i, bytearray(packed(i))) for i in range(n)], "node long, packed binary")
    leaves = nodes.select("node", "packed", F.lit(0).alias("tree"), F.lit(0).alias("leaf"))
    lost = nodes.orderBy(F.xxhash64("node").desc()).first().node  # no start of the leaf
    rest = [i for i in range(n) if i != lost]
    graph = [(a, b, 1.0) for a, b in zip(rest, rest[1:])] + [(b, a, 1.0) for a, b in zip(rest, rest[1:])] + [(lost, rest[0], 1.0)]
    graph = spark.createDataFrame(graph, "node long, other long, d float")
    queries = nodes.where(F.col("node") == 5).select(F.col("node").alias("query"), "node", "packed")
    found = {r.node for r in neighbour_graph.walk(queries, leaves, graph, nodes).collect()}
    assert lost in found
    assert neighbour_graph.beam_of(10_000) == neighbour_graph.BEAM < neighbour_graph.beam_of(50_000) < neighbour_graph.beam_of(500_000)


def test_lists_of_hubs_are_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(neighbour_graph, "LIST", 10)
    graph = spark.createDataFrame([(i, 0, 1.0) for i in range(1, 101)], "node long, other long, d float")
    lists = [r.others for r in neighbour_graph.lists_of(graph).where("node = 0").collect()]
    assert len(lists) > 5 and sorted(x for v in lists for x in v) == list(range(1, 101))


# -- 5 ------------------------------------------------------------------------------------------------------------


def test_licences_equal_brute_force(docs, empty, texts):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        found = [(k, label) for p, label in license_scan.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in found})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert license_scan.scan_licenses(empty).count() == 0


def test_licence_expressions():
    assert license_scan.parse_expression("MIT OR (GPL-2.0-only AND Apache-2.0)") == (["mit", "gpl-2.0-only", "apache-2.0"], True)
    assert license_scan.parse_expression("GPL-2.0-only WITH Classpath-exception-2.0 AND MIT")[1] is False
    assert license_scan.parse_expression("GPL-2.0-only WITH Classpath-exception-2.0")[0][0] == "gpl-2.0-only with classpath-exception-2.0"
    assert license_scan.parse_expression("MIT and") == (["mit"], True)
    assert license_scan.parse_expression("(MIT") == ([], None) and license_scan.parse_expression("") == ([], None) and license_scan.parse_expression("OR MIT") == ([], None)
    assert license_scan.parse_expression("MIT */ text") == (["mit"], True)


def test_tags_and_notices(spark):
    rows = [
        (1, "x\n// SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0)\nrest"),
        (2, "# spdx-license-identifier : Apache-2.0 AND GPL-3.0+ */ more"),
        (3, "SPDX-License-Identifier: see file"),
        (4, "SPDX-License-Identifier:\nMIT"),
        (5, "SPDX License Identifier MIT"),
        (6, "Permission is hereby granted, free of charge, to all. public domain"),
        (7, "é SPDX-License-Identifier: BSD-3-Clause\r\nSPDX-License-Identifier: LicenseRef-own"),
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "gpl-2.0-only,gpl-2.0-only with classpath-exception-2.0,mit" and got[1].permissive and got[1].score == 1.0
    assert got[2].labels == "apache-2.0,gpl-3.0+" and got[2].permissive is False
    assert [got[i].labels for i in (3, 4, 5)] == ["", "", ""] and got[3].score == 0.0
    assert got[6].labels == "mit,public-domain" and abs(got[6].score - (1 - 0.1 * 0.7)) < 1e-12
    assert got[7].labels == "bsd-3-clause,licenseref-own" and got[7].permissive is False


# -- 6 ------------------------------------------------------------------------------------------------------------


def shingles(t: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts}
    top = {i: i for i in sets}
    for _ in range(len(sets)):
        changed = False
        for i in sets:
            for j in sets:
                if i < j and sets[i] and sets[j] and top[i] != top[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    low, high = sorted((top[i], top[j]))
                    top = {k: low if v == high else v for k, v in top.items()}
                    changed = True
        if not changed:
            return top
    return top


def test_components_equal_brute_force(docs, empty, texts):
    got = jaccard_join.near_duplicate_classes(docs).collect()
    want = brute_components(texts)
    assert len(got) == len(texts)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(shingles(dict(texts)[r.doc_id])) for r in got)
    assert sum(want[i] != i for i in want) > 20
    assert jaccard_join.near_duplicate_classes(empty).count() == 0


def test_large_groups_are_split(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "CROWD", 2)
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicate_classes(docs).collect()} == brute_components(texts)


def crowd_of_unlike_texts(copies: int) -> list[tuple[int, str]]:
    """Texts that share half of their shingles, so they meet, but do not link; ``copies`` of them have a copy with another last word."""
    line = " ".join(f"line{k}" for k in range(10))
    rows = [(i, f"{line} {' '.join(f'own{i}x{k}' for k in range(6))}") for i in range(40)]
    return rows + [(100 + i, t.rsplit(" ", 1)[0] + " other") for i, t in rows[:copies]]


def test_texts_are_sent_only_where_links_may_be(spark, monkeypatch):
    sent, send = [], jaccard_join.texts_of

    def counted(placed, *rest):
        sent.append(placed.count())
        return send(placed, *rest)

    monkeypatch.setattr(jaccard_join, "texts_of", counted)
    rows = crowd_of_unlike_texts(2)
    got = jaccard_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
    assert 4 <= sum(sent) <= 12  # the pairs' texts, and not all 42 that met


def test_large_groups_of_unlike_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "CROWD", 2)
    rows = crowd_of_unlike_texts(15)
    got = jaccard_join.near_duplicate_classes(spark.createDataFrame(rows + rows[:3], "doc_id long, text string")).collect()
    assert len(got) == 58 and {r.doc_id: r.component_id for r in got} == brute_components(rows)


@pytest.mark.parametrize("percent, most", [(75, 1 << 16), (75, 256), (30, 1 << 16)])
def test_bounds_leave_out_no_link(monkeypatch, percent, most):
    monkeypatch.setattr(jaccard_join, "SKETCH", most)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in rng.integers(1, 1500, 40)]
    sets += [np.unique(np.append(rng.permutation(s)[: max(1, int(len(s) * rng.uniform(percent / 100, 1)))], rng.integers(0, 1 << 63, 2, np.uint64))) for s in sets[:25]]
    side, n = rng.integers(0, 2, len(sets)), np.array([len(s) for s in sets])
    maps = [jaccard_join.sketch(s) for s in sets]
    for sides in (np.zeros(len(sets), np.int64), side):
        want = np.zeros(len(sets), bool)
        for i, a in enumerate(sets):
            for k, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if sides[i] + sides[k] < 2 and 100 * both >= percent * (len(a) + len(b) - both):
                    want[[i, k]] = True
        found = jaccard_join.within_bounds(n, maps, sides, percent)
        assert want.sum() > 10 and (found | ~want).all() and (most == 256 or percent == 30 or found.sum() < len(sets))


def test_a_full_table_of_bits_loses_no_row(spark, monkeypatch):
    docs = spark.createDataFrame([(i - 500, f"t{i}") for i in range(1000)] + [(None, "x"), (1, None)], "doc_id long, text string")
    named = docs.where("pmod(doc_id, 10) = 0").selectExpr("doc_id AS rep")
    for slots in (1 << 27, 1 << 15):
        monkeypatch.setattr(jaccard_join, "SLOTS", slots)
        got = {r.doc_id for r in jaccard_join.among(docs, named).collect()}
        assert {i for i in range(-500, 500) if i % 10 == 0} <= got and len(got) < 200
    monkeypatch.setattr(jaccard_join, "SLOTS_AN_ID", 0)
    monkeypatch.setattr(jaccard_join, "PAGE", 8)
    assert {i for i in range(-500, 500) if i % 10 == 0} <= {r.doc_id for r in jaccard_join.among(docs, named).collect()}


def test_links_are_confirmed_by_words(docs, texts, monkeypatch):
    nodes, sets = np.arange(3), [np.arange(10, dtype=np.uint64)] * 3
    said = {(0, 1): False, (0, 2): True, (1, 2): False}
    assert jaccard_join.link_group(nodes, sets, None, 75, lambda i, k: said[min(i, k), max(i, k)]) == [(2, 0)]
    assert jaccard_join.linked(b"a b c d e f", b"a b c d e f", 5, 75) and not jaccard_join.linked(b"a b c d e f", b"a b c d e g", 5, 75)


# -- 7 ------------------------------------------------------------------------------------------------------------


def test_isotonic():
    x, y = np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.0])
    knots, values = toxicity.isotonic(x, y)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all() and abs(values[0]) < 1e-9


def test_toxicity_on_held_out(spark):
    rng = random.Random(6)
    bad = ["vrok", "zlub", "grent", "plook"]
    rows, labels = [], []
    for i in range(1500):
        w, toxic = [f"w{rng.randrange(300)}" for _ in range(60)], int(rng.random() < 0.2)
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "s", "ing"])
        rows.append((i, " ".join(w), "x", 1.0))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame([*rows, (5000, None, "x", 1.0), (5001, "", "x", 1.0)], "doc_id long, text string, lang string, toxicity_score double")
    lab = spark.createDataFrame([*labels, (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    out = toxicity.with_scores(docs, model, "s").select("doc_id", "s").toPandas().set_index("doc_id").s
    assert out.between(0, 1).all() and out[5000] < 0.5 and out[5001] < 0.5
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(out[i] >= 0.5) == bool(labels[i][2]) for i in held])
    assert right > 0.97
    nothing = toxicity.fit(docs, lab.limit(0))
    assert toxicity.with_scores(docs, nothing, "s").where("s <> 0").count() == 0
    assert toxicity.with_scores(docs.limit(0), model, "s").count() == 0
    again = spark.createDataFrame([(1, "b", "x", 1.0), (1, "a", "x", 1.0), (1, None, "x", 1.0)], docs.schema)
    assert [(r.toxic, r.text) for r in toxicity.training_rows(again, spark.createDataFrame([(1, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")).collect()] == [(1, "a")]


def test_toxicity_of_the_given_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.with_scores(docs.select("doc_id", "text"), toxicity.fit(docs, labels), "s").where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").select("s", "toxic").toPandas()
    toxic, clean = scored.s[scored.toxic == 1].to_numpy(), scored.s[scored.toxic == 0].to_numpy()
    assert (toxic[:, None] > clean).mean() + (toxic[:, None] == clean).mean() / 2 > 0.9
    long = spark.createDataFrame([(1, "you plain word " * 300_000)], "doc_id long, text string")
    assert toxicity.with_scores(long, toxicity.fit(docs, labels), "s").count() == 1


def test_features_equal_counts_one_at_a_time():
    lexicon = np.sort(np.array([toxicity._word_hash("bad")], np.uint64))
    text = "You are BAD, b4d! fine looool"
    data = np.frombuffer(text.encode(), np.uint8)
    f = dict(zip(toxicity.FEATURES, toxicity.feature_rows(data, np.array([0, len(data)]), lexicon)[0]))
    assert f["hits_share"] == 2 / 6 and abs(f["log_hits"] - np.log(3)) < 1e-12 and abs(f["log_disguised_hits"] - np.log(2)) < 1e-12
    assert f["hits_near_you_share"] == 1.0 and f["you_share"] == 1 / 6 and f["capitals_share"] == sum(c.isupper() for c in text) / sum(c.isalpha() for c in text)
    assert f["all_capitals_share"] == 1 / 6 and f["shout_share"] == 1 / len(text) and f["punctuation_share"] == 2 / len(text)
    assert f["disguised_share"] == 1 / 6 and f["stretched_share"] == 1 / 6 and abs(f["log_words"] - np.log(7)) < 1e-12


# -- 8 ------------------------------------------------------------------------------------------------------------


def test_hilbert_neighbours_touch():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(side**3))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_packing_is_exact(docs, empty, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    p = packing.pack_documents(docs).toPandas()
    totals = p.groupby("sequence_id").length.sum()
    assert (totals.drop(totals.index.max()) == 1024).all() and totals.index.tolist() == list(range(len(totals)))
    q = p.sort_values(["sequence_id", "offset"])
    assert (q.groupby("sequence_id").length.cumsum() - q.length == q.offset).all()
    single = {i: x for i, x in texts if sum(j == i for j, _ in texts) == 1}
    for i, x in single.items():
        mine = p[p.doc_id == i].sort_values("start")
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(mine.ids) == ids.tobytes() and (mine.doc_tokens == len(ids)).all()
        assert [zlib.crc32(b) for b in mine.ids] == mine.ids_crc32.tolist()
    assert packing.pack_documents(empty).count() == 0


# -- 9 ------------------------------------------------------------------------------------------------------------


def brute_removal(texts) -> dict[int, tuple]:
    first: dict[bytes, tuple[int, int]] = {}
    raw = {i: (t or "").encode() for i, t in texts}
    for i in sorted(raw):
        for j in range(len(raw[i]) - 99):
            first.setdefault(raw[i][j : j + 100], (i, j))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 99):
            if first[b[j : j + 100]] != (i, j):
                gone[j : j + 100] = True
        out[i] = (len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_removal_equals_brute_force(docs, empty, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs).collect()}
    assert got == brute_removal(texts)
    assert suffix_dedup.digests(empty).count() == 0
    clean = suffix_dedup.cleaned(docs)
    assert clean.columns == docs.columns and clean.count() == len(texts)


def test_crowded_anchors_are_split(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "OCCURRENCES_A_GROUP", 3)
    monkeypatch.setattr(suffix_dedup, "SORTED", 200)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 300)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs).collect()}
    assert got == brute_removal(texts)


def test_blind_trie_and_sort():
    rng = random.Random(9)
    raw = "".join(rng.choice("ab") for _ in range(3000)) + "abab" * 200
    data, starts = np.frombuffer(raw.encode(), np.uint8), np.arange(0, 3600)
    for group in (np.zeros(len(starts), np.int64), starts % 3):
        order, new = suffix_dedup.deep_shallow_sort(data, starts, np.full(len(starts), 40), group)
        strings = [(group[i], raw[starts[i] : starts[i] + 40]) for i in order]
        assert strings == sorted(strings) and sorted(order) == list(range(len(starts)))
        assert [strings[0] != strings[-1], *(a != b for a, b in zip(strings, strings[1:]))] == new.tolist()


def test_rows_that_repeat_an_id(spark):
    rng = random.Random(13)
    a, b = words(rng, 60), words(rng, 60)
    big = 2**62 + 1
    rows = [(1, a), (1, a), (1, b), (big, b), (None, b), (3, None)]
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == sorted([(1, len(a), 0), (1, len(a), 0), (1, len(b), 0), (big, len(b), len(b)), (0, len(b), 0), (3, 0, 0)])


def test_removed_bytes_come_from_sorted_neighbours(monkeypatch):
    rng = random.Random(14)
    passage = words(rng, 40)
    raw = [f"{words(rng, 20)} {passage} {words(rng, 20)}".encode() for _ in range(5)]
    offsets, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
    gram, doc, start, end = suffix_dedup.stretches(data, offsets, 100, 24)
    places = suffix_dedup._packed(suffix_dedup._PLACE, gram=gram, doc=doc, mark=np.zeros(len(doc)), start=start, length=end - start, part=np.zeros(len(doc)), groups=np.ones(len(doc)))
    pdf = pd.DataFrame({"doc_id": [0], "mark": [0], "places": [suffix_dedup._squeezed(places)], "data": [suffix_dedup._squeezed(np.frombuffer(b"".join(raw[d][a:z] for d, a, z in zip(doc, start, end)), np.uint8))]})
    found = suffix_dedup.sort_bucket(100)(pdf)
    assert sorted(found.doc_id) == [1, 2, 3, 4]
    kept = suffix_dedup.later_ones
    monkeypatch.setattr(suffix_dedup, "later_ones", lambda order, new, places: kept(order, np.ones(len(new), bool), places))
    assert not len(suffix_dedup.sort_bucket(100)(pdf))  # without equal neighbours nothing goes


# -- 10 -----------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(docs, empty, texts):
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(bpe.default_path()), bpe.Bpe()
    lexicon = bpe_transducer.build_lexicon(docs, b, 500)
    got = {r.doc_id: r for r in bpe_transducer.digests(docs, b, lexicon).collect()}
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_transducer.digests(empty, b, bpe_transducer.build_lexicon(empty, b)).count() == 0


def test_pretokens_equal_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, b, rng = Tokenizer.from_file(bpe.default_path()), bpe.Bpe(), random.Random(10)
    pool = list("aZ09 '\n\t.,!é日🎉 　Ⅷ²") + ["'s", "'re", "'ll", "'LL", "  ", " '", "<|endoftext|>", "<|endof"]
    cases = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(1500)]
    points = [*range(0x80, 0x800), *range(0x1C80, 0x1C90), *range(0xA7C0, 0xA7E0), *range(0x105C0, 0x105F0)] + [rng.choice([c for c in (rng.randrange(0x110000),) if not 0xD800 <= c < 0xE000] or [0x3042]) for _ in range(3000)]
    cases += [f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)}b {chr(c)} " for c in points] + [thue_morse("ab"), thue_morse("ba"), thue_morse("ab") + " " + thue_morse("ba")]
    for x, ids in zip(cases, bpe.Encoder(b).documents(pa.array(cases))):
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_words_with_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, b, rng = Tokenizer.from_file(bpe.default_path()), bpe.Bpe(), random.Random(15)
    few = lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(4)
    monkeypatch.setattr(common, "span_hashes", few)
    monkeypatch.setattr(bpe, "span_hashes", few)
    monkeypatch.setattr(common, "RUN_BYTES", 200)
    cases = [words(rng, rng.randrange(30)) for _ in range(60)]
    for x, ids in zip(cases, bpe.Encoder(b).documents(pa.array(cases))):
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids


def test_transducer_shares_suffixes():
    b = bpe.Bpe()
    listed = sorted(f"{p}{s}".encode() for p in ("a", "b", "cd", "ce") for s in ("tion", "tions", "ting", "ed"))
    m = bpe_transducer.Transducer.mapped(bpe_transducer.Transducer.build(listed, b.merge(listed)).to_bytes())
    assert len(m.final) < 20  # of 70 in a tree of prefixes
    assert all(np.array_equal(x, y) for x, y in zip(m.lookup(listed), b.merge(listed)))
    assert m.lookup([b"", b"ation!", b"ati", b"zz"]) == [None] * 4


# -- all ----------------------------------------------------------------------------------------------------------


def test_registry_and_pipeline(spark):
    import corpus_pipeline

    assert [n.split("_")[0] for n in registry.queries()] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.select("doc_id").toPandas().doc_id
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        assert set(kept.select("doc_id").toPandas().doc_id) <= set(before)
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) == {r.doc_id for r in kept.select("doc_id").collect()}
    assert isinstance(out, pd.DataFrame) and out.groupby("sequence_id").length.sum().max() == 1024
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").select("doc_id")
    stage = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    clean = docs.join(labels, "doc_id", "left_semi").count()
    assert stage.join(labels, "doc_id", "left_semi").count() >= 0.97 * clean


def test_pipeline_cut_keeps_texts_that_were_empty(spark):
    import corpus_pipeline

    passage = "".join(chr(97 + i * i % 23) + str(i) for i in range(60))[:120]
    rows = [(1, None, 0), (2, "", 0), (3, passage, 120), (4, passage, 120), (5, "short", 5)]
    out = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), SF).collect()
    got = {r.doc_id: (r.text, r.n_chars) for r in out}
    assert got[1] == (None, 0) and got[2] == ("", 0) and got[3] == (passage, 120) and got[5] == ("short", 5)
    assert 4 not in got or (len(got[4][0]) == got[4][1] > 0)


def test_pipeline_on_awkward_tables(spark, docs, empty, texts):
    import corpus_pipeline

    kept = empty
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        assert kept.count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    want = brute_components(texts)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i in want if want[i] == i)  # repeated rows stay once
    again = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "other words of the same id", 3), (None, "x", 4), (None, "x", 5), (2, None, 6), (2, None, 7)], "doc_id long, text string, odd int")
    assert sorted(((r.doc_id or 0), r.text) for r in corpus_pipeline.drop_near_duplicates(spark, again, SF).collect() if r.text) == [(0, "x"), (0, "x"), (1, "a b c d e f"), (1, "other words of the same id")]
