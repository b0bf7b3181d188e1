"""Near-duplicate documents by SimHash: fingerprints of 64 bits, linked where at most RADIUS bits differ, in BK-trees.

Texts are lower-cased (A-Z) and split at blanks; every shingle of WIDTH words, repeats included, is hashed by XXH64, and a bit
of the fingerprint is 1 if it is set in over half of the hashes. Equal fingerprints are one node from here on.

Two fingerprints that differ in at most RADIUS bits agree on ``pick`` whole blocks of bits out of RADIUS + ``pick``, so a
fingerprint goes to one shard for each choice of ``pick`` blocks, and the shards hold every link. A shard of more than
CROWDED fingerprints, as a large group of near copies makes, is dealt out once more by the bits it has not used yet; when
12 bits are left a shard cannot hold more than 4,096. No group is capped, and no more than a shard meets anywhere.

Each shard has a BK-tree: a node's children are keyed by their integer Hamming distance to it. A search follows only the
edges whose number is within the radius of the query's distance, which by the triangle inequality loses no link. A task
holds the trees of many shards side by side in arrays and walks them together. Of each shard's links the task returns only
as many as join its components. Linked fingerprints get their smallest one by repeated joins.

Defined cases: a null or blank text has fingerprint 0, which links like any other; a text of fewer words than a shingle is
one shingle; any length is read whole; repeated rows give repeated results; a row without a doc_id brings its fingerprint's
links, but is nobody's component, and its component is null if no linked row has an id; rows that repeat a doc_id with other
texts stand for themselves; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import LOWER, doc_texts, saved, table
from cellwright.llm.jaccard_join import smallest_reachable, spread_join

WIDTH, RADIUS, SEED = 4, 4, 42
#: A larger shard is dealt out by further bits; with so few bits left it is not.
CROWDED, LAST_BITS = 2048, 12
#: Rows of shards a task holds, and pairs a search holds at most.
ROWS, PAIRS = 200_000, 2_000_000
#: So many crowded shards are joined by broadcast; more are not.
BROADCAST_ROWS = 1_000_000
_LOWER = LOWER.tobytes()


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The fingerprint of one text, unsigned."""
    words = text.translate(_LOWER).split()  # bytes split at 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - width, 0)
    spans = zip(starts[: last + 1].tolist(), ends[len(words) - last - 1 :].tolist())
    hashed = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in spans], "<u8")
    set_ = np.zeros(64, np.int64)
    for i in range(0, len(hashed), 1 << 16):
        set_ += np.unpackbits(hashed[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(hashed), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp: a fingerprint as a signed number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):  # bounded lists of texts
                rows = batch.slice(first, 256)
                found = np.array([fingerprint((t or "").encode(), width) for t in rows.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return doc_texts(docs).mapInArrow(scan, "doc_id long, fp long")


class Forest:
    """BK-trees over runs of distinct codes; ``starts`` are the places where runs begin. The first code of a run is its root."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        n = len(codes)
        self.codes = codes
        self.root = np.repeat(starts, np.diff(np.append(starts, n)))
        live = np.flatnonzero(self.root != np.arange(n))
        at = self.root[live]  # the node that each code not placed yet has come down to
        key, child = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(live):
            edge = at * 65 + np.bitwise_count(codes[live] ^ codes[at])
            order = np.argsort(edge, kind="stable")
            edge, live = edge[order], live[order]
            new = np.append(True, edge[1:] != edge[:-1])
            key.append(edge[new])
            child.append(live[new])
            at = np.repeat(live[new], np.diff(np.append(np.flatnonzero(new), len(live))))[~new]
            live = live[~new]
        key, child = np.concatenate(key), np.concatenate(child)
        order = np.argsort(key)
        self.edges, self.children = key[order], child[order]

    def links(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (query, earlier code of its run) at a distance of at most ``radius``."""
        node = self.root[queries]
        query, node = queries[node < queries], node[node < queries]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        while len(query):
            apart = np.bitwise_count(self.codes[query] ^ self.codes[node]).astype(np.int64)
            hit = apart <= radius
            found.append((query[hit], node[hit]))
            low = np.searchsorted(self.edges, node * 65 + np.maximum(apart - radius, 0))
            many = np.searchsorted(self.edges, node * 65 + np.minimum(apart + radius, 64), side="right") - low
            query = np.repeat(query, many)
            node = self.children[np.arange(len(query)) + np.repeat(low - np.cumsum(many) + many, many)]
            query, node = query[node < query], node[node < query]  # whatever is below a node comes after it
        return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest place of each component) after the links (a, b)."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def shard_links(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): fingerprints that connect what is connected in each shard."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    once = np.append(True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]))
    key, fp = key[once], fp[once]
    alone = np.append(True, key[1:] != key[:-1])
    several = ~(alone & np.append(alone[1:], True))
    key, codes = key[several], fp[several].view(np.uint64)
    if not len(codes):
        return fp[:0], fp[:0]
    forest = Forest(codes, np.flatnonzero(np.append(True, key[1:] != key[:-1])))
    label, place = np.arange(len(codes)), np.arange(len(codes))
    block = np.cumsum(place - forest.root) // PAIRS  # a query meets at most the codes before it in its run
    for queries in np.split(place, np.flatnonzero(np.diff(block)) + 1):
        label = merge(label, *forest.links(queries, radius))
    tied = np.flatnonzero(label != place)
    return codes[tied].view(np.int64), codes[label[tied]].view(np.int64)


def levels(radius: int, pick: int) -> list[tuple[int, int, int]]:
    """(blocks, pick, bits a block) for each time that shards are dealt out."""
    out, bits = [], 64
    while not out or bits > LAST_BITS:
        size = math.ceil(bits / (radius + pick))
        out.append((radius + pick, pick, size))
        bits, pick = radius * size, 2
    return out


def _dealt(rows: DataFrame, blocks: int, pick: int, size: int) -> DataFrame:
    """fp, key, rest: rows (fp, key, rest) go to one shard for each choice of blocks of ``rest``; a new rest has the other blocks."""
    block = [F.shiftrightunsigned("rest", i * size).bitwiseAND(F.lit((1 << size) - 1)) if i * size < 64 else F.lit(0).cast("long") for i in range(blocks)]

    def packed(places) -> F.Column:
        out = F.lit(0).cast("long")
        for k, i in enumerate(places):
            out = out.bitwiseOR(F.shiftleft(block[i], k * size))
        return out

    shards = [F.struct(F.xxhash64("key", F.lit(c), packed(taken)).alias("key"), packed([i for i in range(blocks) if i not in taken]).alias("rest")) for c, taken in enumerate(combinations(range(blocks), pick))]
    return rows.select("fp", F.explode(F.array(*shards)).alias("s")).select("fp", "s.key", "s.rest")


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: pairs of the different fingerprints ``fp`` that connect all that differ in at most ``radius`` bits."""
    n = prints.count()
    plan = levels(radius, 2 if n < 1 << 31 else 3)
    rows, edges = prints.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), None

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(pdf["key"].to_numpy(), pdf["fp"].to_numpy(), radius)
        return pd.DataFrame({"a": a, "b": b})

    for depth, (blocks, pick, size) in enumerate(plan):
        rows = _dealt(rows, blocks, pick, size)
        n *= math.comb(blocks, pick)
        further = None
        if depth + 1 < len(plan):
            crowd = saved(rows.groupBy("key").count().where(F.col("count") > CROWDED).select("key"), "crowded")
            if many := crowd.count():
                mark = crowd.withColumn("crowded", F.lit(True))
                marked = rows.join(F.broadcast(mark), "key", "left") if many <= BROADCAST_ROWS else spread_join(rows, mark, ["key"], "fp")
                further, rows = saved(marked.where("crowded").select("fp", "key", "rest"), "shards"), marked.where("crowded IS NULL")
        part = F.pmod(F.xxhash64(F.col("key"), F.lit(7)), F.lit(max(12, math.ceil(n / ROWS)))).alias("part")
        found = rows.groupBy(part).applyInPandas(compare, "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if further is None:
            break
        rows, n = further, further.count()
    return saved(edges.distinct(), "links")


def near_duplicate_classes(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed), component_id of every document."""
    prints = saved(fingerprints(docs, width), "prints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    labels = smallest_reachable(near_links(classes, radius)).withColumnRenamed("node", "fp")
    named = classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    components = spread_join(named.select("fp", "label"), smallest, ["label"], "fp").select("fp", "component_id")
    return spread_join(prints, components, ["fp"], "doc_id").select("doc_id", "fp", "component_id")


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
