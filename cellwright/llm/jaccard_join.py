"""Exact Jaccard join of documents on word shingles, by prefix filters under several global orders.

A pair with similarity t or more shares a token among the first n - ceil(t n) + 1 tokens of both sets, whatever global
order the tokens are put in. The first order is rare-first: by how often a token's hashed counter was hit over all
documents (a table of a fixed size, so it can be broadcast), then by hash. Posting lists are built from the prefixes under
this order. The smallest member of a list is its hub, and every member is sent to its hub once: any two members of a list
meet in the hub's group, and what is sent grows with the number of postings, not with pairs. In a group, two documents
are compared only if nothing links them there yet, and only after the filters are intersected: sizes, the Hamming bound of
bitmaps, and a shared prefix token under every further order. Then the sets decide, and the words themselves confirm a link.

A group above GROUP documents is dealt over blocks, and the hub goes to every block. A document that its block connects
with the hub is settled: it need not look for other settled ones. Only the others meet documents of other blocks, and of
those only the ones whose distance from the hub differs by no more than a link allows (Jaccard distance is a metric).

Texts travel last. Documents meet first as a size and a bitmap of about a bit a token; only where another document of the
group lies within the bounds of both are texts sent there. Before any text is shuffled, a table of bits of the wanted ids
leaves out the others.
Linked documents get their smallest id by repeated joins, in which crowded keys are dealt over SALTS parts.

Equal sets are one class from the start: a task posts a set once, a list holds it once, and one document stands for it.
Classes are told apart by two 64-bit sums; one of the sums names a set in lists, where two sets of one name only meet.

Defined cases: a null or blank text has an empty set and links with nothing; a text of fewer words than a shingle is one
shingle; any length is read whole; repeated rows give repeated results; a row without a doc_id brings no links, and has the
component of the rows with an equal set, if any; rows that repeat a doc_id with other texts are linked through it; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import LOWER, doc_texts, mix, saved, shingle_hashes, table, text_runs

WIDTH, PERCENT = 5, 75
COUNTERS, CHUNKS = 1 << 19, 16
#: Further orders besides the rare-first one, as seeds.
ORDERS = (0x51ED27, 0xA24BAE)
GROUP, BITMAP, SKETCH = 512, 2048, 1 << 16
POSTINGS_A_BUCKET = 2_000_000
#: A key of more than CROWD rows is dealt over SALTS parts in joins.
CROWD, SALTS = 4096, 64
#: Steps of the distance from a hub.
STEPS = 20
#: Slots of a table of bits that stands for ids: so many an id, up to a fixed number; PAGE of them are a row.
SLOTS_AN_ID, SLOTS, PAGE = 16, 1 << 27, 1 << 15
#: Prefixes are longer by SHARED - 1 tokens than one shared token needs, so linked sets share SHARED of them.
SHARED = 4


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_runs(column):
        hashes, at = shingle_hashes(data, offsets, width)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield np.unique(hashes[a:b])


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers of a set."""
    both = np.array([tokens.sum(dtype=np.uint64), mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)
    name, check = mix(mix(both) + both[::-1]).view(np.int64).tolist()
    return name, check


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Left join of ``many`` with ``one``, which has one row a key; a key of more than CROWD rows is dealt over SALTS parts by ``by``."""
    crowd = many.groupBy(*keys).count().where(F.col("count") > CROWD).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(crowd.withColumn("crowded", F.lit(True)), [*keys, "salt"], "left")
    left = salted.withColumn("salt", F.when(F.col("crowded"), F.col("salt")).otherwise(0)).drop("crowded")
    right = one.join(crowd, keys, "left").withColumn("salt", F.coalesce("salt", F.lit(0)))
    return left.join(right, [*keys, "salt"], "left").drop("salt")


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def document_sets(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, digest, check of every row; chunk, at, hits: what each task adds to the counters), in one written scan."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sizes, digests, checks = [], [], []
            for tokens in _sets(batch.column("text"), width):
                sizes.append(len(tokens))
                digest, check = _digest(tokens)
                digests.append(digest)
                checks.append(check)
                np.add.at(counters, (tokens % np.uint64(COUNTERS)).astype(np.int64), 1)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), pa.array(checks, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())], names)
        step = COUNTERS // CHUNKS
        chunks = [(i, np.flatnonzero(c), c) for i, c in enumerate(counters.reshape(CHUNKS, step)) if c.any()]
        none = pa.nulls(len(chunks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([i for i, _, _ in chunks], pa.int32()), pa.array([at.astype("<i4").tobytes() for _, at, _ in chunks], pa.binary()), pa.array([c[at].astype("<i4").tobytes() for _, at, c in chunks], pa.binary())], names)

    names = ["doc_id", "n", "digest", "check", "chunk", "at", "hits"]
    both = saved(doc_texts(docs).mapInArrow(scan, "doc_id long, n long, digest long, check long, chunk int, at binary, hits binary"), "sets")
    return both.where("chunk IS NULL").select("doc_id", "n", "digest", "check"), both.where("chunk IS NOT NULL").select("chunk", "at", "hits")


def hit_ranks(hits: DataFrame) -> np.ndarray:
    """The summed counters: a table of COUNTERS numbers, whatever the input's size. Added up in two levels."""

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTERS // CHUNKS, np.int64)
        for at, n in zip(pdf["at"], pdf["hits"]):
            at, n = np.frombuffer(at, "<i4"), np.frombuffer(n, "<i4")
            total[at] += n
        at = np.flatnonzero(total)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "at": [at.astype("<i4").tobytes()], "hits": [np.minimum(total[at], 2**31 - 1).astype("<i4").tobytes()]})

    schema = "chunk int, at binary, hits binary"
    first = hits.groupBy("chunk", F.pmod(F.xxhash64("at"), F.lit(16))).applyInPandas(added, schema)
    out = np.zeros(COUNTERS, np.int64)
    for r in first.groupBy("chunk").applyInPandas(added, schema).collect():  # CHUNKS rows
        out[r.chunk * (COUNTERS // CHUNKS) + np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["hits"], "<i4")
    return out


def postings(docs: DataFrame, ranks: np.ndarray, buckets: int, width: int, percent: int) -> DataFrame:
    """bucket, tokens, nodes, counts, sizes: prefix tokens of each different set of a task, packed by bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = ["bucket", "tokens", "nodes", "counts", "sizes"]

    def packed(held: list[tuple[int, np.ndarray, int]]) -> pa.RecordBatch:
        tokens = np.concatenate([t for _, t, _ in held])
        node = np.repeat(np.arange(len(held)), [len(t) for _, t, _ in held])
        bucket = (tokens >> np.uint64(32)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        digests, sizes = np.array([d for d, _, _ in held], np.int64), np.array([n for _, _, n in held], "<i4")
        out: list[list] = [[] for _ in names]
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            first = np.flatnonzero(np.diff(node[part], prepend=-1))
            out[0].append(int(bucket[part[0]]))
            out[1].append(tokens[part].astype("<u8").tobytes())
            out[2].append(digests[node[part[first]]].tobytes())
            out[3].append(np.diff(np.append(first, len(part))).astype("<i4").tobytes())
            out[4].append(sizes[node[part[first]]].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen, held, size = shared.value, set(), [], 0
        for batch in batches:
            for tokens in _sets(batch.column("text"), width):
                if not len(tokens) or (d := _digest(tokens)) in seen:
                    continue
                seen.add(d)
                order = np.lexsort((tokens, rank[(tokens % np.uint64(COUNTERS)).astype(np.int64)]))
                held.append((d[0], tokens[order[: prefix_length(len(tokens), percent) + SHARED - 1]], len(tokens)))
                size += len(held[-1][1])
                if size > 2_000_000:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return doc_texts(docs).select("text").mapInArrow(scan, "bucket int, tokens binary, nodes binary, counts binary, sizes binary")


def hub_members(posted: DataFrame, percent: int = PERCENT) -> DataFrame:
    """hub, node: which documents have to meet, every pair once.

    A list ordered by set size is cut wherever a size is too far above the one before it: no pair across a cut can link.
    Of a list of two or three the pairs are counted by themselves, over all lists: linked sets share SHARED tokens of
    their prefixes (fewer, if their overlap can be smaller), so a pair that meets less often and in no longer list is
    dropped. In longer lists every member meets the list's hub.
    """

    def lists(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(x, "<u8") for x in pdf["tokens"]])
        counts = np.concatenate([np.frombuffer(x, "<i4") for x in pdf["counts"]])
        nodes = np.repeat(np.concatenate([np.frombuffer(x, "<i8") for x in pdf["nodes"]]), counts)
        sizes = np.repeat(np.concatenate([np.frombuffer(x, "<i4") for x in pdf["sizes"]]), counts).astype(np.int64)
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        alone = np.append(True, ordered[1:] != ordered[:-1])
        order = order[~(alone & np.append(alone[1:], True))]
        order = order[np.lexsort((nodes[order], sizes[order], tokens[order]))]
        tokens, nodes, sizes = tokens[order], nodes[order], sizes[order]
        # a set posted by several tasks stands in a list once
        once = np.append(True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])) if len(tokens) else np.empty(0, bool)
        tokens, nodes, sizes = tokens[once], nodes[once], sizes[once]
        if not len(tokens):
            return pd.DataFrame({"hub": [], "node": [], "met": [], "need": []}).astype("int64")
        new = np.append(True, (tokens[1:] != tokens[:-1]) | (100 * sizes[:-1] < percent * sizes[1:]))
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(nodes)))
        at = [(first[length == 2], 0, 1), *((first[length == 3], i, j) for i, j in ((0, 1), (0, 2), (1, 2)))]
        a, b = np.concatenate([f + i for f, i, _ in at]), np.concatenate([f + j for f, _, j in at])
        need = np.minimum(SHARED, -(-percent * sizes[b] // 100))  # sizes[b] is the larger one
        short = np.stack([np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b]), need], 1)
        many = np.repeat(length > 3, length)
        hub = np.repeat(np.minimum.reduceat(nodes, first), length)
        star = np.stack([hub, nodes, np.zeros(len(hub), np.int64)], 1)[many & (hub != nodes)]
        pairs, met = np.unique(np.concatenate([short, star]), axis=0, return_counts=True)
        return pd.DataFrame({"hub": pairs[:, 0], "node": pairs[:, 1], "met": met, "need": pairs[:, 2]})

    found = posted.groupBy("bucket").applyInPandas(lists, "hub long, node long, met long, need long")
    return found.groupBy("hub", "node").agg(F.sum("met").alias("met"), F.min("need").alias("need")).where("met >= need").select("hub", "node")


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps: bits set in one of two bitmaps only are at most as many as tokens in one of the sets only."""
    out = np.zeros((len(sets), BITMAP // 64), np.uint64)
    for row, tokens in zip(out, sets):
        bit = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % BITMAP, minlength=BITMAP) & 1
        row[:] = np.packbits(bit.astype(np.uint8)).view(np.uint64)
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def link_group(nodes: np.ndarray, sets: list[np.ndarray], sides: np.ndarray | None, percent: int = PERCENT, confirm=lambda i, k: True) -> list[tuple[int, int]]:
    """Links that connect all documents of a group that are connected in it; at most one less than documents.

    sides: with two different values, only documents of different sides are compared. confirm: of two places in ``nodes``,
    whether they link by their words.
    """
    n = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((nodes, n))
    nodes, n, sets = nodes[order], n[order], [sets[i] for i in order]
    side = sides[order] if sides is not None and len(np.unique(sides)) > 1 else None
    maps = _bitmaps(sets)
    top = np.arange(len(nodes))  # by document the first document of its component
    prefixes: dict[int, list[set]] = {}

    def prefix(i: int) -> list[set]:
        if i not in prefixes:
            p = prefix_length(len(sets[i]), percent)
            prefixes[i] = [set(np.partition(mix(sets[i] ^ np.uint64(seed)), p - 1)[:p].tolist()) for seed in ORDERS]
        return prefixes[i]

    links = []
    for i in range(1, len(nodes)):
        low = int(np.searchsorted(n, -(-percent * n[i] // 100)))
        j = np.arange(low, i)
        j = j[top[j] != top[i]]
        if side is not None:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        apart = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)
        most = (100 - percent) * (n[j] + n[i]) // (100 + percent)
        j, apart = j[apart <= most], apart[apart <= most]
        for k in j[np.argsort(apart, kind="stable")].tolist():
            if top[k] == top[i] or not all(a & b for a, b in zip(prefix(i), prefix(k))):
                continue
            both = _overlap(sets[i], sets[k])
            if 100 * both >= percent * (n[i] + n[k] - both) and confirm(int(order[i]), int(order[k])):
                links.append((int(nodes[i]), int(nodes[k])))
                top[top == top[i]] = top[k]
    return links


def _shingles(words: list[bytes], width: int) -> set[tuple]:
    return set(zip(*(words[k:] for k in range(width)))) if len(words) >= width else {tuple(words)}


def linked(a: bytes, b: bytes, width: int, percent: int) -> bool:
    """Whether two normalised texts link, by their words."""
    x, y = _shingles(a.split(), width), _shingles(b.split(), width)
    return 100 * len(x & y) >= percent * len(x | y)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """A parity bitmap of at least a bit a token, up to SKETCH bits; of two of different widths, the wider one is folded to the other's width."""
    bits = min(max(64, 1 << max(len(tokens) - 1, 0).bit_length()), SKETCH)
    bit = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(bit.astype(np.uint8)).view(np.uint64)


def within_bounds(n: np.ndarray, maps: list[np.ndarray], sides: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which sets, given as sizes and sketches, have another one that sizes and bitmaps allow to link; two of side 1 are not compared."""
    order = np.argsort(n, kind="stable")
    n, side, maps = n[order], sides[order], [maps[i] for i in order]
    widths, first = np.unique([len(x) for x in maps], return_index=True)  # they rise with the sizes
    stacks = {int(w): (a, np.stack(maps[a:b])) for w, a, b in zip(widths, first.tolist(), [*first[1:].tolist(), len(maps)])}
    found = np.zeros(len(n), bool)
    for i in range(1, len(n)):
        low, x = int(np.searchsorted(n, -(-percent * n[i] // 100))), maps[i]
        while low < i:
            start, stack = stacks.get(len(x), (0, maps[:0]))
            a, b = max(low, start), min(i, start + len(stack))
            if a < b:
                apart = np.bitwise_count(stack[a - start : b - start] ^ x).sum(1, dtype=np.int64)
                fits = (apart <= (100 - percent) * (n[a:b] + n[i]) // (100 + percent)) & ((side[a:b] == 0) | (side[i] == 0))
                found[a:b] |= fits
                found[i] |= fits.any()
            if len(x) <= len(maps[low]):
                break
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    out = np.empty(len(n), bool)
    out[order] = found
    return out


def near_rows(placed: DataFrame, keys: list[str], kept: list[str], percent: int) -> DataFrame:
    """``kept`` columns and near: of the documents of each group of ``keys`` (rep, n, sketch, side, is_hub, of_many), each once.

    near: whether another one of the group may link with it; the hub of a large group is near if any document is. Those that
    are not near are returned of large groups only.
    """
    types = dict(placed.dtypes)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, "side"], ignore_index=True).drop_duplicates([*keys, "rep"], ignore_index=True)
        start = np.flatnonzero(~pdf.duplicated(keys).to_numpy()).tolist()
        n, sides, maps = pdf["n"].to_numpy(), pdf["side"].to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf["sketch"]]
        hub, many = pdf["is_hub"].to_numpy(bool), pdf["of_many"].to_numpy(bool)
        near = np.zeros(len(pdf), bool)
        for a, b in zip(start, [*start[1:], len(pdf)]):
            near[a:b] = within_bounds(n[a:b], maps[a:b], sides[a:b], percent)
            near[a:b] |= hub[a:b] & many[a:b] & near[a:b].any()
        return pdf.assign(near=near)[[*kept, "near"]][near | many]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if len(pdf):
                pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()  # the last group may go on
                rest = pdf[last]
                yield whole(pdf[~last])
        if rest is not None:
            yield whole(rest)

    read = placed.select(*dict.fromkeys([*keys, *kept, "n", "sketch", "side", "is_hub", "of_many"]))
    return read.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(scan, ", ".join(f"{c} {types[c]}" for c in kept) + ", near boolean")


class Group:
    """Documents that meet, with their texts and sets."""

    def __init__(self, pdf: pd.DataFrame, width: int, percent: int):
        self.pdf = pdf = pdf.drop_duplicates("rep").sort_values("rep")
        self.nodes, self.texts, self.width, self.percent = pdf["rep"].to_numpy(), pdf["words"].tolist(), width, percent
        self.sets = list(_sets(pa.array(self.texts, pa.binary()).cast(pa.string()), width))

    def links(self, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
        return link_group(self.nodes, self.sets, sides, self.percent, lambda i, k: linked(self.texts[i], self.texts[k], self.width, self.percent))


def among(docs: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id and text of the rows of ``docs`` whose doc_id is a rep of ``named`` (best a written table), and of a few others.

    A table of bits stands for the ids: it is broadcast, and above SLOTS bits it only lets more others through.
    """
    slots = PAGE * min(SLOTS // PAGE, 1 + SLOTS_AN_ID * named.count() // PAGE)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    placed = named.select(slot("rep").alias("slot")).select((F.col("slot") / PAGE).cast("int").alias("page"), (F.col("slot") % PAGE).alias("at"))
    bits = placed.repartition("page").groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))
    rows = doc_texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("slot", slot("doc_id"))
    met = rows.withColumn("page", (F.col("slot") / PAGE).cast("int")).join(F.broadcast(bits), "page")
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("slot") % PAGE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (F.col("slot") % 8).cast("int")) == 1).select("doc_id", "text")


def sketches(docs: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """rep, digest, check of ``named`` with n, sketch: made where the texts are read, no text is shuffled."""
    names = ["rep", "digest", "check", "n", "sketch"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(*_digest(t), len(t), sketch(t).tobytes()) for t in _sets(batch.column("text"), width)]
            columns = zip(*made) if made else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names)

    made = among(docs, named).mapInArrow(scan, "rep long, digest long, check long, n long, sketch binary")
    return saved(made.join(named, names[:3]).dropDuplicates(names[:3]), "sketches")


def texts_of(placed: DataFrame, docs: DataFrame, columns: list[str], width: int) -> DataFrame:
    """``columns`` of ``placed`` (a written table; rep, digest, check among its columns) and words, the normalised text; rows of rep's doc_id with other texts are left out."""
    types = dict(placed.dtypes)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, packed = None, None, b""
        for batch in batches:
            for part in range(0, batch.num_rows, 256):  # bounded batches of texts
                rows, out = batch.slice(part, 256), []
                for name, check, text in zip(*(rows.column(c).to_pylist() for c in ("digest", "check", "text"))):
                    if digest is None or text != last:
                        last, digest = text, _digest(next(_sets(pa.array([text], pa.string()), width)))
                        packed = b" ".join(LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes().split())
                    out.append(packed if digest == (name, check) else None)
                done = pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(out, pa.binary())], [*columns, "words"])
                yield done.filter(done.column("words").is_valid())

    met = among(docs, placed).join(placed, F.col("doc_id") == F.col("rep"))
    return met.select(*dict.fromkeys([*columns, "digest", "check"]), "text").mapInArrow(normal, ", ".join(f"{c} {types[c]}" for c in columns) + ", words binary")


def links(docs: DataFrame, classes: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links between the documents that stand for different sets."""
    pairs = saved(members, "members")
    pairs = pairs.unionByName(pairs.select("hub", F.col("hub").alias("node")).distinct())
    large = saved(pairs.groupBy("hub").count().where(F.col("count") > GROUP).select("hub", F.ceil(F.col("count") / GROUP).cast("int").alias("blocks")), "large")
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    dealt = spread_join(pairs, large, ["hub"], "node").select("hub", "node", F.coalesce(block, F.lit(0)).alias("block"), F.col("blocks").isNotNull().alias("of_many"))
    every = dealt.unionByName(large.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("of_many")))
    named = saved(classes.join(pairs.select(F.col("node").alias("digest")).distinct(), "digest", "left_semi").select("rep", "digest", "check"), "named")
    sketched = sketches(docs, named, width)
    placed = every.join(sketched.withColumn("node", F.col("digest")), "node").withColumn("is_hub", F.col("node") == F.col("hub")).withColumn("side", F.lit(0))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links; and of a large group's block, by document, the distance from the hub and whether it is settled."""
        group = Group(pdf, width, percent)
        found = group.links()
        out = [(None, a, b, None, None) for a, b in found]
        if pdf["of_many"].iloc[0]:
            top = {int(x): int(x) for x in group.nodes}

            def root(x: int) -> int:
                while top[x] != x:
                    top[x] = x = top[top[x]]
                return x

            for a, b in found:
                top[root(a)] = root(b)
            hub, at = int(pdf["hub"].iloc[0]), int(np.flatnonzero(group.pdf["is_hub"].to_numpy())[0])
            for node, own in zip(group.nodes.tolist(), group.sets):
                both = _overlap(own, group.sets[at])
                step = int(STEPS * (1 - both / (len(own) + len(group.sets[at]) - both)))
                out.append((hub, node, None, step, root(node) == root(int(group.nodes[at]))))
        return pd.DataFrame(out, columns=["hub", "a", "b", "step", "settled"]).astype({"hub": "Int64", "a": "Int64", "b": "Int64", "step": "Int64", "settled": "boolean"})

    columns = ["hub", "block", "of_many", "is_hub", "rep"]
    met = saved(near_rows(placed, ["hub", "block"], [*columns, "digest", "check"], percent), "met")
    first = saved(texts_of(met.where("near"), docs, columns, width).groupBy("hub", "block").applyInPandas(compare, "hub long, a long, b long, step long, settled boolean"), "links")
    near = first.where("hub IS NULL").select("a", "b")
    if large.isEmpty():
        return near
    alone = met.where("NOT near").select("hub", F.col("rep").alias("a"), F.lit(None).cast("long").alias("step"), F.lit(False).alias("settled"))
    return near.unionByName(unsettled_links(docs, sketched, first.where("hub IS NOT NULL").select("hub", "a", "step", "settled").unionByName(alone), width, percent))


def unsettled_links(docs: DataFrame, sketched: DataFrame, seen: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links of unsettled documents of large groups with any documents of their group.

    Cells hold unsettled documents of one step of the distance against documents of steps near enough, both in blocks.
    Documents that were near none of their block have no step: they have cell -1, and meet every cell.
    """
    reach = math.ceil(STEPS * (100 - percent) / 100) + 1
    members = seen.groupBy("hub", F.col("a").alias("rep")).agg(F.max("step").alias("step"), F.max("settled").alias("settled"))
    open_ = members.where("NOT settled").select("hub", "rep", F.coalesce("step", F.lit(-1)).alias("cell"))
    cells = saved(open_.groupBy("hub", "cell").count().select("hub", "cell", F.ceil(F.col("count") / GROUP).cast("int").alias("rows")), "open")
    if cells.isEmpty():
        return seen.select("a", F.col("a").alias("b")).limit(0)
    low, high = F.coalesce(F.greatest(F.col("step") - reach, F.lit(0)), F.lit(0)), F.coalesce(F.col("step") + reach, F.lit(STEPS))
    others = members.withColumn("cell", F.explode(F.concat(F.array(F.lit(-1).cast("long")), F.sequence(low.cast("long"), high.cast("long"))))).select("hub", "rep", "cell")
    others = spread_join(others, cells, ["hub", "cell"], "rep").where("rows IS NOT NULL")
    across = saved(others.groupBy("hub", "cell").agg(F.count("*").alias("n"), F.max("rows").alias("rows")).select("hub", "cell", "rows", F.ceil(F.col("n") / GROUP).cast("int").alias("columns")), "cells")
    place = lambda n: F.pmod(F.xxhash64("rep", F.lit(2)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    down = spread_join(open_, across, ["hub", "cell"], "rep").withColumn("row", place("rows")).withColumn("column", spread("columns")).withColumn("side", F.lit(0))
    right = spread_join(others.drop("rows"), across, ["hub", "cell"], "rep").withColumn("column", place("columns")).withColumn("row", spread("rows")).withColumn("side", F.lit(1))
    keys = ["hub", "cell", "row", "column"]
    placed = down.select(*keys, "side", "rep").unionByName(right.select(*keys, "side", "rep")).join(sketched, "rep").withColumn("is_hub", F.lit(False)).withColumn("of_many", F.lit(False))
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side")  # a document on both sides counts as unsettled
        group = Group(pdf, width, percent)
        side = group.pdf["side"].to_numpy()
        found = group.links(side) if len(np.unique(side)) > 1 else []
        if (side == 0).sum() > 1:
            own = group.pdf[side == 0]
            found += Group(own, width, percent).links()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    met = saved(near_rows(placed, keys, ["side", *keys, "rep", "digest", "check"], percent), "met")
    return texts_of(met, docs, [*keys, "side", "rep"], width).groupBy(*keys).applyInPandas(compare, "a long, b long")


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """node, label: for every node of ``edges`` (a, b) the smallest node it is connected with."""
    both = saved(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        heard = spread_join(both, labels.withColumnRenamed("node", "b"), ["b"], "a").select(F.col("a").alias("node"), "label")
        near = labels.select("node", "label").union(heard).groupBy("node").agg(F.min("label").alias("label"))
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = saved(spread_join(near, jump, ["label"], "node").select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        settled = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        labels = new
        if settled:
            return labels


def near_duplicate_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    nodes, hits = document_sets(docs, width)
    size = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    buckets = max(24, math.ceil(size * (100 - percent) / 100 / POSTINGS_A_BUCKET))
    classes = saved(nodes.where("n > 0").groupBy("digest", "check").agg(F.min("doc_id").alias("rep")), "classes")
    members = hub_members(postings(docs, hit_ranks(hits), buckets, width, percent), percent)
    labels = smallest_reachable(links(docs, classes.where("rep IS NOT NULL"), members, width, percent))
    named = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("digest", "check", F.coalesce("label", "rep").alias("component_id"))
    full = spread_join(nodes.where("n > 0"), named, ["digest", "check"], "doc_id")
    empty = nodes.where("n = 0")
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(empty.select("doc_id", "n", "doc_id"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


#: All pairs by a join on shingles; only small tables are meant for it.
ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
shingles AS (
  SELECT doc_id, n, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS token
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sets AS (
  SELECT t.doc_id, coalesce(s, []) AS s FROM texts t LEFT JOIN (SELECT doc_id, list(DISTINCT token ORDER BY token) AS s FROM shingles WHERE i = 1 OR i <= n - 4 GROUP BY doc_id) d ON t.doc_id = d.doc_id),
classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT rep, n, unnest(s) AS token FROM classes),
shared AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n + b.n) AS total, count(*) AS common FROM tokens a JOIN tokens b ON a.token = b.token AND a.rep < b.rep GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 75 * (total - common)),
reach AS (SELECT rep AS node, rep AS other FROM classes UNION SELECT r.node, e.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON r.other = e.a),
components AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN components ON components.node = classes.rep"""
