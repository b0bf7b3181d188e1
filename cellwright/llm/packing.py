"""Packing of documents into sequences along a space-filling curve.

Every document is encoded once and kept with a hashed vector of its ids, projected to three dimensions. Each coordinate
is replaced by its quantile level over all documents, the levels give a Hilbert key, and documents are range-sorted by
(key, doc_id): neighbours on the curve have similar contents. Lengths alone are sorted and summed up; a document's place
in the one long stream of ids decides how it is cut into sequences. Only the last sequence can have padding.

Defined cases: a null text counts as empty and is the single id 0; a text of any length is cut freely; equal keys are
ordered by document id, then by row; repeated rows are packed as often as they occur; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.bpe import Bpe, Encoder
from cellwright.llm.common import doc_texts, mix, saved, table

LENGTH = 1024
DIMENSIONS, BITS, HASHED = 3, 8, 256
_SEED = 20_240_601


def hilbert_keys(levels: np.ndarray, bits: int) -> np.ndarray:
    """Keys of points with ``bits`` bits a coordinate: Gray-code transposition, all points at once."""
    x = levels.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) > 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def _projection(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every id its hashed place and sign; and the projection of hashed vectors."""
    h = mix(np.arange(size, dtype=np.uint64) + np.uint64(_SEED))
    plane = np.random.default_rng(_SEED).standard_normal((HASHED, DIMENSIONS))
    return (h % np.uint64(HASHED)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), plane


def encoded(docs: DataFrame, bpe: Bpe, end_id: int = 0) -> DataFrame:
    """row, doc_id, n, ids (binary, unsigned 16-bit where the vocabulary allows) and coordinates x0, x1, x2 of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe)
    names = ["row", "doc_id", "n", "ids", *(f"x{i}" for i in range(DIMENSIONS))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        encoder = Encoder(tables)
        place, sign, plane = _projection(len(tables.piece_length))
        kind = id_type(len(tables.piece_length))
        for batch in batches:
            lengths, blobs, points = [], [], []
            for ids in encoder.documents(batch.column("text")):
                vector = np.bincount(place[ids], sign[ids], HASHED)
                norm = np.sqrt((vector**2).sum())
                points.append(vector @ plane / norm if norm else np.zeros(DIMENSIONS))
                lengths.append(len(ids) + 1)
                blobs.append(np.append(ids, end_id).astype(kind).tobytes())
            xs = np.array(points).reshape(-1, DIMENSIONS)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary()), *(pa.array(xs[:, i]) for i in range(DIMENSIONS))], names)

    rows = doc_texts(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(encode, "row long, doc_id long, n long, ids binary, " + ", ".join(f"x{i} double" for i in range(DIMENSIONS)))


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def places(kept: DataFrame) -> DataFrame:
    """row, place: where each document begins in the stream of all ids, in the order of the curve. ``kept``: as from ``encoded``, written."""
    grid = [(i + 1) / (1 << BITS) for i in range((1 << BITS) - 1)]
    axes = [f"x{i}" for i in range(DIMENSIONS)]
    borders = [np.array(b) for b in (kept.approxQuantile(axes, grid, 0.0005) if not kept.isEmpty() else [[]] * DIMENSIONS)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = np.stack([np.searchsorted(b, batch.column(a).to_numpy(zero_copy_only=False)) for a, b in zip(axes, borders)], axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n")), pa.array(hilbert_keys(levels, BITS))], ["row", "doc_id", "n", "key"])

    keys = kept.select("row", "doc_id", "n", *axes).mapInArrow(keyed, "row long, doc_id long, n long, key long")
    ordered = saved(keys.repartitionByRange("key", "doc_id", "row").withColumn("part", F.spark_partition_id()), "curve")
    # one row a partition: small however many documents there are
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.sum("n").alias("total")).withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    local = ordered.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(F.broadcast(parts.select("part", "before")), "part").select("row", (F.col("before") + F.col("inside")).alias("place"))


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids: one row a piece."""
    bpe = Bpe(path)
    kind = id_type(len(bpe.piece_length))
    kept = saved(encoded(docs, bpe), "encoded")
    placed = kept.select("row", "doc_id", "ids").join(places(kept), "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, raw, place in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("place").to_pylist()):
                ids = np.frombuffer(raw.as_buffer(), kind).astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(place + start, length)
                    piece = ids[start : start + length - offset].tobytes()
                    n = len(piece) // 4
                    for column, value in zip(out, (doc, start, n, zlib.crc32(piece), len(ids), sequence, offset, piece)):
                        column.append(value)
                    start += n
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.binary())], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    return placed.mapInArrow(cut, ", ".join(f"{c} long" for c in names[:7]) + ", ids binary")


def op8_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), path).drop("ids")
