"""Token ids in patched frame-of-reference blocks, in files ordered by document.

A file is a Parquet part; its rows are segments, each with whole documents in ascending doc_id and the payload of their
ids. A payload cuts the ids into blocks of BLOCK: a block's minimum is subtracted, the rest is packed at the width that
holds the PERCENTILE of its values, and what doesn't fit is kept whole in the block's exception list. Before the blocks
stand, block by block, minimum, width and number of exceptions, and the index of block starts (bytes from the first).

Defined results: a null text is an empty one; the end id is there for every document; rows with the same doc_id follow by
a hash of their text; null doc_ids come last; an empty table gives no files and an empty result; other columns are not read.
"""

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, shared_folder
from .tokens import encoder

BLOCK = 128
#: Share of a block's values that the packed width must hold.
PERCENTILE = 0.9
#: A segment is closed when it has as many ids.
SEGMENT = 1 << 16
END_ID = 1
SEGMENTS = "seq long, doc_ids array<long>, lengths array<int>, n_ids long, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """The payload of some ids below 2**32."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.array([0], "<u4").tobytes()
    x = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1])]).astype(np.int64).reshape(blocks, BLOCK)
    low = x.min(axis=1)
    x -= low[:, None]
    widths = np.frexp(np.partition(x, int(BLOCK * PERCENTILE), axis=1)[:, int(BLOCK * PERCENTILE)].astype(float))[1].astype(np.int64)
    over = x >= (np.int64(1) << widths)[:, None]
    rows, places = np.nonzero(over)
    patches = over.sum(axis=1)
    values = (x[over]).astype("<u4")
    starts = np.concatenate([[0], np.cumsum(widths * (BLOCK // 8) + 5 * patches)])
    body = np.zeros(starts[-1], np.uint8)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        if w:
            wide = 16 if w <= 16 else 32
            bits = np.unpackbits((x[at] << (wide - w)).astype(f">u{wide // 8}").view(np.uint8), axis=1).reshape(len(at), BLOCK, wide)
            packed = np.packbits(bits[:, :, :w].reshape(len(at), -1), axis=1)
            body[starts[at][:, None] + np.arange(packed.shape[1])] = packed
    if len(rows):
        nth = np.arange(len(rows)) - np.concatenate([[0], np.cumsum(patches)])[rows]
        base = starts[rows] + widths[rows] * (BLOCK // 8)
        body[base + nth] = places.astype(np.uint8)
        base = base + patches[rows] + 4 * nth
        body[base[:, None] + np.arange(4)] = values.view(np.uint8).reshape(-1, 4)
    head = [np.array([n], "<u4"), low.astype("<u4"), widths.astype(np.uint8), patches.astype(np.uint8), starts[:-1].astype("<u4")]
    return b"".join(a.tobytes() for a in head) + body.tobytes()


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids that were packed, or those from place `first` up to `last`; the block index leads to the blocks that hold them."""
    n = int(np.frombuffer(payload, "<u4", 1)[0])
    every = -(-n // BLOCK)
    first, last = max(0, first), n if last is None else min(n, last)
    if first >= last:
        return np.zeros(0, np.uint32)
    skipped = first // BLOCK
    blocks = -(-last // BLOCK) - skipped
    low = np.frombuffer(payload, "<u4", blocks, 4 + 4 * skipped).astype(np.int64)
    widths = np.frombuffer(payload, np.uint8, blocks, 4 + 4 * every + skipped).astype(np.int64)
    patches = np.frombuffer(payload, np.uint8, blocks, 4 + 5 * every + skipped).astype(np.int64)
    starts = np.frombuffer(payload, "<u4", blocks, 4 + 6 * every + 4 * skipped).astype(np.int64)
    body = np.frombuffer(payload, np.uint8, -1, 4 + 10 * every)
    x = np.zeros((blocks, BLOCK), np.int64)
    for w in np.unique(widths):
        if w:
            at = np.flatnonzero(widths == w)
            packed = body[starts[at][:, None] + np.arange(w * (BLOCK // 8))]
            wide = 16 if w <= 16 else 32
            bits = np.zeros((len(at), BLOCK, wide), np.uint8)
            bits[:, :, :w] = np.unpackbits(packed, axis=1).reshape(len(at), BLOCK, w)
            x[at] = np.packbits(bits.reshape(len(at), -1), axis=1).view(f">u{wide // 8}") >> (wide - w)
    if patches.any():
        rows = np.repeat(np.arange(blocks), patches)
        nth = np.arange(len(rows)) - np.concatenate([[0], np.cumsum(patches)])[rows]
        base = starts[rows] + widths[rows] * (BLOCK // 8)
        values = np.ascontiguousarray(body[(base + patches[rows] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        x[rows, body[base + nth]] = values
    return (x + low[:, None]).reshape(-1)[first - skipped * BLOCK : last - skipped * BLOCK].astype(np.uint32)


def segments(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Segments of all documents, in order of doc_id from partition to partition and within."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        kinds = pa.schema([("seq", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("payload", pa.binary())])
        seq, doc_ids, lengths, ids = 0, [], np.zeros(0, np.int64), np.zeros(0, coder.type)

        def closed(names: list, sizes: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            row = {"seq": seq, "doc_ids": names, "lengths": sizes.tolist(), "n_ids": len(own), "payload": pack(own)}
            return pa.RecordBatch.from_pylist([row], kinds)

        for batch in batches:
            new, n = coder.ids(batch.column("text"))
            doc_ids += batch.column("doc_id").to_pylist()
            ids, lengths = np.concatenate([ids, np.insert(new, np.cumsum(n), end_id)]), np.concatenate([lengths, n + 1])
            ends, start, row = np.cumsum(lengths), 0, 0
            while row < len(ends) and ends[-1] - start >= SEGMENT:
                last = int(np.searchsorted(ends, start + SEGMENT)) + 1
                yield closed(doc_ids[row:last], lengths[row:last], ids[start : ends[last - 1]])
                start, row, seq = int(ends[last - 1]), last, seq + 1
            doc_ids, lengths, ids = doc_ids[row:], lengths[row:], ids[start:]
        if len(lengths):
            yield closed(doc_ids, lengths, ids)

    keys = [F.col("doc_id").asc_nulls_last(), F.col("_hash")]
    lined = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    lined = lined.repartitionByRange(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    return lined.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, SEGMENTS).withColumn("part", F.spark_partition_id())


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> None:
    """Token files of all documents in a new folder."""
    segments(docs, tokenizer, end_id).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the token files.

    Where a part starts follows from the sums of the parts before it, where a segment starts from those within its part.
    """

    def open_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, ends = unpack(row.payload).astype("<u4"), np.cumsum(row.lengths)
                starts = ends - row.lengths
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                doc_ids = pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], dtype="Int64")
                yield pd.DataFrame({"doc_id": doc_ids, "start": starts + row.before, "n_tokens": ends - starts, "ids_crc32": sums})

    files = spark.read.parquet(folder)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("_own"))
    starts = starts.join(parts, F.col("part") == F.col("_part")).select(F.col("part").alias("_p"), F.col("seq").alias("_s"), (F.col("_own") + F.col("_before")).alias("before"))
    found = files.join(starts, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s"))).select("doc_ids", "lengths", "payload", "before")
    return found.mapInPandas(open_segments, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id, token_ids of those documents in the token files whose doc_id is in `wanted`; only the blocks that hold them are unpacked."""

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ends = np.cumsum(row.lengths)
                ids = [unpack(row.payload, ends[k] - row.lengths[k], ends[k]).tolist() for k in row.places]
                yield pd.DataFrame({"doc_id": [row.doc_ids[k] for k in row.places], "token_ids": ids})

    files = spark.read.parquet(folder)
    placed = files.select("part", "seq", F.posexplode("doc_ids").alias("pos", "doc_id"))
    placed = placed.join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    # A segment has no more documents than ids, so the list of those wanted has a bound.
    placed = placed.groupBy("part", "seq").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    return files.join(placed, ["part", "seq"]).select("doc_ids", "lengths", "payload", "places").mapInPandas(seek, "doc_id long, token_ids array<long>")


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the token files of docs to the shared folder and describes the documents as read from them."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid4().hex}"
    write(docs, tokenizer, folder, end_id)
    return read(docs.sparkSession, folder)
