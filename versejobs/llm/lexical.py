"""Ranked search by terms over an inverted index in shards.

A task gathers documents until a shard is full. A shard has a list of postings for each of its terms; a list is cut into
blocks, each with the bounds of its documents, the largest share that a posting of it adds to a score, and its postings,
packed at the widths that its documents' and occurrences' numbers need. Shards are rows of a Parquet folder, so an index
outlives its session and each shard is read by one task wherever it lies.

For each item a task goes through its shards one after another and keeps the best so far; the last one's score is the
floor. Lists come by their largest possible addition, and are essential as long as those behind them could lift
a document from nothing to the floor: these are opened whole. Then only documents met so far are left. Block maxima of the
other lists bound what they can still get; those that stay below the floor are rejected, and only blocks with one of the
others are unpacked. The best of each task's shards are merged by rank.

Items are sent to tasks in blocks with about TERMS terms, each block against the whole index.

Defined results: every row of the documents is a document, also where doc_ids are alike; null doc_ids come after others
of equal score; null text has no terms; rows with the same item_id, null among them, are one item with the terms of all; an
item without terms that occur has no result; an empty table gives an empty one; other columns are not read.
"""

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .terms import folding, numbers, sliced

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TABLE = folding(string.ascii_lowercase + string.digits)
#: Postings of a block.
BLOCK = 128
#: A shard is closed when it has as many documents or postings.
DOCUMENTS, POSTINGS = 1 << 16, 1 << 20
#: About as many terms of items are sent to tasks at a time.
TERMS = 200_000
SHARD = "doc_ids array<long>, lengths array<long>, terms array<string>, counts array<int>, first binary, last binary, doc_width binary, tf_width binary, most binary, body binary"


def sized(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = numbers(batch.column("text"), TABLE)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["docs", "terms"])

    got = docs.select("text").mapInArrow(count, "docs long, terms long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "terms")]).first()
    return got.docs, got.terms


def added(tf: np.ndarray, lengths: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term of weight 1 adds to the score of a document that has it `tf` times."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * lengths * docs // max(1, terms)))


def bits_of(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(float))[1].astype(np.int64)


def pack(values: np.ndarray, widths: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """Sets the bits of each value, which stand from its place `at` on."""
    for b in range(int(widths.max(initial=0))):
        on = np.flatnonzero((widths > b) & ((values >> b) & 1 == 1))
        bits[at[on] + b] = 1


def unpack(widths: np.ndarray, at: np.ndarray, body: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for b in range(int(widths.max(initial=0))):
        place = at + b
        bit = (body[np.minimum(place >> 3, len(body) - 1)] >> (place & 7)) & 1
        out |= np.where(widths > b, bit, 0).astype(np.int64) << b
    return out


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Builder:
    """A shard while documents are added."""

    def __init__(self):
        self.doc_ids, self.lengths, self.terms, self.parts, self.n = [], [], {}, [], 0

    def add(self, doc_ids: list, lengths: np.ndarray, rows: np.ndarray, codes: np.ndarray, tf: np.ndarray, names: list[str]) -> None:
        own = np.fromiter((self.terms.setdefault(x, len(self.terms)) for x in names), np.int64, len(names))
        self.parts.append(tuple(x.astype(np.int32) for x in (rows + len(self.doc_ids), own[codes], tf)))
        self.doc_ids += doc_ids
        self.lengths.append(lengths)
        self.n += len(rows)

    def close(self, docs: int, terms: int) -> pa.RecordBatch:
        doc, term, tf = (np.concatenate([p[k] for p in self.parts]).astype(np.int64) for k in range(3))
        lengths = np.concatenate(self.lengths)
        order = np.argsort(term, kind="stable")
        doc, tf, term = doc[order], tf[order], term[order]
        share = added(tf, lengths[doc], docs, terms)
        counts = np.bincount(term, minlength=len(self.terms))
        starts = np.flatnonzero(within(counts) % BLOCK == 0)
        sizes = np.diff(np.append(starts, len(doc)))
        first, last = doc[starts], doc[starts + sizes - 1]
        doc_width, tf_width = bits_of(last - first), bits_of(np.maximum.reduceat(tf, starts) - 1)
        each = np.repeat(doc_width + tf_width, sizes)
        at = np.cumsum(each) - each
        bits = np.zeros(int(each.sum()) + 8, np.uint8)
        pack(doc - np.repeat(first, sizes), np.repeat(doc_width, sizes), at, bits)
        pack(tf - 1, np.repeat(tf_width, sizes), at + np.repeat(doc_width, sizes), bits)
        row = {
            "doc_ids": self.doc_ids, "lengths": lengths, "terms": list(self.terms), "counts": counts, "first": first.astype("<u4").tobytes(), "last": last.astype("<u4").tobytes(),
            "doc_width": doc_width.astype(np.uint8).tobytes(), "tf_width": tf_width.astype(np.uint8).tobytes(), "most": np.maximum.reduceat(share, starts).astype("<u4").tobytes(), "body": np.packbits(bits, bitorder="little").tobytes(),
        }
        kinds = [pa.list_(pa.int64())] * 2 + [pa.list_(pa.string()), pa.list_(pa.int32())] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))


def built(batches: Iterator[pa.RecordBatch], size: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Shards of a task's documents."""
    own = Builder()
    for batch in batches:
        ids = batch.column("doc_id")
        for rows, codes, names in sliced(batch.column("text"), TABLE):
            if not len(rows):
                continue
            begins = np.concatenate([[True], rows[1:] != rows[:-1]])  # rows come in order
            there, at = rows[begins], np.cumsum(begins) - 1
            lengths = np.bincount(at)
            keys, tf = np.unique(at * len(names) + codes, return_counts=True)
            doc, code = keys // len(names), keys % len(names)
            start = 0  # a slice that doesn't fit goes to several shards
            while start < len(there):
                edges = np.searchsorted(doc, np.arange(start, len(there) + 1))
                room = max(1, int(np.searchsorted(edges, edges[0] + POSTINGS - own.n, side="right")) - 1)
                end = min(len(there), start + room, start + max(1, DOCUMENTS - len(own.doc_ids)))
                a, b = edges[0], edges[end - start]
                used, code_of = np.unique(code[a:b], return_inverse=True)
                own.add(ids.take(pa.array(there[start:end])).to_pylist(), lengths[start:end], doc[a:b] - start, code_of, tf[a:b], names.take(pa.array(used)).to_pylist())
                start = end
                if start < len(there) or own.n >= POSTINGS or len(own.doc_ids) >= DOCUMENTS:
                    yield own.close(*size)
                    own = Builder()
    if own.n:
        yield own.close(*size)


def shards(docs: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Shards of the documents that have terms; no exchange."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: built(batches, size), SHARD)


def write(docs: DataFrame, folder: str) -> None:
    """An index of the documents in a new folder. Its block maxima go by the number and the length of the documents in it."""
    size = sized(docs)
    found = shards(docs, size).withColumn("all_docs", F.lit(size[0]).cast("long")).withColumn("all_terms", F.lit(size[1]).cast("long"))
    found.write.option("parquet.block.size", 1 << 25).parquet(folder)


class Shard:
    """A shard as it is read; lists are unpacked by blocks."""

    def __init__(self, row: dict, known: pa.Array):
        self.doc_ids, self.size = row["doc_ids"], (row["all_docs"], row["all_terms"])
        self.lengths = row["lengths"].values.to_numpy()
        self.first, self.last, self.most = (np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("first", "last", "most"))
        self.doc_width, self.tf_width = (np.frombuffer(row[k], np.uint8).astype(np.int64) for k in ("doc_width", "tf_width"))
        self.body = np.frombuffer(row["body"], np.uint8)
        counts = row["counts"].values.to_numpy().astype(np.int64)
        blocks = -(-counts // BLOCK)
        #: The first block of each list, and the sizes of blocks.
        self.lists = np.concatenate([[0], np.cumsum(blocks)])
        self.sizes = np.minimum(BLOCK, np.repeat(counts, blocks) - BLOCK * within(blocks))
        ends = np.cumsum(self.sizes * (self.doc_width + self.tf_width))
        self.starts = ends - self.sizes * (self.doc_width + self.tf_width)
        self.top = np.maximum.reduceat(self.most, self.lists[:-1])
        #: The list of each known term, or -1.
        self.list_of = pc.fill_null(pc.index_in(known, value_set=row["terms"].values), -1).to_numpy(zero_copy_only=False)
        self.opened = 0

    def open(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of some blocks and what each adds for a weight of 1."""
        sizes = self.sizes[blocks]
        dw, tw = np.repeat(self.doc_width[blocks], sizes), np.repeat(self.tf_width[blocks], sizes)
        at = np.repeat(self.starts[blocks], sizes) + within(sizes) * (dw + tw)
        docs = np.repeat(self.first[blocks], sizes) + unpack(dw, at, self.body)
        self.opened += len(blocks)
        return docs, added(1 + unpack(tw, at + dw, self.body), self.lengths[docs], *self.size)


def kth(scores: np.ndarray, k: int, floor: int) -> int:
    """The floor that k scores set, if there are as many."""
    return max(floor, int(np.partition(scores, -k)[-k])) if len(scores) >= k else floor


def best(shard: Shard, lists: np.ndarray, weights: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that may be among the best k for the terms of some lists, none below the floor, and their scores."""
    order = np.argsort(-weights * shard.top[lists], kind="stable")
    lists, weights = lists[order], weights[order]
    rest = np.append(np.cumsum((weights * shard.top[lists])[::-1])[::-1], 0)
    total, new, i = np.zeros(len(shard.lengths), np.int64), 0, 0
    while i < len(lists) and rest[i] >= floor:
        docs, share = shard.open(np.arange(shard.lists[lists[i]], shard.lists[lists[i] + 1]))
        total[docs] += weights[i] * share
        new, i, floor = new + len(docs), i + 1, kth(total[docs], k, floor)
        if 4 * new >= len(total) or i == len(lists):  # as much work as was done since
            floor, new = kth(total, k, floor), 0
    left = np.flatnonzero((total > 0) & (total + rest[i] >= floor))
    score = total[left]
    # The block of each other list where a document would stand, and the most that it adds.
    at, most = np.full((len(lists) - i, len(left)), -1), np.zeros((len(lists) - i, len(left)), np.int64)
    for j in range(i, len(lists)):
        a, b = shard.lists[lists[j]], shard.lists[lists[j] + 1]
        block = a + np.searchsorted(shard.last[a:b], left)
        there = np.flatnonzero((block < b) & (shard.first[np.minimum(block, b - 1)] <= left))
        at[j - i, there], most[j - i, there] = block[there], weights[j] * shard.most[block[there]]
    ceiling, found = score + most.sum(axis=0), np.zeros(len(total), np.int64)
    for j in range(len(lists) - i):
        stay = ceiling >= floor
        left, score, ceiling, at, most = left[stay], score[stay], ceiling[stay], at[:, stay], most[:, stay]
        blocks = np.unique(at[j][at[j] >= 0])
        if not len(blocks):
            continue
        docs, share = shard.open(blocks)
        found[docs] = weights[i + j] * share
        own = found[left]
        found[docs] = 0
        score, ceiling = score + own, ceiling + own - most[j]
        floor = kth(score, k, floor)
    stay = score >= floor
    return left[stay], score[stay]


def best_of_shards(batches: Iterator[pa.RecordBatch], words: list[str], asked: list[tuple], names: list, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a task's shards for each item (names), from the numbers of its terms in `words` and their weights (asked)."""
    known = pa.array(words, pa.string())
    heaps: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(asked)
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r] for c in batch.schema.names}
            row = {c: v if c in ("doc_ids", "lengths", "terms", "counts") else v.as_py() for c, v in row.items()}
            ids, nulls = pc.fill_null(row["doc_ids"].values, 0).to_numpy(), pc.is_null(row["doc_ids"].values).to_numpy(zero_copy_only=False)
            shard = Shard(row, known)
            for i, (terms, weights) in enumerate(asked):
                on = shard.list_of[terms] >= 0
                if not on.any():
                    continue
                score, doc, null = heaps[i]
                docs, new = best(shard, shard.list_of[terms[on]], weights[on], kth(score, k, 1), k)
                score, doc, null = np.concatenate([score, new]), np.concatenate([doc, ids[docs]]), np.concatenate([null, nulls[docs]])
                top = np.lexsort((doc, null, -score))[:k]
                heaps[i] = score[top], doc[top], null[top]
    of = [names[i] for i, h in enumerate(heaps) for _ in h[0]]
    if of:
        score, doc, null = (np.concatenate([h[x] for h in heaps]) for x in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(doc, pa.int64(), mask=null), pa.array(score)], ["item_id", "doc_id", "score"])


def lowered(text: Column | str) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def weighed(spark: SparkSession, folder: str, items: DataFrame) -> DataFrame:
    """item_id, terms (an array of structs of term and w) of each item, with terms that occur in the index and weigh over 0."""
    index = spark.read.parquet(folder)
    first = index.select("all_docs").first()
    own = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(lowered("text"), F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    df = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    df = df.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * (first.all_docs if first else 0) + 2) / (2 * F.col("df") + 1))).cast("long")
    return own.join(df.select("term", w.alias("w")), "term").where("w > 0").groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"))


def search(spark: SparkSession, folder: str, items: DataFrame, k: int = 10, terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents in the index for each item (item_id, text)."""
    every = cut(weighed(spark, folder, items).withColumn("_n", F.size("terms")))
    n = every.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    blocks = -(-n // terms) or 1
    item_kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for b in range(blocks):
        own = every.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about `terms` terms, whatever the table
        part = searched(spark, folder, [(r.item_id, [(t.term, t.w) for t in r.terms]) for r in own], item_kind, k)
        found = part if found is None else found.unionByName(part)
    by = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def searched(spark: SparkSession, folder: str, items: list[tuple], item_kind: str, k: int) -> DataFrame:
    """item_id, doc_id, score: the best k of each task's shards."""
    words = sorted({t for _, terms in items for t, _ in terms})
    number = {t: i for i, t in enumerate(words)}
    asked = [(np.array([number[t] for t, _ in terms], np.int64), np.array([w for _, w in terms], np.int64)) for _, terms in items]
    sent = spark.sparkContext.broadcast((words, asked, [i for i, _ in items]))
    return spark.read.parquet(folder).mapInArrow(lambda batches: best_of_shards(batches, *sent.value, k), f"item_id {item_kind}, doc_id long, score long")
