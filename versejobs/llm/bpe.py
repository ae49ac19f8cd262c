"""Encoding and decoding of whole texts with reuse of content-defined chunks.

A rolling hash over the bytes cuts texts at blanks and line ends, so equal passages give equal chunks wherever they stand.
Chunks that occur twice in the corpus are encoded once: their texts meet in one row, and the ids go to the places by a
join. What stands between them in a document is encoded there. Where two pieces meet, the whole words beside the join are
encoded together and apart. Where that differs, the document's pieces go on with their ids to be joined again beside its text:
a window of words on both sides of such a join is encoded, and grows until its outer halves agree with the ids of both sides,
at the latest when it holds both sides whole. All ids outside the windows stay those of the pieces.

Which chunks are shared is told to the tasks by a bit map of fixed size: a wrong bit sends a chunk the longer way, with
the same result. Rows with the same text are encoded once.

Defined results: null is the empty text, with no ids and an empty decoded text; a text without blanks is one chunk; repeated
rows get equal results; null doc_ids keep their rows; an empty table gives an empty result; other columns are not read.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions
from .tokens import encoder

#: Bytes in the rolling hash (a power of two), and how many of its bits must be 0 where a chunk ends.
ROLL, BITS = 16, 7
#: Bits of the map of shared chunks.
MAP_BITS = 1 << 25
#: Texts handled at a time in a task, and most texts that a task remembers as done.
SLICE, SEEN = 200, 200_000
GEAR = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)


def chunked(texts: list[str]) -> list[list[str]]:
    """The chunks of each text; joined, they are the text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    x = np.frombuffer(b"".join(raw), np.uint8)
    if not len(x):
        return [[] for _ in texts]
    h, span = GEAR[x], 1
    while span < ROLL:
        h[span:] = h[span:] + (h[:-span] << np.uint64(span))
        span *= 2
    blank = (x == 32) | (x == 10)
    ends = np.zeros(len(x), bool)
    ends[1:] = blank[1:] & ~blank[:-1] & (((h[:-1] >> np.uint64(ROLL)) & np.uint64((1 << BITS) - 1)) == 0)
    at = np.flatnonzero(ends)
    out, start = [], 0
    for r in raw:
        own = at[np.searchsorted(at, start + ROLL) : np.searchsorted(at, start + len(r))] - start
        cuts = [0, *own.tolist(), len(r)]
        out.append([r[i:j].decode("utf-8", "surrogatepass") for i, j in zip(cuts, cuts[1:], strict=False) if j > i])
        start += len(r)
    return out


def chunk_hash(chunk: str) -> int:
    return xxhash.xxh3_64_intdigest(chunk.encode("utf-8", "surrogatepass")) >> 1


def edge(piece: str) -> tuple[str, str]:
    """The words at both ends of a piece, with the blanks at their outer side."""
    first = piece.find(" ", len(piece) - len(piece.lstrip()))
    last = max(piece.rstrip().rfind(" "), 0)
    return piece if first < 0 else piece[:first], piece[last:]


def parted(text: str, words: int, at_end: bool) -> tuple[str, str]:
    """text in two, cut before a blank so that the part at its end, or else at its start, has about `words` words."""
    at = len(text.rstrip()) if at_end else len(text) - len(text.lstrip())
    for _ in range(words):
        at = text.rfind(" ", 0, at) if at_end else text.find(" ", at + 1)
        if at <= 0:
            at = 0 if at_end else len(text)
            break
    return text[:at], text[at:]


def repaired(coder, left: str, right: str, left_ids: bytes, right_ids: bytes, begins: bool = True) -> tuple[bytes, int] | None:
    """Ids of left + right from the ids of each, and the words of the window that it took on each side (0: none).

    None if the window holds all of left and more text stands before that (not `begins`).
    """
    a, b = edge(left)[1], edge(right)[0]
    one, two, both = coder.whole([a, b, a + b])
    if one + two == both:
        return left_ids + right_ids, 0
    words = 2
    while True:
        (before, tail), (head, after) = parted(left, words, True), parted(right, words, False)
        if not before and not begins:
            return None
        if not before and not after:
            return coder.whole([left + right])[0], words
        outer, far = parted(tail, words // 2, True)[0], parted(head, words // 2, False)[1]
        window, tail_ids, head_ids, outer_ids, far_ids = coder.whole([tail + head, tail, head, outer, far])
        fits = left_ids.endswith(tail_ids) and right_ids.startswith(head_ids)
        agrees = all(x.startswith(outer_ids) for x in (tail_ids, window)) and all(x.endswith(far_ids) for x in (head_ids, window))
        if fits and agrees and (outer or not before) and (far or not after):
            return left_ids[: len(left_ids) - len(tail_ids)] + window + right_ids[len(head_ids) :], words
        words *= 2


def rejoined(coder, pieces: list[tuple[str, bytes]]) -> bytes:
    """Ids of a text from its pieces and their ids, joined one by one with repairs."""
    done: list[tuple[str, bytes]] = []  # the joins between these hold
    for piece, own in pieces:
        found = None
        while done and not (found := repaired(coder, done[-1][0], piece, done[-1][1], own, len(done) == 1)):
            (one, one_ids), (two, two_ids) = done[-2:]
            done[-2:] = [(one + two, one_ids + two_ids)]
        if found and found[1]:
            done[-1] = (done[-1][0] + piece, found[0])
        else:
            done.append((piece, own))
    return b"".join(ids for _, ids in done)


def digests(path: str) -> tuple[str, Callable]:
    """Columns and function for encode(): number of ids, SHA-256 of the ids as text and of the decoded text."""

    def finish(ids: np.ndarray) -> tuple:
        coder = encoder(path)
        return len(ids), hashlib.sha256(coder.numbers(ids).encode()).hexdigest(), hashlib.sha256(coder.decode(ids).encode("utf-8")).hexdigest()

    return "n_tokens long, ids_sha256 string, decoded_sha256 string", finish


def full(path: str) -> tuple[str, Callable]:
    """Columns and function for encode(): the ids and the decoded text."""
    return "token_ids array<int>, decoded string", lambda ids: (ids.astype(np.int32).tolist(), encoder(path).decode(ids))


def table(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as plain objects, which Spark turns into its own types."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


def shared_map(texts: DataFrame, map_bits: int = MAP_BITS, cutter: Callable = chunked) -> np.ndarray:
    """One bit for each residue of a hash that stands twice among the chunks of different texts, packed."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, some in fresh(batches):
            yield pd.DataFrame({"h": [chunk_hash(c) for chunks in cutter(some) for c in chunks]}, dtype="int64")

    twice = texts.mapInPandas(hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    bit = F.col("h") % map_bits
    words = twice.groupBy(F.floor(bit / 32).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h % {map_bits} % 32 AS int))")).alias("bits"))
    got = words.toPandas()  # map_bits / 32 rows at most, whatever the corpus
    out = np.zeros(map_bits // 32, np.uint32)
    out[got["at"].to_numpy(dtype=np.int64)] = got.bits.to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def fresh(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts by slices, without those that this task has seen."""
    seen: set = set()
    for batch in batches:
        for i in range(0, len(batch), SLICE):
            keys, some = [], []
            for key, text in zip(batch["key"].iloc[i : i + SLICE], batch.text.iloc[i : i + SLICE], strict=True):
                if key not in seen:
                    if len(seen) < SEEN:
                        seen.add(key)
                    keys.append(key)
                    some.append(text)
            yield keys, some


def encode(docs: DataFrame, tokenizer: str, outputs: Callable = digests, cutter: Callable = chunked) -> DataFrame:
    """doc_id and the columns of `outputs` for each row of docs; `cutter` gives the chunks of each of some texts."""
    spark = docs.sparkSession
    columns, finish = outputs(tokenizer)
    names = [c.split()[0] for c in columns.split(", ")]
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.unhex(F.md5("text")))
    texts = keyed.select("key", "text")
    bits = spark.sparkContext.broadcast(shared_map(texts, cutter=cutter))
    pieces = f"key binary, pos int, ids binary, head string, tail string, {columns}"

    def is_shared(h: int) -> bool:
        h %= len(bits.value) * 32
        return bool(bits.value[h // 32] >> (h % 32) & 1)

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Places of shared chunks; a chunk's text goes along once from each task."""
        sent: set = set()
        for keys, some in fresh(batches):
            rows = []
            for key, chunks in zip(keys, cutter(some), strict=True):
                for pos, c in enumerate(chunks):
                    if is_shared(chunk_hash(c)):
                        name = hashlib.md5(c.encode("utf-8", "surrogatepass")).digest()
                        rows.append((name, key, pos, None if name in sent else c))
                        if len(sent) < SEEN:
                            sent.add(name)
            yield table(rows, ["chunk", "key", "pos", "text"])

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ids and outer words of each chunk."""
        coder = encoder(tokenizer)
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                some = batch.text.iloc[i : i + SLICE].tolist()
                rows = [(name, ids, *edge(c)) for name, ids, c in zip(batch.chunk.iloc[i : i + SLICE], coder.encode(some), some, strict=True)]
                yield table(rows, ["chunk", "ids", "head", "tail"])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ids of what lies between shared chunks; documents without any are finished here."""
        coder = encoder(tokenizer)
        for keys, some in fresh(batches):
            runs = []
            for key, text, chunks in zip(keys, some, cutter(some), strict=True):
                shared = [is_shared(chunk_hash(c)) for c in chunks]
                if not any(shared):
                    runs.append((key, -1, text))
                    continue
                start = 0
                for pos in range(1, len(chunks) + 1):
                    if pos == len(chunks) or shared[pos] or shared[start]:
                        if not shared[start]:
                            runs.append((key, start, "".join(chunks[start:pos])))
                        start = pos
            rows = []
            for (key, pos, text), ids in zip(runs, coder.encode([r[2] for r in runs]), strict=True):
                if pos < 0:
                    rows.append((key, pos, None, None, None, *finish(np.frombuffer(ids, coder.type))))
                else:
                    rows.append((key, pos, ids, *edge(text), *[None] * len(names)))
            yield table(rows, ["key", "pos", "ids", "head", "tail", *names])

    def assembled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole documents from their pieces, which come in order; where a join differs, the places and ids of the pieces."""
        coder, agreed = encoder(tokenizer), {}
        key, last, places, parts, tail, good = None, None, [], [], None, True
        out = ["key", "places", "parts", *names]

        def close() -> tuple:
            if good:
                return (key, None, None, *finish(np.frombuffer(b"".join(parts), coder.type)))
            return (key, places, parts, *[None] * len(names))

        def agrees(left: str, right: str) -> bool:
            if (left, right) not in agreed:
                if len(agreed) > 50_000:
                    agreed.clear()
                a, b, both = coder.whole([left, right, left + right])
                agreed[left, right] = a + b == both
            return agreed[left, right]

        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if row.key != key:
                    if key is not None and last >= 0:
                        rows.append(close())
                    key, last, places, parts, tail, good = row.key, None, [], [], None, True
                if row.pos == last:  # the same text came from two tasks
                    continue
                last = row.pos
                if row.pos < 0:
                    rows.append((key, None, None, *row[5:]))
                    continue
                if tail is not None and good:
                    good = agrees(tail, row.head)
                places.append(row.pos)
                parts.append(row.ids)
                tail = row.tail
            yield table(rows, out)
        if key is not None and last >= 0:
            yield table([close()], out)

    def repairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Documents with joins that differ, from their pieces' ids."""
        coder = encoder(tokenizer)
        for batch in batches:
            rows = []
            for key, text, places, parts in zip(batch["key"], batch.text, batch.places, batch.parts, strict=True):
                chunks = cutter([text])[0]
                pieces = ["".join(chunks[i:j]) for i, j in zip(places, [*places[1:], len(chunks)], strict=True)]
                rows.append((key, *finish(np.frombuffer(rejoined(coder, list(zip(pieces, parts, strict=True))), coder.type))))
            yield table(rows, ["key", *names])

    n = partitions(spark)
    want = cut(texts.mapInPandas(wanted, "chunk binary, key binary, pos int, text string"))
    # A chunk's text is the same from every task; one is kept before the exchange and one behind it.
    done = want.where("text IS NOT NULL").groupBy("chunk").agg(F.max("text").alias("text")).mapInPandas(once, "chunk binary, ids binary, head string, tail string")
    nothing = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")]
    met = want.drop("text").join(done.hint("merge"), "chunk").select("key", "pos", "ids", "head", "tail", *nothing)
    found = met.unionByName(texts.mapInPandas(local, pieces))
    found = found.repartition(n, "key").sortWithinPartitions("key", "pos").mapInPandas(assembled, f"key binary, places array<int>, parts array<binary>, {columns}")
    found = cut(found)
    odd = found.where("places IS NOT NULL").select("key", "places", "parts")
    results = found.where("places IS NULL").drop("places", "parts")
    if not odd.isEmpty():
        beside = texts.join(odd.select("key"), "key", "left_semi").dropDuplicates(["key"]).join(odd, "key")
        results = results.unionByName(beside.mapInPandas(repairs, f"key binary, {columns}"))
    return keyed.select("doc_id", "key").join(results, "key").select("doc_id", *names)
