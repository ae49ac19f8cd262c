"""N-gram Jaccard join by a token-group matrix: documents that share 80 of 100 word shingles, as components.

Sets of 64-bit shingle hashes are compared, so two documents link when 100 * intersection >= 80 * union.

1. Equal sets are one class. All shingles are counted, exactly up to 32-bit hashes; a bit map of fixed size tells which
   occur more than once, a bounded list which are frequent. Rarest first, a set's prefix is as long as it takes for linked
   sets to share a shingle of it. A set with more single shingles than a linked one can have takes no further part.
2. Sets that share prefix shingles are put with the least of them and compared with it; linked ones are connected.
3. The matrix: sets are grouped with their leader, or with their component where that is large, and groups are cut in parts
   of at most PART sets; each part has the union of its shingles. Parts that share a prefix shingle meet: the overlap of a
   set with the other part's union bounds that with any member, and only where it suffices is the part opened, all members
   being counted at once. Of the links found a part returns those that connect what wasn't yet.

Parts of one component never meet, and a part returns at most one link a set and member, so large groups of copies cost few
rows. Parts are streamed in key order; a task holds one part's members and no more.

Defined results: null texts and texts without words have 0 shingles, no links, and their own doc_id as component; a text of
fewer than five words is one shingle; rows with a null doc_id take part and link others, but never name a component (a
component of such rows alone is null); repeated rows get equal results; an empty table gives an empty result; other
columns are not read.
"""

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions

N = 5
#: Bits of the map of repeated shingles; where more repeat, more sets stay in the search, with the same result.
MAP_BITS = 1 << 27
#: A shingle is frequent from 2**LEAST_CLASS sets on, or from more, so that the list has at most FREQUENT entries.
LEAST_CLASS, FREQUENT = 4, 2_000_000
#: Most sets in a part of a group on average, queries of one copy of a part.
PART, STAR = 64, 512
#: Texts hashed side by side, shingles counted at a time in a task.
SLICE, FLUSH = 200, 4_000_000
MIX = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
STEP, BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; A-Z count as a-z, words are parted by ASCII white space."""
    raw = [b" " + t.encode("utf-8", "surrogatepass") + b" " if t else b" " for t in texts]
    x = np.frombuffer(b"".join(raw), np.uint8)
    if not len(x):
        return []
    x = np.where((x >= 65) & (x <= 90), x + 32, x).astype(np.uint8)
    space = (x == 32) | ((x >= 9) & (x <= 13))
    edges = np.flatnonzero(np.diff(space.astype(np.int8)))
    starts, ends = edges[::2] + 1, edges[1::2] + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(MIX[x] * powers(STEP, len(x)), dtype=np.uint64)])
    words = mixed((total[ends] - total[starts]) * powers(BACK, len(x))[starts])
    sizes = np.array([len(r) for r in raw])
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    rolled = np.zeros(max(0, len(words) - N + 1), np.uint64)
    for k in range(N):
        rolled = rolled * STEP + words[k : len(words) - N + 1 + k] if len(rolled) else rolled
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= N:
            out.append(np.unique(rolled[a : b - N + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                whole = mixed(whole * STEP + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def enough(n: int) -> int:
    """Fewest shingles that a set of n shares with one it is linked to."""
    return (4 * n + 4) // 5


def counted(docs: DataFrame, map_bits: int, ranges: int) -> DataFrame:
    """class, shingles (packed) and bits of each range of 32-bit shingle hashes: the frequent ones by class, and the map's slice (class -1).

    A slice is compressed, so that the map of a small table is small wherever it goes.
    """
    shift = 32 - (ranges.bit_length() - 1)

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            x = np.concatenate(held)
            held.clear()
            x.sort()
            at = np.searchsorted(x, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(shift))
            rows = []
            for r in range(ranges):
                own = x[at[r] : at[r + 1]]
                if len(own):  # differences, byte by byte, which compress well
                    rows.append((r, np.ascontiguousarray(np.diff(own, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes()))
            return pd.DataFrame(rows, columns=["range", "payload"])

        for batch in batches:
            for i in range(0, len(batch), SLICE):
                for s in shingle_sets(batch.text.iloc[i : i + SLICE].tolist()):
                    if len(s):
                        name = xxhash.xxh3_128_digest(s.tobytes())
                        if name not in seen:  # equal sets within a task count once
                            if len(seen) < 200_000:
                                seen.add(name)
                            held.append((s >> np.uint64(32)).astype(np.uint32))
                            size += len(s)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.cumsum(np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1), dtype=np.uint32) for p in rows.payload]
        x, n = np.unique(np.concatenate(parts), return_counts=True)
        width = map_bits // ranges
        at = (x[n > 1].astype(np.uint64) * np.uint64(map_bits) >> np.uint64(32)).astype(np.int64) - int(key[0]) * width
        bits = np.zeros(width, np.uint8)
        bits[at] = 1
        out = [(int(key[0]), -1, 0, zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))]
        classes = np.log2(n).astype(int)
        for c in np.unique(classes[classes >= LEAST_CLASS]):
            out.append((int(key[0]), int(c), int((classes == c).sum()), x[classes == c].tobytes()))
        return pd.DataFrame(out, columns=["range", "class", "n", "payload"])

    found = docs.select("text").mapInPandas(tokens, "range int, payload binary")
    return found.groupBy("range").applyInPandas(count, "range int, class int, n long, payload binary")


class Order:
    """Which shingles repeat, and the classes of the frequent ones.

    The map is held in compressed slices and opened by the workers that ask it; the driver never opens it.
    """

    def __init__(self, slices: list[bytes], shingles: np.ndarray, classes: np.ndarray, map_bits: int):
        order = np.argsort(shingles)
        self.slices, self.shingles, self.classes, self.map_bits = slices, shingles[order], classes[order], map_bits

    @cached_property
    def bits(self) -> np.ndarray:
        out = np.zeros(self.map_bits // 8, np.uint8)
        width = len(out) // len(self.slices)
        for k, x in enumerate(self.slices):
            if x:
                out[k * width : (k + 1) * width] = np.frombuffer(zlib.decompress(x), np.uint8)
        return out

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of a set's prefix that occur elsewhere, none if it can't be linked to another set; all that may occur elsewhere."""
        length = len(s) - enough(len(s)) + 1
        high = s >> np.uint64(32)
        at = (high * np.uint64(self.map_bits) >> np.uint64(32)).astype(np.int64)
        often = s[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        length -= len(s) - len(often)
        if length <= 0:
            return often[:0], often
        high = (often >> np.uint64(32)).astype(np.uint32)
        where = np.searchsorted(self.shingles, high)
        known = where < len(self.shingles)
        known[known] = self.shingles[where[known]] == high[known]
        rank = np.zeros(len(often), np.int64)
        rank[known] = self.classes[where[known]]
        return often[np.lexsort((often, rank))[:length]], often


def ordered(docs: DataFrame, map_bits: int = MAP_BITS) -> Order:
    """The order of all shingles in docs."""
    ranges = 1 << min(12, max(4, (4 * partitions(docs.sparkSession)).bit_length()))
    table = cut(counted(docs, map_bits, ranges))
    sizes = {r["class"]: r["n"] for r in table.where("class >= 0").groupBy("class").agg(F.sum("n").alias("n")).collect()}
    least, total = 99, 0
    for c in sorted(sizes, reverse=True):
        total += sizes[c]
        if total > FREQUENT:
            break
        least = c
    slices = [b""] * ranges
    for r in table.where("class = -1").select("range", "payload").toLocalIterator():
        slices[r[0]] = bytes(r[1])
    shingles, classes = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)]
    for r in table.where(F.col("class") >= least).select("class", "payload").toLocalIterator():
        shingles.append(np.frombuffer(r[1], np.uint32))
        classes.append(np.full(len(shingles[-1]), r[0], np.uint8))
    return Order(slices, np.concatenate(shingles), np.concatenate(classes), map_bits)


def named(s: np.ndarray) -> bytes | None:
    """The key of a set, none for an empty one."""
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n, key (of the set) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                some = batch.iloc[i : i + SLICE]
                rows = [(None if pd.isna(doc_id) else int(doc_id), len(s), named(s)) for doc_id, s in zip(some.doc_id, shingle_sets(some.text.tolist()), strict=True)]
                yield pd.DataFrame(rows, columns=["doc_id", "n", "key"], dtype=object)

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, key binary")


def linkable(docs: DataFrame, order: Order) -> DataFrame:
    """key, n, prefix, members of the sets that have a prefix; members are those of the n shingles that may occur elsewhere."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                rows = []
                for s in shingle_sets(batch.text.iloc[i : i + SLICE].tolist()):
                    prefix, often = shared.value.prefix(s) if len(s) else (s, s)
                    if len(prefix) and (key := named(s)) not in seen:  # equal sets within a task are one
                        if len(seen) < 200_000:
                            seen.add(key)
                        rows.append((key, len(s), prefix.astype(np.int64).tolist(), often.tobytes()))
                yield pd.DataFrame(rows, columns=["key", "n", "prefix", "members"], dtype=object)

    found = docs.select("text").mapInPandas(run, "key binary, n long, prefix array<long>, members binary")
    # Dealt out by key once, so that what is joined by it comes to the members.
    return found.repartition(partitions(docs.sparkSession), "key").dropDuplicates(["key"])


class Part:
    """Some sets, their union, and which of them are known to be connected; sizes are those of whole sets."""

    def __init__(self, keys: list, roots: list, sizes: list[int], sets: list[np.ndarray]):
        self.keys, self.sizes = keys, np.array(sizes)
        who, every = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.who = who[order]
        self.union, starts = np.unique(every[order], return_index=True)
        self.starts = np.append(starts, len(every))
        self.over: dict = {}
        self.roots = roots

    def top(self, x: bytes) -> bytes:
        while self.over.get(x, x) != x:
            x = self.over[x]
        return x

    def links(self, key: bytes, root: bytes, size: int, s: np.ndarray) -> list[tuple]:
        """Links of a set of that size with members that are not connected with it yet; s: its shingles that may occur elsewhere."""
        at = np.searchsorted(self.union, s)
        inside = at < len(self.union)
        at = at[inside][self.union[at[inside]] == s[inside]]
        if len(at) < enough(size):
            return []
        n = self.starts[at + 1] - self.starts[at]
        places = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.who[places], minlength=len(self.keys))
        found = []
        for k in np.flatnonzero(100 * both >= 80 * (self.sizes + size - both)):
            here, there = self.top(root), self.top(self.roots[k])
            if here != there:
                self.over[here] = there
                found.append((key, self.keys[k]))
        return found


def opened(groups: DataFrame, queries: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of queries with members of the part of the same name and salt; both are part, salt, key, root (what it is connected with).

    Where groups have `own`, a part's members are held against each other as well.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held, part, alone = None, [], None, False

        def within() -> list[tuple]:
            """The part is made when its members have come."""
            nonlocal part
            part = Part(*map(list, zip(*held, strict=True)))
            return [link for one in held for link in part.links(*one)] if alone else []

        for batch in batches:
            rows = []
            for at, query, own, key, root, n, members in zip(zip(batch.g, batch.pure, batch["sub"], batch.salt, strict=True), batch["query"], batch.own, batch.key, batch.root, batch.n, batch.members, strict=True):
                if at != name:
                    if alone and part is None:
                        rows += within()
                    name, held, part, alone = at, [], None, False
                one = (key, root, n, np.frombuffer(members, np.uint64))
                if not query:
                    held.append(one)
                    alone = own
                    continue
                if part is None and held:
                    rows += within()
                if part is not None:
                    rows += part.links(*one)
            yield pd.DataFrame(rows, columns=["a", "b"], dtype=object)
        if alone and part is None:
            yield pd.DataFrame(within(), columns=["a", "b"], dtype=object)

    cols = ["part.*", "salt", "query", "own", "key", "root"]
    own = F.col("own") if "own" in groups.columns else F.lit(False)
    both = groups.withColumn("query", F.lit(0)).withColumn("own", own).select(*cols).unionByName(queries.withColumn("query", F.lit(1)).withColumn("own", F.lit(False)).select(*cols))
    both = both.join(sets.select("key", "n", "members"), "key")
    by = ["g", "pure", "sub", "salt"]
    return both.repartition(partitions(both.sparkSession), *by).sortWithinPartitions(*by, "query", "key").mapInPandas(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node in links (a, b)."""
    links = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = cut(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        near = links.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # A root's own root is nearer still.
        jump = lower.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        lower = cut(lower.join(jump, F.col("root") == F.col("_n")).select("node", "old", F.least("root", "_r").alias("root")))
        roots = lower.select("node", "root")
        if lower.where("old != root").isEmpty():
            return roots


def join(docs: DataFrame, map_bits: int = MAP_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    sets = cut(linkable(docs, ordered(docs, map_bits)))
    every = cut(profiles(docs))
    posts = sets.select("key", "n", F.explode("prefix").alias("t"))

    # Stars: each set with the least of the leaders that its prefix meets.
    leaders = posts.groupBy("t").agg(F.min("key").alias("leader"), F.count("*").alias("_m")).where("_m > 1").drop("_m")
    star = posts.join(leaders, "t").where("leader != key").groupBy("key").agg(F.min("leader").alias("leader"))
    star = cut(star)
    parts = star.groupBy("leader").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    salt = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")

    def part_of(g: str, pure, sub):
        return F.struct(F.col(g).alias("g"), F.lit(pure).alias("pure"), sub.alias("sub")).alias("part")

    queries = star.join(parts, "leader").select(part_of("leader", False, salt), "key", F.col("key").alias("root"))
    heads = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    heads = heads.select(part_of("leader", False, F.col("salt")), F.col("leader").alias("key"), F.col("leader").alias("root"))
    first = components(opened(heads.withColumn("salt", F.lit(0)), queries.withColumn("salt", F.lit(0)), sets)).withColumnRenamed("root", "_root")

    # Groups in parts.
    grouped = sets.select("key", "n").join(first, F.col("key") == F.col("node"), "left").join(star, "key", "left")
    grouped = grouped.select("key", "n", F.coalesce("_root", "key").alias("root"), F.coalesce("leader", "key").alias("leader"))
    large = grouped.groupBy(F.col("root").alias("_big")).count().where(F.col("count") >= PART).select("_big")
    grouped = grouped.join(large, F.col("root") == F.col("_big"), "left").withColumn("pure", F.col("_big").isNotNull())
    grouped = grouped.withColumn("g", F.coalesce("_big", "leader"))
    counts = grouped.groupBy("g", "pure").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    grouped = grouped.join(counts, ["g", "pure"])
    sub = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    grouped = cut(grouped.select("key", "n", "root", F.struct("g", "pure", sub.alias("sub")).alias("part")))

    # Parts that share a prefix shingle, unless both are of one component; of two parts the one with fewer sets asks.
    # A mixed part's members are held against each other where they lie.
    held = grouped.groupBy("part").agg(F.count("*").alias("sets"))
    columns = posts.select("key", "t").join(grouped, "key").groupBy("t", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    left, right = columns.select("t", F.col("part").alias("p"), F.col("lo").alias("plo"), F.col("hi").alias("phi")), columns.select("t", F.col("part").alias("q"), "lo", "hi")
    apart = (F.col("p") < F.col("q")) & ~(F.col("p.pure") & F.col("q.pure") & (F.col("p.g") == F.col("q.g")))
    fits = (5 * F.col("phi") >= 4 * F.col("lo")) & (5 * F.col("hi") >= 4 * F.col("plo"))
    meet = left.join(right, "t").where(apart & fits).select("p", "q").distinct()
    for side in ("p", "q"):
        meet = meet.join(held.select(F.col("part").alias(side), F.col("sets").alias(f"{side}_sets")), side)
    p, q = F.struct(F.col("p_sets").alias("sets"), F.col("p").alias("part")), F.struct(F.col("q_sets").alias("sets"), F.col("q").alias("part"))
    meet = cut(meet.select(F.greatest(p, q).alias("p"), F.least(p, q).alias("q")).select(F.col("p.part").alias("p"), F.col("q.part").alias("q"), F.col("q.sets").alias("sets")))
    rows = grouped.select("part", "key", "root")
    # A part that many sets meet stands in several copies, so its queries spread over as many tasks.
    copies = meet.groupBy(F.col("p").alias("part")).agg(F.ceil(F.sum("sets") / STAR).cast("int").alias("copies"))
    alone = held.where("NOT part.pure AND sets > 1").select("part", F.lit(0).alias("copies"))
    copies = cut(copies.unionByName(alone).groupBy("part").agg(F.greatest(F.max("copies"), F.lit(1)).alias("copies"), (F.min("copies") == 0).alias("alone")))
    matrix = rows.join(copies, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("own", F.col("alone") & (F.col("salt") == 0))
    asked = meet.join(rows.withColumnRenamed("part", "q"), "q").select(F.col("p").alias("part"), "key", "root")
    asked = asked.join(copies, "part").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("copies")).cast("int"))
    more = opened(matrix, asked, sets)
    owner = grouped.select(F.col("key").alias("_k"), F.col("root").alias("g"))
    edges = more.join(owner, F.col("a") == F.col("_k")).select(F.col("g").alias("a"), "b").join(owner, F.col("b") == F.col("_k")).select("a", F.col("g").alias("b"))
    second = components(edges).withColumnRenamed("root", "_top")

    # Classes, groups and components, and the least doc_id of each.
    root = grouped.join(second, F.col("root") == F.col("node"), "left").select(F.col("key").alias("_key"), F.coalesce("_top", "root").alias("_root"))
    classes = every.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("_low")).join(root, F.col("key") == F.col("_key"), "left")
    classes = classes.select(F.col("key").alias("_key"), F.coalesce("_root", "key").alias("_root"), "_low")
    names = classes.groupBy("_root").agg(F.min("_low").alias("component_id"))
    found = classes.join(names, "_root").select("_key", "component_id")
    out = every.select("doc_id", F.col("n").alias("n_shingles"), "key").join(found, F.col("key") == F.col("_key"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
