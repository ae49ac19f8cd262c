"""Approximate nearest neighbours by inner product: inverted lists, scanned with adaptive dimensions.

Centroids are fitted on a bounded sample, as many as the root of the number of vectors, up to MOST / EACH, which is reached with
a thousand million vectors; beyond that lists grow longer, and take more tasks each. Every vector goes to the list of its
nearest one. In a list vectors are rotated at random and read by blocks of columns. After each block the
distance over the columns so far, scaled up, bounds the whole distance from below unless a hypothesis test at EPSILON errs;
with the norms that bounds the inner product from above, and candidates that can't reach the query's threshold are
abandoned. What is left is measured in double precision on the vectors as they came.

A query goes first to the FIRST lists whose centroids come nearest to it; the k-th best found there is its threshold in all
others, and lists that can't hold anything better, by their radius, are passed over. How many lists it goes to in all follows
from the data: as many as hold TARGET of the nearest neighbours of some sampled vectors within the sample, which lie further
off than those among all vectors. So a query is sent once to each of a share of about root-of-n lists.

Lists of more than VALUES numbers are dealt out in parts, so a list of any size spreads over many tasks; a task holds one part
and streams the queries past it.

Defined results: null and zero vectors, and those with null or non-finite components, take no part; nor do vectors of
another length than the most frequent one among `vectors` (the longest of these, on a tie), be they searched or asked, and
rows with a null vec_id; of several asked rows with one vec_id the least vector counts, while each searched row is a
candidate; equal scores are ranked by vec_id; a query never finds rows with its own vec_id; queries for which the probed lists
hold too few candidates are searched again over all lists; an empty table gives an empty result; other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

#: Fewest and most vectors that the centroids are fitted on, and vectors for each list.
SAMPLE, MOST, EACH = 8192, 1 << 16, 2
#: Share of neighbours that the probed lists must hold, and vectors of the sample that it is measured with.
TARGET, MEASURED = 0.97, 512
#: Lists that a query goes to before the others.
FIRST = 2
#: Columns read at a time, and how far an estimate may be off: EPSILON / sqrt(columns read).
COLUMNS, EPSILON = 16, 2.1
#: Most numbers in a part of a list, and queries met at a time.
VALUES, BATCH = 1 << 22, 64
K = 20


def fine(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors without zero, null or non-finite ones."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND size(embedding) > 0")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(finite & F.exists("embedding", lambda x: x != 0))


def usable(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """vec_id and embedding of the vectors that take part; their length and number."""
    rows = fine(vectors)
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d, n = (size["d"], size["count"]) if size else (0, 0)
    return rows.where(F.size("embedding") == d), d, n


def fitted(sample: np.ndarray, lists: int, seed: int = 1, rounds: int = 12) -> np.ndarray:
    """Centroids of a sample; where they are many, of its parts by a few centroids."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    if lists > 512 and len(sample) > lists:
        coarse = fitted(sample, round(np.sqrt(lists)), seed, rounds)
        near = nearest(sample, coarse)
        share = [(sample[near == k], max(1, round(lists * float((near == k).mean())))) for k in np.unique(near)]
        return np.concatenate([fitted(own, min(n, 512), seed, rounds) for own, n in share])
    centers = sample[rng.permutation(len(sample))[:lists]]
    for _ in range(rounds):
        near = nearest(sample, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centers))
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centers.T - (centers**2).sum(axis=1) / 2, axis=1)


def probes_for(sample: np.ndarray, centers: np.ndarray, k: int) -> int:
    """Lists to probe for TARGET of the k nearest neighbours within the sample."""
    sample = np.unique(sample, axis=0)
    asked = np.random.default_rng(4).permutation(len(sample))[:MEASURED]
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    found = np.argsort(-scores, axis=1)[:, : max(1, min(k, len(sample) - 1))]
    rank = np.argsort(np.argsort(-(sample[asked] @ centers.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(rank, nearest(sample, centers)[found], axis=1), TARGET)) + 1


def rotation(d: int, seed: int = 2) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Part:
    """Some vectors of one list."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.turned = self.vectors @ turn
        self.squares = (self.vectors**2).sum(axis=1)

    def search(self, own: np.ndarray, queries: np.ndarray, turned: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of some queries, with ids and scores of the k nearest to each in this part; known: thresholds so far."""
        n, d = self.vectors.shape
        squares = (queries**2).sum(axis=1)
        alive = self.ids[:, None] != own
        # A query's threshold is the k-th best of some vectors that are measured whole, or what it knows from other lists.
        probe = np.arange(0, n, max(1, n // (4 * k)))
        bar = known
        if len(probe) > k:
            some = np.where(alive[probe], self.vectors[probe] @ queries.T, -np.inf)
            bar = np.maximum(bar, np.partition(some, len(probe) - k, axis=0)[len(probe) - k])
        # Products computed in another order differ by less than this.
        slip = 1e-12 * d * np.sqrt(self.squares[:, None] * squares)
        partial = np.zeros((n, len(queries)))
        for start in range(0, d, COLUMNS):
            x, q = self.turned[:, start : start + COLUMNS], turned[:, start : start + COLUMNS]
            seen = min(d, start + COLUMNS)
            if alive.mean() > 0.25:
                partial += (x**2).sum(axis=1)[:, None] + (q**2).sum(axis=1) - 2 * (x @ q.T)
            else:
                r, c = np.nonzero(alive)
                partial[r, c] += ((x[r] - q[c]) ** 2).sum(axis=1)
            slack = (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < d else 1.0
            alive &= (self.squares[:, None] + squares - partial * (d / seen / slack)) / 2 >= bar - slip
        product = np.where(alive, (self.squares[:, None] + squares - partial) / 2, -np.inf)
        if n > k:
            alive &= product >= np.partition(product, n - k, axis=0)[n - k] - slip
        r, c = np.nonzero(alive)
        scores = (self.vectors[r] * queries[c]).sum(axis=1)
        good = scores >= known[c]
        r, c, scores = r[good], c[good], scores[good]
        order = np.lexsort((self.ids[r], -scores, c))
        r, c, scores = r[order], c[order], scores[order]
        keep = np.arange(len(c)) - np.searchsorted(c, c) < k
        return c[keep], self.ids[r[keep]], scores[keep]


def scanned(placed: DataFrame, asked: DataFrame, d: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest to each query (list, sub, vec_id, embedding, bar) in each part (list, sub, vec_id, embedding) it is sent to."""
    turn = rotation(d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, ids, vectors, part = None, [], [], None
        for batch in batches:
            rows = []
            x = np.array(batch.embedding.tolist(), dtype=float).reshape(-1, d)
            turned, who = x @ turn, batch.vec_id.to_numpy()
            marks, bars = batch[["list", "sub", "query"]].to_numpy(), batch.bar.to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(marks, axis=0) != 0).any(axis=1)) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                at, query = (marks[a][0], marks[a][1]), marks[a][2]
                if at != name:
                    name, ids, vectors, part = at, [], [], None
                if not query:
                    ids.append(who[a:b])
                    vectors.append(x[a:b])
                    continue
                if part is None and ids:
                    part = Part(np.concatenate(ids), np.concatenate(vectors), turn)
                for i in range(a, b, BATCH) if part is not None else ():
                    own = who[i : min(b, i + BATCH)]
                    c, found, scores = part.search(own, x[i : i + len(own)], turned[i : i + len(own)], bars[i : i + len(own)], k)
                    rows.append((own[c], found, scores))
            if rows:
                yield pd.DataFrame({"query_id": np.concatenate([r[0] for r in rows]), "vec_id": np.concatenate([r[1] for r in rows]), "score": np.concatenate([r[2] for r in rows])})

    cols = ["list", "sub", "query", "vec_id", "embedding", "bar"]
    both = placed.withColumns({"query": F.lit(0), "bar": F.lit(0.0)}).select(*cols).unionByName(asked.withColumn("query", F.lit(1)).select(*cols))
    both = both.repartition(partitions(both.sparkSession), "list", "sub").sortWithinPartitions("list", "sub", "query", "vec_id")
    return both.mapInPandas(run, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, probes: int | None = None, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id of queries the k nearest found among all rows of vectors."""
    spark = vectors.sparkSession
    base, d, n = usable(vectors)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = lists or max(1, min(MOST // EACH, round(np.sqrt(n))))
    some = base.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(min(MOST, max(SAMPLE, EACH * lists))).toPandas()
    sample = np.array(some.embedding.tolist(), dtype=float).reshape(-1, d)
    kind = dict(base.dtypes)["embedding"]
    centers = fitted(sample, lists)
    probes = min(probes or probes_for(sample, centers, k), len(centers))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch.embedding.tolist(), dtype=float).reshape(-1, d)
            near = nearest(x, centers)
            yield batch.assign(list=near.astype(np.int32), off=np.sqrt(((x - centers[near]) ** 2).sum(axis=1)))

    placed = cut(base.mapInPandas(assign, f"vec_id long, embedding {kind}, list int, off double"))
    parts = placed.groupBy("list").agg(F.ceil(F.count("*") * d / VALUES).cast("int").alias("parts"), F.max("off").alias("radius"))
    parts = cut(parts)  # MOST / EACH rows at most, so it may be broadcast
    reach = {r["list"]: r["radius"] for r in parts.collect()}
    radius = np.array([reach.get(i, -np.inf) for i in range(len(centers))])
    spread = placed.join(F.broadcast(parts), "list").withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).select("list", "sub", "vec_id", "embedding")

    def send(first: int, last: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = np.array(batch.embedding.tolist(), dtype=float).reshape(-1, d)
                product, bar = x @ centers.T, batch.bar.to_numpy()
                near = np.argsort(-product, axis=1, kind="stable")[:, first:last]
                norm = np.sqrt((x**2).sum(axis=1))[:, None]
                best = np.take_along_axis(product, near, axis=1) + norm * radius[near]
                open_ones = best >= bar[:, None] - 1e-12 * d * norm * (norm + np.abs(best))
                yield batch.assign(lists=[row[on] for row, on in zip(near.astype(np.int32), open_ones, strict=True)])

        return run

    def asked(rows: DataFrame, first: int, last: int) -> DataFrame:
        sent = rows.mapInPandas(send(first, last), f"vec_id long, embedding {kind}, bar double, lists array<int>")
        sent = sent.select("vec_id", "embedding", "bar", F.explode("lists").alias("list")).join(F.broadcast(parts), "list")
        return sent.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "radius")

    asking = fine(queries).where(F.size("embedding") == d).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asking = cut(asking.withColumn("bar", F.lit(float("-inf"))))
    found = cut(ranked(scanned(spread, asked(asking, 0, min(FIRST, probes)), d, k), k))
    if probes > FIRST:
        bars = found.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("_bar"))
        rest = asking.join(bars, F.col("vec_id") == F.col("_q"), "left").select("vec_id", "embedding", F.coalesce("_bar", "bar").alias("bar"))
        more = scanned(spread, asked(rest, FIRST, probes), d, k)
        found = cut(ranked(more.unionByName(found.drop("rank")), k))
    if probes >= len(centers):
        return found
    most = asking.select(F.col("vec_id").alias("query_id")).join(found.groupBy("query_id").count(), "query_id", "left")
    few = cut(most.where(F.coalesce("count", F.lit(0)) < min(k, n - 1)).select("query_id"))
    if few.isEmpty():
        return found
    again = ranked(scanned(spread, asked(asking.join(few, F.col("vec_id") == F.col("query_id"), "left_semi"), 0, len(centers)), d, k), k)
    return found.join(few, "query_id", "left_anti").unionByName(again)
