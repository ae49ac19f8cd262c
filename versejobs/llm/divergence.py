"""How far the sources of a language part in the terms they use.

Which terms enough documents of a language have is found by refining prefixes: the first bytes of terms are counted, by
distinct documents; a prefix that too few documents have is left, as none of its terms can be kept; the others are
extended to twice the length, until no term is longer than its prefix. A term as short as its prefix has its own count and
is kept by it. Tasks are told which prefixes stay by a bit map of fixed size; a wrong bit lets a prefix be counted for
nothing, with the same result. Only kept terms are counted by source then.

Sources are compared by what they share: pairs of sources are made only of terms that both hold. What one holds alone stands
against the other's share of a term that doesn't occur, so it goes by how many of its terms have each count.

Defined results: every row is a document, also where rows are alike; null text, language and source are empty ones; a group
without terms has all shares alike; a language without kept terms has distances of 0; other columns are not read; an empty
table gives an empty result.
"""

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .terms import distinct, folding, sliced

#: Bytes of the first prefixes.
FIRST = 6
#: Bits of the map of prefixes that stay.
MAP_BITS = 1 << 25
#: Most pairs of a language and a term that a task marks in a table; more are sorted.
MARKS = 1 << 24
#: Most groups whose sizes are sent to all tasks; more are joined.
GROUPS = 20_000
LETTERS = folding(string.ascii_lowercase)


def marked(rows: DataFrame, bits: int) -> np.ndarray:
    """A bit for the hash of each (lang, term), packed; bits / 32 rows at most reach the driver, whatever the table."""
    bit = F.xxhash64("lang", "term").bitwiseAND(bits - 1)
    one = rows.select(F.shiftright(bit, 5).cast("int").alias("at"), F.expr("shiftleft(1L, cast(xxhash64(lang, term) & 31 AS int))").alias("bit"))
    got = one.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[got["at"].to_numpy(dtype=np.int64)] = got.bits.to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def hashes(langs: list[str], which: np.ndarray, terms: list[bytes]) -> np.ndarray:
    """Spark's xxhash64 of each language (by number) and term."""
    seeds = [xxhash.xxh64_intdigest(x.encode(), 42) for x in langs]
    return np.fromiter((xxhash.xxh64_intdigest(t, seeds[k]) for k, t in zip(which.tolist(), terms, strict=True)), np.uint64, len(terms))


def stays(found: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(found) * 32 - 1)
    return (found[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & 1 == 1


def alive(langs: list[str], of: np.ndarray, codes: np.ndarray, names: pa.Array, upto: int | None, found: np.ndarray) -> np.ndarray:
    """Whether the first `upto` bytes of each term (all: None) stay in its language; each pair of both is looked up once."""
    keys = of * len(names) + codes
    if len(langs) * len(names) <= MARKS:
        seen = np.zeros(len(langs) * len(names), bool)
        seen[keys] = True
        both, back = np.flatnonzero(seen), None
    else:
        both, back = np.unique(keys, return_inverse=True)
    raw = names.take(pa.array(both % len(names))).to_pylist()
    on = stays(found, hashes(langs, both // len(names), raw if upto is None else [x[:upto] for x in raw]))
    if back is None:
        seen[both] = on
        return seen[keys]
    return on[back]


def by_slices(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """For each slice: row, term number and terms; then the group by `columns` of each row of the batch, and the groups' values."""
    for batch in batches:
        coded = [batch.column(c).dictionary_encode() for c in columns]
        of = np.zeros(batch.num_rows, np.int64)
        for c in coded:
            of = of * len(c.dictionary) + c.indices.to_numpy()
        groups, of = np.unique(of, return_inverse=True)
        values = []
        for c in coded[::-1]:
            values.insert(0, c.dictionary.take(pa.array(groups % len(c.dictionary))))
            groups = groups // len(c.dictionary)
        for rows, codes, names in sliced(batch.column("text"), LETTERS):
            if len(rows):
                yield rows, codes, names.cast(pa.large_binary()), of, values


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def prefixes(rows: DataFrame, done: int, upto: int, found: np.ndarray | None) -> DataFrame:
    """lang, term, whole, docs: documents with each prefix of `upto` bytes, of terms of over `done` bytes whose prefix stays."""
    sent = rows.sparkSession.sparkContext.broadcast(found)
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("whole", pa.bool_()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, codes, names, of, (langs,) in by_slices(batches, "lang"):
            sizes = pc.binary_length(names).to_numpy()
            on = sizes[codes] > done
            row, codes = row[on], codes[on]
            if len(codes) and sent.value is not None:
                on = alive(langs.to_pylist(), of[row], codes, names, done, sent.value)
                row, codes = row[on], codes[on]
            if not len(codes):
                continue
            heads = pc.binary_slice(names, 0, upto).dictionary_encode()
            #: A prefix that is a whole term is another one than the same bytes with more behind them.
            head = heads.indices.to_numpy().astype(np.int64) * 2 + (sizes <= upto)
            n = 2 * len(heads.dictionary)
            # A document counts once for a prefix, however many of its terms begin with it.
            once = distinct(row * n + head[codes])
            keys, docs = np.unique(of[once // n] * n + once % n, return_counts=True)
            yield batch_of(schema, langs.take(pa.array(keys // n)), heads.dictionary.take(pa.array(keys % n // 2)), keys % 2 == 1, docs)

    parts = rows.select("lang", "text").mapInArrow(count, "lang string, term binary, whole boolean, docs long")
    return parts.groupBy("lang", "term", "whole").agg(F.sum("docs").alias("docs"))


def kept_terms(rows: DataFrame, least: int, first: int = FIRST, bits: int = MAP_BITS) -> DataFrame:
    """lang, term (binary) of the terms that `least` documents of the language have."""
    kept, done, found = None, 0, None
    while True:
        upto = first if not done else 2 * done
        stay = cut(prefixes(rows, done, upto, found).where(F.col("docs") >= least))
        whole = stay.where("whole").select("lang", "term")
        kept = whole if kept is None else kept.unionByName(whole)
        longer = stay.where("NOT whole")
        if longer.isEmpty():
            return kept
        done, found = upto, marked(longer, bits)


def counted(rows: DataFrame, kept: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """lang, source, term, n, all_n: occurrences of each kept term in a group, where there are any, and in its language.

    All that follows goes by language and term, so counts are exchanged by these alone.
    """
    sent = rows.sparkSession.sparkContext.broadcast(marked(kept, bits))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, codes, names, of, (langs, sources) in by_slices(batches, "lang", "source"):
            keys, n = np.unique(of[row] * len(names) + codes, return_counts=True)
            own, codes = keys // len(names), keys % len(names)
            lang = langs.dictionary_encode()
            on = alive(lang.dictionary.to_pylist(), lang.indices.to_numpy().astype(np.int64)[own], codes, names, None, sent.value)
            own, at = pa.array(own[on]), pa.array(codes[on])
            yield batch_of(schema, langs.take(own), sources.take(own), names.take(at), n[on])

    parts = rows.mapInArrow(count, "lang string, source string, term binary, n long").repartition("lang", "term")
    n = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept, ["lang", "term"], "left_semi")
    return n.withColumn("all_n", F.sum("n").over(Window.partitionBy("lang", "term")))


def share(n: str, size: str, terms: str) -> Column:
    """1 + floor(1000000000 * (n + 5) / (size + 5 * terms)) in whole numbers, null where there are no terms."""
    return F.expr(f"1 + (cast({n} + 5 AS decimal(19,0)) * 1000000000BD) div cast(nullif({size} + 5 * {terms}, 0) AS decimal(20,0))")


def audit(docs: DataFrame, least: int = 30, top: int = 50, first: int = FIRST, bits: int = MAP_BITS) -> DataFrame:
    """lang, source, part, item, value, rank: distance from each other source of the language, and the terms most above its share."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = cut(counted(rows, kept_terms(rows, least, first, bits), bits))
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("held"))
    langs = counts.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_size"))
    groups = rows.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut(groups.na.fill(0, ["size", "held", "terms", "lang_size"]).withColumn("none", share("0", "size", "terms")))
    few: Callable = F.broadcast if groups.count() <= GROUPS else lambda x: x

    shares = counts.join(few(groups), ["lang", "source"]).withColumn("p", share("n", "size", "terms"))
    above = shares.withColumn("value", F.col("p") - share("all_n", "lang_size", "terms")).where("value > 0")
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)

    others = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("other"), F.col("none").alias("other_none"), F.col("held").alias("other_held"))
    same = F.col("lang") == F.col("_lang")
    # Terms that neither holds, as if none were held by both.
    idle = groups.join(few(others), same & (F.col("source") < F.col("other")))
    idle = idle.select("lang", "source", "other", ((F.col("terms") - F.col("held") - F.col("other_held")) * F.abs(F.col("none") - F.col("other_none"))).alias("value"))
    # Terms that one holds, as if the other didn't.
    often = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    alone = often.join(few(others), same & (F.col("source") != F.col("other")))
    alone = alone.select("lang", F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other"), (F.col("k") * F.abs(F.col("p") - F.col("other_none"))).alias("value"))
    # What that was wrong by for terms that both hold.
    mine = shares.select("lang", "source", "term", "p", "none")
    theirs = mine.select(F.col("lang").alias("_lang"), F.col("source").alias("other"), F.col("term").alias("_term"), F.col("p").alias("q"), F.col("none").alias("other_none"))
    both = mine.join(theirs, same & (F.col("term") == F.col("_term")) & (F.col("source") < F.col("other")))
    wrong = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("other_none")) - F.abs(F.col("none") - F.col("q")) + F.abs(F.col("none") - F.col("other_none"))
    both = both.select("lang", "source", "other", wrong.alias("value"))
    sums = idle.unionByName(alone).unionByName(both).groupBy("lang", "source", "other").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    ends = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", ends.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(by))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
