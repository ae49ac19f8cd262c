"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Each source gets a target in words. Its documents are lined up by size, each stands for `target / source size` expected
copies, and one random offset is added to the running sum: a document is taken once for each whole number that the sum
crosses at it. Large documents of a source are lined up first; what they leave of the target, or have in excess, changes the
expected copies of all others alike. Of some random offsets the one that brings the words nearest to the target is used.

Defined results: a null text has size 0; null sources are one source, the last; a source without words has target 0 and
nothing of it is taken; repeated rows count one by one; an empty table gives an empty result; further columns
stay, whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, unit_hash, unused, word_count

#: Sources by code point weigh these, repeating.
WEIGHTS = (1, 2, 3)
#: Most that a source, and so a document, is repeated.
MOST = 3
SEED = "mix-1"
#: Offsets that are drawn for a source; the one that brings its words nearest to the target is added.
TRIES = 8
#: A document of more than one of so many parts of its source's target is a large one.
LARGE = 32


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source in `sizes` (source, size).

    A target is the smaller of `most` times the source's size and its weight times one level; the level rises as sources
    reach their bound, until the targets sum to all sizes. Each rise is one aggregate over the table of sources.
    """
    sources = numbered(cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), [], ["source"])
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("row_no") % len(weights)).cast("int"))
    sources = cut(sources.select("source", "source_size", weight.alias("weight")))
    bound = F.col("source_size") * float(most)
    total, level = sources.agg(F.sum("source_size")).first()[0] or 0, None
    while True:
        free = F.lit(True) if level is None else bound > F.lit(level) * F.col("weight")
        held, share = sources.agg(F.sum(F.when(~free, F.col("source_size") * most)), F.sum(F.when(free, F.col("weight")))).first()
        if not share:
            break
        risen = (total - (held or 0)) / share
        if level is not None and risen <= level:
            break
        level = risen
    return sources.select("source", "source_size", F.least(bound, F.lit(level or 0.0) * F.col("weight")).alias("target"))


def copies(docs: DataFrame, seed: str = SEED, by: tuple = ("doc_id", "source", "size")) -> DataFrame:
    """One row for each row of docs: the columns `by`, then source_size, target and how many copies the mix takes."""
    sizes = cut(docs.withColumn("size", word_count(F.col("text"))).select(*by))
    goal = cut(targets(sizes).withColumnsRenamed({"source": "_of", "source_size": "_all", "target": "_goal"}))
    same = F.col("source").eqNullSafe(F.col("_of"))
    classed = sizes.join(goal, same).withColumn("_large", F.col("size") * LARGE > F.col("_goal")).select(*by, "_large")
    lined = numbered(classed, ["source", "_large"], ["size", *[c for c in by if c not in ("source", "size")]])
    offsets = [unit_hash(f"{seed}-{k}", F.col("_of")) for k in range(TRIES)]

    def crossed(rate: str, offset: Column) -> Column:
        upto, before = ((F.col("row_no") + k).cast("double") * F.col(rate) + offset for k in (1, 0))
        return F.floor(upto) - F.floor(before)

    def tried(rows: DataFrame, rate: str) -> DataFrame:
        """_source and _words: by offset, the words that it takes of some rows of a source."""
        each = [F.sum(crossed(rate, o) * F.col("size")).alias(f"_{k}") for k, o in enumerate(offsets)]
        return rows.groupBy("_of").agg(*each).select(F.col("_of").alias("_source"), F.array(*[f"_{k}" for k in range(TRIES)]).alias("_words"))

    def best(*lacks) -> Column:
        """The offset (place, words) with the least lack, by each function of the words in turn."""
        ways = [F.struct(*[lack(F.coalesce(F.get("_words", k), F.lit(0)).cast("double")).alias(f"l{i}") for i, lack in enumerate(lacks)], F.lit(k).alias("k"), o.alias("offset"), F.coalesce(F.get("_words", k), F.lit(0)).alias("words")) for k, o in enumerate(offsets)]
        return F.array_min(F.array(*ways))

    rest = sizes.join(goal, same).groupBy(F.col("_of").alias("_source")).agg(F.sum(F.when(F.col("size") * LARGE <= F.col("_goal"), F.col("size")).otherwise(0)).alias("_rest"))
    goal = goal.join(rest, F.col("_of").eqNullSafe(F.col("_source"))).drop("_source")
    goal = cut(goal.withColumn("_rate", F.when(F.col("_all") > 0, F.col("_goal") / F.col("_all")).otherwise(0.0)))

    def filled(words: Column) -> Column:
        """What the small documents can add to the words of the large ones."""
        return F.least(F.greatest(F.col("_goal") - words, F.lit(0.0)), F.col("_rest") * float(MOST))

    large = tried(lined.where("_large").join(goal, same), "_rate")
    first = best(lambda w: F.abs(F.col("_goal") - w - filled(w)), lambda w: F.abs(F.col("_goal") - F.col("_rest") * F.col("_rate") - w))
    goal = goal.join(large, F.col("_of").eqNullSafe(F.col("_source")), "left").withColumn("_first", first).drop("_source", "_words")
    goal = cut(goal.withColumn("_second", F.when(F.col("_rest") > 0, filled(F.col("_first.words").cast("double")) / F.col("_rest")).otherwise(0.0)))
    small = tried(lined.where("NOT _large").join(goal, same), "_second")
    second = best(lambda w: F.abs(F.col("_goal") - F.col("_first.words") - w))
    goal = goal.join(small, F.col("_of").eqNullSafe(F.col("_source")), "left").withColumn("_last", second).drop("_source", "_words")
    taken = F.when(F.col("_large"), crossed("_rate", F.col("_first.offset"))).otherwise(crossed("_second", F.col("_last.offset")))
    return lined.join(goal, same).select(*by, F.col("_all").alias("source_size"), F.col("_goal").alias("target"), taken.alias("copies"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs.

    Texts move once, to meet their number of copies; rows alike in doc_id, source and text are interchangeable.
    """
    kept, alike, copy = docs.columns, unused("alike", docs), unused("copy", docs)
    # Null is told from text by a mark, so that one plain column says which rows are alike.
    digest = F.md5(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in ("doc_id", "source")], F.xxhash64("text").cast("string")))
    narrow = docs.select("doc_id", "source", "text").withColumn("_alike", digest)
    plan = copies(narrow, seed, ("doc_id", "source", "size", "_alike"))
    plan = plan.groupBy(F.col("_alike").alias(copy)).agg(F.struct(F.sum("copies").alias("all"), F.count("*").alias("rows")).alias(f"{copy}_plan"))
    plan = plan.select(F.struct(F.col(copy).alias("key"), F.col(f"{copy}_plan.*")).alias(copy))
    found = docs.withColumn(alike, digest)
    found = found.join(plan, F.col(alike) == F.col(f"{copy}.key"))
    # Rows that are alike share their copies; the window reads them in the order that the join has left.
    rank = F.row_number().over(Window.partitionBy(alike).orderBy(alike))
    n = F.floor(F.col(f"{copy}.all") / F.col(f"{copy}.rows")) + F.when(rank <= F.col(f"{copy}.all") % F.col(f"{copy}.rows"), 1).otherwise(0)
    found = found.withColumn(copy, n).where(F.col(copy) > 0)
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy).cast("int")))).select(*kept)
