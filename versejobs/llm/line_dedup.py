"""Line dedup by content-defined chunks of lines and by repeated long runs, with DataFrame operations only.

A line's hash is the start of its MD5. A rolling hash over each two neighbouring lines ends a chunk where it is divisible
by DIVISOR, so an inserted line moves only the boundaries next to it. Chunks of two lines and more that stand twice in
the corpus are removed everywhere but at their first place: the smallest doc_id, there the first occurrence. Chunks count
as alike only if their bytes are: the texts themselves are the grouping key, the MD5 only leads from there to the places,
and a digest that stood for two texts would remove nothing.

Chunks miss what lies across their boundaries. So every run of lines with over LONG words that stands twice goes as well,
wherever it begins: of each line with words the shortest such runs that begin and that end with it. Every longer repeated run
is made up of these, so all its lines from the first with words to the last go, but at its first place. Runs are grouped by the
SHA-256 of the SHA-256 of their lines.

Places meet the repeated keys by a join on the key, and then come together by document. Where the keys aren't few enough to be
sent to all tasks, a key that stands very often is a large partition of that join, which adaptive execution can split.

Defined results: a null text stays null with 0 lines; an empty text is one empty line; a text all of whose lines go
becomes empty; null doc_ids rank last and count as one document; rows with equal doc_id and text get equal results and
take nothing from each other; an empty table gives an empty result; further columns stay, whatever their names;
n_lines and removed_lines are set.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: White space within lines, beside the blank.
BLANKS = "\t\x0b\x0c\r"
#: A chunk ends after a line where the rolling hash is divisible by this: the mean number of lines.
DIVISOR = 3
#: Lines in the rolling hash.
ROLL = 2
#: Fewest lines of a chunk that may be removed.
LEAST = 2
#: A repeated run of lines with more words than this goes whole, also a single line.
LONG = 50
LAST_ID = (1 << 63) - 1


def chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, h (hash of the text), first (line, from 0), n and chunk, the text of it, for each chunk of each document."""

    def hash_of(line):
        return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")

    lined = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n", -1).alias("lines"))
    lined = lined.withColumn("hashes", F.transform("lines", hash_of))
    n = F.size("hashes")

    def ends(i):
        rolled = F.get("hashes", i - 1) * 31 + F.get("hashes", i)
        return (i == n - 1) | ((i >= ROLL - 1) & (rolled % divisor == 0))

    lined = lined.withColumn("ends", F.filter(F.sequence(F.lit(0), n - 1), ends))
    spans = F.transform("ends", lambda e, j: F.struct(F.when(j == 0, 0).otherwise(F.get("ends", j - 1) + 1).alias("first"), e.alias("last")))
    found = lined.select("doc_id", "h", "lines", F.explode(spans).alias("span"))
    size = F.col("span.last") - F.col("span.first") + 1
    text = F.array_join(F.slice("lines", F.col("span.first") + 1, size), "\n")
    return found.select("doc_id", "h", F.col("span.first").alias("first"), size.alias("n"), text.alias("chunk"))


def runs(docs: DataFrame, long: int = LONG) -> DataFrame:
    """doc_id, h, first, n and key of the shortest runs of lines with over `long` words from and up to each line with words."""
    # No filter stands on what is derived here: it would go below this and derive it twice.
    lined = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n", -1).alias("lines"), "text")
    other = F.translate("text", BLANKS, " " * len(BLANKS))
    has_other = F.contains("text", F.lit(BLANKS[0]))
    for c in BLANKS[1:]:
        has_other |= F.contains("text", F.lit(c))
    lined = lined.withColumn("plain", F.when(has_other, F.split(other, "\n", -1)).otherwise(F.col("lines")))

    def words(line):
        """Words of a line, but no more than decide whether it is a run by itself."""
        odd = (line == "") | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | F.contains(line, F.lit("  "))
        few = F.size(F.split(line, " ", long + 1))  # the last part has all further words
        return F.when(odd, F.least(F.size(F.array_remove(F.split(line, " ", -1), "")), F.lit(long + 1))).otherwise(few)

    # The line of each word. A line's first word and the one `long` words on name a run, as do its last and the one `long` before.
    lined = lined.withColumn("of", F.flatten(F.transform("plain", lambda x, i: F.array_repeat(i, words(x)))))
    lined = lined.withColumn("most", F.size("of") - 1)

    def at(i):
        return F.get("of", i)

    heads = F.array_compact(F.transform(F.when(F.col("most") >= long, F.col("of")), lambda line, p: F.when(~at(p - 1).eqNullSafe(line), p)))
    lined = lined.withColumn("heads", heads).withColumn("keys", F.transform("lines", lambda x: F.sha2(x, 256)))
    starts = F.transform(F.filter("heads", lambda p: p + long <= F.col("most")), lambda p: F.struct(at(p).alias("first"), at(p + long).alias("last")))
    tails = F.transform("heads", lambda p, i: F.coalesce(F.get("heads", i + 1), F.col("most") + 1) - 1)
    stops = F.transform(F.filter(tails, lambda q: q >= long), lambda q: F.struct(at(q - long).alias("first"), at(q).alias("last")))

    def named(r):
        n = r["last"] - r["first"] + 1
        return F.struct(r["first"].alias("first"), n.alias("n"), F.unhex(F.sha2(F.array_join(F.slice("keys", r["first"] + 1, n), ""), 256)).alias("key"))

    lined = lined.select("doc_id", "h", "keys", F.array_distinct(F.concat(starts, stops)).alias("found"))
    return lined.select("doc_id", "h", F.explode(F.transform("found", named)).alias("run")).select("doc_id", "h", "run.*")


def ranked() -> Column:
    return F.coalesce("doc_id", F.lit(LAST_ID))


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, least: int = LEAST) -> DataFrame:
    """doc_id, h, first, n, key and owner (the smallest doc_id that has it) of the places of chunks that stand twice."""
    places = chunks(docs, divisor).where(F.col("n") >= least)
    # Grouping by the text compares bytes; copies within a task are folded before the shuffle.
    twice = places.groupBy("chunk").agg(F.count("*").alias("times"), F.min(ranked()).alias("owner")).where("times > 1")
    twice = twice.groupBy(F.unhex(F.md5("chunk")).alias("key")).agg(F.count("*").alias("texts"), F.min("owner").alias("owner")).where("texts = 1").drop("texts")
    return places.select("doc_id", "h", "first", "n", F.unhex(F.md5("chunk")).alias("key")).join(twice, "key")


def repeated_runs(docs: DataFrame, long: int = LONG) -> DataFrame:
    """The places of runs that stand twice, as in repeated_chunks()."""
    places = runs(docs, long)
    twice = places.groupBy("key").agg(F.count("*").alias("times"), F.min(ranked()).alias("owner")).where("times > 1").drop("times")
    return places.join(twice, "key")


def dedup(docs: DataFrame, divisor: int = DIVISOR, least: int = LEAST, long: int | None = LONG) -> DataFrame:
    """docs without the repeated chunks and runs in text, and the columns n_lines (before) and removed_lines; long None: chunks alone."""
    narrow = docs.select("doc_id", "text")
    places = repeated_chunks(narrow, divisor, least)
    if long is not None:
        places = places.unionByName(repeated_runs(narrow, long))
    own = ranked() == F.col("owner")
    place = F.struct(F.when(own, F.col("key")).alias("key"), "first", "n")
    gone = places.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(place)).alias("places"))
    # Keys stand in order, so a place of the owner's goes if the one before it has its key.
    again = F.filter("places", lambda x, i: x["key"].isNull() | ((i > 0) & (F.get("places", i - 1)["key"] == x["key"])))
    gone = gone.select(F.col("doc_id").alias("id"), "h", F.transform(again, lambda x: F.struct(x["first"].alias("first"), x["n"].alias("n"))).alias("spans")).where("size(spans) > 0")

    given = [c for c in docs.columns if c not in ("n_lines", "removed_lines")]
    lost, text = unused("lost", docs), unused("lines", docs)
    gone = gone.select(F.struct("id", "h", "spans").alias(lost))
    both = docs.select(*given).join(gone, F.col("doc_id").eqNullSafe(F.col(f"{lost}.id")) & (F.xxhash64("text") == F.col(f"{lost}.h")), "left")
    both = both.withColumn(lost, F.array_distinct(F.flatten(F.transform(f"{lost}.spans", lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)))))
    both = both.withColumn(text, F.split("text", "\n", -1))
    both = both.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(text)).cast("long"))
    both = both.withColumn("removed_lines", F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost)).cast("long"))
    left = F.array_except(F.sequence(F.lit(0), F.size(text) - 1), lost)
    kept = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(text, i)), "\n"))
    return both.withColumn("text", kept).select(*given, "n_lines", "removed_lines")
