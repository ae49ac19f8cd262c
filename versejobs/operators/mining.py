"""Loanword candidates from line ends (L1-L3)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.phonetics import overrides

#: An English word in lower-case text, with apostrophes inside.
WORD = "[a-z]+(?:'[a-z]+)*"
HANGUL = "[가-힣]+"
#: What may stand between a word and the end of its line for it to be a line end: no other token, no other English word, white space.
ENDS = ("token", "word", "bare")


def behind(word: str, ends: str) -> str:
    """A pattern for what stands behind a word up to the end of its line."""
    if ends == "bare":
        return r"[^\S\n]*+\n"
    if word == WORD:  # the same, faster: any letter begins a word
        return r"[^a-z가-힣\n]*+\n" if ends == "token" else r"[^a-z\n]*+\n"
    return rf"(?:(?!{word}|{HANGUL})[^\n])*+\n" if ends == "token" else rf"(?:(?!{word})[^\n])*+\n"


def word_counts(songs: DataFrame, word: str = WORD, ends: str = "token") -> DataFrame:
    """word, total_count, line_end_count of each English word but stopwords. A task folds its own words before the exchange.

    `word` is a pattern over lower-case text that takes in no line break; `ends`, one of ENDS, says which words end a line.
    """
    if ends not in ENDS:
        raise ValueError(f"ends must be one of {ENDS}, not {ends}")
    found = F.regexp_extract_all(F.lower(F.concat("lyrics", F.lit("\n"))), F.lit(f"(?U){HANGUL}|(?:{word})(?:{behind(word, ends)})?"), F.lit(0))
    each = songs.select(F.explode(found).alias("found")).where("found < '가'")
    last = F.endswith("found", F.lit("\n"))
    each = each.select(F.when(last, F.regexp_extract("found", f"^(?:{word})", 0)).otherwise(F.col("found")).alias("word"), last.cast("int").alias("last"))
    counts = each.groupBy("word").agg(F.count("*").alias("total_count"), F.sum("last").alias("line_end_count"))
    return counts.where(~F.col("word").isin(*T.STOPWORDS))


def candidates(counts: DataFrame, n: int = 500) -> DataFrame:
    """L1: the first n words by line ends, all occurrences and spelling."""
    return counts.orderBy(F.desc("line_end_count"), F.desc("total_count"), "word").limit(n)


def uncovered(found: DataFrame) -> DataFrame:
    """L2: candidates without a given spelling; the fixed list is small."""
    return found.join(F.broadcast(overrides(found.sparkSession).select("word")), "word", "left_anti")


def coverage(found: DataFrame) -> DataFrame:
    """L3: how many candidates and line ends have a given spelling."""
    both = found.join(F.broadcast(overrides(found.sparkSession).select("word", F.lit(1).alias("given"))), "word", "left")
    ends = F.sum(F.when(F.col("given") == 1, F.col("line_end_count")).otherwise(0))
    sums = both.agg(F.count("*").alias("words"), F.count("given").alias("given_words"), F.coalesce(F.sum("line_end_count"), F.lit(0)).alias("line_ends"), F.coalesce(ends, F.lit(0)).alias("given_line_ends"))
    return sums.withColumn("share", F.when(F.col("line_ends") > 0, F.col("given_line_ends") / F.col("line_ends")))
