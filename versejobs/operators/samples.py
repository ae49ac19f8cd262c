"""Training samples cut from songs."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats, text

LEAST_LINES, SHORT, LONG = 8, 8, 16


def samples(songs: DataFrame, number=formats.short_number) -> DataFrame:
    """song_id, pos, text: windows of 16, then of 8 lines, without repeats within the song. No exchange."""
    rows = songs.withColumn("_lines", text.clean_lines(F.col("lyrics"))).where(F.size("_lines") >= LEAST_LINES)
    long_ones = F.when(F.size("_lines") >= LONG, text.chunks(F.col("_lines"), LONG)).otherwise(F.array().cast("array<array<string>>"))
    rows = rows.withColumn("_chunks", F.concat(long_ones, text.chunks(F.col("_lines"), SHORT))).withColumn("_audio", formats.audio(number))
    texts = F.array_distinct(F.transform("_chunks", lambda c: formats.sample_text(F.col("_audio"), c)))
    return rows.select("song_id", F.posexplode(texts).alias("pos", "text"))


def split(rows: DataFrame, share: float = 0.1, seed: int = 42, key: tuple = ("song_id", "pos")) -> DataFrame:
    """Rows with is_eval, true for about `share` of them, by a hash of the seed and the key. No exchange."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    return rows.withColumn("is_eval", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(share * 2**32))


def split_exactly(rows: DataFrame, share: float = 0.1, seed: int = 42, key: tuple = ("song_id", "pos")) -> DataFrame:
    """Rows with is_eval, true for `share` of them, rounded up: those first by the hash of split() and by the key.

    Counts by the hash's first 16 bits lead to the part that holds the last such row; that part alone is sorted. The rows
    themselves are not exchanged. Rows alike in the key are all in or all out.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    rows = rows.withColumn("_place", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(F.shiftright("_place", 16).alias("p")).agg(F.count("*").alias("n")).collect())  # 65,536 at most
    wanted = math.ceil(sum(n for _, n in counts) * share)
    if not wanted:
        return rows.withColumn("is_eval", F.lit(False)).drop("_place")
    part = 0
    for part, n in counts:  # noqa: B007
        if wanted <= n:
            break
        wanted -= n
    place = F.struct("_place", *key)
    kind = rows.select(place.alias("at")).schema["at"].dataType
    last = rows.where(F.shiftright("_place", 16) == part).select(place.alias("at")).orderBy("at").limit(wanted).agg(F.max("at")).first()[0]
    return rows.withColumn("is_eval", place <= F.struct(*map(F.lit, last)).cast(kind)).drop("_place")


def marked(rows: DataFrame, end_of_text: str) -> DataFrame:
    """D7"""
    return rows.withColumn("text", F.concat("text", F.lit(end_of_text)))
