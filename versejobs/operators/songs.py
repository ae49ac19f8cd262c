"""Rhyme density of songs and what is reported of it."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phonetics, rhyme, text


#: Size of a quantile sketch.
SKETCH = 800


def songs_lines(songs: DataFrame, clean: bool = False) -> DataFrame:
    """song_id, line_no, line; clean leaves out section tags."""
    rows = (text.clean_lines if clean else text.lines)(F.col("lyrics"))
    return songs.select("song_id", F.posexplode(rows).alias("line_no", "line"))


def pairs(songs: DataFrame) -> DataFrame:
    """song_id, line_no, score of each line with the next, in ten-thousandths."""
    rows = songs.select("song_id", text.lines(F.col("lyrics")).alias("lines"))
    rows = rows.withColumn("tails", rhyme.tails(F.col("lines")))
    return rows.select("song_id", F.posexplode(rhyme.pair_scores(F.col("tails"))).alias("line_no", "score"))


def density(songs: DataFrame, known: Callable[[Column], Column] | None = None) -> DataFrame:
    """songs with density, in ten-thousandths; 0 for fewer than two lines and for no lyrics. No exchange.

    `known` looks words up in a lexicon that is in the rows (phonetics.in_rows).
    """
    rows = songs.withColumn("_lines", F.coalesce(text.lines(F.col("lyrics")), F.array().cast("array<string>")))
    rows = rows.withColumn("_tails", rhyme.tails(F.col("_lines"), known))
    rows = rows.withColumn("_scores", rhyme.pair_scores(F.col("_tails")))
    return rows.withColumn("density", rhyme.mean_score(F.col("_scores"))).drop("_lines", "_tails", "_scores")


def density_by_words(songs: DataFrame, lexicon: DataFrame | None = None, g2p=None) -> DataFrame:
    """song_id, density with a lexicon or g2p.

    A lexicon whose size is known to be small goes into the rows, so nothing is exchanged; else words are resolved and joined
    to the ends of lines, of which only the last codes go on, and the number of lines is taken inside the row.
    """
    if g2p is None and lexicon is not None and (known := phonetics.in_rows(lexicon)):
        return density(songs, known).select("song_id", "density")
    tails = phonetics.line_tails_by_words(songs_lines(songs), ["song_id", "line_no"], lexicon, g2p)
    by = Window.partitionBy("song_id").orderBy("line_no")
    follows = F.lead("line_no").over(by) == F.col("line_no") + 1  # lines without any sound score nothing
    scored = tails.select("song_id", F.when(follows, rhyme.tail_score(F.col("tail"), F.lead("tail").over(by))).alias("score"))
    sums = scored.groupBy(F.col("song_id").alias("_id")).agg(F.sum("score").alias("s"))
    sized = songs.select("song_id", (F.size(F.coalesce(text.lines(F.col("lyrics")), F.array().cast("array<string>"))) - 1).cast("long").alias("m"))
    found = sized.join(sums, F.col("song_id") == F.col("_id"), "left").withColumn("s", F.coalesce("s", F.lit(0).cast("long")))
    return found.select("song_id", F.when(F.col("m") > 0, F.floor((F.col("s") * 2 + F.col("m")) / (F.col("m") * 2))).otherwise(0).cast("long").alias("density"))


def replaced(songs: DataFrame, known: Callable[[Column], Column] | None = None) -> DataFrame:
    """A1: the density so far becomes rhyme_density_old, if there is one, and the new one takes its place."""
    if "rhyme_density" in songs.columns:
        songs = songs.withColumn("rhyme_density_old", F.col("rhyme_density"))
    return density(songs, known).withColumn("rhyme_density", F.col("density") / 10000).drop("density")


def best_first(*columns: str) -> list[Column]:
    """Orders by the first column downwards, without numbers last, and by the others upwards."""
    first = F.nullif(F.col(columns[0]).cast("double"), F.lit(float("nan")))
    return [first.desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in columns[1:]]]


def top_songs(scored: DataFrame, n: int = 10) -> DataFrame:
    """A2: the first songs by density; columns before the sort are few, so that it moves little."""
    return scored.select("song_id", "artist", "title", "density", "rhyme_density_old").orderBy(*best_first("density", "song_id")).limit(n)


def sketch(value: str, k: int = SKETCH) -> Column:
    """An aggregate: a quantile sketch of a score of any precision, which F.kll_merge_agg_double() merges with others; nulls don't count."""
    return F.kll_sketch_agg_double(F.col(value).cast("double"), k)


def sketched(sketch: Column, share: float = 0.5) -> Column:
    """A quantile from a sketch; of the median's rank it is off by about 1.7 / k**0.9 of the rows, whatever their number."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def spread(scored: DataFrame, exact: bool = True) -> DataFrame:
    """A3, A4, A5: number, mean, sample deviation and median of the new and the old score, and of their difference.

    Old scores are taken as they are. New ones have at most 10,001 values, so their median is exact; that of the old ones,
    which may have any, is so if asked for, else it is a sketch's and takes bounded memory. Means are sums of decimals.
    """
    old = F.nullif(F.col("rhyme_density_old"), F.lit(float("nan")))
    both = scored.select((F.col("density") / 10000).alias("density"), old.alias("old")).withColumn("delta", F.col("density") - F.col("old"))
    found = []
    for name in ("density", "old", "delta"):
        c = F.col(name)
        total = F.sum(c.cast("decimal(28,18)")).cast("double")
        found += [F.count(c).alias(f"{name}_n"), F.try_divide(total, F.count(c)).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_std")]
    old_median = F.median("old") if exact else sketched(sketch("old"))
    return both.agg(*found, F.median("density").alias("density_median"), old_median.alias("old_median"))


def overlap(scored: DataFrame, n: int = 50) -> DataFrame:
    """How many songs are among the first n by the new score and by the old one."""
    narrow = scored.select("song_id", "density", "rhyme_density_old")
    tops = [narrow.orderBy(*best_first(c, "song_id")).limit(n).select("song_id") for c in ("density", "rhyme_density_old")]
    return tops[0].intersect(tops[1]).agg(F.count("*").alias("shared"))


def top_artists(scored: DataFrame, n: int = 10) -> DataFrame:
    """The first artists by mean density; whole sums make the mean independent of the order of rows."""
    sums = scored.where("artist IS NOT NULL").groupBy("artist").agg(F.sum("density").alias("total"), F.count("*").alias("songs"))
    return sums.withColumn("mean", F.floor((F.col("total") * 2 + F.col("songs")) / (F.col("songs") * 2))).orderBy(*best_first("mean", "artist")).limit(n).select("artist", "songs", "mean")


def analyzed(songs: DataFrame, path: str, known: Callable[[Column], Column] | None = None) -> DataFrame:
    """Songs with new scores, written to a new folder, and read from there for reports; each song is scored once."""
    replaced(songs, known).write.parquet(path)
    return songs.sparkSession.read.parquet(path)


def reports(stored: DataFrame, songs: int = 10, artists: int = 10, shared: int = 50) -> DataFrame:
    """A2 to A7 of scored songs, as rows of report, place, name, value and old; lyrics aren't read."""
    narrow = stored.select("song_id", "artist", "title", F.round(F.col("rhyme_density") * 10000).cast("long").alias("density"), *(["rhyme_density_old"] if "rhyme_density_old" in stored.columns else []))
    if "rhyme_density_old" not in narrow.columns:
        narrow = narrow.withColumn("rhyme_density_old", F.lit(None).cast("double"))
    none = F.lit(None).cast("double")

    def placed(rows: DataFrame, report: str, by: list[Column], name: Column, value: Column, old: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by))  # a few rows
        return rows.select(F.lit(report).alias("report"), place.alias("place"), name.cast("string").alias("name"), value.alias("value"), old.alias("old"))

    found = placed(top_songs(narrow, songs), "song", best_first("density", "song_id"), F.col("title"), F.col("density") / 10000, F.col("rhyme_density_old"))
    found = found.unionByName(placed(top_artists(narrow, artists), "artist", best_first("mean", "artist"), F.col("artist"), F.col("mean") / 10000, none))
    both = [F.struct(F.lit(k).alias("place"), F.lit(x).alias("name"), F.col(f"density_{x}").cast("double").alias("value"), F.col(f"old_{x}").cast("double").alias("old")) for k, x in enumerate(("n", "mean", "std", "median"), 1)]
    both += [F.struct(F.lit(k).alias("place"), F.lit(f"delta {x}").alias("name"), F.col(f"delta_{x}").alias("value"), none.alias("old")) for k, x in enumerate(("mean", "std"), 5)]
    found = found.unionByName(spread(narrow).select(F.explode(F.array(*both)).alias("x")).select(F.lit("spread").alias("report"), "x.*"))
    return found.unionByName(overlap(narrow, shared).select(F.lit("overlap").alias("report"), F.lit(1).alias("place"), F.lit("shared").alias("name"), F.col("shared").cast("double").alias("value"), none.alias("old")))
