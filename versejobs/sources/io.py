"""Readers and writers with declared schemas."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import rows_by_name

SONGS = (
    "song_id long, artist string, title string, lyrics string, bpm double, energy double, danceability double, "
    "loudness double, valence double, rhyme_density double, rhyme_density_old double"
)
CANDIDATES = "word string, total_count long, line_end_count long"
TRAINER_STATE = "log_history array<variant>"
#: Columns that every song needs.
NEEDED = ("artist", "title", "lyrics", "bpm", "energy", "danceability", "loudness", "valence")
# Text that a CSV may hold for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def known(value: Column, missing: tuple = MISSING) -> Column:
    return F.when(~value.isin(*missing), value)


def by_name(spark: SparkSession, path: str, kinds: dict[str, str], needed: tuple, missing: tuple = MISSING, split: bool = False, **options) -> DataFrame:
    """A delimited file with a header: columns go by their names, whatever their order; those in `kinds` get their type.

    A missing one of `needed` is an error; further columns stay, as text. The header is the first file's: another file in
    the folder with other names or another order is an error too. A byte order mark before the header is passed over.
    With `split` several tasks read a file.
    """
    rows = spark.read.csv(path, header=True, enforceSchema=False, **options)
    names = [c.lstrip("\ufeff") for c in rows.columns]
    rows = rows_by_name(spark, path, names, options.get("sep", ",")) if split else rows.toDF(*names)
    if lacking := [c for c in needed if c not in rows.columns]:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    return rows.select(*[known(F.col(f"`{c}`"), missing).cast(kinds.get(c, "string")).alias(c) for c in rows.columns])


def read_songs(spark: SparkSession, path: str, needed: tuple = NEEDED, split: bool = False) -> DataFrame:
    """Songs from CSV with quoted line breaks; texts for missing values become null.

    Without a column song_id it is derived from artist, title and lyrics, so exact copies share it. Spark's reader takes such
    a file in one task; with `split` several tasks take it by blocks, if it has no quotes in fields that aren't quoted.
    """
    kinds = dict(c.split() for c in SONGS.split(", "))
    rows = by_name(spark, path, kinds, needed, split=split, multiLine=True, quote='"', escape='"')
    named = [c for c in ("artist", "title", "lyrics") if c in rows.columns]
    if "song_id" not in rows.columns and named:
        rows = rows.select(F.xxhash64(*named).alias("song_id"), "*")
    return rows


def write_songs(songs: DataFrame, path: str) -> None:
    """Songs as CSV, to a folder of their own, with a byte order mark before the header and nothing for missing values."""
    kinds = dict(songs.dtypes)
    given = [F.nullif(F.col(f"`{c}`"), F.lit(float("nan")).cast(kinds[c])) if kinds[c] in ("float", "double") else F.col(f"`{c}`") for c in songs.columns]
    marked = songs.select(*[x.alias(("\ufeff" if k == 0 else "") + c) for k, (x, c) in enumerate(zip(given, songs.columns, strict=True))])
    marked.write.csv(path, header=True, escape='"', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_samples(samples: DataFrame, path: str) -> None:
    """S3: texts of samples as JSON lines."""
    samples.select("text").write.json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Texts of samples; a line that isn't a JSON object, or whose text isn't a text, is an error when it is read."""
    lines = parsed_lines(spark, path)
    wrong = F.raise_error(F.concat(F.lit("not a sample, in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80)))
    return lines.select(F.when(F.col("good"), F.col("text")).otherwise(wrong).alias("text"))


def read_samples_apart(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Texts of the lines that are samples; file and value of those that aren't."""
    lines = parsed_lines(spark, path)
    return lines.where("good").select("text"), lines.where("NOT good").select("file", "value")


def parsed_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value, text and good of each line that isn't blank."""
    lines = spark.read.text(path).where("trim(value) != ''").select(F.col("_metadata.file_path").alias("file"), "value")
    lines = lines.withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    text = F.try_variant_get("v", "$.text", "variant")
    object_like, text_like = F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.coalesce(F.schema_of_variant(text).isin("STRING", "VOID"), F.lit(True))
    return lines.select("file", "value", F.when(object_like, F.try_variant_get("v", "$.text", "string")).alias("text"), (object_like & text_like).alias("good"))


def count_samples(spark: SparkSession, path: str) -> DataFrame:
    """How many lines an output has, blank ones among them; nothing is parsed."""
    return spark.read.text(path).agg(F.count("*").alias("samples"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """S6"""
    kinds = dict(c.split() for c in CANDIDATES.split(", "))
    return by_name(spark, path, kinds, tuple(kinds), missing=("",), sep="\t").select(*kinds)


def write_candidates(candidates: DataFrame, path: str) -> None:
    candidates.select("word", "total_count", "line_end_count").write.csv(path, sep="\t", header=True)


def first_pronunciations(entries: DataFrame) -> DataFrame:
    """Word, phones from lines `WORD(n)  PHONES` (value) of a pronouncing dictionary; of several the first counts."""

    def parts(v: Column) -> Column:
        return F.struct(v.alias("value"), F.regexp_extract(v, r"^(\S+?)(?:\(\d+\))?\s", 1).alias("word"), F.regexp_extract(v, r"^\S+?\((\d+)\)\s", 1).alias("n"), F.regexp_extract(v, r"^\S+\s+(.*)$", 1).alias("phones"))

    # A function over one element, exploded, so that a line that is worked out from columns is so once, not for each use of it.
    each = F.transform(F.array("value"), parts)
    rows = entries.select(F.explode(F.filter(each, lambda x: ~x["value"].like(";;;%") & (F.trim(x["value"]) != ""))).alias("x")).select("x.word", "x.n", "x.phones")
    variant = F.when(F.col("n") == "", 0).otherwise(F.col("n").cast("int"))
    return rows.where("word != ''").groupBy(F.lower("word").alias("word")).agg(F.min_by("phones", variant).alias("phones"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return first_pronunciations(spark.read.text(path))


def write_trainer_states(states: DataFrame, path: str) -> None:
    """A state file for each row of states (stage, checkpoint, log_history), in folders as read_trainer_states() finds them."""
    states.write.partitionBy("stage", "checkpoint").json(path)


def read_trainer_states(spark: SparkSession, path: str) -> DataFrame:
    """log_history (values as they are typed in JSON) and file of each state file; the stage is the folder above the checkpoint's.

    A file that isn't JSON is an error.
    """
    rows = spark.read.schema(TRAINER_STATE).json(path, multiLine=True, mode="FAILFAST").select("log_history", F.col("_metadata.file_path").alias("file"))
    return rows.withColumn("stage", F.regexp_extract("file", "([^/=]+)/[^/]+/[^/]+$", 1))
