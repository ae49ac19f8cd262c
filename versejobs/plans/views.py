"""The driver's tables as songs, completions, logs and pronunciations, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..sources.shared import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as songs: some have a section tag in front, every third line ends in a Hangul character."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").withColumn("_lines", F.split("text", "\n", -1))

    def line(x, n):
        c = F.decode(F.unhex(F.hex(F.lit(T.FIRST_HANGUL) + (i * 131 + n * 977) % 11172)), "UTF-16BE")
        return F.when((i + n) % 3 == 0, F.concat(x, F.lit(" "), c)).otherwise(x)

    body = F.array_join(F.transform("_lines", line), "\n")
    return docs.select(
        i.alias("song_id"), F.col("source").alias("artist"), F.concat(F.lit("doc-"), i.cast("string")).alias("title"),
        F.concat(F.when(i % 4 == 0, "[Verse]\n").otherwise(""), body).alias("lyrics"), (i % 120 + 60).cast("double").alias("bpm"), (i * 7 % 101 / 100).alias("energy"),
        (i * 13 % 101 / 100).alias("danceability"), (-(i * 3 % 150) / 10).alias("loudness"), (i * 17 % 101 / 100).alias("valence"), (i * 37 % 10001 / 10000).alias("rhyme_density_old"),
    )


SONGS_SQL = """lined AS (SELECT *, string_split(text, chr(10)) AS parts FROM documents),
songs AS (SELECT doc_id AS song_id, source AS artist, 'doc-' || doc_id AS title,
  CASE WHEN doc_id % 4 = 0 THEN '[Verse]' || chr(10) ELSE '' END || array_to_string(list_transform(parts, lambda x, n:
    CASE WHEN (doc_id + n - 1) % 3 = 0 THEN x || ' ' || chr((44032 + (doc_id * 131 + (n - 1) * 977) % 11172)::INT) ELSE x END), chr(10)) AS lyrics,
  (60 + doc_id % 120)::DOUBLE AS bpm, (doc_id * 7 % 101)::DOUBLE / 100::DOUBLE AS energy, (doc_id * 13 % 101)::DOUBLE / 100::DOUBLE AS danceability,
  (-((doc_id * 3) % 150))::DOUBLE / 10::DOUBLE AS loudness, (doc_id * 17 % 101)::DOUBLE / 100::DOUBLE AS valence, doc_id * 37 % 10001 AS old_score FROM lined)"""


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn with the assistant's next as prompt and completion."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(by)).withColumn("reply", F.lead("text").over(by))
    bars = F.when(F.col("conv_id") % 2 == 0, "8").otherwise("16")
    reply = F.when(F.col("conv_id") % 5 == 0, F.concat("reply", F.lit("\n"), "reply")).otherwise(F.col("reply"))
    reply = F.concat(reply, F.when(F.col("conv_id") % 3 == 0, "\n[End]").otherwise(""))
    return turns.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit("\n[Verse "), bars, F.lit("마디]\n")).alias("prompt"), reply.alias("completion"))


COMPLETIONS_SQL = """turns AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
completions AS (SELECT conv_id, turn, text || chr(10) || '[Verse ' || CASE WHEN conv_id % 2 = 0 THEN '8' ELSE '16' END || '마디]' || chr(10) AS prompt,
  CASE WHEN conv_id % 5 = 0 THEN reply || chr(10) || reply ELSE reply END || CASE WHEN conv_id % 3 = 0 THEN chr(10) || '[End]' ELSE '' END AS completion
  FROM turns WHERE role = 'user' AND next_role = 'assistant')"""


def loss_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log entries: the stage is the type, the step props.k, files follow by time and id."""
    file = F.concat_ws("/", F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    step = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), file.alias("file"), F.lit(0).alias("pos"), step.alias("step"), F.col("value").cast("double").alias("loss")).where("step IS NOT NULL AND loss IS NOT NULL")


#: For the pseudo lexicon: the phone that stands for each letter.
LETTER_PHONES = {
    "a": "AE1", "b": "B", "c": "K", "d": "D", "e": "EH1", "f": "F", "g": "G", "h": "HH", "i": "IY0", "j": "JH", "k": "K", "l": "L", "m": "M",
    "n": "N", "o": "OW1", "p": "P", "q": "CH", "r": "R", "s": "S", "t": "T", "u": "AH0", "v": "V", "w": "W", "x": "SH", "y": "Y", "z": "Z",
}


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pronunciation for every English word of the documents, letter by letter."""
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    phones = F.array(*[F.lit(p) for p in LETTER_PHONES.values()])  # by the letter's place in the alphabet
    return found.withColumn("phones", F.array_join(F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: F.get(phones, F.ascii(c) - ord("a"))), " "))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon as dictionaries are: words of a length divisible by five aren't in it, so all ways to a word's codes are taken."""
    return lexicon(spark, sf_dir).where("length(word) % 5 != 0")


def trainer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stage, checkpoint, log_history: events as state files with the entries of 1000 event_ids each.

    Some entries have a step or a loss of another type: as a text, with a point, as a truth value, null or nested.
    """
    i, k, loss = F.col("event_id"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.coalesce(F.col("value").cast("string"), F.lit("null"))
    step = F.when(i % 7 == 1, F.concat(F.lit('"'), k, F.lit('"'))).when(i % 7 == 2, F.concat(k, F.lit(".5"))).otherwise(k)
    loss = F.when(i % 11 == 1, F.concat(F.lit('"'), loss, F.lit('"'))).when(i % 11 == 2, "true").when(i % 11 == 3, "null").when(i % 11 == 4, F.concat(F.lit("["), loss, F.lit("]"))).otherwise(loss)
    entry = F.concat(F.lit('{"step":'), step, F.lit(',"loss":'), loss, F.lit(',"lr":{"value":1}}'))
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.lpad(F.floor(i / 1000).cast("string"), 16, "0").alias("checkpoint"), "event_id", entry.alias("entry"))
    logs = F.array_sort(F.collect_list(F.struct("event_id", "entry")))  # 1000 entries at most
    return events.groupBy("stage", "checkpoint").agg(F.transform(logs, lambda x: F.parse_json(x["entry"])).alias("log_history"))


LEXICON_SQL = f"""words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
lexicon AS (SELECT word, array_to_string(list_transform(string_split(word, ''), lambda c: MAP {{{", ".join(f"'{k}': '{v}'" for k, v in LETTER_PHONES.items())}}}[c]), ' ') AS phones FROM words)"""
