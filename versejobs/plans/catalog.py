"""Every registered query of the lyric operators, and SQL that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, phonetics, rhyme, text
from ..operators import metrics, mining, prompts, rewards, samples, songs
from ..sources import io
from ..sources.shared import kept, new_folder
from ..streaming import rewards as stream
from . import oracle as O
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str):
    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[query.__name__], ORACLES[query.__name__] = query, sql
        return query

    return add


# Sources and sinks.


@registered(f"WITH {O.SONGS_SQL} SELECT song_id, artist, title, lyrics, bpm, loudness FROM songs")
def songs_csv(spark, sf_dir):
    """Songs written as CSV and read again."""
    path = new_folder(spark)
    io.write_songs(views.songs(spark, sf_dir), path)
    return io.read_songs(spark, path).select("song_id", "artist", "title", "lyrics", "bpm", "loudness")


@registered(f"WITH {O.SONGS_SQL} SELECT song_id, artist, title, lyrics, bpm, loudness FROM songs")
def songs_csv_split(spark, sf_dir):
    """S1, by blocks of files: the same songs, read by several tasks a file."""
    path = new_folder(spark)
    io.write_songs(views.songs(spark, sf_dir), path)
    return io.read_songs(spark, path, split=True).select("song_id", "artist", "title", "lyrics", "bpm", "loudness")


@registered(f"""WITH {O.SAMPLES} SELECT text, (length(text) % 5 = 0)::INT AS malformed FROM samples WHERE length(text) % 5 <> 0
UNION ALL SELECT substr(text, 1, 40), 1 FROM samples WHERE length(text) % 5 = 0""")
def malformed_samples(spark, sf_dir):
    """Every fifth line isn't JSON; these come apart."""
    path = new_folder(spark)
    found = samples.samples(views.songs(spark, sf_dir)).withColumn("bad", F.length("text") % 5 == 0)
    found.select(F.when(F.col("bad"), F.translate(F.substring("text", 1, 40), "\n\r", "¶¶")).otherwise(F.to_json(F.struct("text"))).alias("value")).write.text(path)
    good, bad = io.read_samples_apart(spark, path)
    return good.select("text", F.lit(0).alias("malformed")).unionByName(bad.select(F.translate("value", "¶", "\n").alias("text"), F.lit(1).alias("malformed")))


@registered(f"WITH {O.SAMPLES} SELECT text FROM samples")
def samples_json(spark, sf_dir):
    """Samples written as JSON lines and read again."""
    path = new_folder(spark)
    io.write_samples(samples.samples(views.songs(spark, sf_dir)), path)
    return io.read_samples(spark, path)


@registered(f"WITH {O.SAMPLES} SELECT count(*) AS samples, count(DISTINCT song_id) AS songs FROM samples")
def sample_count(spark, sf_dir):
    """S5"""
    return samples.samples(views.songs(spark, sf_dir)).agg(F.count("*").alias("samples"), F.count_distinct("song_id").alias("songs"))


@registered(f"WITH {O.SAMPLES} SELECT count(*) AS samples FROM samples")
def stored_sample_count(spark, sf_dir):
    """S5, of an output that is there already"""
    path = new_folder(spark)
    io.write_samples(samples.samples(views.songs(spark, sf_dir)), path)
    return io.count_samples(spark, path)


@registered(f"WITH {O.MINED} SELECT * FROM found")
def candidates_tsv(spark, sf_dir):
    """Candidates written as tab-separated text and read again."""
    path = new_folder(spark)
    io.write_candidates(mining.candidates(mining.word_counts(views.songs(spark, sf_dir))), path)
    return io.read_candidates(spark, path)


@registered(f"WITH {O.LEXICON_SQL} SELECT word, phones FROM lexicon")
def first_pronunciations(spark, sf_dir):
    """Of dictionary lines with several variants of each word, the first."""
    words = views.lexicon(spark, sf_dir)
    later = words.select(F.concat(F.upper("word"), F.lit("(1)  "), F.reverse("phones")).alias("value"))
    return io.first_pronunciations(words.select(F.concat(F.upper("word"), F.lit("  "), F.col("phones")).alias("value")).unionByName(later))


# Lines and tokens.


@registered(f"WITH {O.SONGS_SQL}, {O.LINES_SQL} SELECT song_id, line_no::INT AS line_no, line FROM lines")
def song_lines(spark, sf_dir):
    """T1, T3"""
    return songs.songs_lines(views.songs(spark, sf_dir))


@registered(f"WITH {O.SONGS_SQL}, c AS (SELECT song_id, {O.CLEAN} AS l FROM songs) SELECT song_id, unnest(range(len(l)))::INT AS line_no, unnest(l) AS line FROM c")
def clean_lines(spark, sf_dir):
    """T2"""
    return songs.songs_lines(views.songs(spark, sf_dir), clean=True)


@registered(f"WITH {O.SONGS_SQL}, {O.LINES_SQL} SELECT song_id, line_no::INT AS line_no, {O.TOKEN.format('line')} AS tokens FROM lines")
def line_tokens(spark, sf_dir):
    """T4"""
    return songs.songs_lines(views.songs(spark, sf_dir)).select("song_id", "line_no", text.tokens(F.col("line")).alias("tokens"))


@registered(f"WITH {O.SONGS_SQL}, c AS (SELECT song_id, {O.CLEAN} AS l FROM songs), k AS (SELECT song_id, {O.chunk_list(8)} AS c FROM c) SELECT song_id, unnest(range(len(c)))::INT AS chunk_no, array_to_string(unnest(c), '/') AS chunk FROM k")
def line_chunks(spark, sf_dir):
    """T5"""
    rows = views.songs(spark, sf_dir).select("song_id", text.clean_lines(F.col("lyrics")).alias("l"))
    return rows.select("song_id", F.posexplode(text.chunks(F.col("l"), 8)).alias("chunk_no", "c")).select("song_id", "chunk_no", F.array_join("c", "/").alias("chunk"))


# Pronunciation.


@registered(f"WITH {O.SONGS_SQL}, {O.LINES_SQL}, t AS (SELECT DISTINCT unnest(regexp_extract_all(line, '[가-힣]+')) AS token FROM lines) SELECT token, {O.fill(O.HANGUL, 'token')} AS codes FROM t")
def hangul_codes(spark, sf_dir):
    """P1"""
    lines = songs.songs_lines(views.songs(spark, sf_dir))
    tokens = lines.select(F.explode(F.regexp_extract_all("line", F.lit("[가-힣]+"), F.lit(0))).alias("token")).distinct()
    return tokens.select("token", phonetics.hangul_codes(F.col("token")).alias("codes"))


@registered(f"WITH {O.LEXICON_SQL} SELECT word, {O.fill(O.LETTERS, 'word')} AS codes FROM lexicon")
def letter_codes(spark, sf_dir):
    """P6"""
    return views.lexicon(spark, sf_dir).select("word", phonetics.fallback_codes(F.col("word")).alias("codes"))


@registered(f"WITH {O.SPOKEN} SELECT l.word, loanword, coalesce(codes, []::INT[]) AS codes, coalesce(simple_codes, []::INT[]) AS simple_codes FROM lexicon l LEFT JOIN spoken USING (word)")
def loanwords(spark, sf_dir):
    """P2 to P5"""
    return phonetics.with_syllables(views.lexicon(spark, sf_dir)).select("word", "loanword", "codes", "simple_codes")


@registered(f"WITH {O.SONGS_SQL}, {O.LINES_SQL}, {O.coded('lines', 'song_id, line_no')} SELECT token, codes FROM coded")
def word_codes(spark, sf_dir):
    """P7 to P9 without a lexicon"""
    lines = songs.songs_lines(views.songs(spark, sf_dir))
    return phonetics.resolve_words(lines.select(F.explode(text.tokens(F.col("line"))).alias("token")))


@registered(f"WITH {O.SPOKEN}, {O.SONGS_SQL}, {O.LINES_SQL}, {O.coded('lines', 'song_id, line_no', 'known')} SELECT song_id, line_no::INT AS line_no, codes FROM tails")
def line_codes_lexicon(spark, sf_dir):
    """P9, P11 with a lexicon, by join"""
    lines = songs.songs_lines(views.songs(spark, sf_dir))
    counts = kept(lines.select(F.explode(text.tokens(F.col("line"))).alias("token")).groupBy("token").count())
    words = kept(phonetics.resolve_words(counts, views.dictionary(spark, sf_dir)))
    return phonetics.line_codes_by_words(lines, words, ["song_id", "line_no"], counts=counts).select("song_id", "line_no", "codes")


@registered(f"WITH {O.SONGS_SQL}, {O.LINES_SQL}, {O.coded('lines', 'song_id, line_no')} SELECT song_id, line_no::INT AS line_no, tail FROM tails")
def line_ends(spark, sf_dir):
    """P11 inside the row, the last three syllables"""
    return songs.songs_lines(views.songs(spark, sf_dir)).select("song_id", "line_no", phonetics.last_codes(F.col("line")).alias("tail"))


def say(word: str) -> str | None:
    """A pronouncing library for tests: it fails for some words and has nothing for others."""
    if ord(word[0]) % 3 == 0:
        raise ValueError(word)
    return "".join(chr(44032 + (ord(c) - 44032 + 28) % 11172) for c in word) if ord(word[0]) % 3 == 1 else None


@registered(f"""WITH {O.SONGS_SQL}, {O.LINES_SQL}, t AS (SELECT DISTINCT unnest(regexp_extract_all(line, '[가-힣]+')) AS token FROM lines),
said AS (SELECT token, CASE WHEN unicode(token) % 3 = 1 THEN array_to_string(list_transform(string_split(token, ''), lambda c: chr((44032 + (unicode(c) - 44032 + 28) % 11172)::INT)), '') ELSE token END AS spoken FROM t)
SELECT token, {O.fill(O.HANGUL, 'spoken')} AS codes FROM said""")
def spoken_codes(spark, sf_dir):
    """P10: Hangul words as a pronouncing function says them; as they are written where it fails or has nothing"""
    lines = songs.songs_lines(views.songs(spark, sf_dir))
    found = phonetics.resolve_words(lines.select(F.explode(text.tokens(F.col("line"))).alias("token")), g2p=phonetics.spoken(lambda: say, "say"))
    return found.where(phonetics.is_hangul(F.col("token")))


# Rhyme.


@registered(f"""WITH {O.SONGS_SQL}, {O.LINES_SQL}, {O.coded('lines', 'song_id, line_no')}, ends AS (SELECT tail[1] AS a, lead(tail[1]) OVER (PARTITION BY song_id ORDER BY line_no) AS b FROM tails)
SELECT a, b, count(*) AS n, ({O.syllable('a', 'b')})::INT AS score FROM ends WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b""")
def syllable_scores(spark, sf_dir):
    """R1, of the last syllables of neighbouring lines, each pair once"""
    lines = views.songs(spark, sf_dir).select(rhyme.tails(text.lines(F.col("lyrics"))).alias("tails"))
    ends = F.transform("tails", lambda t: F.get(t, 0))
    n = F.size(ends)
    both = F.when(n >= 2, F.arrays_zip(F.slice(ends, 1, n - 1).alias("a"), F.slice(ends, 2, n - 1).alias("b")))
    pairs = lines.select(F.explode(both).alias("pair")).select("pair.a", "pair.b").where("a IS NOT NULL AND b IS NOT NULL")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    return counts.select("a", "b", "n", rhyme.syllable_score(F.col("a"), F.col("b")).cast("int").alias("score"))


@registered(f"WITH {O.SCORED} SELECT song_id, (row_number() OVER (PARTITION BY song_id ORDER BY line_no) - 1)::INT AS line_no, score FROM pairs")
def line_scores(spark, sf_dir):
    """R2, R3"""
    return songs.pairs(views.songs(spark, sf_dir))


@registered(f"WITH {O.SCORED} SELECT song_id, density FROM scored")
def song_density(spark, sf_dir):
    """R4"""
    return songs.density(views.songs(spark, sf_dir)).select("song_id", "density")


@registered(f"""WITH {O.SPOKEN}, {O.SONGS_SQL}, {O.LINES_SQL}, {O.coded('lines', 'song_id, line_no', 'known')}, {O.pairs('song_id')},
sums AS (SELECT song_id, sum(score) AS s, count(*) AS m FROM pairs GROUP BY song_id) SELECT song_id, coalesce((2 * s + m) // (2 * m), 0)::BIGINT AS density FROM songs LEFT JOIN sums USING (song_id)""")
def song_density_lexicon(spark, sf_dir):
    """R4 with a lexicon, by join"""
    return songs.density_by_words(views.songs(spark, sf_dir), kept(views.dictionary(spark, sf_dir)))


# Reports on songs.


@registered(f"WITH {O.SCORED} SELECT song_id, density::DOUBLE / 10000::DOUBLE AS rhyme_density, old_score::DOUBLE / 10000::DOUBLE AS rhyme_density_old FROM scored")
def replaced_scores(spark, sf_dir):
    """A1"""
    old = views.songs(spark, sf_dir).withColumnRenamed("rhyme_density_old", "rhyme_density")
    return songs.replaced(old).select("song_id", "rhyme_density", "rhyme_density_old")


@registered(f"WITH {O.SCORED} SELECT song_id, artist, title, density, old_score::DOUBLE / 10000::DOUBLE AS rhyme_density_old FROM scored ORDER BY density DESC, song_id LIMIT 10")
def top_songs(spark, sf_dir):
    """A2"""
    return songs.top_songs(songs.density(views.songs(spark, sf_dir)))


@registered(f"WITH {O.SPREAD} SELECT {', '.join(f'round({c}_{x}, 9) AS {c}_{x}' if x != 'n' else f'{c}_{x}' for c in ('density', 'old', 'delta') for x in ('n', 'mean', 'std'))}, density_median, old_median FROM spread")
def score_spread(spark, sf_dir):
    """A3, A4, A5"""
    found = songs.spread(songs.density(views.songs(spark, sf_dir)))
    return found.select(*[F.round(c, 9).alias(c) if c.endswith(("_mean", "_std")) else F.col(c) for c in found.columns])


@registered(f"WITH {O.SCORED} SELECT count(*) AS shared FROM (SELECT song_id FROM scored ORDER BY density DESC, song_id LIMIT 50) JOIN (SELECT song_id FROM scored ORDER BY old_score DESC, song_id LIMIT 50) USING (song_id)")
def top_overlap(spark, sf_dir):
    """A6"""
    return songs.overlap(songs.density(views.songs(spark, sf_dir)))


@registered(f"WITH {O.SCORED} SELECT artist, count(*) AS songs, ((2 * sum(density) + count(*)) // (2 * count(*)))::BIGINT AS mean FROM scored WHERE artist IS NOT NULL GROUP BY artist ORDER BY mean DESC, artist LIMIT 10")
def top_artists(spark, sf_dir):
    """A7"""
    return songs.top_artists(songs.density(views.songs(spark, sf_dir)))


@registered(f"""WITH {O.SPREAD},
top AS (SELECT * FROM scored ORDER BY density DESC, song_id LIMIT 10),
artists AS (SELECT artist, ((2 * sum(density) + count(*)) // (2 * count(*)))::BIGINT AS mean FROM scored WHERE artist IS NOT NULL GROUP BY artist ORDER BY mean DESC, artist LIMIT 10),
shared AS (SELECT song_id FROM (SELECT song_id FROM scored ORDER BY density DESC, song_id LIMIT 50) JOIN (SELECT song_id FROM scored ORDER BY old_score DESC, song_id LIMIT 50) USING (song_id))
SELECT 'song' AS report, (row_number() OVER (ORDER BY density DESC, song_id))::INT AS place, title AS name, density::DOUBLE / 10000::DOUBLE AS value, old_score::DOUBLE / 10000::DOUBLE AS old FROM top
UNION ALL SELECT 'artist', (row_number() OVER (ORDER BY mean DESC, artist))::INT, artist, mean::DOUBLE / 10000::DOUBLE, NULL FROM artists
UNION ALL SELECT 'overlap', 1, 'shared', count(*)::DOUBLE, NULL FROM shared
UNION ALL SELECT 'spread', 1, 'n', density_n::DOUBLE, old_n::DOUBLE FROM spread UNION ALL SELECT 'spread', 2, 'mean', round(density_mean, 9), round(old_mean, 9) FROM spread
UNION ALL SELECT 'spread', 3, 'std', round(density_std, 9), round(old_std, 9) FROM spread UNION ALL SELECT 'spread', 4, 'median', density_median, old_median FROM spread
UNION ALL SELECT 'spread', 5, 'delta mean', round(delta_mean, 9), NULL FROM spread UNION ALL SELECT 'spread', 6, 'delta std', round(delta_std, 9), NULL FROM spread""")
def song_analysis(spark, sf_dir):
    """Scored songs are written once, all reports read them."""
    found = songs.reports(songs.analyzed(views.songs(spark, sf_dir).withColumnRenamed("rhyme_density_old", "rhyme_density"), new_folder(spark)))
    exact = F.col("name").contains("mean") | F.col("name").contains("std")
    return found.select("report", "place", "name", *[F.when(exact, F.round(c, 9)).otherwise(F.col(c)).alias(c) for c in ("value", "old")])


# Samples.


@registered(f"WITH {O.SONGS_SQL} SELECT song_id, {O.AUDIO} AS audio FROM songs")
def audio_headers(spark, sf_dir):
    """D1"""
    return views.songs(spark, sf_dir).select("song_id", formats.audio().alias("audio"))


@registered(f"WITH {O.SONGS_SQL} SELECT song_id, 'BPM: ' || printf('%.0f', bpm / 7) || ' | 에너지: ' || printf('%.2f', energy / 3) || ' | 댄서빌리티: ' || printf('%.2f', danceability / 3) || ' | 라우드니스: ' || printf('%.1f', loudness / 3) || 'dB | 밸런스: ' || printf('%.2f', valence / 8) AS audio FROM songs")
def exact_headers(spark, sf_dir):
    """D1 with numbers of many decimals, through Arrow"""
    rows = views.songs(spark, sf_dir).withColumns({"bpm": F.col("bpm") / 7, "energy": F.col("energy") / 3, "danceability": F.col("danceability") / 3, "loudness": F.col("loudness") / 3, "valence": F.col("valence") / 8})
    return rows.select("song_id", formats.audio(formats.exact_number).alias("audio"))


@registered(f"WITH {O.SAMPLES} SELECT song_id, pos, text FROM samples")
def training_samples(spark, sf_dir):
    """D2 to D5, T8"""
    return samples.samples(views.songs(spark, sf_dir))


@registered(f"WITH {O.SAMPLES} SELECT song_id, pos, ('0x' || substr(md5('42:' || song_id || ':' || pos), 1, 8))::BIGINT < {int(0.1 * 2**32)} AS is_eval, text || '<|endoftext|>' AS text FROM samples")
def split_samples(spark, sf_dir):
    """D6, D7"""
    return samples.marked(samples.split(samples.samples(views.songs(spark, sf_dir))), "<|endoftext|>")


@registered(f"""WITH {O.SAMPLES}, placed AS (SELECT *, ('0x' || substr(md5('42:' || song_id || ':' || pos), 1, 8))::BIGINT AS place FROM samples)
SELECT song_id, pos, row_number() OVER (ORDER BY place, song_id, pos) <= ceil(0.1::DOUBLE * count(*) OVER ()) AS is_eval FROM placed""")
def exact_split(spark, sf_dir):
    """D6, by count"""
    return samples.split_exactly(samples.samples(views.songs(spark, sf_dir))).select("song_id", "pos", "is_eval")


# Prompts and rewards.


@registered(f"WITH {O.PROMPTS} SELECT * FROM prompts")
def top_prompts(spark, sf_dir):
    """G1"""
    return prompts.prompts(songs.density(views.songs(spark, sf_dir)))


@registered(f"WITH {O.SONGS_SQL} SELECT song_id, (CASE WHEN song_id % 2 = 0 THEN 8 ELSE 16 END)::INT AS bars, '아티스트: ' || coalesce(artist, 'nan') || chr(10) || {O.AUDIO} || chr(10) || '[Verse ' || CASE WHEN song_id % 2 = 0 THEN 8 ELSE 16 END || '마디]' || chr(10) AS prompt FROM songs")
def requested_prompts(spark, sf_dir):
    """G2"""
    requests = views.songs(spark, sf_dir).withColumn("bars", F.when(F.col("song_id") % 2 == 0, 8).otherwise(16))
    return prompts.requested(requests).select("song_id", "bars", "prompt")


@registered(f"WITH {O.PROMPTS} SELECT * FROM prompts ORDER BY rank, n_bars LIMIT 20")
def check_prompts(spark, sf_dir):
    """G3"""
    return prompts.check_sample(prompts.prompts(songs.density(views.songs(spark, sf_dir))))


REWARD_COLUMNS = ("n_lines", "target", "rhyme", "format_ok", "length_score", "dup_ratio", "max_run", "run_penalty", "reward")
ROUNDED = ("rhyme", "length_score", "dup_ratio", "run_penalty", "reward")


@registered(f"WITH {O.REWARDS} SELECT conv_id, turn, " + ", ".join(f"round({c}, 9) AS {c}" if c in ROUNDED else c for c in REWARD_COLUMNS) + " FROM rewards")
def verse_rewards(spark, sf_dir):
    """G4 to G10, T6, T7"""
    found = rewards.rewards(views.completions(spark, sf_dir))
    return found.select("conv_id", "turn", *[F.round(c, 9).alias(c) if c in ROUNDED else F.col(c) for c in REWARD_COLUMNS])


@registered(ORACLES["verse_rewards"])
def verse_rewards_stream(spark, sf_dir):
    """G10 as files come in: some are scored by one run, the others by a second that takes up where it ended."""
    source, sink, progress = new_folder(spark), new_folder(spark), new_folder(spark)
    rows = views.completions(spark, sf_dir)
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    for part in (0, 1):
        rows.where(F.col("conv_id") % 2 == part).write.mode("append").json(source)
        stream.reward_files(spark, source, sink, progress, schema, files=4).awaitTermination()
    found = spark.read.parquet(sink)
    return found.select("conv_id", "turn", *[F.round(c, 9).alias(c) if c in ROUNDED else F.col(c) for c in REWARD_COLUMNS])


@registered(f"WITH {O.REWARDS} SELECT (conv_id % 4)::BIGINT AS run, count(*) AS n, round(avg(reward), 9) AS mean, round(stddev_samp(reward), 9) AS std, round(min(reward), 9) AS least, round(max(reward), 9) AS greatest, stddev_samp(reward) < 0.05::DOUBLE AS weak_signal, avg(reward) < 0 AS harsh FROM rewards GROUP BY conv_id % 4")
def reward_spread(spark, sf_dir):
    """G11, G12"""
    found = rewards.reward_stats(rewards.rewards(views.completions(spark, sf_dir)).withColumn("run", (F.col("conv_id") % 4).cast("long")), ("run",))
    return found.select("run", "n", *[F.round(c, 9).alias(c) for c in ("mean", "std", "least", "greatest")], "weak_signal", "harsh")


# Mining and metrics.


@registered(f"WITH {O.MINED} SELECT * FROM found")
def loanword_candidates(spark, sf_dir):
    """L1"""
    return mining.candidates(mining.word_counts(views.songs(spark, sf_dir)))


@registered(f"WITH {O.mined('[a-z]+', 'word')} SELECT * FROM found")
def plain_word_candidates(spark, sf_dir):
    """L1 with words of letters alone, where the last English word ends a line, whatever Hangul is behind it"""
    return mining.candidates(mining.word_counts(views.songs(spark, sf_dir), "[a-z]+", "word"))


@registered(f"WITH {O.MINED} SELECT * FROM counts WHERE NOT {O.GIVEN}")
def uncovered_words(spark, sf_dir):
    """L2, of all words"""
    return mining.uncovered(mining.word_counts(views.songs(spark, sf_dir)))


@registered(f"""WITH {O.MINED} SELECT count(*) AS words, count(*) FILTER ({O.GIVEN}) AS given_words, sum(line_end_count)::BIGINT AS line_ends, coalesce(sum(line_end_count) FILTER ({O.GIVEN}), 0)::BIGINT AS given_line_ends,
coalesce(sum(line_end_count) FILTER ({O.GIVEN}), 0)::DOUBLE / sum(line_end_count)::DOUBLE AS share FROM counts""")
def override_coverage(spark, sf_dir):
    """L3, of all words"""
    return mining.coverage(mining.word_counts(views.songs(spark, sf_dir)))


@registered("""WITH p AS (SELECT event_type AS stage, ts, event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS step, value::DOUBLE AS loss FROM events)
SELECT stage, step, max_by(loss, (ts, event_id)) AS loss FROM p WHERE step IS NOT NULL AND loss IS NOT NULL GROUP BY stage, step""")
def loss_curves(spark, sf_dir):
    """M1"""
    return metrics.loss_curve(views.loss_points(spark, sf_dir))


@registered("""WITH p AS (SELECT event_type AS stage, event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS step, value::DOUBLE AS loss FROM events
  WHERE event_id % 7 NOT IN (1, 2) AND event_id % 11 NOT IN (1, 2, 3, 4))
SELECT stage, step, max_by(loss, event_id) AS loss FROM p WHERE step IS NOT NULL AND loss IS NOT NULL GROUP BY stage, step""")
def trainer_states_json(spark, sf_dir):
    """State files written, read again and made a curve of the entries with a whole step and a numeric loss"""
    path = new_folder(spark)
    io.write_trainer_states(views.trainer_states(spark, sf_dir), path)
    return metrics.loss_curve(metrics.loss_points(io.read_trainer_states(spark, f"{path}/*/*/*.json")))


@registered("""WITH n AS (SELECT doc_id, text AS name FROM documents), k AS (SELECT doc_id, name, regexp_replace(regexp_replace(trim(name), '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g') AS key FROM n)
SELECT doc_id, CASE WHEN coalesce(key, '') = '' THEN 'experiment' ELSE key END AS key FROM k""")
def experiment_keys(spark, sf_dir):
    """M2, of whole texts"""
    return views.table(spark, sf_dir, "documents").select("doc_id", formats.experiment_key(F.col("text")).alias("key"))
