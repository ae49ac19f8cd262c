"""Goldens of the phonetic model, rhyme scores, windows and rewards."""

import bisect
import math
import os
import random
import re
import statistics
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from versejobs.functions import formats, phonetics, rhyme, tables, text
from versejobs.operators import metrics, mining, prompts, rewards, samples, songs


def syllables(spark, words):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, line string")
    got = rows.select("i", phonetics.spelled(phonetics.line_codes(F.col("line"))).alias("s")).orderBy("i").collect()
    return [[(x.v, x.c) for x in r.s] for r in got]


def test_tables():
    assert len(tables.OVERRIDES) == 105 and len(tables.STOPWORDS) == 34
    assert (len(tables.ONSETS), len(tables.VOWELS), len(tables.CODAS)) == (19, 21, 28)


def test_syllables(spark):
    got = syllables(spark, ["강", "바다", "한국어", "apple", "orange", "flow", "yeah", "hello 강", "", "12345", "!@#$%", "blarg", "zumo", "brrr", "TV"])
    assert got[0] == [("ㅏ", "ㅇ")]
    assert got[1] == [("ㅏ", None), ("ㅏ", None)]
    assert len(got[2]) == 3
    assert got[3][-1] == ("ㅡ", "ㄹ")
    assert [v for v, _ in got[4]] == ["ㅗ", "ㅔ", "ㅣ"]
    assert [v for v, _ in got[5]] == ["ㅡ", "ㅗ", "ㅜ"]
    assert got[6] == [] and len(got[7]) >= 2
    assert got[8] == got[9] == got[10] == got[13] == []
    assert got[11] == [("ㅏ", "ㄹ")]
    assert got[12] == [("ㅜ", None), ("ㅗ", None)]
    assert got[14] == [("ㅣ", None), ("ㅣ", None)]


def test_loanwords(spark):
    rows = [("hands", "HH AE1 N D Z"), ("church", "CH ER1 CH"), ("table", "T EY1 B AH0 L"), ("street", "S T R IY1 T"), ("extra", "EH1 K S T R AH0"), ("idea", "AY0 D IY1 AH0"), ("hmm", "HH M"), ("none", "")]
    got = phonetics.with_syllables(spark.createDataFrame(rows, "word string, phones string"))
    words = {r.word: r for r in got.collect()}
    assert {w: words[w].loanword for w, _ in rows} == {"hands": "핸드즈", "church": "첯", "table": "테블", "street": "싣", "extra": "엑러", "idea": "아디어", "hmm": None, "none": None}
    assert words["hmm"].simple_codes == []
    assert words["table"].codes == [tables.code("ㅔ", None), tables.code("ㅡ", "ㄹ")]


def scores(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return [r.s / 10000 for r in rows.select("i", rhyme.tail_score(phonetics.last_codes(F.col("a")), phonetics.last_codes(F.col("b"))).alias("s")).orderBy("i").collect()]


def test_line_scores(spark):
    got = scores(spark, [("강", "강"), ("강", "방"), ("강", "산"), ("강", "가"), ("강", "봄"), ("강물", "방물"), ("바다", "마차"), ("", "강"), ("강", ""), ("강물", "산물"), ("계", "게"), ("게", "계")])
    assert got == [1.0, 1.0, 0.94, 0.80, 0.14, 1.0, 1.0, 0.0, 0.0, 0.98, 0.84, 0.20]


def test_unmapped_codas(spark):
    pairs = [("ㅏ", "ㅆ", "ㅎ", 94), ("ㅏ", "ㄱ", "ㅆ", 80), ("ㅏ", "ㄹ", "ㄴ", 80)]
    rows = spark.createDataFrame([(tables.code(v, a), tables.code(v, b), s) for v, a, b, s in pairs], "a int, b int, s int")
    assert all(r.got == r.s for r in rows.select("s", rhyme.syllable_score(F.col("a"), F.col("b")).alias("got")).collect())


def test_strip_and_tags(spark):
    row = spark.createDataFrame([("　 a\t\n[Hook]\n\n b \r\n[x\n[]",)], "t string").select(text.lines(F.col("t")).alias("l"), text.clean_lines(F.col("t")).alias("c")).first()
    assert row.l == ["a", "[Hook]", "b", "[x", "[]"] and row.c == ["a", "b", "[x"]


@pytest.mark.parametrize("lines, expected", [(7, 0), (8, 1), (11, 1), (12, 2), (15, 2), (16, 3), (19, 3), (20, 4), (24, 5), (31, 6), (32, 6), (40, 8)])
def test_sample_counts(spark, lines, expected):
    song = spark.createDataFrame([(1, None, "\n".join(f"line {i}" for i in range(lines)), 90.5, 0.1, 0.2, None, 0.4)], "song_id long, artist string, lyrics string, bpm double, energy double, danceability double, loudness double, valence double")
    got = samples.samples(song).collect()
    assert len(got) == expected
    if got:
        assert got[0].text.startswith("아티스트: nan\n") and "라우드니스: nandB" in got[0].text and got[0].text.endswith("\n[End]")


def test_exact_numbers(spark):
    row = spark.createDataFrame([(90.5, 0.125, None)], "a double, b double, c double")
    got = row.select(formats.exact_number(F.col("a"), 0), formats.exact_number(F.col("b"), 2), formats.exact_number(F.col("c"), 1)).first()
    assert tuple(got) == ("90", "0.12", "nan")


def test_rewards(spark):
    eight = "\n".join(["강", "방", "상", "장", "당", "창", "항", "망"]) + "\n[End]"
    cases = [("", -0.8), ("[End]", -0.6), ("강\n[End]", 0.225), ("강\n방\n[End]", 0.75), ("강\n강\n[End]", -0.1), ("강\n강\n강", -0.425), ("강\n강\n방\n방\n강\n[End]", 0.0), (eight, 0.9), (None, -0.8)]
    rows = spark.createDataFrame([(i, None, c) for i, (c, _) in enumerate(cases)], "i int, prompt string, completion string")
    got = [r.reward for r in rewards.rewards(rows).orderBy("i").collect()]
    assert got == pytest.approx([x for _, x in cases], abs=1e-9)
    bars = spark.createDataFrame([("[Verse  16 마디]",), ("x",), (None,)], "p string").select(rewards.target_bars(F.col("p")).alias("b")).collect()
    assert [r.b for r in bars] == [16, 8, 8]
    runs = spark.createDataFrame([(list("aabbba"),), ([],)], "l array<string>").select(text.longest_run(F.col("l")).alias("n")).collect()
    assert [r.n for r in runs] == [3, 0]


def test_experiment_keys_are_worked_out_once(spark):
    """One search for a text's characters, and nothing but the ends is looked at again."""
    names = [" a b ", "..-", None, "", "-x.", ".a--b.-", "한글", "a\n", "\n.a.\n"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select(formats.experiment_key(F.col("name")).alias("key"))
    assert [r.key for r in rows.collect()] == ["a-b", "experiment", "experiment", "experiment", "x", "a--b", "experiment", "a", "a"]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_names_and_loss(spark):
    got = spark.createDataFrame([(" my exp/1 ",), ("...",), (None,)], "n string").select(formats.experiment_key(F.col("n")).alias("k")).collect()
    assert [r.k for r in got] == ["my-exp-1", "experiment", "experiment"]
    logs = [("s", "checkpoint-1000/x", ['{"step": 10, "loss": 1.0}']), ("s", "checkpoint-50/x", ['{"step": 10, "loss": 2.0}', '{"step": "a", "loss": 3}', '{"step": 11, "loss": null}'])]
    states = spark.createDataFrame(logs, "stage string, file string, logs array<string>").withColumn("log_history", F.transform("logs", F.parse_json))
    assert [tuple(r) for r in metrics.loss_curve(metrics.loss_points(states)).collect()] == [("s", 10, 2.0)]


@pytest.mark.parametrize("name", sorted(tables.PHONE_ONSET))
def test_many_phones_behind_the_last_vowel(spark, name):
    """None is left out, however many there are."""
    lexicon = spark.createDataFrame([("w", " ".join(["AA1", *[name] * 150]))], "word string, phones string")
    row = phonetics.with_syllables(lexicon).first()
    assert len(row.codes) == 1 + 149 == len(row.loanword)


def songs_of(spark):
    rows = [(1, "a", "강\n방 love\n산 time\n\nyeah table"), (2, "a", None), (3, None, "one line"), (4, "b", "hello world\n강 hands\nhands 방")]
    return spark.createDataFrame(rows, "song_id long, artist string, lyrics string")


def test_both_forms_agree(spark):
    by_row = {r.song_id: r.density for r in songs.density(songs_of(spark)).collect()}
    by_join = {r.song_id: r.density for r in songs.density_by_words(songs_of(spark).repartition(3)).collect()}
    assert by_row == by_join and by_row[2] == by_row[3] == 0
    lexicon = spark.createDataFrame([("hands", "HH AE1 N D Z")], "word string, phones string")
    assert {r.song_id: r.density for r in songs.density_by_words(songs_of(spark), lexicon).collect()}[4] != by_row[4]


def words_of(spark):
    """Lines whose sounding words stand far before their ends, in a lexicon where some words with vowels have no syllable."""
    words = ["hmm", "shh", "table", "the", "강", "yeah", "brrr", "Hands", "why", "love", "밥물"]
    rng = random.Random(5)
    rows = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100, "강 table " + "hmm " * 40 + "\nhands " + "the shh " * 30), (101, None), (102, "love"), (None, "a\nb")]
    lexicon = [("hmm", "HH M"), ("shh", "SH"), ("table", "T EY1 B AH0 L"), ("hands", "HH AE1 N D Z"), ("why", "W AY1"), ("love", "L V"), ("brrr", "B ER1"), ("the", "DH AH0"), ("unused", "AH1")]
    # A table whose size is known to the planner.
    listed = ", ".join(f"('{w}', '{p}')" for w, p in lexicon)
    return spark.createDataFrame(rows, "song_id long, lyrics string"), spark.sql(f"SELECT * FROM VALUES {listed} AS t(word, phones)")


def test_lexicon_by_rows_and_by_join(spark):
    """A lexicon inside rows, and joined in rounds with few words or many at a time, against the codes of whole lines."""
    song, lexicon = words_of(spark)
    known = phonetics.in_rows(lexicon)
    assert known is not None and phonetics.in_rows(spark.createDataFrame([("w", "AA1")], "word string, phones string")) is None  # of unknown size
    by_row = {r.song_id: r.density for r in songs.density(song, known).collect()}
    lines = songs.songs_lines(song)
    words = phonetics.resolve_words(lines.select(F.explode(text.tokens(F.col("line"))).alias("token")), lexicon)
    whole = {(r.song_id, r.line_no): r.codes[::-1][:3] for r in phonetics.line_codes_by_words(lines.where("song_id IS NOT NULL"), words, ["song_id", "line_no"]).collect()}
    for near in (2, 50):
        tails = phonetics.line_tails_by_words(lines.where("song_id IS NOT NULL"), ["song_id", "line_no"], lexicon, near=near)
        found = {(r.song_id, r.line_no): r.tail for r in tails.collect()}
        assert found == {k: v for k, v in whole.items() if k in found} and not any(v for k, v in whole.items() if k not in found)
    in_rows = {(r.song_id, r.line_no): r.tail for r in lines.select("song_id", "line_no", phonetics.last_codes(F.col("line"), known).alias("tail")).collect()}
    assert {k: v for k, v in in_rows.items() if k[0] is not None} == whole
    assert {r.song_id: r.density for r in songs.density_by_words(song, lexicon).collect()} == by_row


@pytest.mark.parametrize("most", [0, 3, 20_000])
def test_line_codes_with_frequent_words_in_rows(spark, monkeypatch, most):
    """Codes of whole lines, whatever part of the tokens is joined; lines alike in their keys alone stay apart, null keys and lines stay."""
    monkeypatch.setattr(phonetics, "SMALL_WORDS", most)
    given = ["table love the love table", "", None, "가나 hands 다 unknown", "the the", "love", "bread love " * 60, "table love the love table"]
    lines = spark.createDataFrame([(k if k != 4 else None, 0, x) for k, x in enumerate(given)] + [(0, 0, "hands why"), (3, 1, "why 나 why")], "song_id long, line_no int, line string")
    lexicon = spark.createDataFrame([("table", "T EY1 B AH0 L"), ("hands", "HH AE1 N D Z"), ("love", "L V"), ("Why", "W AY1")], "word string, phones string")
    words = phonetics.resolve_words(lines.select(F.explode(text.tokens(F.col("line"))).alias("token")), lexicon)
    codes = {r.token: list(r.codes) for r in words.collect()}
    want = [(r.song_id, r.line_no, [c for t in re.findall(text.TOKEN, r.line or "") for c in codes[t]]) for r in lines.collect()]
    counts = lines.select(F.explode(text.tokens(F.col("line"))).alias("token")).groupBy("token").count()
    for given_counts in (None, counts):
        got = phonetics.line_codes_by_words(lines, words, ["song_id", "line_no"], counts=given_counts)
        assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(want, key=str)
    assert dict(got.dtypes)["codes"] == "array<int>"


def test_lexicon_size_decides(spark, monkeypatch):
    song, lexicon = words_of(spark)
    small = songs.density_by_words(song, lexicon)
    assert "Exchange" not in plan(small)
    want = {r.song_id: r.density for r in small.collect()}
    for name in ("SMALL_BYTES", "SMALL_WORDS"):
        monkeypatch.setattr(phonetics.in_rows, "__defaults__", (0, 20_000) if name == "SMALL_BYTES" else (4 << 20, 3))
        assert phonetics.in_rows(lexicon) is None
        joined = songs.density_by_words(song, lexicon)
        assert "Exchange" in plan(joined) and {r.song_id: r.density for r in joined.collect()} == want


def test_no_lines_in_exchanges(spark):
    """What the join form exchanges are tokens and codes; neither lyrics nor lines."""
    song, lexicon = words_of(spark)
    rows = phonetics.line_tails_by_words(songs.songs_lines(song), ["song_id", "line_no"], lexicon, near=50)
    assert "line#" not in plan(rows) and "lyrics#" not in plan(rows)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange(spark):
    song = spark.createDataFrame([(1, "a", "x", 1.0, 0.1, 0.1, 0.1, 0.1)], "song_id long, artist string, lyrics string, bpm double, energy double, danceability double, loudness double, valence double")
    for df in (samples.split(samples.samples(song)), songs.density(song), rewards.rewards(spark.createDataFrame([("p", "c")], "prompt string, completion string"))):
        assert "Exchange" not in plan(df)


def test_stream(spark, tmp_path):
    from versejobs.streaming.rewards import reward_stream

    spark.createDataFrame([("", "강\n방\n[End]")], "prompt string, completion string").write.json(str(tmp_path / "in"))
    query = reward_stream(spark, str(tmp_path / "in"), files=1).writeStream.format("memory").queryName("rewarded").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("rewarded").first().reward == pytest.approx(0.75)


def test_stream_is_taken_up(spark, tmp_path):
    """A run that is stopped between files, and those after it, score each file once."""
    from versejobs.streaming.rewards import reward_files

    folder, sink, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    rows = [("[Verse 8마디]", f"강 {i}\n방 {i}\n[End]") for i in range(30)]
    for part in range(3):
        spark.createDataFrame(rows[10 * part : 10 * part + 10], "prompt string, completion string").repartition(5).write.mode("append").json(folder)
        query = reward_files(spark, folder, sink, progress, files=1)
        if part < 2:
            while not query.lastProgress and query.isActive:
                time.sleep(0.05)
            query.stop()
    query.awaitTermination()
    assert sorted(r.completion for r in spark.read.parquet(sink).collect()) == sorted(c for _, c in rows)
    reward_files(spark, folder, sink, progress).awaitTermination()
    assert spark.read.parquet(sink).count() == 30


def counted(folder):
    """Makes what makes a pronouncing function; that leaves a file for each time it does."""

    def start():
        (folder / f"{os.getpid()}-{time.monotonic_ns()}").touch()
        return lambda word: {"밥물": "밤물", "국물": None}[word]

    return start


def test_pronouncing_function(spark, tmp_path):
    """Null, failing and unknown words keep their spelling; each word is asked once; English words aren't asked; a worker starts once."""
    words = spark.createDataFrame([("밥물",), ("밥물",), ("국물",), ("없다",), ("hello",), (None,)], "token string")
    say, asked = phonetics.spoken(counted(tmp_path), "counted"), Observation()
    got = {r.token: list(r.codes) for r in phonetics.resolve_words(words, g2p=say, asked=asked).collect()}
    plain = {r.token: list(r.codes) for r in phonetics.resolve_words(words).collect()}
    assert got["밥물"] == tables.hangul_codes("밤물") != plain["밥물"]
    assert {k: v for k, v in got.items() if k != "밥물"} == {k: v for k, v in plain.items() if k != "밥물"} and len(got) == 4
    assert asked.get == {"words": 3, "failed": 1}
    many = spark.range(4000).repartition(40).select(F.concat(F.lit("밥"), F.decode(F.unhex(F.hex(F.col("id") + 0xAC00)), "UTF-16BE")).alias("token"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        assert phonetics.resolve_words(many, g2p=say).count() == 4000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    starts = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert starts and len(starts) == len(set(starts))  # each worker's process stands once
    song = spark.createDataFrame([(1, "a", "밥물\n밤물")], "song_id long, artist string, lyrics string")
    assert songs.density_by_words(song, g2p=say).first().density == 10000


def test_rewards_in_any_order(spark):
    """The same bits over 1, 2 and 7 partitions, near what Python's statistics give, with nothing left of equal values."""
    rng = random.Random(4)
    rows = [(k, rng.uniform(-0.8, 0.9)) for k in (1, 2) for _ in range(5000)] + [(3, 0.1)] * 999 + [(4, -0.3)] + [(5, None), (5, float("nan"))] + [(6, 0.7 + x * 2**-40) for x in range(5)]
    table = spark.createDataFrame(rows, "run int, reward double")
    got = [sorted(tuple(map(repr, r)) for r in rewards.reward_stats(t, ("run",)).select("run", "mean", "std", "weak_signal", "harsh").collect()) for t in (table.coalesce(1), table.repartition(2), table.repartition(7).orderBy("reward"))]
    assert got[0] == got[1] == got[2]
    stats = {r.run: r for r in rewards.reward_stats(table, ("run",)).collect()}
    for run in (1, 2, 6):
        own = [x for k, x in rows if k == run]
        assert stats[run].mean == pytest.approx(statistics.mean(own), abs=1e-13) and stats[run].std == pytest.approx(statistics.stdev(own), abs=1e-13)
    assert stats[3].std == 0.0 and stats[3].weak_signal and stats[4].std is None and stats[4].harsh and stats[5].mean is None
    whole = rewards.reward_stats(table.where("run < 3")).first()
    assert whole.mean == pytest.approx(statistics.mean(x for k, x in rows if k < 3), abs=1e-13)


def test_scores_of_any_precision(spark):
    """Old scores with ten decimals: mean and deviation as Python's, the exact median, and the sketch's within its error."""
    rng = random.Random(8)
    old = [round(rng.random() ** 2, 10) for _ in range(20_001)]
    rows = [(i, rng.randint(0, 10_000), x) for i, x in enumerate(old)] + [(-1, 5, None), (-2, 7, float("nan"))]
    table = spark.createDataFrame(rows, "song_id long, density long, rhyme_density_old double")
    exact, near = songs.spread(table).first(), songs.spread(table, exact=False).first()
    assert exact.old_mean == pytest.approx(statistics.fmean(old), abs=1e-15) and exact.old_std == pytest.approx(statistics.stdev(old), abs=1e-12) and exact.old_median == statistics.median(old)
    assert exact.delta_mean == pytest.approx(statistics.fmean(d / 10000 - x for _, d, x in rows[:-2]), abs=1e-12) and (exact.old_n, exact.density_n) == (20_001, 20_003)
    ranks = sorted(old)
    assert abs(bisect.bisect(ranks, near.old_median) / len(old) - 0.5) < 0.01
    parts = table.groupBy(F.col("song_id") % 5).agg(songs.sketch("rhyme_density_old").alias("s"))
    merged = parts.agg(songs.sketched(F.kll_merge_agg_double("s"), 0.9).alias("x")).first().x
    assert abs(bisect.bisect(ranks, merged) / len(old) - 0.9) < 0.01


def test_analysis_is_one_pass(spark, tmp_path):
    """Scored songs are written once with all their columns; the reports read them without lyrics."""
    song = songs_of(spark).withColumn("title", F.concat(F.lit("t"), "song_id")).withColumn("rhyme_density", F.lit(0.25))
    stored = songs.analyzed(song, str(tmp_path / "scored"))
    assert {*stored.columns} == {*song.columns, "rhyme_density_old"} and stored.count() == 4
    found = songs.reports(stored)
    text_of = plan(found)
    assert "lyrics" not in text_of and "regexp_extract_all" not in text_of
    rows = {(r.report, r.place): r for r in found.collect()}
    best = max(songs.density(song).collect(), key=lambda r: (r.density, -r.song_id))
    assert rows["song", 1].name == best.title and rows["song", 1].value == best.density / 10000 and rows["song", 1].old == 0.25
    assert rows["spread", 1].value == 4 and rows["spread", 2].old == 0.25 and rows["overlap", 1].value == 4
    none = songs.reports(songs.analyzed(song.drop("rhyme_density"), str(tmp_path / "new"))).where("report = 'spread' AND name = 'n'").first()
    assert (none.value, none.old) == (4, 0)


LYRICS = "Don't stop, rock'n'roll!\nlove 강\n강 love...\nthe end  \n12 go 34\n\nAI ok\r\n"


def test_mining_parameters(spark):
    """Word patterns and rules for line ends, against Python line by line."""
    song = spark.createDataFrame([(1, LYRICS), (2, None), (3, "")], "song_id long, lyrics string")
    for word in (mining.WORD, "[a-z]+", "[a-z]{3,}"):
        for ends in mining.ENDS:
            want = {}
            for line in LYRICS.lower().split("\n"):
                found = [(m.group(), m.end()) for m in re.finditer(f"[가-힣]+|{word}", line)]
                english = [k for k, (w, _) in enumerate(found) if w < "가"]
                for k, (w, end) in enumerate(found):
                    if w < "가":
                        last = {"token": k == len(found) - 1, "word": k == english[-1], "bare": not line[end:].strip()}[ends]
                        total, at_end = want.get(w, (0, 0))
                        want[w] = (total + 1, at_end + last)
            want = {w: n for w, n in want.items() if w not in tables.STOPWORDS}
            assert {r.word: (r.total_count, r.line_end_count) for r in mining.word_counts(song, word, ends).collect()} == want, (word, ends)
    with pytest.raises(ValueError, match="ends must be"):
        mining.word_counts(song, ends="x")


@pytest.mark.parametrize("n, share", [(0, 0.1), (1, 0.1), (10, 0.1), (11, 0.1), (995, 0.1), (995, 0.5), (995, 1.0), (995, 0.0)])
def test_exact_split(spark, n, share):
    rows = spark.range(n).select(F.col("id").alias("song_id"), F.lit(0).alias("pos"))
    got = samples.split_exactly(rows, share).collect()
    assert len(got) == n and sum(r.is_eval for r in got) == math.ceil(n * share)
    again = samples.split_exactly(rows.repartition(3), share).where("is_eval").collect()
    assert {r.song_id for r in again} == {r.song_id for r in got if r.is_eval}


def test_bars_of_requests(spark):
    request = spark.createDataFrame([("a", 8), ("b", 16), (None, None)], "artist string, bars int").withColumns({c: F.lit(0.5) for c in ("bpm", "energy", "danceability", "loudness", "valence")})
    got = [r.prompt.split("\n")[2] for r in prompts.requested(request).collect()]
    assert got == ["[Verse 8마디]", "[Verse 16마디]", "[Verse 8마디]"]
    with pytest.raises(Exception, match="bars must be one of"):
        prompts.requested(request.withColumn("bars", F.lit(12))).collect()


def test_line_ends_far_back(spark):
    """Tokens that bear no sound may stand at the end in any number; few codes send the search to the whole line."""
    lines = ["love time 강 " + "the " * 12, "강 - - - - - - - -", "x " * 9 + "love", "", "the", "hello-world,강강강강 the"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in rows.select("line", phonetics.last_codes(F.col("line")).alias("tail"), phonetics.line_codes(F.col("line")).alias("codes")).collect():
        assert r.tail == r.codes[::-1][:3]
