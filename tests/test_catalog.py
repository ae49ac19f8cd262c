"""Registered queries against their SQL at the smallest scale, and the readers."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from versejobs.operators import metrics
from versejobs.plans import catalog
from versejobs.sources import io

DATA = "/root/testdata/sf0.001"


def rows_of(found):
    return sorted(repr([list(v) if hasattr(v, "__iter__") and not isinstance(v, str) else v for v in r]) for r in found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["songs_csv", "songs_csv_split", "malformed_samples", "song_analysis", "score_spread", "reward_spread", "verse_rewards_stream", "plain_word_candidates", "stored_sample_count", "first_pronunciations", "syllable_scores", "spoken_codes", "exact_split", "trainer_states_json", "word_codes", "line_codes_lexicon", "song_density_lexicon", "clean_lines", "line_chunks", "hangul_codes", "letter_codes", "loanwords", "line_ends", "song_density", "top_artists", "split_samples", "top_prompts", "verse_rewards", "loanword_candidates", "override_coverage", "loss_curves", "experiment_keys"])
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, DATA)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    expected = con.sql(f"SELECT {', '.join(order)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert rows_of(tuple(r) for r in got.select(*order).collect()) == rows_of(expected)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


HEADER = "artist,title,lyrics,bpm,energy,danceability,loudness,valence"


def test_song_csv(spark, tmp_path):
    """Columns by name: without song_id, in any order, with further ones, after a byte order mark."""
    (tmp_path / "a.csv").write_text(f'{HEADER}\nA,"T ""x""","x\ny",90.5,0.1,0.2,-3.5,0.4\nNA,U,,,,,,\n', encoding="utf-8")
    one, two = io.read_songs(spark, str(tmp_path / "a.csv")).orderBy("title").collect()
    assert (one.artist, one.title, one.lyrics, one.bpm, one.energy, one.danceability, one.loudness, one.valence) == ("A", 'T "x"', "x\ny", 90.5, 0.1, 0.2, -3.5, 0.4)
    assert (two.artist, two.title, two.lyrics, two.bpm) == (None, "U", None, None) and one.song_id != two.song_id
    (tmp_path / "b.csv").write_text("\ufeffvalence,lyrics,mood.of,song_id,bpm,title,artist,energy,loudness,danceability,rhyme_density\n0.4,x,m,7,90,T,A,0.1,-3,0.2,0.5\n", encoding="utf-8")
    row = io.read_songs(spark, str(tmp_path / "b.csv")).first()
    assert (row.song_id, row.artist, row.lyrics, row.bpm, row.valence, row.rhyme_density, row["mood.of"]) == (7, "A", "x", 90.0, 0.4, 0.5, "m")
    again = io.read_songs(spark, str(tmp_path / "a.csv")).orderBy("title").first()
    assert again.song_id == one.song_id
    (tmp_path / "c.csv").write_text("artist,title,bpm\nA,T,1\n")
    with pytest.raises(ValueError, match="lyrics, energy"):
        io.read_songs(spark, str(tmp_path / "c.csv"))
    assert io.read_songs(spark, str(tmp_path / "c.csv"), needed=("artist",)).columns == ["song_id", "artist", "title", "bpm"]


def test_song_csv_as_written(spark, tmp_path):
    """A byte order mark before the header, nothing for missing values, and the same rows when read again."""
    rows = [(1, "a", " t ", "x\n\"y\", z", 90.5, None), (2, None, "nan so", None, None, 0.25)]
    songs = spark.createDataFrame(rows, "song_id long, artist string, title string, lyrics string, bpm double, rhyme_density double")
    io.write_songs(songs.coalesce(1), str(tmp_path / "out"))
    raw = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert raw.startswith("\ufeffsong_id,artist".encode()) and b"nan," not in raw and b"2,,nan so,,," in raw
    back = io.read_songs(spark, str(tmp_path / "out"), needed=("lyrics",)).orderBy("song_id").collect()
    assert [tuple(r) for r in back] == rows


def test_candidates_in_any_order(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("line_end_count\tword\ttotal_count\n2\tnan\t5\n")
    assert [tuple(r) for r in io.read_candidates(spark, str(tmp_path / "c.tsv")).collect()] == [("nan", 5, 2)]


def test_shared_folder_on_a_cluster(spark):
    """Without a folder that the cluster shares there is an error, and no local one."""
    from types import SimpleNamespace

    from versejobs.sources.shared import shared_folder

    here = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=here, conf=SimpleNamespace(get=lambda k, d: d)))


def test_lexicon(spark, tmp_path):
    (tmp_path / "d").write_text(";;; comment\nREAD  R EH1 D\nREAD(1)  R IY1 D\n")
    assert [tuple(r) for r in io.read_lexicon(spark, str(tmp_path / "d")).collect()] == [("read", "R EH1 D")]


def test_lines_of_a_lexicon_are_worked_out_once(spark, tmp_path):
    """A costly expression that makes the lines is evaluated once a row, whatever is taken from it."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def line(word):
        made.add(1)
        return f"{word}(1)  K AE1 T" if word != "NONE" else ";;; no word"

    rows = spark.createDataFrame([("CAT",), ("DOG",), ("NONE",)], "word string")
    got = io.first_pronunciations(rows.select(line("word").alias("value"))).collect()
    assert sorted(map(tuple, got)) == [("cat", "K AE1 T"), ("dog", "K AE1 T")] and made.value == 3


def test_trainer_states(spark, tmp_path):
    """Entries as they are typed: texts, truth values, numbers with a point, nulls, nested and other values are no points."""
    folder = tmp_path / "grpo" / "checkpoint-50"
    folder.mkdir(parents=True)
    entries = '{"step": 1, "loss": 0.5}, {"step": 2}, {"step": 3.0, "loss": 1}, {"step": 4, "loss": 1e-7}, {"step": 1e3, "loss": 2}, {"step": "6", "loss": 3}, {"step": 7, "loss": "2.5"}'
    entries += ', {"step": true, "loss": 2}, {"step": 8, "loss": true}, 5, null, [1], {"step": 9, "loss": 7, "more": {"step": 1}}, {"step": 10, "loss": [1]}, {"step": null, "loss": 1}, {"step": {"a": 1}, "loss": 1}, {"step": 5, "loss": NaN}'
    (folder / "trainer_state.json").write_text('{"best": null, "log_history": [\n' + entries + "]}")
    states = io.read_trainer_states(spark, str(tmp_path / "*" / "checkpoint-*" / "trainer_state.json"))
    found = {r.step: r.loss for r in metrics.loss_points(states).where("stage = 'grpo'").collect()}
    assert {k: v for k, v in found.items() if k != 5} == {1: 0.5, 4: 1e-7, 9: 7.0} and math.isnan(found[5])
    other = tmp_path / "sft" / "checkpoint-1"
    other.mkdir(parents=True)
    (other / "trainer_state.json").write_text('{"best": 1}')
    assert metrics.loss_points(io.read_trainer_states(spark, str(other / "*.json"))).count() == 0
    (other / "trainer_state.json").write_text('{"log_history": [{"step"')
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        metrics.loss_points(io.read_trainer_states(spark, str(other / "*.json"))).collect()


def test_samples_that_are_malformed(spark, tmp_path):
    lines = ['{"text": "a\\n강"}', "", '{"text": "b"', '{"text": 5}', "[1]", '{"other": 1}', '{"text": null, "x": 1}', "plain"]
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    with pytest.raises(Exception, match="not a sample"):
        io.read_samples(spark, str(tmp_path / "s.jsonl")).collect()
    good, bad = io.read_samples_apart(spark, str(tmp_path / "s.jsonl"))
    assert [r.text for r in good.collect()] == ["a\n강", None, None] and [r.value for r in bad.collect()] == [lines[2], lines[3], lines[4], lines[7]]
    assert bad.first().file.endswith("s.jsonl") and io.count_samples(spark, str(tmp_path / "s.jsonl")).first().samples == 8
    (tmp_path / "s.jsonl").write_text('{"text": "a"}\n\n{"text": "b"}\n{"text": "c"}')
    assert io.count_samples(spark, str(tmp_path / "s.jsonl")).first().samples == 4


def test_songs_without_numbers(spark, tmp_path):
    songs = spark.createDataFrame([(1, "a", float("nan"), None), (2, "NaN so", 0.5, float("nan"))], "song_id long, title string, bpm double, energy float")
    io.write_songs(songs.coalesce(1), str(tmp_path / "out"))
    raw = next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8-sig").splitlines()
    assert raw == ["song_id,title,bpm,energy", "1,a,,", "2,NaN so,0.5,"]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_song_csv(spark, tmp_path, small_blocks, end):
    """Files with a byte order mark, quoted breaks and doubled quotes, read by blocks of 300 bytes, against Spark's reader."""
    rng = random.Random(3)
    texts = ["", "plain", " padded ", "a,b", "line" + end + "break", 'say ""hi""', "\n\n", '""', "x" * 700 + "\n" * 5 + "y" * 700, "é강", "tail\n", "NA", '""\n""']
    for k in range(2):
        rows = [[rng.choice(texts) for _ in range(3)] + [str(rng.random())] * 5 for _ in range(60)]
        body = end.join(",".join(f'"{x}"' if any(c in x for c in ',\n\r"') else x for x in r) for r in rows)
        (tmp_path / f"{k}.csv").write_text("\ufeff" + HEADER + end + body + (end if k else ""), encoding="utf-8", newline="")
    lines = io.read_songs(spark, str(tmp_path), split=True)
    assert lines.rdd.getNumPartitions() > 20
    got, want = (sorted(map(repr, map(tuple, x.collect()))) for x in (lines, io.read_songs(spark, str(tmp_path))))
    assert got == want and len(got) == 120


def test_split_csv_of_one_column_and_odd_files(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('lyrics\n"one\n' + "more\n" * 300 + '"\ntwo\n\nthree')
    got = sorted(r.lyrics for r in io.read_songs(spark, str(tmp_path / "a.csv"), needed=("lyrics",), split=True).collect())
    assert got == sorted(["one\n" + "more\n" * 300, "two", "three"])
    (tmp_path / "b.csv").write_text('lyrics,artist\n7" single,x\n')
    with pytest.raises(Exception, match="a quote inside a field"):
        io.read_songs(spark, str(tmp_path / "b.csv"), needed=(), split=True).collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.csv").write_text("lyrics,artist\na,b\n")
    (tmp_path / "d" / "2.csv").write_text("artist,lyrics\na,b\n")
    with pytest.raises(Exception, match="other columns"):
        io.read_songs(spark, str(tmp_path / "d"), needed=(), split=True).collect()
    assert [tuple(r) for r in io.read_songs(spark, str(tmp_path / "d" / "1.csv"), needed=("lyrics",), split=True).select("lyrics", "artist").collect()] == [("a", "b")]


def test_split_csv_by_join(spark, tmp_path, small_blocks):
    """Where too many blocks begin within quotes to name them to all tasks."""
    from versejobs.sources import records

    (tmp_path / "a.csv").write_text("lyrics\n" + "\n".join(f'"{k}\n{"z" * 400}\n"' for k in range(20)))
    few, none = (sorted(r.record for r in records.records(spark, str(tmp_path / "a.csv"), most).collect()) for most in (1000, 0))
    assert few == none and len(few) == 21


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_whole_input(spark):
    """No length of texts or words is left out."""
    assert max(len(r.key) for r in catalog.QUERIES["experiment_keys"](spark, DATA).collect()) > 1000
    lengths = {len(r.word) for r in catalog.QUERIES["loanwords"](spark, DATA).select("word").collect()}
    assert min(lengths) == 1 and max(lengths) > 12


def test_bench_times_the_lexicon_join():
    import bench

    assert "song_density_lexicon" in bench.HEADLINE


@pytest.mark.parametrize("absent", ["xxhash", "ahocorasick", "corpus_pipeline", "versejobs.llm"])
def test_entry_without_what_llm_needs(absent):
    """The lyric queries stay where a library that only llm needs, or llm itself, can't be imported."""
    import subprocess
    import sys

    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') for n in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__)), capture_output=True, text=True, check=True).stdout.split()
    assert said == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "False"]


def test_small_tables_are_dealt_out(spark, tmp_path):
    """One row group goes to all cores; a table over the bound has no exchange; only the columns asked for are read."""
    from versejobs.sources.shared import dealt

    spark.range(1000).selectExpr("id", "id * 2 AS x").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    small = dealt(rows).select("x")
    assert small.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and min(small.rdd.glom().map(len).collect()) > 0
    assert "ReadSchema: struct<x:bigint>" in small._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Exchange" not in dealt(rows, 1)._jdf.queryExecution().executedPlan().toString() and dealt(rows, 1) is rows
