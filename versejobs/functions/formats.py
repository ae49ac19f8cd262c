"""Text made from numbers and names."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Label, column, decimals and unit of each audio feature; the words of the texts below are fixed as well.
AUDIO = (("BPM", "bpm", 0, ""), ("에너지", "energy", 2, ""), ("댄서빌리티", "danceability", 2, ""), ("라우드니스", "loudness", 1, "dB"), ("밸런스", "valence", 2, ""))


def short_number(value: Column, decimals: int) -> Column:
    """A number that has no more decimals than are printed; nan for null and NaN."""
    return F.when(value.isNull() | F.isnan(value), "nan").otherwise(F.format_string(f"%.{decimals}f", value))


def exact_number(value: Column, decimals: int) -> Column:
    """Any number, rounded as Python prints it, through Arrow."""
    show = F.pandas_udf(lambda s: pd.Series(["nan" if pd.isna(x) else f"{x:.{decimals}f}" for x in s], dtype=object), "string")
    return show(value)


def audio(number=short_number) -> Column:
    """The header line of a song's audio features."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{label}: "), number(F.col(name), n), F.lit(unit)) for label, name, n, unit in AUDIO])


def named(artist: Column) -> Column:
    return F.coalesce(artist, F.lit("nan"))


def sample_text(header: Column, chunk: Column) -> Column:
    """Artist and audio lines, the number of lines, the lines and an end mark."""
    return F.concat(F.lit("아티스트: "), named(F.col("artist")), F.lit("\n"), header, F.lit("\n[Verse "), F.size(chunk), F.lit("마디]\n"), F.array_join(chunk, "\n"), F.lit("\n[End]"))


def bars_of(bars: Column, allowed: tuple = (8, 16), default: int = 8) -> Column:
    """How many bars a request asks for; the default for null, an error for any other number."""
    asked = F.coalesce(bars, F.lit(default))
    return F.when(asked.isin(*allowed), asked).otherwise(F.raise_error(F.concat(F.lit(f"bars must be one of {allowed}, not "), asked.cast("string"))))


def prompt_text(header: Column, bars: Column) -> Column:
    """What a model is asked to go on from."""
    return F.concat(F.lit("아티스트: "), named(F.col("artist")), F.lit("\n"), header, F.lit("\n[Verse "), bars, F.lit("마디]\n"))


def experiment_key(name: Column) -> Column:
    """M2: a name that is safe as a folder."""
    key = F.btrim(F.regexp_replace(F.trim(name), "[^A-Za-z0-9._-]+", "-"), F.lit(".-"))
    # A function over one element, so that the key is worked out once.
    return F.get(F.transform(F.array(key), lambda k: F.when(F.coalesce(k, F.lit("")) == "", "experiment").otherwise(k)), 0)
