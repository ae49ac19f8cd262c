"""Prompts from the songs that rhyme best, and from requests."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats

TOP, BARS = 200, (8, 16)


def prompts(scored: DataFrame, top: int = TOP, bars: tuple = BARS, number=formats.short_number) -> DataFrame:
    """G1: rank, song_id, n_bars, prompt of the first songs by density."""
    rows = scored.select("song_id", "artist", *[name for _, name, _, _ in formats.AUDIO], F.nullif(F.col("density").cast("double"), F.lit(float("nan"))).alias("_best"))
    order = [F.col("_best").desc_nulls_last(), F.col("song_id").asc_nulls_last()]
    kept = rows.orderBy(*order).limit(top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # `top` rows
    each = ranked.withColumn("n_bars", F.explode(F.array(*map(F.lit, bars))))
    return each.select("rank", "song_id", "n_bars", formats.prompt_text(formats.audio(number), F.col("n_bars")).alias("prompt"))


def requested(requests: DataFrame, number=formats.short_number) -> DataFrame:
    """Requests (artist, audio columns, bars) with prompt. No exchange."""
    return requests.withColumn("prompt", formats.prompt_text(formats.audio(number), formats.bars_of(F.col("bars"))))


def check_sample(found: DataFrame, n: int = 20) -> DataFrame:
    """G3"""
    return found.orderBy("rank", "n_bars").limit(n)
