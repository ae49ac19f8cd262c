"""Rewards of generated verses (G4-G12). Expressions inside one row, so they also run on streams."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import moments, rhyme, text

# The mark of a verse's end and how a prompt names its number of bars.
END, BARS = "[End]", r"(?U)\[Verse\s+(\d+)\s*마디\]"
# Weights of rhyme, length, format, repeats and runs; from the last two on a reward is 0 at most.
WEIGHTS, MOST_REPEATS, MOST_RUN = (0.5, 0.2, 0.2, 0.4, 0.4), 0.6, 3


def verse(completion: Column) -> Column:
    """Lines before the first end mark."""
    return text.lines(F.substring_index(completion, END, 1))


def target_bars(prompt: Column, default: int = 8) -> Column:
    """G5"""
    return F.coalesce(F.regexp_extract(F.coalesce(prompt, F.lit("")), BARS, 1).try_cast("int"), F.lit(default))


def rewards(rows: DataFrame) -> DataFrame:
    """rows (prompt, completion) with n_lines, target, rhyme, format_ok, length_score, dup_ratio, max_run, run_penalty and reward.

    A null completion counts as an empty one; without a prompt column the target is the default.
    """
    prompt = F.col("prompt") if "prompt" in rows.columns else F.lit(None).cast("string")
    found = rows.withColumn("_lines", verse(F.coalesce("completion", F.lit(""))))
    found = found.withColumn("_tails", rhyme.tails(F.col("_lines"))).withColumn("_scores", rhyme.pair_scores(F.col("_tails")))
    n, total = F.size("_lines"), F.aggregate("_scores", F.lit(0).cast("long"), lambda x, y: x + y)
    pairs = F.size("_scores")
    found = found.withColumns({
        "n_lines": n, "target": target_bars(prompt), "rhyme": F.when(pairs > 0, total / (pairs * F.lit(10000.0))).otherwise(0.0),
        "format_ok": F.coalesce(F.contains("completion", F.lit(END)), F.lit(False)).cast("double"), "dup_ratio": text.duplicate_ratio(F.col("_lines")), "max_run": text.longest_run(F.col("_lines")),
    })
    miss = F.abs(F.col("n_lines") - F.col("target")) / F.nullif(F.col("target"), F.lit(0))
    found = found.withColumns({
        "length_score": F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - miss), F.lit(0.0)),
        "run_penalty": F.when(F.col("n_lines") > 0, F.greatest(F.lit(0.0), (F.col("max_run") - 1) / F.greatest(F.lit(1), F.col("n_lines") - 1))).otherwise(1.0),
    })
    a, b, c, d, e = map(F.lit, WEIGHTS)
    raw = a * (F.col("rhyme") * (F.lit(1.0) - F.col("dup_ratio"))) + b * F.col("length_score") + c * F.col("format_ok") - d * F.col("dup_ratio") - e * F.col("run_penalty")
    capped = (F.col("dup_ratio") >= MOST_REPEATS) | (F.col("max_run") >= MOST_RUN)
    return found.withColumn("_raw", raw).withColumn("reward", F.when(capped, F.least("_raw", F.lit(0.0))).otherwise(F.col("_raw"))).drop("_lines", "_tails", "_scores", "_raw")


def reward_stats(scored: DataFrame, by: tuple = ()) -> DataFrame:
    """Mean, sample deviation, least and greatest reward of each run, and whether they tell a model little or punish too much.

    The same bits come out for any order of rows and any partitions.
    """
    stats = moments.described(scored, "reward", by)
    return stats.withColumn("weak_signal", F.col("std") < 0.05).withColumn("harsh", F.col("mean") < 0)
