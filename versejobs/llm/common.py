"""What several operators share: cut lineage, numbered rows, text sizes."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: A word, where only ASCII white space parts words.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that lost executors don't lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(name: str, *rows: DataFrame) -> str:
    """name, with as many underscores in front as it takes so that none of `rows` has such a column."""
    taken = {c.lower() for df in rows for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column | str) -> Column:
    """A number from 0 up to 1 that depends on the parts' text alone; null counts as empty text."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def numbered(df: DataFrame, within: list[str], order: list[str], name: str = "row_no") -> DataFrame:
    """df with each row's number from 0 among the rows with its values in `within`, by `order` (nulls last).

    Rows are dealt out by range, so a group of any size spreads over many tasks; only the number of rows of each group
    and partition is gathered. df should be narrow: it is written to the checkpoint folder once.
    """
    keys = [F.col(c).asc_nulls_last() for c in [*within, *order]]
    part = F.shiftright("_at", 33)
    dealt = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", part)
    runs = dealt.groupBy(*within, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(c).alias(f"_{c}") for c in within], F.col("_part").alias("_run"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_run")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = dealt.join(runs, same).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
    return out.drop("_at", "_part", "_run", "_first", "_before", *[f"_{c}" for c in within])
