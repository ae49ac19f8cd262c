"""Delimited files with quoted line breaks, read by several tasks each.

Tasks take files by blocks of lines. A line break ends a record where the quotes before it in the file are even in number, as
a quote within quotes is doubled. So the quotes of each block are counted first; sums over the blocks before it tell whether
a block begins within quotes, and a task then knows where records begin. What stands before a block's first record belongs
to the last one of a block before it: only these ends of blocks are exchanged, to be put together.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most blocks whose first states are sent to all tasks; more are joined.
BLOCKS = 200_000
PIECES = "file string, block long, no long, kind string, record string"
# Of a line: a field is quoted as a whole, or has no quote.
REGULAR = '(?s)(?:(?:"(?:[^"]|"")*+"|[^"{0}]*+)(?:{0}|$))*+'


def quoted_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (the offset it begins at), value, odd (whether the line's quotes are odd in number), in the files' order within a block."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return lines.withColumn("odd", F.length(F.regexp_replace("value", '[^"]+', "")) % 2 == 1)


def records(spark: SparkSession, path: str, most: int = BLOCKS) -> DataFrame:
    """file, first (whether it is the file's first record), record: the text of each record, without the break behind it."""
    lines = quoted_lines(spark, path)
    odd = lines.groupBy("file", "block").agg(F.sum(F.col("odd").cast("long")).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    state = odd.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("within"))
    within = state.where("within").select(F.col("file").alias("_file"), F.col("block").alias("_block"), "within")
    # Only blocks that begin within quotes are named, so well-behaved files name few.
    if within.limit(most + 1).count() <= most:
        within = F.broadcast(within)
        lines = lines.join(within, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")), "left")
    else:
        lines = lines.withColumn("_no", F.monotonically_increasing_id())
        lines = lines.join(within, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")), "left").repartition("file", "block").sortWithinPartitions("file", "block", "_no")
    lines = lines.select("file", "block", "value", "odd", F.coalesce("within", F.lit(False)).alias("within"))
    pieces = lines.mapInArrow(joined, PIECES)
    whole = pieces.where("kind = 'whole'").select("file", (F.col("block") + F.col("no") == 0).alias("first"), "record")
    # A block's last record goes on in the heads of the blocks behind it, up to the one that has a last record of its own.
    last = Window.partitionBy("file").orderBy("block", "no")
    ends = pieces.where("kind != 'whole'").withColumn("of", F.max(F.when(F.col("kind") == "last", F.col("block"))).over(last))
    ends = ends.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("block", "no", "record"))).alias("parts"))
    parts = F.transform("parts", lambda x: x["record"])
    first = (F.get("parts", 0)["block"] == 0) & (F.get("parts", 0)["no"] == 0)
    return whole.unionByName(ends.select("file", first.alias("first"), F.array_join(parts, "\n").alias("record")))


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of each block; its head (lines of a record that began before) and its last record."""
    at, odd, no, held, head = None, False, 0, [], False
    out: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}

    def put(kind: str) -> None:
        for name, x in zip(out, (*at, no, kind, "\n".join(held)), strict=True):
            out[name].append(x)

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("block", "no") else pa.string()) for k, v in out.items()], list(out))
        for v in out.values():
            v.clear()
        return batch

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file", "block", "value", "odd", "within")]
        for file, block, value, flips, within in zip(*columns, strict=True):
            if (file, block) != at:
                if held:
                    put("head" if head else "last")
                at, odd, no, held, head = (file, block), within, 0, [], within
            elif not odd:  # the line before ended a record
                put("head" if head else "whole")
                no, held, head = no + 1, [], False
            held.append(value)
            odd ^= flips
        if len(out["no"]) >= 1000:
            yield flushed()
    if held:
        put("head" if head else "last")
    yield flushed()


def fields(record: Column, names: list[str], sep: str = ",") -> Column:
    """A struct of texts; an error for a record with a quote in a field that isn't quoted, as quotes don't tell its records apart.

    Where lines end in carriage return and line feed, breaks within quotes become line feeds, as Spark's reader has them; in a
    last record that ends without a break they stay.
    """
    text = F.when(record.endswith("\r"), F.replace(F.substring(record, F.lit(1), F.length(record) - 1), F.lit("\r\n"), F.lit("\n"))).otherwise(record)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = F.from_csv(text, schema, {"quote": '"', "escape": '"', "sep": sep, "multiLine": "true"})
    return F.when(text.rlike(f"^{REGULAR.format(sep)}$"), parsed).otherwise(F.raise_error(F.concat(F.lit("a quote inside a field without quotes: "), F.substring(text, 1, 80))))


def rows_by_name(spark: SparkSession, path: str, names: list[str], sep: str = ",") -> DataFrame:
    """Rows of delimited files whose first records all are the header `names`, as texts; another header is an error."""
    rows = records(spark, path).where("trim(record) NOT IN ('', '\r')").select("first", fields(F.regexp_replace("record", "^\ufeff", ""), names, sep).alias("x"))
    # Spark numbers names that are empty or stand twice.
    same = [F.coalesce(F.col("x")[n], F.lit("")).isin(n, n.removesuffix(str(k)) if n != f"_c{k}" else "") for k, n in enumerate(names)]
    wrong = F.raise_error(F.concat(F.lit(f"{path} has a file with other columns: "), F.to_csv("x")))
    header = F.when(~F.col("first"), True)
    for k in same:
        header = header.when(~k, wrong.cast("boolean"))
    return rows.withColumn("ok", header.otherwise(True)).where("ok AND NOT first").select("x.*")
