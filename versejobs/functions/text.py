"""Lines, tokens, windows and repeats as expressions inside one row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() takes it.
SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TOKEN = "[가-힣]+|[A-Za-z]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def lines(text: Column) -> Column:
    """Stripped lines that aren't empty; null for null."""
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")


def is_tag(line: Column) -> Column:
    """Whether a stripped line is a section tag in brackets."""
    return line.startswith("[") & line.endswith("]") & (F.length(line) >= 2)


def clean_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda x: ~is_tag(x))


def tokens(line: Column) -> Column:
    """Runs of Hangul and runs of ASCII letters, in order."""
    return F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))


def chunks(rows: Column, size: int) -> Column:
    """Windows of `size` lines one after another; a last one over the end if at least half a window is left and it is new."""
    n = F.size(rows)
    count = F.floor(n / size).cast("int")
    whole = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(rows, i * size + 1, size))
    tail = F.slice(rows, n - size + 1, size)
    last = F.slice(rows, (count - 1) * size + 1, size)
    extra = (n % size >= size // 2) & ~(tail == last)
    none = F.array().cast("array<array<string>>")
    return F.when(n >= size, F.concat(whole, F.when(extra, F.array(tail)).otherwise(none))).otherwise(none)


def longest_run(rows: Column) -> Column:
    """Most equal lines one after another; 0 for none."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, line: Column) -> Column:
        run = F.when(acc["last"] == line, acc["run"] + 1).otherwise(1)
        return F.struct(line.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(rows, start, step, lambda acc: acc["best"])


def duplicate_ratio(rows: Column) -> Column:
    return F.when(F.size(rows) > 0, F.lit(1.0) - F.size(F.array_distinct(rows)) / F.size(rows)).otherwise(1.0)
