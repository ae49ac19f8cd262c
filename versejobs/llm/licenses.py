"""License scans by diagonal voting.

Every two neighbouring words of a document are hashed and joined with the places of the same two words in the templates;
the words themselves are then compared, for notices with the word behind them, which leaves few chance hits. Each hit votes for a diagonal, the document's word minus the template's. Diagonals
of a template that lie next to each other are merged into spans, which bridge left out or added words. A span holds if it
covers enough of its template's pairs and is not much longer than the template.

Base phrases are templates that hold only as a whole on one diagonal; each of their places counts.

Defined results: a null text is an empty one; texts of fewer than two words have no hits; rows with equal doc_id and text get
equal results; null doc_ids keep their rows; an empty table gives an empty result; other columns are not read.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a hashed gram; words that a hit on a notice takes.
K, NOTICE_K = 2, 3
#: Diagonals up to so far apart belong to one span.
NEAR = 3
#: Least share of a template's grams in a span, and most of its length that a span may have.
COVER, STRETCH = 0.8, 1.5
#: Phrases that count wherever their words stand consecutively.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices of public licenses.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version", "gpl"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the gnu lesser general public license version", "lgpl"),
    ("licensed under the gnu affero general public license version", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution license", "cc-by"),
)


def template_grams(spark, base=BASE, notices=NOTICES) -> DataFrame:
    """template, label, is_base, n_grams, at and the gram's words, for each place in each template; and a row that every document meets."""
    rows = []
    for k, (text, label) in enumerate([*base, *notices]):
        words, size = text.split(), K if k < len(base) else NOTICE_K
        grams = [words[i : i + size] for i in range(len(words) - size + 1)]
        rows += [(k, label, k < len(base), len(grams), i, a, b, c[0] if c else None) for i, (a, b, *c) in enumerate(grams)]
    found = spark.createDataFrame(rows, "template int, label string, is_base boolean, n_grams int, at int, w1 string, w2 string, w3 string")
    every = spark.createDataFrame([(-1, None, False, 0, 0, None, None, None)], found.schema)
    return found.withColumn("gram", F.xxhash64("w1", "w2")).unionByName(every.withColumn("gram", F.lit(0).cast("long")))


def hits(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, _h, n_words, template, at, pos of each gram that stands in a template; once for each document with template -1."""
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    worded = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("_words"))
    worded = worded.withColumn("n_words", F.size("_words").cast("long"))
    places = F.when(F.size("_words") >= K, F.sequence(F.lit(0), F.size("_words") - K)).otherwise(F.array().cast("array<int>"))
    grams = F.concat(F.transform(places, lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1))), F.array(F.lit(0).cast("long")))
    placed = worded.select("*", F.posexplode(grams).alias("pos", "_gram"))
    # The templates are a fixed list of this module, a few hundred rows.
    met = placed.join(F.broadcast(templates), F.col("_gram") == F.col("gram"))
    alike = (F.get("_words", F.col("pos")) == F.col("w1")) & (F.get("_words", F.col("pos") + 1) == F.col("w2")) & (F.col("w3").isNull() | (F.get("_words", F.col("pos") + 2) == F.col("w3")))
    ending = F.col("pos") == F.greatest(F.col("n_words") - K + 1, F.lit(0))
    met = met.where(F.when(F.col("template") < 0, ending).otherwise(alike))
    return met.select("doc_id", "_h", "n_words", "template", "label", "is_base", "n_grams", "at", F.col("pos").cast("long").alias("pos"))


def scan(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of each document."""
    met = cut(hits(docs, template_grams(docs.sparkSession, base, notices)))
    doc = ["doc_id", "_h"]
    rows = met.where("template < 0").groupBy(*doc, "n_words").agg(F.count("*").alias("_rows"))
    votes = met.where("template >= 0").drop("n_words").distinct().withColumn("diagonal", F.col("pos") - F.col("at"))
    one = [*doc, "template", "label", "is_base", "n_grams"]
    lines = votes.groupBy(*one, "diagonal").agg(F.collect_set("at").alias("_at"), F.min("pos").alias("_from"), F.max("pos").alias("_to"))
    whole = lines.where("is_base AND size(_at) = n_grams").select(*doc, "label", F.lit(True).alias("_base"), F.lit(1.0).alias("_score"), F.col("diagonal").alias("_start"), (F.col("_to") + K - 1).alias("_end"))

    # Merged spans of the notices: a new one begins where the diagonal jumps or the hits do.
    by = Window.partitionBy(*one).orderBy("_from", "diagonal")
    jump = (F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) > NEAR) | (F.col("_from") - F.lag("_to").over(by) > F.col("n_grams"))
    spans = lines.where("NOT is_base").withColumn("_span", F.sum(F.coalesce(jump, F.lit(True)).cast("int")).over(by))
    spans = spans.groupBy(*one, "_span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("_at")))).alias("_n"), F.min("_from").alias("_start"), (F.max("_to") + NOTICE_K - 1).alias("_end"))
    held = spans.withColumn("_score", F.col("_n") / F.col("n_grams")).where((F.col("_score") >= COVER) & (F.col("_end") - F.col("_start") + 1 <= STRETCH * (F.col("n_grams") + NOTICE_K - 1)))
    both = whole.unionByName(held.select(*doc, "label", F.lit(False).alias("_base"), "_score", "_start", "_end"))

    def joined(labels):
        return F.array_join(F.array_sort(labels), ",")

    base_only = F.when(F.col("_base"), F.col("_start"))
    found = both.groupBy(*doc).agg(
        F.count(base_only).alias("n_base"), F.min(base_only).alias("first_word"), F.max(base_only).alias("last_word"),
        joined(F.collect_set(F.when(F.col("_base"), F.col("label")))).alias("base_labels"), joined(F.collect_set("label")).alias("labels"), F.max("_score").alias("score"),
        F.array_sort(F.collect_list(F.struct(F.col("_start").alias("first_word"), F.col("_end").alias("last_word"), "label", F.col("_score").alias("cover")))).alias("spans"),
    ).withColumnsRenamed({"doc_id": "_i", "_h": "_k"})
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("_h").eqNullSafe(F.col("_k")), "left")
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    return out.select(*[F.coalesce(c, empty[c]).alias(c) if c in empty else F.col(c) for c in cols])
