"""One query for each operator, over its whole table, and SQL where SQL can express it."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dealt, new_folder
from . import ann, bpe, divergence, images, jaccard, lexical, licenses, line_dedup, mixing, pieces, quality, token_files, toxicity

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.copies(dealt(read(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = quality.held_out(F.col("doc_id"), 4, 2)
    return toxicity.scored(docs, toxicity.fit(docs, labels, ~held)).select("doc_id", held.alias("held_out"), "score", "predicted", "spans")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = quality.held_out(F.col("doc_id"), 5, 0)
    ranking = quality.fit(docs, labels, ~held)
    return quality.scored(docs.select("doc_id", "text"), ranking).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(dealt(read(spark, sf_dir, "documents")).select("doc_id", "text"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images; each vector is drawn, with edited copies of every tenth, and all of these are searched."""
    return images.groups(images.mosaics(read(spark, sf_dir, "embeddings")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    lexical.write(read(spark, sf_dir, "documents"), folder)
    return lexical.search(spark, folder, read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_ann": op1_ann,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_licenses": op4_licenses,
    "op5_jaccard": op5_jaccard,
    "op6_quality": op6_quality,
    "op7_token_files": op7_token_files,
    "op8_line_dedup": op8_line_dedup,
    "op9_bpe": op9_bpe,
    "op10_images": op10_images,
    "op11_divergence": op11_divergence,
    "op12_pieces": op12_pieces,
    "op13_lexical": op13_lexical,
}

#: The level is the greatest of those found with the sources of the smallest bounds, for their weight, held at their bounds.
OP2_SQL = """
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(w) OVER (ORDER BY 3 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goals AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT max(level) FROM levels) * w) AS target FROM levels),
lined AS (SELECT s.*, g.source_size, g.target, s.size * 32 > g.target AS large, row_number() OVER (PARTITION BY s.source, s.size * 32 > g.target ORDER BY s.size, s.doc_id) AS i
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
rates AS (SELECT source, any_value(target) AS target, CASE WHEN any_value(source_size) > 0 THEN any_value(target) / any_value(source_size) ELSE 0 END AS rate, sum(CASE WHEN large THEN 0 ELSE size END)::DOUBLE AS rest FROM lined GROUP BY source),
shifts AS (SELECT *, ('0x' || substr(md5('mix-1-' || k || ':' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE AS shift FROM rates, range(8) AS tries(k)),
first_tries AS (SELECT f.source, f.k, f.shift, f.target, f.rate, f.rest, coalesce(sum((floor(i::DOUBLE * rate + shift) - floor((i - 1)::DOUBLE * rate + shift)) * size), 0)::BIGINT AS words
  FROM shifts f LEFT JOIN lined l ON l.source IS NOT DISTINCT FROM f.source AND l.large GROUP BY ALL),
filled AS (SELECT *, least(greatest(target - words::DOUBLE, 0), rest * 3) AS more FROM first_tries),
firsts AS (SELECT *, CASE WHEN rest > 0 THEN more / rest ELSE 0 END AS second_rate FROM filled QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(target - words::DOUBLE - more), abs(target - rest * rate - words::DOUBLE), k) = 1),
second_tries AS (SELECT h.source, h.k, h.shift, f.target, f.words AS before, coalesce(sum((floor(i::DOUBLE * second_rate + h.shift) - floor((i - 1)::DOUBLE * second_rate + h.shift)) * size), 0)::BIGINT AS words
  FROM shifts h JOIN firsts f ON h.source IS NOT DISTINCT FROM f.source LEFT JOIN lined l ON l.source IS NOT DISTINCT FROM h.source AND NOT l.large GROUP BY ALL),
seconds AS (SELECT * FROM second_tries QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(target - before - words::DOUBLE), k) = 1),
chosen AS (SELECT l.*, CASE WHEN large THEN f.rate ELSE f.second_rate END AS r, CASE WHEN large THEN f.shift ELSE s.shift END AS u FROM lined l JOIN firsts f ON l.source IS NOT DISTINCT FROM f.source JOIN seconds s ON l.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, ((floor(i::DOUBLE * r + u) - floor((i - 1)::DOUBLE * r + u)) * size)::BIGINT AS taken FROM chosen
"""

#: Chunks by the rolling hash, and all shortest runs of lines with 51 words or more by the number of words before each line.
OP8_SQL = """
WITH lined AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
hashed AS (SELECT *, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM lined),
cut AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR (i > 1 AND (h[i - 1] * 31 + h[i]) % 3 = 0)) AS ends FROM hashed),
spans AS (SELECT doc_id, lines, ends, unnest(range(1, len(ends) + 1)) AS j FROM cut),
chunks AS (SELECT doc_id, CASE WHEN j = 1 THEN 1 ELSE ends[j - 1] + 1 END AS a, ends[j] AS b, lines FROM spans),
each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM lined),
sized AS (SELECT doc_id, i, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM each),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM sized),
starts AS (SELECT s.doc_id, s.i AS a, min(t.i) AS b FROM summed s JOIN summed t ON s.doc_id = t.doc_id AND t.i >= s.i AND t.upto - (s.upto - s.w) > 50 WHERE s.w > 0 GROUP BY s.doc_id, s.i),
stops AS (SELECT t.doc_id, max(s.i) AS a, t.i AS b FROM summed s JOIN summed t ON s.doc_id = t.doc_id AND t.i >= s.i AND t.upto - (s.upto - s.w) > 50 WHERE t.w > 0 GROUP BY t.doc_id, t.i),
runs AS (SELECT * FROM starts UNION SELECT * FROM stops),
texts AS (SELECT 0 AS kind, doc_id, a, b, array_to_string(lines[a:b], chr(10)) AS part FROM chunks WHERE b > a
  UNION ALL SELECT 1, doc_id, a, b, array_to_string(lines[a:b], chr(10)) FROM runs JOIN lined USING (doc_id)),
judged AS (SELECT *, count(*) OVER (PARTITION BY kind, part) AS times, min(doc_id) OVER (PARTITION BY kind, part) AS owner, min(a) OVER (PARTITION BY kind, doc_id, part) AS earliest FROM texts),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(a, b + 1)))) AS lost FROM judged WHERE times > 1 AND (doc_id <> owner OR a > earliest) GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lost), 0)::BIGINT AS removed_lines,
  CASE WHEN lost IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(lost, i)), chr(10)) END AS text
FROM lined l LEFT JOIN gone g ON l.doc_id = g.doc_id
"""

#: Every kept term stands beside every group of its language.
OP11_SQL = """
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
vocabulary AS (SELECT lang, count(*) AS v, sum(n) AS size FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
held AS (SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, k.n AS lang_n FROM groups g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
sizes AS (SELECT lang, source, sum(n) AS size FROM held GROUP BY ALL),
shares AS (SELECT h.*, 1 + (1000000000::HUGEINT * (h.n + 5)) // (s.size + 5 * w.v) AS p, 1 + (1000000000::HUGEINT * (h.lang_n + 5)) // (w.size + 5 * w.v) AS q
  FROM held h JOIN sizes s USING (lang, source) JOIN vocabulary w USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
above AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

OP13_SQL = """
WITH docs AS (SELECT row_number() OVER () AS i, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
sizes AS (SELECT i, count(*) AS n FROM docs GROUP BY i),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
postings AS (SELECT i, doc_id, term, count(*) AS tf FROM docs WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term, docs),
scores AS (SELECT item_id, i, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (i), whole GROUP BY item_id, i, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES = {
    "op2_mixing": OP2_SQL,
    "op8_line_dedup": OP8_SQL,
    "op11_divergence": OP11_SQL,
    "op13_lexical": OP13_SQL,
}
