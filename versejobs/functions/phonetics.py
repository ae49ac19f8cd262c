"""Syllables of Hangul and English text as expressions inside one row, as integer codes (see tables)."""

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import kept
from . import tables as T
from .text import tokens

CODES = "array<int>"
#: Words at a line's end that are looked at first: inside the row, and by join; how many times as many there the next time.
NEAR, NEAR_JOINED, MORE_JOINED = 6, 4, 16
#: Stands for the codes of a token that isn't resolved yet.
GAP = -1
#: Most bytes, by the plan's statistics, and most words of a lexicon that goes into rows as a whole.
SMALL_BYTES, SMALL_WORDS = 4 << 20, 20_000


def constants(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def none() -> Column:
    return F.array().cast(CODES)


def hangul_codes(text: Column) -> Column:
    """Codes of the Hangul characters; others are passed over."""
    chars = F.filter(F.split(text, ""), lambda c: (c >= "가") & (c <= "힣"))

    def one(c: Column) -> Column:
        n = F.ascii(c) - T.FIRST_HANGUL
        return (F.floor(n % 588 / 28) * 32 + n % 28).cast("int")

    return F.transform(chars, one)


def compose(onset: Column, vowel: Column, coda: Column) -> Column:
    """The Hangul character of index numbers; null onsets are silent, null codas none."""
    n = F.lit(T.FIRST_HANGUL) + (F.coalesce(onset, F.lit(T.ONSETS.index("ㅇ"))) * 21 + vowel) * 28 + F.coalesce(coda, F.lit(0))
    return F.decode(F.unhex(F.hex(n)), "UTF-16BE")


def spelled(codes: Column) -> Column:
    """Codes as structs of vowel and coda letters."""
    return F.transform(codes, lambda s: F.struct(F.get(constants(T.VOWELS), F.floor(s / 32).cast("int")).alias("v"), F.get(constants(T.CODAS), s % 32).alias("c")))


def phones_of(pronunciation: Column) -> Column:
    """ARPAbet phones without stress."""
    return F.filter(F.split(F.regexp_replace(pronunciation, "[0-9]", ""), r"\s+"), lambda p: p != "")


def vowel_places(phones: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(phones) - 1), lambda i: F.get(phones, i).isin(*T.PHONE_VOWEL))


def with_syllables(lexicon: DataFrame, phones: str = "phones") -> DataFrame:
    """Lexicon with ph, loanword (Hangul spelling, null without vowels), codes (of the loanword) and simple_codes."""
    vowels, onsets = lookup({p: T.VOWELS.index(v) for p, v in T.PHONE_VOWEL.items()}), lookup({p: T.ONSETS.index(o) for p, o in T.PHONE_ONSET.items()})
    codas, simple = (lookup({p: T.CODAS.index(c) for p, c in t.items()}) for t in (T.PHONE_LOAN_CODA, T.PHONE_CODA))
    rows = lexicon.withColumn("ph", phones_of(F.col(phones)))
    rows = rows.withColumn("at", F.when(F.size("ph") > 0, vowel_places(F.col("ph"))).otherwise(none()))
    rows = rows.withColumn("_k", F.when(F.size("at") > 0, F.sequence(F.lit(0), F.size("at") - 1)).otherwise(none()))

    def part(k: Column) -> Column:
        """What belongs to the k-th vowel."""
        here, last = F.get("at", k), k == F.size("at") - 1
        end = F.when(last, F.size("ph")).otherwise(F.get("at", k + 1))
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("at", k - 1) + 1)
        return F.struct(F.get("ph", here).alias("v"), F.slice("ph", here + 2, end - here - 1).alias("after"), F.slice("ph", start + 1, here - start).alias("before"), (k == 0).alias("first"), last.alias("last"))

    rows = rows.withColumn("_parts", F.transform("_k", part))

    def syllables(p: Column) -> Column:
        """Onset, vowel and coda numbers: the vowel's syllable, then one for each consonant that is left at the end."""
        n = F.size(p["after"])
        vowel = F.when((p["v"] == "AH") & (n == 1) & (F.get(p["after"], 0) == "L"), F.lit(T.VOWELS.index("ㅡ"))).otherwise(F.element_at(vowels, p["v"]))
        lead = F.when(p["first"], F.get(p["before"], 0)).otherwise(F.get(p["before"], F.size(p["before"]) - 1))
        coda = F.when((n >= 2) | (p["last"] & (n >= 1)), F.element_at(codas, F.get(p["after"], 0)))
        main = F.struct(F.element_at(onsets, lead).alias("o"), vowel.alias("v"), F.coalesce(coda, F.lit(0)).alias("c"))
        rest = F.filter(F.slice(p["after"], 2, F.size(p["after"])), lambda c: p["last"] & F.element_at(onsets, c).isNotNull())
        added = F.transform(rest, lambda c: F.struct(F.element_at(onsets, c).alias("o"), F.when(c.isin(*T.FRONT_PHONES), T.VOWELS.index("ㅣ")).otherwise(T.VOWELS.index("ㅡ")).alias("v"), F.lit(0).alias("c")))
        return F.concat(F.array(main), added)

    rows = rows.withColumn("_syl", F.flatten(F.transform("_parts", syllables)))
    plain = F.transform("_parts", lambda p: F.element_at(vowels, p["v"]) * 32 + F.coalesce(F.when(p["last"] | (F.size(p["after"]) >= 2), F.element_at(simple, F.get(p["after"], 0))), F.lit(0)))
    word = F.array_join(F.transform("_syl", lambda s: compose(s["o"], s["v"], s["c"])), "")
    rows = rows.withColumn("loanword", F.when(F.size("_syl") > 0, word)).withColumn("codes", F.transform("_syl", lambda s: s["v"] * 32 + s["c"])).withColumn("simple_codes", plain)
    return rows.drop("at", "_k", "_parts", "_syl")


def fallback_codes(word: Column) -> Column:
    """Codes of an English word by its letters: a vowel, and the first consonant after it where that closes the syllable."""
    vowels, codas = lookup({a: T.VOWELS.index(v) for a, v in T.LETTER_VOWEL.items()}), lookup({a: T.CODAS.index(c) for a, c in T.LETTER_CODA.items()})
    parts = F.regexp_extract_all(F.lower(word), F.lit("[aeiouy][^aeiouy]*"), F.lit(0))
    closed = F.regexp_extract_all(F.concat(F.lower(word), F.lit("#")), F.lit("[aeiouy][^aeiouy]*"), F.lit(0))

    def one(part: Column, marked: Column) -> Column:
        # A mark at the word's end makes a last consonant count as two.
        coda = F.when((F.length(part) >= 2) & (F.length(marked) >= 3), F.element_at(codas, F.substring(part, 2, 1)))
        return F.element_at(vowels, F.substring(part, 1, 1)) * 32 + F.coalesce(coda, F.lit(0))

    return F.zip_with(parts, closed, one)


def is_hangul(token: Column) -> Column:
    return token >= "가"


def given_codes(low: Column) -> Column:
    """Codes of a lower-case English word that is a stopword or has a given spelling, else null.

    A map is searched from end to end, a set is hashed.
    """
    given = F.create_map(*[x for w, c in T.OVERRIDE_CODES.items() for x in (F.lit(w), constants(c))])
    return F.when(low.isin(*T.STOPWORDS), none()).when(low.isin(*T.OVERRIDES), F.element_at(given, low))


def english_codes(word: Column, known: Callable[[Column], Column] | None = None) -> Column:
    """Codes of an English word; `known` gives those that a lexicon has for a lower-case word, else null."""
    low = F.lower(word)
    return F.coalesce(given_codes(low), *([known(low)] if known else []), fallback_codes(low))


def token_codes(token: Column, known: Callable[[Column], Column] | None = None) -> Column:
    return F.when(is_hangul(token), hangul_codes(token)).otherwise(english_codes(token, known))


def bears_sound(token: Column) -> Column:
    """Whether a token has any syllable, without a lexicon."""
    low = F.lower(token)
    return is_hangul(token) | (~low.isin(*T.STOPWORDS) & (low.rlike("[aeiouy]") | low.isin(*T.OVERRIDES)))


def line_codes(line: Column) -> Column:
    """Codes of a whole line, without a lexicon."""
    return F.flatten(F.transform(tokens(line), lambda t: token_codes(t)))


def last_codes(line: Column, known: Callable[[Column], Column] | None = None) -> Column:
    """The last three codes of a line, the last one first; `known` as in english_codes().

    Only tokens with sounds are looked at, among those behind the NEAR-th last blank, where no token is cut; the
    whole line is searched only if these give too few codes.
    """

    def among(part: Column) -> Column:
        # What bears a sound in a lexicon shows only when it is looked up.
        some = F.reverse(tokens(part)) if known else F.slice(F.reverse(F.filter(tokens(part), bears_sound)), 1, 3)
        return F.slice(F.flatten(F.transform(some, lambda t: F.reverse(token_codes(t, known)))), 1, 3)

    near = F.substring_index(line, " ", -NEAR)
    # A function over one element, so that what it names is worked out once.
    found = F.transform(F.array(F.struct(near.alias("near"), among(near).alias("codes"))), lambda x: F.when((F.size(x["codes"]) == 3) | (F.length(x["near"]) == F.length(line)), x["codes"]).otherwise(among(line)))
    return F.get(found, 0)


def lexicon_codes(lexicon: DataFrame) -> DataFrame:
    """word (lower case), known: codes of the loanword, else the simple ones. Of several rows of a word the least counts."""
    codes = F.coalesce(F.when(F.col("loanword").isNotNull(), F.col("codes")), F.col("simple_codes"))
    return with_syllables(lexicon).where("word IS NOT NULL").groupBy(F.lower("word").alias("word")).agg(F.min(codes).alias("known"))


def in_rows(lexicon: DataFrame, most_bytes: int = SMALL_BYTES, most_words: int = SMALL_WORDS) -> Callable[[Column], Column] | None:
    """A lookup of lower-case words in a lexicon small enough to be a constant of the plan, or None for any other.

    The plan's statistics are asked first, so a large lexicon is never read for that; then the words are counted as they come.
    """
    if int(str(lexicon._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most_bytes:
        return None
    if lexicon.limit(most_words + 1).count() > most_words:
        return None
    return constant_lookup(lexicon_codes(lexicon))


def constant_lookup(words: DataFrame) -> Callable[[Column], Column]:
    """A lookup in words (word, known), few enough to be a constant of the plan.

    The constant is an array of buckets by the words' hash, so a lookup compares about one word, whatever the size.
    """
    rows = words.select(F.xxhash64("word").alias("h"), "word", "known").collect()  # SMALL_WORDS at most, or as many as the caller allows
    buckets = max(1, len(rows))
    held: list = [[] for _ in range(buckets)]
    for r in rows:
        held[r.h % buckets].append({"w": r.word, "c": list(r.known)})
    table = F.from_json(F.lit(json.dumps(held)), f"array<array<struct<w:string,c:{CODES}>>>")

    def known(low: Column) -> Column:
        own = F.get(table, F.pmod(F.xxhash64(low), F.lit(buckets)).cast("int"))
        return F.get(F.filter(own, lambda x: x["w"] == low), 0)["c"]

    return known


def overrides(spark: SparkSession) -> DataFrame:
    """word, hangul, override_codes of the fixed spellings."""
    return spark.createDataFrame([(w, T.OVERRIDES[w], c) for w, c in T.OVERRIDE_CODES.items()], f"word string, hangul string, override_codes {CODES}")


def stopwords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in T.STOPWORDS], "word string")


#: Pronouncing functions of this Python worker, by name.
STARTED: dict[str, Callable[[str], str | None]] = {}


def started(name: str, start: Callable[[], Callable]) -> Callable[[str], str | None]:
    if name not in STARTED:
        STARTED[name] = start()
    return STARTED[name]


def spoken(start: Callable[[], Callable[[str], str | None]], name: str | None = None) -> Callable[[Column | str], Column]:
    """P10: an Arrow UDF from a word's spelling to a struct: said, how it is spoken, and failed, whether the function raised an error.

    `start` makes the pronouncing function, such as a model; it is called once in each Python worker, not for each batch or
    task. said is null where the function gives none or fails, so the spelling holds. Functions go by `name`.
    """
    name = name or f"{start.__module__}.{start.__qualname__}"

    @F.pandas_udf("said string, failed boolean")
    def say(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = started(name, start)
        for words in batches:
            rows = []
            for w in words:
                try:
                    rows.append((None if w is None else one(w), False))
                except Exception:  # whatever a pronouncing library raises for a word
                    rows.append((None, True))
            yield pd.DataFrame(rows, columns=["said", "failed"], dtype=object)

    return say


def resolve_words(words: DataFrame, lexicon: DataFrame | None = None, g2p=None, asked: Observation | None = None) -> DataFrame:
    """Token, codes for each distinct token of words (token).

    An English token is a stopword, else has a given spelling, else the lexicon's pronunciation, else goes by its letters.
    g2p, made by spoken(), is called for Hangul tokens, once for each; `asked` then observes how many `words` it was asked and
    how many `failed`. Pronunciations are made codes only for words that occur; the lexicon joins by whatever way its size
    calls for.
    """
    one = words.select("token").where("token IS NOT NULL").distinct()
    hangul = one.where(is_hangul(F.col("token")))
    if g2p is not None:
        hangul = hangul.repartition("token").withColumn("_g2p", g2p("token"))
        if asked is not None:
            hangul = hangul.observe(asked, F.count(F.lit(1)).alias("words"), F.coalesce(F.count_if("_g2p.failed"), F.lit(0)).alias("failed"))
        hangul = hangul.select("token", hangul_codes(F.coalesce("_g2p.said", "token")).alias("codes"))
    else:
        hangul = hangul.select("token", hangul_codes(F.col("token")).alias("codes"))
    english = one.where(~is_hangul(F.col("token"))).withColumn("low", F.lower("token"))
    known = F.lit(None).cast(CODES)
    if lexicon is not None:
        missing = english.where(given_codes(F.col("low")).isNull()).select(F.col("low").alias("_word")).distinct()
        occurring = lexicon.join(missing, F.lower("word") == F.col("_word"), "left_semi")
        spoken = lexicon_codes(occurring).withColumnRenamed("word", "_word")
        english, known = english.join(spoken, F.col("low") == F.col("_word"), "left"), F.col("known")
    codes = F.coalesce(given_codes(F.col("low")), known, fallback_codes(F.col("low")))
    return hangul.unionByName(english.select("token", codes.alias("codes")))


def line_tails_by_words(lines: DataFrame, keys: list[str], lexicon: DataFrame | None = None, g2p=None, line: str = "line", near: int = NEAR_JOINED) -> DataFrame:
    """Keys, tail: the last three codes of each line that has any, the last one first, from resolved words.

    Stopwords have no codes in any dictionary, so they don't leave the row. Of the other tokens behind the last blanks of
    a line `near` at most go to the join; only lines that have more and got fewer than three codes take part in the next
    round, with MORE_JOINED times as many. No exchange holds more of a line than one round's tokens.
    """
    size, short, found = near, None, None
    while True:
        end = F.substring_index(line, " ", -2 * size)
        some = F.reverse(F.filter(tokens(end), lambda t: ~F.lower(t).isin(*T.STOPWORDS)))
        rows = lines.select(*keys, some.alias("_some"), (F.length(end) < F.length(line)).alias("_cut"))
        rows = rows.select(*keys, F.slice("_some", 1, size).alias("_near"), (F.col("_cut") | (F.size("_some") > size)).alias("_more")).where((F.size("_near") > 0) | F.col("_more"))
        if short is not None:
            rows = rows.join(short, keys, "left_semi")
        each = rows.select(*keys, "_more", F.posexplode_outer("_near").alias("_pos", "token"))
        own = given_codes(F.lower("token"))
        if g2p is None:
            own = F.when(is_hangul(F.col("token")), hangul_codes(F.col("token"))).otherwise(own)
        # Tokens whose codes are known already spread by their place instead of meeting at a frequent word.
        each = each.withColumn("_own", own).withColumn("_key", F.when(F.col("_own").isNull(), F.col("token")))
        each = kept(each.withColumn("_key", F.coalesce("_key", F.concat(F.lit("\n"), F.xxhash64(*keys, "_pos").cast("string")))))
        words = resolve_words(each.where("_own IS NULL").select("token"), lexicon, g2p).select(F.col("token").alias("_token"), F.col("codes").alias("_found"))
        each = each.join(words, F.col("_key") == F.col("_token"), "left").select(*keys, "_more", F.struct("_pos", F.reverse(F.coalesce("_own", "_found", none())).alias("c")).alias("_x"))
        tail = F.slice(F.flatten(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["c"])), 1, 3)
        got = kept(each.groupBy(*keys).agg(tail.alias("tail"), F.bool_or("_more").alias("_more")))
        open_ones = (F.size("tail") < 3) & F.col("_more")
        closed = got.where(~open_ones).select(*keys, "tail")
        found = closed if found is None else found.unionByName(closed)
        short = got.where(open_ones).select(*keys)
        if short.isEmpty():
            return found
        size *= MORE_JOINED


def line_codes_by_words(lines: DataFrame, word_codes: DataFrame, keys: list[str], line: str = "line", counts: DataFrame | None = None) -> DataFrame:
    """P11 by join: keys and codes of each line, from resolved words (token, codes); counts: how often each token occurs (token, count), if known.

    Codes of the SMALL_WORDS most frequent tokens go into the rows, so only rarer tokens are joined. A line is exchanged once, as
    its codes, in which a GAP stands for each token that is left.
    """
    if counts is None:
        counts = lines.select(F.explode(tokens(F.col(line))).alias("token")).groupBy("token").count()
    often = counts.orderBy(F.desc("count"), "token").limit(SMALL_WORDS).select(F.col("token").alias("word"))
    words = word_codes.select(F.col("token").alias("_token"), F.col("codes").alias("_codes"))
    known = constant_lookup(often.join(words, F.col("word") == F.col("_token"), "left").select("word", F.coalesce("_codes", none()).alias("known")))
    # Lines that are alike in their keys alone stay apart.
    by, small = [*keys, "_line"], "array<smallint>"
    each = F.transform(tokens(F.col(line)), lambda t, i: F.struct(i.alias("pos"), t.alias("token"), known(t).alias("c")))
    rows = lines.select(*keys, F.hash(line).alias("_line"), each.alias("_each"))
    flat = F.flatten(F.transform("_each", lambda x: F.coalesce(x["c"], F.array(F.lit(GAP)))))
    whole = rows.select(*by, F.coalesce(flat, none()).cast(small).alias("_flat"), F.lit(None).cast(CODES).alias("_x"))
    left = rows.select(*by, F.explode(F.filter("_each", lambda x: x["c"].isNull())).alias("x")).select(*by, "x.pos", "x.token")
    # A token's place in front of its codes.
    found = left.join(words, F.col("token") == F.col("_token"), "left").select(*by, F.lit(None).cast(small).alias("_flat"), F.concat(F.array("pos"), F.coalesce("_codes", none())).alias("_x"))
    got = whole.unionByName(found).groupBy(*by).agg(F.first("_flat", ignorenulls=True).cast(CODES).alias("_flat"), F.array_sort(F.collect_set("_x")).alias("_x"))
    got = got.withColumn("_found", F.transform("_x", lambda x: F.slice(x, 2, F.size(x))))
    got = got.withColumn("_ends", F.concat(F.array_compact(F.transform("_flat", lambda c, i: F.when(c == GAP, i))), F.array(F.size("_flat"))))

    def piece(end: Column, k: Column) -> Column:
        """The codes before the k-th gap, and what belongs into it."""
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("_ends", k - 1) + 1)
        return F.concat(F.slice("_flat", start + 1, end - start), F.coalesce(F.get("_found", k), none()))

    return got.select(*keys, F.flatten(F.transform("_ends", piece)).alias("codes"))
