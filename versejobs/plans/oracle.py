"""SQL for DuckDB that says what the registered queries return, made from the same fixed values."""

from ..functions import tables as T
from .views import COMPLETIONS_SQL, LEXICON_SQL, SONGS_SQL

SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def line_list(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"


def listed(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in values) + "]"


def mapped(table: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {listed(v) if isinstance(v, list) else v if isinstance(v, int) else repr(v)}" for k, v in table.items()) + "}"


def fill(template: str, x: str) -> str:
    return template.replace("{0}", x)


LINES_SQL = f"lines AS (SELECT song_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT song_id, {line_list('lyrics')} AS l FROM songs))"
CLEAN = f"list_filter({line_list('lyrics')}, lambda x: NOT (x LIKE '[%' AND x LIKE '%]' AND length(x) >= 2))"
TOKEN = "regexp_extract_all({}, '[가-힣]+|[A-Za-z]+')"
HANGUL = "list_transform(string_split({0}, ''), lambda c: ((((unicode(c) - 44032) % 588) // 28) * 32 + (unicode(c) - 44032) % 28)::INT)"
VOWEL_CODES, CODA_CODES = {k: T.VOWELS.index(v) for k, v in T.LETTER_VOWEL.items()}, {k: T.CODAS.index(v) for k, v in T.LETTER_CODA.items()}
#: A mark at the word's end makes a last consonant count as two.
LETTERS = (
    "list_transform(regexp_extract_all(lower({0}) || '#', '[aeiouy][^aeiouy]*'), lambda p: "
    f"({mapped(VOWEL_CODES)}[p[1]] * 32 + CASE WHEN length(p) >= 3 THEN coalesce({mapped(CODA_CODES)}[p[2]], 0) ELSE 0 END)::INT)"
)
STOP = "lower({0}) IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
CODES = f"CASE WHEN {{0}} >= '가' THEN {HANGUL} WHEN {STOP} THEN []::INT[] ELSE coalesce({mapped(T.OVERRIDE_CODES)}[lower({{0}})], {LETTERS}) END"


def coded(lines: str, keys: str, known: str = "") -> str:
    """tails (keys, codes, tail): codes of each line in `lines` (keys, line), and the last three, the last first."""
    codes = fill(CODES, "token")
    join = ""
    if known:
        codes = f"CASE WHEN NOT token >= '가' AND NOT {fill(STOP, 'token')} AND NOT map_contains({mapped(T.OVERRIDE_CODES)}, lower(token)) AND k.word IS NOT NULL THEN k.codes ELSE {codes} END"
        join = f"LEFT JOIN {known} k ON k.word = lower(token)"
    using = keys.replace("line_no", f"{lines}.line_no")
    return f"""tokens AS (SELECT {keys}, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT {keys}, {TOKEN.format('line')} AS t FROM {lines})),
coded AS (SELECT token, {codes} AS codes FROM (SELECT DISTINCT token FROM tokens) {join}),
joined AS (SELECT {keys}, flatten(list(codes ORDER BY pos)) AS codes FROM tokens JOIN coded USING (token) GROUP BY {keys}),
tails AS (SELECT {", ".join(f"{lines}.{k.strip()}" for k in keys.split(","))}, coalesce(codes, []::INT[]) AS codes, list_reverse(coalesce(codes, []::INT[]))[1:3] AS tail FROM {lines} LEFT JOIN joined USING ({keys}))"""


def syllable(a: str, b: str) -> str:
    va, vb, ca, cb = f"({a} // 32)", f"({b} // 32)", f"({a} % 32)", f"({b} % 32)"
    similar, group = listed(T.SIMILAR), listed(T.GROUP)
    return f"(CASE WHEN {va} = {vb} THEN 80 WHEN {similar}[{va} + 1] = {vb} THEN 64 ELSE 0 END + CASE WHEN {ca} = {cb} THEN 20 WHEN {ca} > 0 AND {cb} > 0 AND {group}[{ca} + 1] = {group}[{cb} + 1] THEN 14 ELSE 0 END)"


def tail_score(a: str, b: str) -> str:
    n = f"least(len({a}), len({b}))"
    total = " + ".join(f"CASE WHEN {n} > {k} THEN {syllable(f'{a}[{k + 1}]', f'{b}[{k + 1}]')} * {w} ELSE 0 END" for k, w in enumerate((10, 5, 3)))
    whole = f"(CASE {n} WHEN 1 THEN 10 WHEN 2 THEN 15 ELSE 18 END)"
    return f"(CASE WHEN {n} > 0 THEN (({total}) * 200 + {whole}) // (2 * {whole}) ELSE 0 END)"


def pairs(keys: str) -> str:
    """pairs (keys, line_no, score) from tails."""
    return f"""nexts AS (SELECT *, lead(tail) OVER (PARTITION BY {keys} ORDER BY line_no) AS following, lead(line_no) OVER (PARTITION BY {keys} ORDER BY line_no) AS more FROM tails),
pairs AS (SELECT {keys}, line_no, ({tail_score('tail', 'following')})::BIGINT AS score FROM nexts WHERE more IS NOT NULL)"""


SCORED = f"""{SONGS_SQL}, {LINES_SQL}, {coded('lines', 'song_id, line_no')}, {pairs('song_id')},
sums AS (SELECT song_id, sum(score) AS s, count(*) AS m FROM pairs GROUP BY song_id),
scored AS (SELECT songs.*, coalesce((2 * s + m) // (2 * m), 0)::BIGINT AS density FROM songs LEFT JOIN sums USING (song_id))"""
AUDIO = "'BPM: ' || printf('%.0f', bpm) || ' | 에너지: ' || printf('%.2f', energy) || ' | 댄서빌리티: ' || printf('%.2f', danceability) || ' | 라우드니스: ' || printf('%.1f', loudness) || 'dB | 밸런스: ' || printf('%.2f', valence)"


def chunk_list(k: int) -> str:
    extra = f"CASE WHEN len(l) % {k} >= {k // 2} AND l[-{k}:] <> l[(len(l) // {k} - 1) * {k} + 1:(len(l) // {k}) * {k}] THEN [l[-{k}:]] ELSE [] END"
    return f"CASE WHEN len(l) >= {k} THEN list_concat(list_transform(range(len(l) // {k}), lambda i: l[i * {k} + 1:(i + 1) * {k}]), {extra}) ELSE [] END"


SAMPLES = f"""{SONGS_SQL}, cleaned AS (SELECT *, {CLEAN} AS l FROM songs),
cut AS (SELECT *, list_concat(CASE WHEN len(l) >= 16 THEN {chunk_list(16)} ELSE [] END, {chunk_list(8)}) AS chunks FROM cleaned WHERE len(l) >= 8),
texts AS (SELECT song_id, list_transform(chunks, lambda c: '아티스트: ' || coalesce(artist, 'nan') || chr(10) || {AUDIO} || chr(10) || '[Verse ' || len(c) || '마디]' || chr(10) || array_to_string(c, chr(10)) || chr(10) || '[End]') AS t FROM cut),
each AS (SELECT song_id, unnest(range(len(t))) AS place, unnest(t) AS text FROM texts),
firsts AS (SELECT song_id, text, min(place) AS place FROM each GROUP BY song_id, text),
samples AS (SELECT song_id, (row_number() OVER (PARTITION BY song_id ORDER BY place) - 1)::INT AS pos, text FROM firsts)"""
PROMPTS = f"""{SCORED}, ranked AS (SELECT *, row_number() OVER (ORDER BY density DESC, song_id)::INT AS rank FROM scored QUALIFY rank <= 200),
prompts AS (SELECT rank, song_id, n_bars::INT AS n_bars, '아티스트: ' || coalesce(artist, 'nan') || chr(10) || {AUDIO} || chr(10) || '[Verse ' || n_bars || '마디]' || chr(10) AS prompt FROM ranked, (VALUES (8), (16)) b(n_bars))"""
VERSES = f"verses AS (SELECT conv_id, turn, prompt, completion, {line_list("string_split(completion, '[End]')[1]")} AS l FROM completions)"
REWARDS = f"""{COMPLETIONS_SQL}, {VERSES},
verse_lines AS (SELECT conv_id, turn, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM verses), {coded('verse_lines', 'conv_id, turn, line_no')}, {pairs('conv_id, turn')},
sums AS (SELECT conv_id, turn, sum(score) AS s, count(*) AS m FROM pairs GROUP BY conv_id, turn),
changes AS (SELECT conv_id, turn, line_no, CASE WHEN line = lag(line) OVER w THEN 0 ELSE 1 END AS new FROM verse_lines WINDOW w AS (PARTITION BY conv_id, turn ORDER BY line_no)),
islands AS (SELECT conv_id, turn, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY line_no) AS island FROM changes),
runs AS (SELECT conv_id, turn, max(n) AS max_run FROM (SELECT conv_id, turn, island, count(*) AS n FROM islands GROUP BY ALL) GROUP BY conv_id, turn),
parts AS (SELECT v.conv_id, v.turn, len(l)::INT AS n_lines, coalesce(try_cast(nullif(regexp_extract(prompt, '\\[Verse\\s+(\\d+)\\s*마디\\]', 1), '') AS INT), 8) AS target,
  coalesce(s::DOUBLE / (m * 10000)::DOUBLE, 0) AS rhyme, CASE WHEN contains(completion, '[End]') THEN 1::DOUBLE ELSE 0::DOUBLE END AS format_ok,
  CASE WHEN len(l) > 0 THEN 1::DOUBLE - len(list_distinct(l))::DOUBLE / len(l)::DOUBLE ELSE 1::DOUBLE END AS dup_ratio, coalesce(max_run, 0)::INT AS max_run
  FROM verses v LEFT JOIN sums USING (conv_id, turn) LEFT JOIN runs USING (conv_id, turn)),
judged AS (SELECT *, greatest(0::DOUBLE, 1::DOUBLE - abs(n_lines - target)::DOUBLE / target::DOUBLE) AS length_score,
  CASE WHEN n_lines > 0 THEN greatest(0::DOUBLE, (max_run - 1)::DOUBLE / greatest(1, n_lines - 1)::DOUBLE) ELSE 1::DOUBLE END AS run_penalty FROM parts),
rewarded AS (SELECT *, 0.5::DOUBLE * (rhyme * (1::DOUBLE - dup_ratio)) + 0.2::DOUBLE * length_score + 0.2::DOUBLE * format_ok - 0.4::DOUBLE * dup_ratio - 0.4::DOUBLE * run_penalty AS raw FROM judged),
rewards AS (SELECT * EXCLUDE raw, CASE WHEN dup_ratio >= 0.6::DOUBLE OR max_run >= 3 THEN least(raw, 0::DOUBLE) ELSE raw END AS reward FROM rewarded)"""


def mined(word: str = "[a-z]+(?:''[a-z]+)*", ends: str = "token") -> str:
    """counts and found: words by occurrences; a line ends in its last token of any kind, or in its last English word."""
    tokens = f"[가-힣]+|{word}" if ends == "token" else word
    return f"""{SONGS_SQL}, {LINES_SQL}, mined AS (SELECT regexp_extract_all(lower(line), '{tokens}') AS w FROM lines),
spread AS (SELECT unnest(w) AS word, unnest(range(1, len(w) + 1)) = len(w) AS at_end FROM mined),
counts AS (SELECT word, count(*) AS total_count, count(*) FILTER (at_end) AS line_end_count FROM spread WHERE word < '가' AND NOT {fill(STOP, 'word')} GROUP BY word),
found AS (SELECT * FROM counts ORDER BY line_end_count DESC, total_count DESC, word LIMIT 500)"""


MINED = mined()
SPREAD = f"""{SCORED}, s AS (SELECT density::DOUBLE / 10000::DOUBLE AS density, old_score::DOUBLE / 10000::DOUBLE AS old, (density - old_score)::DOUBLE / 10000::DOUBLE AS delta FROM scored),
spread AS (SELECT {", ".join(f"count({c}) AS {c}_n, avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in ("density", "old", "delta"))}, median(density) AS density_median, median(old) AS old_median FROM s)"""
GIVEN = "word IN (" + ", ".join(f"'{w}'" for w in T.OVERRIDES) + ")"

# Pronunciations, phone by phone: each vowel with what follows up to the next one. What a phone stands for is joined once.
PHONES = "(VALUES " + ", ".join(
    f"('{p}', " + ", ".join(str(t.index(m[p])) if p in m else "NULL" for m, t in ((T.PHONE_VOWEL, T.VOWELS), (T.PHONE_ONSET, T.ONSETS), (T.PHONE_LOAN_CODA, T.CODAS), (T.PHONE_CODA, T.CODAS))) + ")"
    for p in [*T.PHONE_VOWEL, *T.PHONE_ONSET]
) + ") AS signs(p, v, o, lc, sc)"
SPOKEN = f"""{LEXICON_SQL}, split AS (SELECT word, string_split(regexp_replace(phones, '[0-9]', '', 'g'), ' ') AS ph FROM lexicon),
phoned AS (SELECT word, i, signs.* FROM (SELECT word, unnest(ph) AS p, unnest(range(len(ph))) AS i FROM split) JOIN {PHONES} USING (p)),
listed AS (SELECT word, list(p ORDER BY i) AS ph, list(o ORDER BY i) AS os, list(lc ORDER BY i) AS lcs, list(sc ORDER BY i) AS scs FROM phoned GROUP BY word),
nuclei AS (SELECT word, p, v, i, lag(i) OVER w AS before, lead(i) OVER w AS next FROM phoned WHERE v IS NOT NULL WINDOW w AS (PARTITION BY word ORDER BY i)),
trailed AS (SELECT *, coalesce(next, len(ph)) - i - 1 AS n, CASE WHEN before IS NULL THEN CASE WHEN i > 0 THEN os[1] END WHEN before + 1 < i THEN os[i] END AS lead_onset FROM nuclei JOIN listed USING (word)),
closed AS (SELECT *, n >= 2 OR (next IS NULL AND n >= 1) AS shut FROM trailed),
pieces AS (SELECT word, i, 0 AS j, coalesce(lead_onset, 11) AS o, CASE WHEN p = 'AH' AND n = 1 AND ph[i + 2] = 'L' THEN 18 ELSE v END AS v, CASE WHEN shut THEN coalesce(lcs[i + 2], 0) ELSE 0 END AS c,
  v AS sv, CASE WHEN shut THEN coalesce(scs[i + 2], 0) ELSE 0 END AS sc FROM closed
  UNION ALL SELECT t.word, t.i, f.i - t.i - 1, f.o, CASE WHEN f.p IN ('CH', 'JH', 'Y') THEN 20 ELSE 18 END, 0, NULL, NULL FROM closed t JOIN phoned f ON t.word = f.word AND f.i > t.i + 1 WHERE t.next IS NULL AND f.o IS NOT NULL),
spoken AS (SELECT word, string_agg(chr((44032 + (o * 21 + v) * 28 + c)::INT), '' ORDER BY i, j) AS loanword, list((v * 32 + c)::INT ORDER BY i, j) AS codes, list((sv * 32 + sc)::INT ORDER BY i) FILTER (sv IS NOT NULL) AS simple_codes FROM pieces GROUP BY word),
known AS (SELECT l.word, coalesce(codes, []::INT[]) AS codes FROM lexicon l LEFT JOIN spoken USING (word) WHERE length(l.word) % 5 <> 0)"""
