"""The pipeline's stages, each on its own input, and run() against plain Python; odd input for every stage."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from versejobs.llm import quality

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 1 << 63


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def last_if_none(doc_id):
    return LAST if doc_id is None else doc_id


def quality_by_hand(rows, ranking):
    return [r for r in rows if ranking.scores(np.array([quality.features(r[1])]))[0] >= quality.CUT]


def line_dedup_by_hand(rows):
    """Every chunk and every shortest long run of every document, by its text."""
    places = defaultdict(list)
    for doc_id, text in {(r[0], r[1]) for r in rows if r[1] is not None}:
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        start, spans = 0, set()
        for i in range(len(lines)):
            if i == len(lines) - 1 or i and (h[i - 1] * 31 + h[i]) % 3 == 0:
                if i > start:
                    spans.add(("chunk", start, i))
                start = i + 1
        sizes = [len(words(x)) for x in lines]
        for a in range(len(lines)):
            fits = [b for b in range(a, len(lines)) if sizes[a] and sum(sizes[a : b + 1]) > 50]
            spans |= {("run", a, b) for b in fits[:1]}
            fits = [b for b in range(a + 1) if sizes[a] and sum(sizes[b : a + 1]) > 50]
            spans |= {("run", b, a) for b in fits[-1:]}
        for kind, a, b in spans:
            places[kind, "\n".join(lines[a : b + 1])].append((last_if_none(doc_id), doc_id, text, a, b))
    lost = defaultdict(set)
    for found in places.values():
        owner = min(found)[0]
        for id_or_last, doc_id, text, a, b in found if len(found) > 1 else ():
            first = min(p[3] for p in found if p[1:3] == (doc_id, text))
            if id_or_last != owner or a > first:
                lost[doc_id, text] |= set(range(a, b + 1))
    out = []
    for doc_id, text, lang, source, n_chars in rows:
        if gone := lost.get((doc_id, text)):
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
            if not words(text):
                continue
            n_chars = len(text)
        out.append((doc_id, text, lang, source, n_chars))
    return out


def near_duplicates_by_hand(rows):
    def shingles(text):
        w = words((text or "").translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, top = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and top[i] != top[j]:
                old, new = top[i], top[j]
                top = [new if t == old else t for t in top]
    least = {}
    for r, t, s in zip(rows, top, sets, strict=True):
        if s and r[0] is not None:
            least[t] = min(least.get(t, r[0]), r[0])
    kept = {}
    for r, t, s in zip(rows, top, sets, strict=True):
        if (least.get(t) if s else r[0]) == r[0]:
            kept.setdefault(r[:2], r)
    return list(kept.values())


def mix_by_hand(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    weights = {s: 1.0 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    level = None
    while True:
        free = [s for s in sizes if level is None or 3.0 * sizes[s] > level * weights[s]]
        if not free:
            break
        risen = (sum(sizes.values()) - sum(3 * n for s, n in sizes.items() if s not in free)) / sum(weights[s] for s in free)
        if level is not None and risen <= level:
            break
        level = risen
    out = []
    for s, total in sizes.items():
        goal = min(3.0 * total, (level or 0.0) * weights[s])
        rate = goal / total if total else 0.0

        def alike(r):
            h = 42 if r[1] is None else xxhash.xxh64_intdigest(r[1].encode(), seed=42)
            parts = ["\x01" if x is None else str(x) for x in (r[0], r[3])] + [str(h - (1 << 64) if h >= 1 << 63 else h)]
            return hashlib.md5("\x00".join(parts).encode()).hexdigest()

        def taken(own, rate):
            for k in range(8):
                u = int(hashlib.md5(f"mix-1-{k}:{s or ''}".encode()).hexdigest()[:8], 16) / 2**32
                found = [math.floor((i + 1) * rate + u) - math.floor(i * rate + u) for i in range(len(own))]
                yield k, found, float(sum(c * len(words(r[1])) for c, r in zip(found, own, strict=True)))

        own = sorted((r for r in rows if r[3] == s), key=lambda r: (len(words(r[1])), last_if_none(r[0]), alike(r)))
        large, small = ([r for r in own if (len(words(r[1])) * 32 > goal) == big] for big in (True, False))
        rest = float(sum(len(words(r[1])) for r in small))

        def filled(w):
            return min(max(goal - w, 0.0), rest * 3.0)

        _, _, _, first, w = min((abs(goal - w - filled(w)), abs(goal - rest * rate - w), k, c, w) for k, c, w in taken(large, rate))
        _, _, second = min((abs(goal - w - v), k, c) for k, c, v in taken(small, filled(w) / rest if rest else 0.0))
        for r, c in [*zip(large, first, strict=True), *zip(small, second, strict=True)]:
            out += [r] * c
    return out


def bpe_by_hand(rows):
    from tokenizers import Tokenizer

    whole, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in rows:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), whole.decode(ids, skip_special_tokens=False))]
        out.append((r[0], len(ids), *sha))
    return out


BY_HAND = {"line_dedup": line_dedup_by_hand, "near_duplicates": near_duplicates_by_hand, "mix": mix_by_hand, "bpe": bpe_by_hand}


def planted():
    """Good and bad documents, copies, near copies, repeated lines and passages, nulls, ties, repeated rows, a very long text."""
    rng = np.random.default_rng(21)

    def sentence(n):
        return " ".join(f"{'kalo rem tin sola ved pir'.split()[k % 6]}{'bcdfgh'[k % 5]}{k % 97}".capitalize() if j == 0 else f"w{k}" for j, k in enumerate(rng.integers(0, 3000, n))) + "."

    passage = "\n".join(sentence(22) for _ in range(4))
    texts = ["\n".join(sentence(int(rng.integers(6, 30))) for _ in range(rng.integers(2, 9))) for _ in range(70)]
    for k in (3, 17, 30, 44):
        lines = texts[k].split("\n")
        texts[k] = "\n".join([*lines[:1], passage, *lines[1:]])
    texts[10] = texts[9]
    texts[12] = texts[11].replace("w1", "w1x", 1)
    texts[25] = "\n".join(texts[24].split("\n")[:2]) + "\n" + sentence(40)
    texts[26] = "same line\nsame line\nsame line\nsame line\nsame line\nsame line"
    texts += ["", None, " \n ", "@@@@ #### $$$$ %%%% 12 34 56", "\n".join(sentence(20) for _ in range(900))]
    rows = [(i, t, "en", [None, "a", "b", "b", "c"][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[6], "en", "a", 3), (None, None, None, None, None), (200, texts[8], "de", "c", 1)]
    labels = [(i, int(i % 9 != 0), 0) for i in range(70)]
    rows = [(*r[:1], r[1] if r[0] is None or r[0] >= 70 or r[0] % 9 else (r[1] + " !!! $$$ ### " * 9), *r[2:]) for r in rows]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("planted")
    rows, labels = planted()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def counted(rows):
    return Counter(map(repr, map(tuple, rows)))


def test_run_against_plain_python(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ranking = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~quality.held_out(F.col("doc_id"), 5, 0))
    sizes = [len(rows)]
    for name, stage in corpus_pipeline.STAGES:
        want = quality_by_hand(rows, ranking) if name == "quality" else BY_HAND[name](rows)
        kinds = SCHEMA if name != "quality" else docs.select(*corpus_pipeline.COLUMNS).schema
        got = stage(spark, spark.createDataFrame(rows, kinds).repartition(3), folder).collect()
        assert counted(got) == counted(want), name
        rows = want
        sizes.append(len(rows))
    assert sizes[1] < sizes[0] and sizes[3] < sizes[2]
    assert counted(corpus_pipeline.run(spark, folder).collect()) == counted(rows)


def test_lines_and_copies_go(spark, folder):
    """What was planted is caught by its stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r.doc_id: r.text for r in STAGES["line_dedup"](spark, docs, folder).collect() if r.doc_id is not None}
    passage = planted()[0][3][1].split("\n")[1:5]
    assert all(x in left[3] for x in passage) and not any(x in left[k] for k in (17, 30, 44) for x in passage)
    kept = {r.doc_id for r in STAGES["near_duplicates"](spark, docs, folder).collect()}
    assert 9 in kept | {10} and not {10, 12, 200} & kept and {0, 1, 2, 3, 11} <= kept


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_input(spark, folder, name):
    """Nulls, empty and very long texts, ties, repeated rows, further columns with names in use, and an empty table."""
    rows, _ = planted()
    more = [(*r, 0.5, 1, "x", [1], 7) for r in rows]
    clash = SCHEMA + ", score double, predicted int, key string, _lost array<int>, alike int"
    docs = spark.createDataFrame(more, clash)
    got = STAGES[name](spark, docs, folder)
    plain = STAGES[name](spark, docs.select(*corpus_pipeline.COLUMNS), folder)
    if name != "bpe":
        assert got.columns == list(corpus_pipeline.COLUMNS)
    assert counted(got.collect()) == counted(plain.collect())
    empty = STAGES[name](spark, docs.limit(0), folder)
    assert empty.columns == got.columns and empty.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_good_ones_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").join(docs, "doc_id")
    kept = STAGES["quality"](spark, docs, DATA)
    assert labels.join(kept.select("doc_id"), "doc_id", "left_anti").count() <= 0.03 * labels.count()
