"""Operators 11 to 13 against brute force, and their defined results for odd input."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from versejobs.llm import divergence, lexical, pieces, terms

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score long, term string, terms int, rank int, p int, value int, n int"
ODD = ["", " \t\n", "1 2 3", "İstanbul naïve 강 日本語 ½ 😀 don't", "a" * 3000 + " b", "<s> </s> <unk> ▁x▁▁y", "\x00\x01", "x" + " " * 500 + "y"]


@pytest.fixture(scope="module")
def rows():
    """A hot source, terms of all lengths that share beginnings, nulls, repeated rows and odd texts."""
    rng = random.Random(7)
    stems = ["a", "ab", "abcdef", "abcdefg", "abcdefghijkl", "abcdefghijklm", "강", "강강강", "straße", "İx", "über" * 9, "z" * 200]
    words = stems + [s + t for s in stems for t in ("s", "ing", "强")] + [f"rare{i}" for i in range(400)]
    out = []
    for i in range(420):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["big", "big", "s1", "s2", "s3", None])
        text = " ".join(rng.choice([str.upper, str, str.title])(rng.choice(words[: rng.choice([5, 20, len(words)])])) for _ in range(rng.randint(0, 40)))
        out.append((i, None if i % 50 == 7 else text, lang, source))
    out += [out[3], out[3], (None, "abcdef ab", "en", "big"), (None, "abcdef ab", "en", "big")]
    out += [(1000 + k, t, "odd", "s1") for k, t in enumerate(ODD)] + [(2000, "a", "one", "only"), (2001, None, "few", "x"), (2002, "", "few", "y")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "t", 2, 3, 4, 5, 6) for r in rows], DOCS).repartition(5).cache()


def audit_by_hand(rows, least, top=50):
    found, groups, held = {}, {}, {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = groups.setdefault(lang, {}).setdefault(source, {})
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        for t in w:
            own[t] = own.get(t, 0) + 1
        for t in set(w):
            held[lang, t] = held.get((lang, t), 0) + 1
    for lang, sources in groups.items():
        kept = {t for (k, t), n in held.items() if k == lang and n >= least}
        size = {s: sum(n for t, n in own.items() if t in kept) for s, own in sources.items()}
        all_n = {t: sum(own.get(t, 0) for own in sources.values()) for t in kept}

        def share(n, total):
            return 1 + 1000000000 * (n + 5) // (total + 5 * len(kept))

        for s, own in sources.items():
            pairs = [(sum(abs(share(own.get(t, 0), size[s]) - share(o.get(t, 0), size[x])) for t in kept), x) for x, o in sources.items() if x != s]
            over = [(share(own[t], size[s]) - share(all_n[t], sum(size.values())), t) for t in kept if own.get(t)]
            for part, items in (("pair", pairs), ("term", [x for x in over if x[0] > 0])):
                for k, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or k <= top:
                        found[lang, s, part, item] = (value, k)
    return found


@pytest.mark.parametrize("least, first, bits, top", [(30, 6, 1 << 25, 50), (3, 1, 1 << 10, 4), (2, 6, 32, 50), (1, 300, 1 << 12, 50), (10_000, 6, 1 << 25, 50)])
def test_divergence(docs, rows, least, first, bits, top):
    """Prefixes of one byte and longer than all terms, maps of bits that are full, no kept term at all."""
    got = divergence.audit(docs, least, top, first, bits).collect()
    assert {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in got} == audit_by_hand(rows, least, top) and len(got) == len(audit_by_hand(rows, least, top))


def test_divergence_many_groups(docs, rows, monkeypatch):
    """Where group sizes are too many to be sent to all tasks, and languages too many for a table of marks."""
    monkeypatch.setattr(divergence, "GROUPS", 0)
    got = divergence.audit(docs, 5).collect()
    assert {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in got} == audit_by_hand(rows, 5)


def test_divergence_of_nothing(spark, docs):
    assert divergence.audit(docs.limit(0)).count() == 0


def test_prefixes_leave_terms_out(docs):
    """Each level counts only terms whose prefix enough documents have."""
    own = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    stay = divergence.prefixes(own, 0, 4, None).where("docs >= 30 AND NOT whole").cache()
    found = divergence.marked(stay, 1 << 20)
    deeper = divergence.prefixes(own, 4, 8, found).collect()
    alive = {(r.lang, bytes(r.term)) for r in stay.collect()}
    assert alive and deeper and all((r.lang, bytes(r.term)[:4]) in alive for r in deeper)


def test_hashes_are_sparks(spark):
    words = ["", "a", "강", "x" * 40, "abcdefgh" * 5]
    table = spark.createDataFrame([(w, v.encode()) for w in ("", "en", "한국어" * 9) for v in words], "lang string, term binary")
    want = [r.h & (2**64 - 1) for r in table.select(F.xxhash64("lang", "term").alias("h")).collect()]
    langs = ["", "en", "한국어" * 9]
    assert divergence.hashes(langs, np.repeat(np.arange(3), 5), [v.encode() for _ in langs for v in words]).tolist() == want


def test_folded_terms(monkeypatch):
    texts = [None, "", "Ab 12-c", "  ", "é강 A", "x", None, "y z  ", "\x7fÀ"]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(terms, "SLICE", size)
        found = [(int(r), names[int(c)].as_py()) for rows, codes, names in terms.sliced(pa.array(texts), lexical.TABLE) for r, c in zip(rows, codes, strict=True)]
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(lexical.TERM, (t or "").translate(LOWER))]
        assert found == want
        assert terms.numbers(pa.array(texts), lexical.TABLE).tolist() == [sum(i == k for i, _ in want) for k in range(len(texts))]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces(docs, rows, library):
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((repr(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = pieces.encode(docs, MODEL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and dict(got.dtypes)["doc_id"] == "bigint"
    assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def test_pieces_round_trip(docs, library):
    ids = pieces.encode(docs.where("doc_id >= 1000"), MODEL, pieces.FULL)
    texts = {r.doc_id: r.text for r in pieces.decode(ids, MODEL).collect()}
    assert texts == {r.doc_id: r.decoded for r in ids.collect()} == {r.doc_id: library.decode(library.encode(r.text or "")) for r in docs.where("doc_id >= 1000").collect()}


def test_prefix_table(library):
    """Random texts, with characters that are no piece; each prefix's last token is that of its own encoding."""
    coder, rng = pieces.Pieces(MODEL), random.Random(1)
    for alphabet in ("abehilnorst", "ab ▁\n\t", "the quick 12 ÄéŒ日本한글😀\x00~<s>", " "):
        for _ in range(150):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
            assert coder.encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True)
    text = "▁international▁thoroughness"
    last = coder.table(text)
    for k in range(1, len(text) + 1):
        assert coder.texts[last[k][0]] == coder.merged(text[:k])[-1]
    long = "".join(rng.choice("abcdefghij") for _ in range(30_000))
    assert coder.encode(long).tolist() == library.encode(long, add_bos=True, add_eos=True)


def test_pair_compatibility():
    """By taking the latest merges apart, against merging both texts anew, and without room for memos."""
    coder, rng = pieces.Pieces(MODEL), random.Random(2)
    own = list(coder.inner)
    for _ in range(4000):
        a, b = rng.choice(own), rng.choice(own)
        assert coder.compatible(a, b) == (coder.merged(coder.texts[a] + coder.texts[b]) == [coder.texts[a], coder.texts[b]])
    coder.units.room = coder.fits.room = 0
    assert coder.encode("no room for anything").tolist() == coder.model.encode("no room for anything", add_bos=True, add_eos=True) and not coder.units


def ranked_by_hand(rows, items, k=10):
    words = [re.findall(lexical.TERM, (t or "").translate(LOWER)) for _, t, *_ in rows]
    n, total = sum(bool(w) for w in words), sum(map(len, words))
    df = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(re.findall(lexical.TERM, (t or "").translate(LOWER)))
    found = []
    for i, own in asked.items():
        scores = []
        for (doc, *_), w in zip(rows, words, strict=True):
            m = 10 + 90 * len(w) * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in own if t in w)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        found += [(repr(i), r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    words = ["a", "ab", "ABCDEF", "abcdefs", "강", "straße", "rare1", "rare2", "rare33", "z" * 200, "absent", "12", "b"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    return [*out, (5, "rare7 a"), (None, "ab rare9"), (100, None), (101, "absent"), (102, "")]


@pytest.mark.parametrize("at_once", [200_000, 30])
def test_lexical(spark, docs, rows, items, tmp_path, at_once):
    """Items sent to tasks at once and in blocks."""
    words = [re.findall(lexical.TERM, t or "") for _, t, *_ in rows]
    assert lexical.sized(docs) == (sum(map(bool, words)), sum(map(len, words)))
    lexical.write(docs, str(tmp_path / "index"))
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(spark, str(tmp_path / "index"), asked, terms=at_once).collect()
    assert sorted(((repr(r.item_id), r["rank"], r.doc_id, r.score) for r in got), key=repr) == ranked_by_hand(rows, items)


@pytest.mark.parametrize("documents, postings, block", [(7, 1 << 20, 4), (1 << 16, 40, 2), (1, 1, 1), (100, 300, 3)])
def test_lexical_in_small_shards(spark, docs, rows, items, tmp_path, monkeypatch, documents, postings, block):
    """Shards and blocks of few postings, built and searched in this process, where their sizes can be set."""
    for name, x in (("DOCUMENTS", documents), ("POSTINGS", postings), ("BLOCK", block)):
        monkeypatch.setattr(lexical, name, x)
    size = lexical.sized(docs)
    built = pa.Table.from_batches(list(lexical.built(docs.select("doc_id", "text").toArrow().to_batches(), size)))
    assert len(built) > 3
    built = built.append_column("all_docs", pa.array([size[0]] * len(built), pa.int64())).append_column("all_terms", pa.array([size[1]] * len(built), pa.int64()))
    pq.write_table(built, tmp_path / "shards.parquet")
    weights = lexical.weighed(spark, str(tmp_path), spark.createDataFrame(items, "item_id long, text string")).collect()
    words = sorted({t.term for r in weights for t in r.terms})
    asked = [(np.array([words.index(t.term) for t in r.terms], np.int64), np.array([t.w for t in r.terms], np.int64)) for r in weights]
    found: dict = {}
    for batch in built.to_batches(max_chunksize=2):  # each with heaps of its own, as tasks have
        for x in lexical.best_of_shards([batch], words, asked, [r.item_id for r in weights], 10):
            for r in x.to_pylist():
                found.setdefault(r["item_id"], []).append((-r["score"], r["doc_id"] is None, r["doc_id"] or 0))
    got = [(repr(i), k, None if null else d, -s) for i, own in found.items() for k, (s, null, d) in enumerate(sorted(own)[:10], 1)]
    assert sorted(got, key=repr) == ranked_by_hand(rows, items)


def test_lexical_of_nothing(spark, docs, items, tmp_path):
    lexical.write(docs.limit(0), str(tmp_path / "none"))
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(spark, str(tmp_path / "none"), asked).count() == 0
    lexical.write(docs, str(tmp_path / "some"))
    assert lexical.search(spark, str(tmp_path / "some"), asked.limit(0)).count() == 0
    named = spark.createDataFrame([("q", "ab rare1", 1)], "item_id string, text string, rank int")
    assert lexical.search(spark, str(tmp_path / "some"), named, k=3).count() == 3


def test_blocks_are_left_packed():
    """With a floor from the rarest term, most blocks of a frequent one are rejected by their maxima."""
    rng = np.random.default_rng(5)
    n = 20_000
    texts = ["often " * int(rng.integers(1, 4)) + "pad " * int(rng.integers(0, 200)) + ("seldom " * 30 if i % 997 == 0 else "") for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    size = (n, sum(len(t.split()) for t in texts))
    row = pa.Table.from_batches(list(lexical.built([batch], size))).append_column("all_docs", pa.array([size[0]])).append_column("all_terms", pa.array([size[1]]))
    shard = lexical.Shard({c: v if c in ("doc_ids", "lengths", "terms", "counts") else v.as_py() for c in row.column_names for v in [row.column(c)[0]]}, pa.array(["often", "seldom"]))
    docs, scores = lexical.best(shard, shard.list_of, np.array([5, 6000]), 1, 10)
    assert len(docs) >= 10 and shard.opened < 0.3 * len(shard.sizes)
    whole = np.zeros(n, np.int64)
    for w, x in ((5, 0), (6000, 1)):
        d, share = shard.open(np.arange(shard.lists[shard.list_of[x]], shard.lists[shard.list_of[x] + 1]))
        whole[d] += w * share
    assert sorted(scores)[-10:] == sorted(whole)[-10:]
