"""The operators for training data against brute force, and their defined results for odd input."""

import collections
import hashlib
import itertools
import pickle
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from versejobs.llm import ann, bpe, images, jaccard, licenses, line_dedup, mixing, quality, token_files, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, count long, part int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = " ".join(f"w{i}" for i in range(120))
NEAR = BASE.replace("w7 ", "x ")
LONG = " ".join(f"z{i % 5000}" for i in range(60_000))


def texts():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, odd characters."""
    rows = [(1, BASE), (2, NEAR), (3, BASE), (3, BASE), (4, None), (5, ""), (6, " \t\n"), (7, LONG), (8, "one two"), (9, "One TWO"), (10, BASE + " " + BASE), (None, NEAR), (11, "a\nb\nc\nd\ne\nf"), (12, "q\na\nb\nc\nd\ne\nf")]
    rows += [(13, "Released under the MIT License. mit license"), (14, "İstanbul <|endoftext|> 　don't 12 ñ́ 😀"), (15, "the GNU General Public License, general public license general public license")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """With further columns whose names the operators use themselves."""
    rows = [(i, t, "en", None if i is None else "ab"[i % 2], None if t is None else len(t), 0.5, 1, 2) for i, t in texts()]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_text(found, *columns):
    return sorted((repr(r.doc_id), *[repr(getattr(r, c)) for c in columns]) for r in found)


def test_jaccard(spark, docs, empty):
    def shingles(text):
        w = words((text or "").translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    rows = [(i, shingles(t)) for i, t in texts()]
    rng = np.random.default_rng(1)
    base = [f"v{k}" for k in range(200)]
    for i in range(100, 180):  # many copies with a few edits each, linked in chains or not at all
        w = list(base)
        for k in rng.integers(0, 200, rng.integers(0, 9)):
            w[k] = f"e{i}-{k}"
        rows.append((i, " ".join(w)))
    more = docs.unionByName(spark.createDataFrame([r for r in rows if r[0] and r[0] >= 100], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(i, x if isinstance(x, set) else shingles(x)) for i, x in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                top[find(i)] = find(j)
    want = []
    for i, (doc_id, s) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if find(j) == find(i) and d is not None]
        want.append((repr(doc_id), repr(len(s)), repr(min(ids) if ids else None)))
    assert by_text(jaccard.join(more).collect(), "n_shingles", "component_id") == sorted(want)
    assert jaccard.join(empty).count() == 0


def test_jaccard_small_map(docs):
    """A full map of repeated shingles changes the work, not the result."""
    small = by_text(jaccard.join(docs, map_bits=1 << 12).collect(), "component_id")
    assert small == by_text(jaccard.join(docs).collect(), "component_id")


def test_jaccard_map_is_small_for_a_small_table(docs):
    """The driver gets the map of repeated shingles compressed, as do the workers, who open it."""
    order = jaccard.ordered(docs)
    assert sum(map(len, order.slices)) < 1 << 18 and "bits" not in vars(order)
    opened = pickle.loads(pickle.dumps(order)).bits
    assert len(opened) == jaccard.MAP_BITS // 8 and 0 < np.count_nonzero(opened) < 10_000


def test_jaccard_members_are_kept_once(docs, monkeypatch):
    """The shingles of a set are written to one place, once, without those that no other set has."""
    kept, cut = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    jaccard.join(docs)
    (sets,) = [x for x in kept if "members" in x.columns]
    rows = sets.collect()
    assert 0 < len(rows) == len({bytes(r["key"]) for r in rows})
    assert all(len(r.members) <= 8 * r.n for r in rows) and any(len(r.members) < 8 * r.n for r in rows)


def test_jaccard_parts_ask_themselves(spark):
    """A part's members are held against each other without being sent to it again, whether or not others ask it."""
    words = [np.sort(np.random.default_rng(k).integers(0, 1 << 63, 100, dtype=np.uint64)) for k in range(3)]
    near = [np.sort(np.concatenate([w[:95], x])) for w, x in zip(words, [np.arange(5, dtype=np.uint64)] * 3, strict=True)]
    keys = [bytes([k]) for k in range(6)]
    sets = spark.createDataFrame([(k, 100, s.tobytes()) for k, s in zip(keys, words + near, strict=True)], "key binary, n long, members binary")
    part = "struct<g:binary,pure:boolean,sub:int>"
    rows = [((b"x", False, 0), 0, own, k, k) for own, k in [(True, keys[0]), (True, keys[3]), (True, keys[1])]] + [((b"y", False, 0), 0, False, k, k) for k in (keys[2], keys[5])]
    groups = spark.createDataFrame(rows, f"part {part}, salt int, own boolean, key binary, root binary")
    queries = spark.createDataFrame([((b"x", False, 0), 0, keys[4], keys[4])], f"part {part}, salt int, key binary, root binary")
    got = [{tuple(sorted((bytes(r.a), bytes(r.b)))) for r in jaccard.opened(groups, x, sets).collect()} for x in (queries, queries.limit(0))]
    assert got == [{(keys[0], keys[3]), (keys[1], keys[4])}, {(keys[0], keys[3])}]


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, t in texts():
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want.append((repr(i), repr(len(ids)), repr(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), repr(hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest())))
    assert by_text(bpe.encode(docs, TOKENIZER).collect(), "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)
    assert bpe.encode(empty, TOKENIZER).count() == 0


def test_bpe_with_blanks_in_tokens(docs):
    """A tokenizer whose tokens take in white space is encoded by whole texts and repaired joins."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    some = docs.where("doc_id IN (1, 2, 10, 11, 12, 14)")
    for r in bpe.encode(some, path, bpe.full).collect():
        text = dict(texts())[r.doc_id]
        assert list(r.token_ids) == whole.encode(text, add_special_tokens=False).ids
        assert r.decoded == whole.decode(r.token_ids, skip_special_tokens=False)


def test_joins_are_repaired():
    """Texts cut anywhere are put together again, from windows of few words."""
    from versejobs.llm import tokens

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder, rng, widths = tokens.Encoder(public_tokenizers.path(name)), np.random.default_rng(2), []
        for _ in range(400):
            text = " ".join(rng.choice(["the", "a  b", "\n\n", "x\n", "   ", "don't", "12345", "é ü", "日本語", "q" * 300, "bar ", " \n "], rng.integers(2, 60)))
            k = int(rng.integers(1, len(text)))
            ids, words = bpe.repaired(coder, text[:k], text[k:], *coder.whole([text[:k], text[k:]]))
            assert ids == coder.whole([text])[0]
            widths.append(words)
        assert sum(w > 0 for w in widths) > 100 and max(widths) <= 8
        pieces = [LONG[i : i + 997] for i in range(0, 20_000, 997)]
        pieces[-1] = pieces[-1][: 20_000 - 997 * 20]
        assert bpe.rejoined(coder, list(zip(pieces, coder.whole(pieces), strict=True))) == coder.whole([LONG[:20_000]])[0]


def test_repairs_encode_windows_alone():
    """A text with one bad join keeps the ids of its pieces but for a window beside it."""
    from versejobs.llm import tokens

    class Counting:
        def __init__(self, coder):
            self.coder, self.most = coder, 0

        def whole(self, some):
            self.most = max(self.most, *map(len, some))
            return self.coder.whole(some)

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder = tokens.Encoder(public_tokenizers.path(name))
        text = " ".join(f"word{i % 997}" for i in range(9_000))
        k = text.index("word500") + 3
        cuts = [0, text.index(" ", 1_000), k, text.index(" ", 30_000), len(text)]
        pieces = [text[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        counting = Counting(coder)
        assert bpe.rejoined(counting, list(zip(pieces, coder.whole(pieces), strict=True))) == coder.whole([text])[0]
        assert 0 < counting.most < 100


def test_bpe_joins_cut_anywhere(spark, docs):
    """Chunks cut within words: documents whose joins differ are repaired from the ids of shared and of their own pieces."""
    from tokenizers import Tokenizer

    def cutter(some):
        return [[t[i : i + 41] for i in range(0, len(t), 41)] for t in some]

    rows = [(i, t) for i, t in texts() if i != 7] + [(20, BASE[:410] + " of its own"), (21, LONG[:2_000]), (22, LONG[:1_640] + "é 日本語 " * 30)]
    rows = rows * 2
    some = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        found = bpe.encode(some, path, bpe.full, cutter).collect()
        want = [(repr(i), repr(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
        assert by_text(found, "token_ids") == sorted(want)


def test_runs_by_hand(spark):
    """Ends of runs with any white space, lines without words, and lines of many words."""
    rng, rows = np.random.default_rng(4), [(0, None), (1, ""), (2, "\n \n\t"), (3, "w " * 51), (4, "w " * 50), (5, "w " * 60 + "\n" + "v " * 60)]
    gaps = [" ", " ", " ", "  ", "\t", "\r", "\x0b ", "\x0c"]
    for i in range(10, 40):
        lines = []
        for n in rng.integers(0, rng.choice([4, 30, 120]), 40):
            line = "".join(f"é{k}" + str(rng.choice(gaps)) for k in range(n))
            lines.append(str(rng.choice(["", " ", "\t"])) + (line if rng.random() < 0.5 else line[:-1]))
        rows.append((i, "\n".join(lines)))
    want = set()
    for i, text in rows:
        of = [k for k, line in enumerate((text or "").split("\n")) for _ in words(line)]
        for p in range(len(of)):
            if (p == 0 or of[p - 1] != of[p]) and p + 50 < len(of):
                want.add((i, of[p], of[p + 50] - of[p] + 1))
            if (p + 1 == len(of) or of[p + 1] != of[p]) and p >= 50:
                want.add((i, of[p - 50], of[p] - of[p - 50] + 1))
    found = [(r.doc_id, r["first"], r["n"]) for r in line_dedup.runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 500


def test_chunks_shift():
    a = " ".join(f"{hashlib.md5(str(i).encode()).hexdigest()[:5]}" for i in range(4000))
    one, two = bpe.chunked([a, "new words first " + a])
    assert "".join(one) == a and len(set(one) & set(two)) > 0.9 * len(one)


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    got = token_files.encode(docs, TOKENIZER).orderBy("start").collect()
    order = sorted({i for i, _ in texts() if i is not None})
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in texts() if i is not None)
    assert got[-1].doc_id is None and {r.doc_id for r in got} == {*order, None}
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        sums = [zlib.crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in texts() if i == r.doc_id]
        assert r.ids_crc32 in sums
    assert token_files.encode(empty, TOKENIZER).count() == 0


def test_token_files_seek(spark, docs, tmp_path):
    """Documents by the block index, in segments that hold several and many blocks."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    token_files.write(docs, TOKENIZER, str(tmp_path / "t"))
    wanted = spark.createDataFrame([(1,), (3,), (7,), (10,), (14,), (14,), (77,), (None,)], "doc_id long")
    got = sorted((r.doc_id, list(r.token_ids)) for r in token_files.fetch(spark, str(tmp_path / "t"), wanted).collect())
    assert got == sorted((i, [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts() if i in (1, 3, 7, 10, 14))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2**32 - 1])
def test_blocks(n, top):
    x = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(x)) == x).all()
    x[::50] = top - 1
    packed = token_files.pack(x)
    assert (token_files.unpack(packed) == x).all()
    for a, b in ((0, n), (n // 3, n // 2), (127, 129), (n - 1, n), (n, n + 5)):
        assert (token_files.unpack(packed, a, b) == x[a:b]).all()


def test_line_dedup(docs, empty):
    got = {(r.doc_id, r.text): r for r in line_dedup.dedup(docs.select("doc_id", "text", "part"), divisor=1, long=None).collect()}
    assert len(got) >= 14 and empty.count() == 0 == line_dedup.dedup(empty).count()
    assert {r.n_lines for r in got.values() if r.doc_id == 4} == {0} and {r.text for r in got.values() if r.doc_id == 4} == {None}


def test_line_dedup_moves(spark):
    block = "\n".join(f"line {i} of a passage" for i in range(40))
    rows = [(1, block), (2, "own start\n" + block + "\nown end"), (3, "a\nb"), (4, None), (5, "")]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), long=None).collect()}
    assert got[1].text == block and got[1].removed_lines == 0
    assert got[2].removed_lines > 20 and got[2].text.startswith("own start") and got[2].text.endswith("own end")
    assert got[2].n_lines == 42 and got[3].text == "a\nb" and got[4].text is None and got[5].text == ""


def without_passages(rows):
    """Lines left of each text when every run of lines with over 50 words that stands earlier is gone, by comparing all runs."""
    lines = {i: t.split("\n") for i, t in rows}
    seen, lost = {}, {i: set() for i in lines}
    for i, own in sorted(lines.items()):
        for a in range(len(own)):
            for b in range(a, len(own)):
                if own[a].split() and own[b].split() and len(words("\n".join(own[a : b + 1]))) > 50:
                    if seen.setdefault("\n".join(own[a : b + 1]), (i, a)) != (i, a):
                        lost[i] |= set(range(a, b + 1))
    return {i: [x for k, x in enumerate(own) if k not in lost[i]] for i, own in lines.items()}


def test_passages(spark, docs, empty):
    rng = np.random.default_rng(6)
    pool = [" ".join(f"p{k}-{j}" for j in range(rng.integers(8, 40))) for k in range(30)] + [" ".join(f"s{j}" for j in range(70)), ""]
    rows = []
    for i in range(40):
        own = [f"only {i} {j}" for j in range(12)]
        for _ in range(2):  # one to five neighbouring lines of the pool, anywhere
            k, at = rng.integers(0, len(pool) - 4), rng.integers(0, len(own))
            own[at:at] = pool[k : k + rng.integers(1, 6)]
        rows.append((i, "\n".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = without_passages(rows)
    got = {r.doc_id: r for r in line_dedup.dedup(table).collect()}
    old = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup(table, long=None).collect()}
    gone = {i: [x for x in t.split("\n") if x not in want[i]] for i, t in rows}
    assert sum(map(len, gone.values())) > 60
    assert any(x in old[i] for i in gone for x in gone[i])  # chunks alone leave some of them
    for i, t in rows:
        left = got[i].text.split("\n")
        assert not [x for x in gone[i] if x in left]
        assert got[i].removed_lines == len(t.split("\n")) - len(left) and {x for x in t.split("\n") if x.startswith("only")} <= set(left)
    assert all(any(x in r.text.split("\n") for r in got.values()) for _, t in rows for x in t.split("\n"))
    clash = {c: F.lit(k) for k, c in enumerate(["lost", "_lost", "lines", "h", "id", "spans", "_spans", "_gone_id", "_text_h", "places", "key", "owner"])}
    wide = line_dedup.dedup(docs.select("doc_id", "text").withColumns(clash))
    assert wide.columns == ["doc_id", "text", *clash, "n_lines", "removed_lines"] and {tuple(r)[2:14] for r in wide.collect()} == {tuple(range(12))}
    odd = line_dedup.dedup(docs.select("doc_id", "text", "part")).collect()
    assert len(odd) == len(texts()) and {r.n_lines for r in odd if r.doc_id == 4} == {0} and line_dedup.dedup(empty).count() == 0


def test_one_chunk_in_every_document(spark):
    """A chunk and a run that stand everywhere stay at their first place alone, also where their keys aren't sent to all tasks."""
    block = "\n".join(f"line {i} of what all have " + "w " * 20 for i in range(12))
    rows = [(i, f"own start {i}\n{block}\nown end {i}\n" + (block if i % 50 == 0 else "")) for i in range(400)] + [(None, block), (7, block)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = line_dedup.dedup(table).collect()
    got = {r.doc_id: r for r in found if r.doc_id not in (None, 7)}
    assert got[0].removed_lines == 12 and all(got[i].removed_lines >= 12 and got[i].text.split("\n")[0] == f"own start {i}" for i in got if i)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        again = line_dedup.dedup(table).collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, map(tuple, found)))


def test_passages_sql(spark):
    import duckdb
    from versejobs.llm import queries

    path = "/root/testdata/sf0.001/documents.parquet"
    want = duckdb.sql(queries.OP8_SQL.replace("FROM documents", f"FROM '{path}'")).fetchall()
    got = line_dedup.dedup(spark.read.parquet(path).select("doc_id", "text")).select("doc_id", "n_lines", "removed_lines", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r.removed_lines for r in got)


def test_mixing(spark, docs, empty):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), "big" if i % 3 else f"s{i % 7}") for i in range(3000)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.copies(many).toPandas()
    assert plan.copies.max() <= 3 and plan.copies.min() >= 0 and len(plan) == 3000
    taken = (plan.copies * plan["size"]).groupby(plan.source).sum()
    for source, goal in plan.groupby("source").target.first().items():
        assert abs(taken[source] - goal) <= 12
        assert goal <= 3 * plan.source_size[plan.source == source].iloc[0] + 1e-6
    assert abs(plan.groupby("source").target.first().sum() - plan["size"].sum()) < 1e-3
    assert mixing.mix(many).count() == plan.copies.sum()
    again = mixing.copies(many.repartition(7)).toPandas()
    assert again.sort_values("doc_id").copies.tolist() == plan.sort_values("doc_id").copies.tolist()
    odd = mixing.copies(docs)
    assert odd.count() == docs.count() and mixing.copies(empty).count() == 0 == mixing.mix(empty).count()
    names = ["_alike", "alike", "copy", "_copy", "_n", "copy_plan", "size", "key", "_of", "row_no"]
    wide = mixing.mix(docs.withColumns({c: F.lit(k) for k, c in enumerate(names)}))
    assert wide.columns == [*docs.columns, *names] and {tuple(r)[-10:] for r in wide.collect()} == {tuple(range(10))}
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == odd.agg(F.sum("copies")).first()[0]


def test_licenses(docs, empty):
    phrases = [(p.split(), label) for p, label in licenses.BASE]
    want = []
    for i, t in texts():
        w = re.findall(licenses.WORD, (t or "").translate(LOWER))
        places = [(k, label) for p, label in phrases for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        starts = [k for k, _ in places]
        want.append(tuple(map(repr, (i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))))
    got = licenses.scan(docs).collect()
    assert by_text(got, "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} for r in got)
    assert licenses.scan(empty).count() == 0


def test_license_span_with_a_gap(spark):
    text = "x y redistribution and use in source and in binary forms with or without modification are permitted z"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "bsd" and row.n_base == 0 and row.spans[0].first_word == 2


def labels_by_hand(text):
    """Labels and score by trying each template at each diagonal, one after another."""
    w = re.findall(licenses.WORD, (text or "").translate(LOWER))
    labels, score = set(), 0.0
    for phrase, label in licenses.BASE:
        p = phrase.split()
        if any(w[k : k + len(p)] == p for k in range(len(w) - len(p) + 1)):
            labels.add(label)
            score = 1.0
    for notice, label in licenses.NOTICES:
        t = notice.split()
        n = len(t) - 2
        lines = {}
        for k in range(len(w) - 2):
            for at in range(n):
                if w[k : k + 3] == t[at : at + 3]:
                    lines.setdefault(k - at, []).append((k, at))
        spans, last = [], None
        for first, d, hits in sorted((min(h)[0], d, h) for d, h in lines.items()):
            if last is None or abs(d - last[0]) > licenses.NEAR or first - last[1] > n:
                spans.append([])
            spans[-1] += hits
            last = (d, max(hits)[0])
        for hits in spans:
            cover, size = len({at for _, at in hits}) / n, max(hits)[0] + 2 - min(hits)[0] + 1
            if cover >= licenses.COVER and size <= licenses.STRETCH * len(t):
                labels.add(label)
                score = max(score, cover)
    return ",".join(sorted(labels)), score


def test_license_labels_by_hand(spark, docs):
    rng = np.random.default_rng(31)
    rows = []
    for i in range(120):
        w = [f"f{k}" for k in rng.integers(0, 50, 30)]
        for _ in range(rng.integers(0, 3)):
            t = licenses.NOTICES[rng.integers(0, len(licenses.NOTICES))][0].split()
            for _ in range(rng.integers(0, 3)):  # words left out, added and changed
                k = rng.integers(0, len(t))
                t[k : k + rng.integers(0, 2)] = [["new"], [], [t[0].upper()]][rng.integers(0, 3)]
            at = rng.integers(0, len(w))
            w[at:at] = t
        rows.append((1000 + i, " ".join(w)))
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((repr(r.doc_id), r.labels, round(r.score, 9)) for r in licenses.scan(some).collect())
    want = sorted((repr(i), labels_by_hand(t)[0], round(labels_by_hand(t)[1], 9)) for i, t in [*texts(), *rows])
    assert got == want and len({x[1] for x in want}) > 8


def labelled(spark, bad, n=160):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(n):
        w = [f"{'abcdefgh'[k % 8]}{k}" for k in rng.integers(0, 400, 60)]
        y = int(i % 4 == 0)
        rows.append((i, bad(w, y, rng)))
        labels.append((i, 1 - y, y))
    labels += [(9999, 1, 1), (None, 0, 0), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, docs, empty):
    found, labels = labelled(spark, lambda w, y, _: " ".join(x.upper() + "!!" if y else x for x in w))
    held = quality.held_out(F.col("doc_id"), 5, 0)
    got = quality.scored(found, quality.fit(found, labels, ~held)).where(held).join(labels, "doc_id").where("quality IS NOT NULL").collect()
    assert got and all(r.predicted == r.quality for r in got)
    blank = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.scored(docs, blank).collect()} == {0.5}
    assert quality.scored(docs.withColumn("predicted", F.lit("x")), blank).columns == [*docs.columns, "predicted"]
    assert quality.scored(empty, blank).count() == 0
    one_label = labels.where("quality = 1")
    assert {r.score for r in quality.scored(docs, quality.fit(found, one_label, F.lit(True))).collect()} == {0.5}


def shape_by_hand(text):
    """The features of a text, each character looked at by itself."""
    if not text:
        return [0.0] * quality.FEATURES
    raw, w, lines = list(text.encode()), text.split(), [x for x in text.split("\n") if x.strip()]
    size, many = len(raw), max(1, len(w))

    def n(chars):
        return sum(b in {ord(c) for c in chars} for b in raw)

    upper, lower, digits, wide = sum(65 <= b < 91 for b in raw), sum(97 <= b < 123 for b in raw), n("0123456789"), sum(b > 127 for b in raw)
    marks = sum(33 <= b < 128 for b in raw) - upper - lower - digits - n(",.")
    shares = [upper / size, digits / size, wide / size, n(",.") / many, marks / many, n("!") / many, n("#$%&*") / many, n("\n") / many, sum(a == b for a, b in zip(w, w[1:], strict=False)) / many,
              1 - len({*w}) / many, 1 - len({*lines}) / max(1, len(lines)), n("<>{}/_") / many, n("()") / many, n("\t") / many]
    return shares + [max(0.0, x) ** 0.5 for x in shares]


def test_quality_by_hand(spark, docs):
    """Scores from the fitted weights one by one; the weights are where the pairwise loss has no slope; the cut is the quantile."""
    found, labels = labelled(spark, lambda w, y, rng: " ".join(x.upper() + "!" if y and rng.random() < 0.7 else x for x in w))
    ranking = quality.fit(found, labels, F.lit(True))
    for r in quality.scored(docs.unionByName(found, allowMissingColumns=True), ranking).select("text", "score", "predicted").collect():
        even = [min(8, max(-8, (x - m) / s)) for x, m, s in zip(shape_by_hand(r.text), ranking.mean, ranking.scale, strict=True)]
        raw = sum(a * b for a, b in zip(even, ranking.weight, strict=True))
        want = 1 / (1 + np.exp(-np.clip(ranking.steep * (raw - ranking.shift) + np.log(3 / 7), -500, 500)))
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.3)
    got = quality.scored(found, ranking).join(labels.where("quality IS NOT NULL"), "doc_id").collect()
    low = sum(r.predicted == 0 for r in got) / len(got)
    assert abs(low - sum(r.quality == 0 for r in got) / len(got)) <= 0.02


def test_quality_has_no_slope(spark):
    """At the fitted weights the pairwise logistic loss with its ridge has no slope, and any step away makes it larger."""
    rng = np.random.default_rng(6)
    low, high = rng.normal(0, 1, (60, quality.FEATURES)), rng.normal(0.4, 1.2, (90, quality.FEATURES))
    ranking = quality.Ranking(low, high, 0.4)
    both = np.vstack([low, high])
    a, b = (np.clip((x - both.mean(axis=0)) / (both.std(axis=0) + 1e-6), -8, 8) for x in (low, high))
    d = b[np.random.default_rng(7).integers(0, len(b), len(a) * quality.PAIRS)] - np.repeat(a, quality.PAIRS, axis=0)

    def loss(w):
        return np.logaddexp(0, -(d @ w)).sum() + 0.5e-3 * len(d) * (w**2).sum()

    for k in range(quality.FEATURES):
        step = np.zeros(quality.FEATURES)
        step[k] = 1e-4
        slope = (loss(ranking.weight + step) - loss(ranking.weight - step)) / 2e-4
        assert abs(slope) < 1e-3 * len(d) ** 0.5
    assert all(loss(ranking.weight + 0.1 * rng.normal(size=quality.FEATURES)) > loss(ranking.weight) for _ in range(20))


def test_quality_learns_from_all_pairs(spark):
    """Of 8,400 labelled rows none is left out: over all their pairs the loss has no slope, and the cut is their exact quantile."""
    rng = np.random.default_rng(21)
    rows, labels = [], []
    for i in range(8400):
        y = int(rng.random() < 0.45)
        rows.append((i, " ".join(w.upper() if rng.random() < 0.3 + 0.1 * y else w + "!" * int(rng.integers(0, 2 + y)) for w in ("ab", "cd", "7", "e.", "fgh")[: rng.integers(1, 6)])))
        labels.append((i, y))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    ranking = quality.fit(docs, marks, F.lit(True))
    x, y = quality.described(pd.Series([t for _, t in rows])), np.array([k for _, k in labels])
    assert np.allclose(ranking.mean, x.mean(axis=0)) and np.allclose(ranking.scale, x.std(axis=0) + 1e-6)
    even = np.clip((x - ranking.mean) / ranking.scale, -8, 8)
    a, b = even[y == 0], even[y == 1]
    wrong = 1 / (1 + np.exp((b @ ranking.weight)[:, None] - a @ ranking.weight)) / (len(a) * len(b))
    slope = wrong.sum(axis=1) @ b - wrong.sum(axis=0) @ a - 1e-3 * ranking.weight
    assert np.abs(slope).max() < 2e-5
    assert abs(ranking.shift - np.sort(ranking.raw(x))[len(a) - 1]) < 1e-9
    again = quality.fit(docs.repartition(7, "text"), marks, F.lit(True))
    assert (again.weight == ranking.weight).all() and again.shift == ranking.shift


def test_labels_of_one_document(spark):
    """Repeated rows count once, of several labels the greater, of several texts the least; the bound holds for rows."""
    rows = [(i, t) for i in range(6) for t in ("b", "a", "c")] + [(7, None), (8, None), (8, "x")]
    labels = [(i, 1, y) for i in range(9) for y in (0, i % 2)] * 3 + [(1, 1, None), (2, 1, 5), (None, 1, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got, counts = quality.training_rows(docs, marks, "toxic", F.lit(True), 100)
    assert sorted(map(tuple, got.select("doc_id", "label", "text").collect())) == [(i, i % 2, "a") for i in range(6)] + [(7, 1, None), (8, 0, "x")] and counts == {0: 4, 1: 4}
    few, counts = quality.training_rows(docs, marks, "toxic", F.lit(True), 1)
    assert few.count() == 2 and counts == {0: 4, 1: 4}


def test_window_sums():
    """Marginals and expected steps of windows, as the field is fitted with, against sums over all taggings; the slope of the likelihood."""
    rng = np.random.default_rng(9)
    e, here = rng.normal(0, 1, (3, 5)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    step, start = rng.normal(0, 1, (2, 2)), 0.4

    def taggings(n):
        return [[(k >> i) & 1 for i in range(n)] for k in range(2**n)]

    def weight(row, y, step):
        return np.exp(start * y[0] + sum(e[row, i] for i in range(len(y)) if y[i]) + sum(step[u, v] for u, v in zip(y, y[1:], strict=False)))

    p, joint = toxicity.Field._expect(e, here, step, start)
    want, steps = np.zeros((3, 5)), np.zeros((2, 2))
    for row, n in enumerate(here.sum(axis=1)):
        total = sum(weight(row, y, step) for y in taggings(n))
        for y in taggings(n):
            want[row, :n] += np.array(y) * weight(row, y, step) / total
            for u, v in zip(y, y[1:], strict=False):
                steps[u, v] += weight(row, y, step) / total
    assert np.allclose(p, want) and np.allclose(joint, steps)
    nudge = np.zeros((2, 2))
    nudge[1, 1] = 1e-5
    slope = sum(np.log(sum(weight(r, y, step + nudge) for y in taggings(n))) - np.log(sum(weight(r, y, step - nudge) for y in taggings(n))) for r, n in enumerate(here.sum(axis=1))) / 2e-5
    assert abs(slope - joint[1, 1]) < 1e-6


def test_marked_forms_by_hand(spark):
    """The counts that Spark makes over whole texts, of any length and in any number of tasks."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["Vile", "vilest", "rotten", "fair", "plain", "word", "x"], 60 if i else 30_000)) + (" onlybad" * (i % 2)), int(i % 2)) for i in range(40)]
    rows += [(50 + i, " ".join(rng.choice(["fair", "plain", "word", "x"], 3000)), 0) for i in range(30)]
    inside, outside, size = {}, {}, [0, 0]
    for _, t, y in rows:
        w = [x.lower() for x in toxicity.WORD.findall(t)]
        size[y] += len(w)
        for k, x in enumerate(w):
            for form in {x, x[:5] + "*"}:
                if y:
                    inside.setdefault(form, set()).add((w[k - 1] if k else "", w[k + 1] if k + 1 < len(w) else ""))
                else:
                    outside[form] = outside.get(form, 0) + 1
    want = sorted(f for f, c in inside.items() if len(c) >= 5 and len(c) / size[1] > 30 * (outside.get(f, 0) + 0.6) / size[0])
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert toxicity.marked_forms(table.repartition(7)) == toxicity.marked_forms(table.coalesce(1)) == want


def test_toxicity_by_hand(spark, docs):
    """Scores and spans from the field, by sums over each text's words one after another."""
    found, labels = labelled(spark, lambda w, y, rng: " ".join([*w[:30], *(["vilest"] * y), *w[30:], *(["rotten"] * y)]))
    field = toxicity.fit(found, labels, F.lit(True))
    some = docs.select("doc_id", "text").unionByName(found.withColumn("doc_id", F.col("doc_id") + 1000))
    for r in toxicity.scored(some, field).join(some.dropDuplicates(["doc_id"]), "doc_id").collect():
        spans = [m.span() for m in toxicity.WORD.finditer(r.text or "")]
        e = [float(np.exp(np.clip(field.weight[toxicity.word_features(r.text[a:b])].sum(), -25, 25))) for a, b in spans]
        step, start, p = np.exp(field.step), np.exp(field.start), []
        forward, back = [], [np.ones(2)]
        for k, x in enumerate(e):
            now = np.array([1.0, x * start]) if k == 0 else np.array([forward[-1] @ step[:, 0], x * (forward[-1] @ step[:, 1])])
            forward.append(now / now.sum())
        for x in e[:0:-1]:
            now = step @ (back[-1] * [1.0, x])
            back.append(now / now.sum())
        for f, b in zip(forward, reversed(back), strict=False):
            p.append(f[1] * b[1] / (f * b).sum())
        p = np.array(p)
        high = p[p >= toxicity.FLOOR] if len(p) else p
        x = [np.log1p(high.sum()), high.max(initial=0), np.sqrt(100 * high.sum() / max(1, len(p))), np.log1p(len(p)) / 4]
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(field.sums[:4] @ x + field.sums[4], -500, 500)))) < 1e-6
        on, want = p >= toxicity.CUT, []
        for k in range(len(p)):
            if on[k] and (k == 0 or not on[k - 1]):
                want.append([spans[k][0], spans[k][1]])
            elif on[k]:
                want[-1][1] = spans[k][1]
        assert [[s.start, s.end] for s in r.spans] == want


def test_toxicity_learns_from_long_texts(spark):
    """All of a long labelled text counts, wherever its words stand."""
    filler = " ".join(f"z{i % 900}" for i in range(30_000))
    rows = [(i, f"x{i} " + " ".join(["foulest" if i % 2 else "fairest", f"y{k}"][j] for k in range(6) for j in (0, 1))) for i in range(60)]
    rows += [(i, filler + (f" foulest v{i} foulest u{i}" if i % 2 else "") + filler) for i in range(60, 70)]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(70)], "doc_id long, quality int, toxic int")
    field = toxicity.fit(found, labels, F.lit(True))
    got = {r.doc_id: r for r in toxicity.scored(found, field).collect()}
    assert all(got[i].predicted == i % 2 for i in range(60)) and all(got[i].spans for i in range(61, 70, 2))


def test_toxicity(spark, docs, empty):
    def spoil(w, y, rng):
        for k in rng.integers(0, 60, 4) if y else ():
            w[k] = ["vilest", "vilesto", "rotten"][rng.integers(0, 3)]
        return " ".join(w)

    found, labels = labelled(spark, spoil)
    held = quality.held_out(F.col("doc_id"), 4, 2)
    field = toxicity.fit(found, labels, ~held)
    got = toxicity.scored(found, field).where(held).join(labels, "doc_id").join(found, "doc_id").where("toxic IS NOT NULL").collect()
    assert got and all(r.predicted == r.toxic for r in got)
    assert all(re.match("vilest|rotten", r.text[s.start : s.end]) for r in got for s in r.spans)
    odd = toxicity.scored(docs, field).collect()
    assert len(odd) == len(texts()) and all(0 <= r.score <= 1 for r in odd)
    assert all(r.predicted == 0 and not r.spans for r in odd if r.doc_id in (1, 4, 5, 6, 7))
    assert toxicity.scored(empty, field).count() == 0
    assert {r.predicted for r in toxicity.scored(docs, toxicity.fit(docs, labels.limit(0), F.lit(True))).collect()} == {0}


def test_marginals():
    """Messages in blocks against sums over all taggings."""
    rng = np.random.default_rng(5)
    e, step, start = rng.normal(0, 2, 9), np.exp(rng.normal(0, 1, (2, 2))), 0.3
    first, last = np.zeros(9, bool), np.zeros(9, bool)
    first[[0, 4]], last[[3, 8]] = True, True
    got = toxicity.marginals(e, first, last, step, start)
    for a, b in ((0, 4), (4, 9)):
        total, on = 0.0, np.zeros(b - a)
        for k in range(2 ** (b - a)):
            y = [(k >> i) & 1 for i in range(b - a)]
            p = start if y[0] else 1.0
            p *= np.exp(sum(e[a + i] for i in range(b - a) if y[i])) * np.prod([step[u, v] for u, v in zip(y, y[1:], strict=False)])
            total, on = total + p, on + p * np.array(y)
        assert np.allclose(got[a:b], on / total)


def test_ann(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 24))
    x[300:400] = x[300]  # a large group of equal vectors
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] * 24, 0), (1003, [1.0] * 3, 0), (1004, [None] * 24, 0), (None, [1.0] * 24, 0), (1020, [float("inf")] * 24, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = ann.search(vectors, vectors.where("vec_id % 20 = 0")).toPandas()
    assert got.groupby("query_id").size().eq(20).all() and set(got.query_id) == set(range(0, 600, 20))
    hits = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        assert np.allclose(own.score, s[own.vec_id]) and own["rank"].tolist() == list(range(1, 21))
        hits += len(set(best) & set(own.vec_id))
    assert hits >= 0.9 * 20 * 30
    # Asked rows that stand twice, and more asked vectors of another length than of the usual one.
    asked = vectors.where("vec_id IN (0, 20, 40)")
    others = spark.createDataFrame([(5000 + i, [1.0] * 7, 0) for i in range(40)], vectors.schema)
    twice = ann.search(vectors, asked.unionByName(asked).unionByName(others)).toPandas().sort_values(["query_id", "rank"])
    once = got[got.query_id.isin([0, 20, 40])].sort_values(["query_id", "rank"])
    assert twice[["query_id", "rank", "vec_id", "score"]].values.tolist() == once[["query_id", "rank", "vec_id", "score"]].values.tolist()
    tiny = vectors.withColumn("embedding", F.transform("embedding", lambda v: v * 1e-9))
    small = ann.search(tiny, tiny.where("vec_id % 20 = 0")).toPandas()
    assert len(small) == 600 and small.groupby("query_id").vec_id.nunique().eq(20).all()
    few = vectors.where("vec_id < 5")
    assert ann.search(few, few).groupBy("query_id").count().where("count = 4").count() == 5
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_images(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(v) for v in rng.normal(size=64)]) for i in range(40)] + [(100, None), (None, [1.0]), (101, [float("nan")])]
    media = images.mosaics(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), edited_every=4)
    odd = [(900, 1, b""), (901, 1, b"P5\n9 9\n255\nshort"), (902, 1, images.pgm(np.full((40, 40), 7.0))), (903, 1, images.pgm(np.full((40, 40), 7.0))), (904, 1, None)]
    media = media.unionByName(spark.createDataFrame(odd, media.schema))
    got = {r.media_id: r for r in images.groups(media).collect()}
    copies = [i for i in got if i is not None and i % 2 and i < 100]
    assert len(copies) == 10 and sum(got[i].group_id == i - 1 for i in copies) >= 9
    assert all(got[i].group_id == i for i in got if i is not None and i < 80 and i % 2 == 0)
    assert got[902].group_id == got[903].group_id == 902 and got[901].group_id == 901 and got[900].n_points == 0
    assert images.groups(media.limit(0)).count() == 0


def textured(rng, h, w):
    """Smooth noise with as many corners everywhere."""
    return np.clip(128 + 90 * images.box(rng.normal(0, 1, (h, w)), 2) * 5 / 2, 0, 255)


def test_images_crop_of_a_large_one(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3):
        x = textured(rng, 640, 640)
        top, left = rng.integers(0, 320, 2)
        rows += [(2 * i, images.pgm(x)), (2 * i + 1, images.pgm(0.9 * x[top : top + 320, left : left + 320] + 9))]
    got = {r.media_id: r.group_id for r in images.groups(spark.createDataFrame(rows, "media_id long, image binary")).collect()}
    assert got == {i: i // 2 * 2 for i in range(6)}


def test_images_of_crowded_descriptors(spark):
    """Images put together from the same few marks, some in several copies: each pair that brute force links counts."""
    rng = np.random.default_rng(9)
    marks = [textured(rng, 6, 6) - 128 for _ in range(48)]
    ramp = np.add.outer(np.arange(104) * 1.3, np.arange(104) * 0.9) * 150 / 226.6 + 50
    rows = []
    for i in range(20):
        x = ramp.copy()
        for k, m in enumerate(rng.permutation(48)[:16]):
            r, c = k // 4 * 26 + rng.integers(3, 17), k % 4 * 26 + rng.integers(3, 17)
            x[r : r + 6, c : c + 6] += 0.6 * marks[m]
        rows += [(10 * i + j, images.pgm((1 - j / 20) * x + 4 * j)) for j in range(5 if i % 5 == 0 else 1)]
    got, want = groups_and_brute_force(spark, rows)
    assert got == want == {i: i // 10 * 10 for i in got}


def groups_and_brute_force(spark, rows, **more):
    """group_id by image, and the same from comparing every two images."""
    points = {i: images.described(x)[1:3] for i, x in rows}
    key = {i: hashlib.md5(x).digest() for i, x in rows}
    top = {i: i for i in points}
    for i in points:
        for j in points:
            if key[i] < key[j] and top[i] != top[j] and images.consensus(*points[i], *points[j]) >= images.AGREE:
                old, new = max(top[i], top[j]), min(top[i], top[j])
                top = {k: new if v == old else v for k, v in top.items()}
    found = images.groups(spark.createDataFrame(rows, "media_id long, image binary"), **more).collect()
    return {r.media_id: r.group_id for r in found}, top


def two_tone(rng, noise):
    """Mosaics of two shades, every fifth with three cropped and noisy copies."""
    rows = []
    for i in range(60):
        x = np.kron(rng.integers(0, 2, (8, 8)) * 120.0 + 60, np.ones((8, 8)))
        rows.append((10 * i, images.pgm(x)))
        for j in range(1, 4 if i % 5 == 0 else 1):
            top, left = rng.integers(0, 9, 2)
            y = 0.85 * x[top:, left:] + 25
            rows.append((10 * i + j, images.pgm(y + rng.normal(0, noise, y.shape))))
    return rows


@pytest.mark.parametrize("noise", [2.0, 5.0])
def test_images_of_two_shades(spark, noise):
    """Nearly all descriptors stand in nearly all images: recall of the pairs that brute force connects, and none besides."""
    got, want = groups_and_brute_force(spark, two_tone(np.random.default_rng(12), noise))
    pairs = {(i, j) for i in want for j in want if i < j and want[i] == want[j]}
    found = {(i, j) for i in got for j in got if i < j and got[i] == got[j]}
    copies = {(i, j) for i, j in pairs if i // 10 == j // 10}
    assert len(copies) > 60 and len(found & copies) >= 0.95 * len(copies)
    assert len(found & pairs) >= 0.9 * len(pairs) and found <= pairs


def test_images_small_map(spark):
    """A full map of crowded keys lengthens keys and leaves more to the comparison of plain classes."""
    rng = np.random.default_rng(14)
    rows = [(10 * i + j, images.pgm((1 - j / 10) * x + 9 * j)) for i in range(8) for x in [textured(rng, 80, 80)] for j in range(2)]
    got, want = groups_and_brute_force(spark, rows, map_bits=1 << 10)
    assert got == want == {i: i // 10 * 10 for i in got}


def corners_of_classes(rng):
    """60 classes of 33 corners: some alike up to each level of their keys, and marks with their neighbours in many classes, plain ones among these."""
    pool = rng.integers(0, 256, (12, 16), dtype=np.uint8)
    marks = rng.integers(0, 256, (4, 16), dtype=np.uint8)
    rows = []
    for c in range(60):
        bits = rng.integers(0, 256, (33, 16), dtype=np.uint8)
        for k in range(8, 22):
            bits[k] = pool[rng.integers(0, 12)]
            if k % 2:  # alike in some tables alone
                bits[k, rng.integers(0, 16)] ^= 1 << rng.integers(0, 8)
        at = np.stack([np.arange(33) * 3, np.full(33, c), rng.choice([1, 2**0.5, 2], 33), rng.choice([-3, 0.1, 2], 33)], axis=1)
        beside = rng.integers(8, 33, (33, 3))
        n = 4 if c % 4 == 3 else 3 if c % 2 else 0  # 4 of 33 make a class plain
        bits[:n], at[:n, 2:], beside[:n] = marks[:n], [1, 0.1], np.array([(1, 2, 0), (2, 0, 0), (0, 1, 0), (1, 2, 0)])[:n]
        beside[6] = -1
        rows.append((100 - c, len(bits), at.astype("<f4").tobytes(), bits.tobytes(), beside.astype("<i4").tobytes(), 32))
    return rows


@pytest.mark.parametrize(("map_bits", "heavy", "together"), [(1 << 20, 256, 512), (1 << 6, 0, 3)])
def test_images_pairs_of_crowded_keys(spark, monkeypatch, map_bits, heavy, together):
    """Every two classes of a key count, also of a longest one that more than CROWD corners have; two plain ones go to the packs instead."""
    rows = corners_of_classes(np.random.default_rng(21))
    entries, levels = [], set()
    for cid, _, at, bits, beside, _ in rows:
        at, bits, beside = np.frombuffer(at, "<f4").reshape(-1, 4), np.frombuffer(bits, np.uint8).reshape(-1, 16), np.frombuffer(beside, "<i4").reshape(-1, 3)
        on = beside[:, 0] >= 0
        for k, keys in zip(np.flatnonzero(on), images.table_keys(bits[on], bits[beside[on]]), strict=True):
            entries += [(cid, k, t, tuple(map(int, keys[t])), round(2 * np.log2(at[k, 2])), int(at[k, 3] / (2 * np.pi) % 1 * 256)) for t in range(images.TABLES)]
    times = collections.Counter((t, level, e[level]) for _, _, t, e, _, _ in entries for level in range(images.LEVELS))
    met = collections.defaultdict(list)
    lost = collections.Counter()
    for cid, k, t, e, size, turn in entries:
        level = next((x for x in range(images.LEVELS) if times[t, x, e[x]] <= images.CROWD), None)
        levels.add(level)
        lost[cid] += level is None
        met[t, level, e[-1 if level is None else level]].append((cid, k, size, turn))
    plain = {c for c, n in lost.items() if n >= images.PLAIN * 32 * images.TABLES}
    votes = collections.defaultdict(set)
    for (_, level, _), some in met.items():
        for one, two in itertools.combinations(sorted(some), 2):
            if one[0] != two[0] and not (level is None and {one[0], two[0]} <= plain and one[0] != min(some)[0]):
                votes[one[0], two[0], (two[3] - one[3] + 128 // images.TURNS) % 256 * images.TURNS // 256, two[2] - one[2]].add(one[1])
    want = {(a, b) for (a, b, *_), at in votes.items() if len(at) > 1}
    assert levels >= {0, 1, 2, 3, None}
    monkeypatch.setattr(images, "TOGETHER", together)
    points = spark.createDataFrame(rows, "cid long, n int, at binary, bits binary, strong binary, entered int")
    pairs, flat = images.candidates(points, *images.counted(points, map_bits, heavy))
    assert {r.cid for r in flat.collect()} == plain and len(plain) == 15
    got = {(r.a, r.b) for r in pairs.collect()}
    odd = {100 - c for c in range(60) if c % 2}
    assert all((a, b) in got for a, b in itertools.combinations(sorted(odd), 2) if not {a, b} <= plain)
    assert got == want


def test_images_side_by_side(spark):
    """Images of one size are described as each alone, and all of them at once; unreadable ones stay where they are."""
    rng = np.random.default_rng(22)
    some = [images.pgm(textured(rng, *size)) for size in [(64, 64), (70, 90)] * 4 + [(9, 200)]] + [b"", None]
    assert images.all_described(some) == [images.described(x) for x in some]
    assert [x[0] > 0 for x in images.all_described(some)] == [True] * 8 + [False] * 3
    one, two = images.described(some[0])[1:3], images.described(images.pgm(0.8 * images.pixels_of(some[0])[3:] + 9))[1:3]
    assert images.AGREE <= images.consensus(*one, *two) <= len(one[1]) // 16


def test_images_many_copies(spark):
    """A large group of edited copies, repeated rows among them."""
    rng = np.random.default_rng(15)
    x = textured(rng, 96, 96)
    rows = [(i, images.pgm((0.7 + 0.006 * i) * x + rng.normal(0, 1.5, x.shape))) for i in range(40)]
    rows += [(i, images.pgm(textured(rng, 96, 96))) for i in range(100, 110)] + rows[:5]
    found = images.groups(spark.createDataFrame(rows, "media_id long, image binary").withColumn("cid", F.lit(1)).withColumn("key", F.lit(2))).collect()
    assert len(found) == 55 and all(r.group_id == (0 if r.media_id < 100 else r.media_id) for r in found)


def test_encoder_memory_is_bounded(monkeypatch):
    """Pieces that occur once leave the memo again, and a frequent one enters it however many came before."""
    from versejobs.llm import tokens

    monkeypatch.setattr(tokens, "MEMO", 50)
    coder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"k{20 * i + j}x" for j in range(20)) + (" later" if i > 10 else "") for i in range(40)]
    got = [coder.encode([t])[0] for t in texts]
    assert got == coder.whole(texts)
    assert len(coder.memo) + len(coder.old) <= 2 * (50 + 21)
    assert "later" in coder.memo or "later" in coder.old
    assert "k0x" not in coder.memo and "k0x" not in coder.old
