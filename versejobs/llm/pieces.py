"""Encoding and decoding with a SentencePiece model of merges.

Merges join neighbours whose text is a piece, best score first, leftmost first among equals. What they make of a text has one
token at the end of each prefix: the one that is compatible with the last token of the prefix before it, that is, merges
of the two tokens' characters give these two tokens. So one pass over a text fills a table of last tokens, from the pieces that
an automaton finds to end at each place, and ids are recovered from its end backwards, in time that grows with the length.

Two tokens are compatible if no merge joins them earlier than the merges that made them. That is looked up by taking the
latest of these apart, step by step, and asking at each step whether what then stands on both sides of the join would merge
before. Where a piece isn't made of better ones only, so that steps don't go by score, the two are merged anew instead.

Where no piece has a word's character before a blank mark, merges never cross into a blank; the table is then filled for
each distinct word once in a worker, as long as its memo has room. A character that is no piece becomes bytes.

Defined results: null is the empty text, with begin and end ids only; texts of any length, words of any length; repeated
rows get equal results; null doc_ids keep their rows; an empty table gives an empty result; other columns are not read.
"""

import functools
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: What stands for a blank in pieces.
MARK = "▁"
#: Most words, and most pairs of tokens, that one Python worker remembers.
MEMO, PAIRS = 800_000, 500_000
#: Numbers of tokens are below this.
MOST = 1 << 22
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+", re.S)


class Memo(dict):
    """Values by key; a lacking one is worked out, and kept as long as there is room."""

    def __init__(self, make: Callable, room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.room:
            self[key] = value
        return value


class Pieces:
    """Gives the ids that the library gives, with begin and end ids, and its decoded texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(self.model.get_piece_size())
        if any(self.model.is_unused(i) for i in every):
            raise ValueError(f"{path} has pieces that must not be used")
        own = [i for i in every if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        #: Texts of tokens: pieces by their id; characters that are no piece come behind them as they are met.
        self.texts = [self.model.id_to_piece(i) for i in every]
        self.id_of = {self.texts[i]: i for i in own}
        self.score = {self.texts[i]: self.model.get_score(i) for i in own}
        self.bytes = {bytes([b]): self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", t) for t in self.id_of)
        self.fits = Memo(self._fits, PAIRS)
        self.units = Memo(self._ids, MEMO)
        self.ends = np.array([self.model.bos_id(), self.model.eos_id()], "<u4")
        self.automaton = ahocorasick.Automaton()
        #: How late a piece is merged (characters: first of all), and the pieces beside a join once its last merge is undone.
        self.late: dict[int, float] = {}
        self.inner: dict[int, tuple[int, int]] = {}
        for text, i in sorted(self.id_of.items(), key=lambda x: len(x[0])):
            parts = self.merged(text, 2)
            if self.merged("", start=list(parts)) != [text]:
                continue  # such a piece never comes out
            self.automaton.add_word(text, (i, len(text)))
            if len(text) == 1:
                self.late[i] = -np.inf
            elif all(self.late.get(self.id_of.get(x), np.inf) < -self.score[text] for x in parts):
                self.late[i], self.inner[i] = -self.score[text], (self.id_of[parts[1]], self.id_of[parts[0]])
        self.automaton.make_automaton()

    def merged(self, text: str, upto: int = 1, start: list[str] | None = None) -> list[str]:
        """What merges make of a short text, one merge after another, until `upto` parts are left."""
        parts = start or list(text)
        while len(parts) > upto:
            scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        late, texts, score = self.late, self.texts, self.score
        if left not in late or right not in late:
            return self.merged(texts[left] + texts[right]) == [texts[left], texts[right]]
        limit, level = np.inf, False  # whether an equal score comes before
        while True:
            both = score.get(texts[left] + texts[right])
            if both is not None and (-both < limit or level and -both == limit):
                return False
            a, b = late[left], late[right]
            if a == b == -np.inf:
                return True
            if a > b:
                limit, level, left = a, False, self.inner[left][0]
            else:  # of equal ones the right one is the later
                limit, level, right = b, True, self.inner[right][1]

    def _fits(self, pair: int) -> bool:
        return self.compatible(pair // MOST, pair % MOST)

    def _character(self, c: str) -> int:
        """The token of a character that is no piece."""
        if c not in self.id_of:
            self.id_of[c] = len(self.texts)
            self.late[len(self.texts)] = -np.inf
            self.texts.append(c)
        return self.id_of[c]

    def table(self, text: str) -> list[tuple[int, int]]:
        """The last token of each prefix of a text, with its length."""
        last: list = [None] * (len(text) + 1)
        fits = self.fits
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                at = end - token[1]
                if at:
                    if last[at] is None:
                        self._fill(last, text, at)
                    if not fits[last[at][0] * MOST + token[0]]:
                        continue
                last[end] = token
        if text and last[-1] is None:
            self._fill(last, text, len(text))
        return last

    def _fill(self, last: list, text: str, at: int) -> None:
        """Characters before `at` at which no piece ends are tokens of their own."""
        while at and last[at] is None:
            last[at] = (self._character(text[at - 1]), 1)
            at -= 1

    def _ids(self, text: str) -> bytes:
        last, at, out, n = self.table(text), len(text), [], self.model.get_piece_size()
        while at:
            token, size = last[at]
            if token < n:
                out.append(token)
            else:
                out += [self.bytes[bytes([b])] for b in reversed(self.texts[token].encode())]
            at -= size
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> np.ndarray:
        whole = self.model.normalize(text)
        body = b"".join(map(self.units.__getitem__, UNIT.findall(whole) if self.apart else [whole]))
        return np.concatenate([self.ends[:1], np.frombuffer(body, "<u4"), self.ends[1:]])

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each Python worker, kept from task to task."""
    return Pieces(path)


def digests(coder: Pieces, ids: np.ndarray) -> tuple:
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest()


def full(coder: Pieces, ids: np.ndarray) -> tuple:
    return ids.tolist(), coder.decode(ids)


#: What encode() can give of each row: its columns and how they come from the ids.
DIGESTS = ("n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
FULL = ("token_ids array<long>, decoded string", full)


def encode(docs: DataFrame, model: str, outputs: tuple[str, Callable] = DIGESTS) -> DataFrame:
    """doc_id and the columns of `outputs` for each row of docs; no exchange."""
    columns, finish = outputs
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = pieces(model)
        for batch in batches:
            rows = [finish(coder, coder.encode(t or "")) for t in batch.text]
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype=object)], axis=1)

    # Ids go as text, so that null ones stay null whatever their type.
    found = docs.select(docs.doc_id.cast("string").alias("doc_id"), "text").mapInPandas(run, f"doc_id string, {columns}")
    return found.withColumn("doc_id", found.doc_id.cast(docs.schema["doc_id"].dataType))


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows with doc_id and token_ids; null ids give a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = pieces(model)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.asarray(x)) for x in batch.token_ids]
            yield pd.DataFrame({"doc_id": batch.doc_id, "text": texts})

    found = rows.select(rows.doc_id.cast("string").alias("doc_id"), "token_ids").mapInPandas(run, "doc_id string, text string")
    return found.withColumn("doc_id", found.doc_id.cast(rows.schema["doc_id"].dataType))
