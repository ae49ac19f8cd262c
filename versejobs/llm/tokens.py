"""A public tokenizer inside tasks: whole texts to ids, with a bounded memo of the pieces that white space parts."""

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces from which on what one Python worker remembers counts as old, and goes when as many new ones have come.
MEMO = 200_000
#: Pieces encoded with one call.
JOINED = 256
#: Bytes of text whose pieces are told apart at once.
SLICE = 1 << 23
#: Stands between pieces of one call; white space on both sides keeps it apart from them.
BAR = "\x01"
#: Letters and marks behind them: two units of a tokenizer at least, or one without marks.
SIMPLE = re.compile("[A-Za-z]+[,.;:!?]*")


class Encoder:
    """Gives the ids that the tokenizer gives for whole texts, without special tokens, truncation or padding.

    Where the tokenizer drops white space between words, the ids of a text are those of its pieces between spaces and line
    ends, one after another; `apart` says whether probes bear that out. Else whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {"": b""}
        probes = ["ab cd", " ab", "ab ", "a\nb", "a  b", "it's don 't", "1 2,3 .", "x \n y", "Ab Cd", f"a, {BAR} b", f"9 {BAR} !"]
        self.apart = all(self.whole([p])[0] == b"".join(self.whole(p.replace("\n", " ").split(" "))) for p in probes)
        bar = self.whole([BAR])[0]
        self.bar = int(np.frombuffer(bar, self.type)[0]) if len(bar) == self.type.itemsize else None
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        #: Which ids end a unit of a word, where the vocabulary tells them by a suffix.
        self.closing = np.array([bool(suffix) and x.endswith(suffix) for x in self.strings])

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text from a call for it alone."""
        return [np.array(x.ids, dtype=self.type).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word. Many go in one call; where its parts don't come out in the number expected, each goes alone.

        Simple words are parted by the ids that end their units: letters give one or more, marks behind them one or more, so
        if all together give no more than that, each does. Other words are parted by BAR.
        """
        out, wide = {}, self.type.itemsize
        simple = [w for w in words if SIMPLE.fullmatch(w)] if self.closing.any() else []
        groups = [simple[i : i + JOINED] for i in range(0, len(simple), JOINED)]
        for group, got in zip(groups, self.whole([" ".join(g) for g in groups]) if groups else [], strict=True):
            units = np.cumsum([1 + (not w[-1].isalpha()) for w in group])
            ends = np.flatnonzero(self.closing[np.frombuffer(got, self.type)]) + 1
            if len(ends) == units[-1]:
                ends = (ends[units - 1] * wide).tolist()
                out |= {w: got[a:b] for w, a, b in zip(group, [0, *ends], ends, strict=False)}
        plain = [w for w in words if w not in out and BAR not in w] if self.bar is not None else []
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, got in zip(groups, self.whole([f" {BAR} ".join(g) for g in groups]) if groups else [], strict=True):
            ends = [*np.flatnonzero(np.frombuffer(got, self.type) == self.bar).tolist(), len(got) // wide]
            if len(ends) != len(group):
                continue
            start = 0
            for word, end in zip(group, ends, strict=True):
                out[word] = got[start * wide : end * wide]
                start = end + 1
        rest = [w for w in words if w not in out]
        return out | dict(zip(rest, self.whole(rest), strict=True)) if rest else out

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        rows = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = rows.flatten().dictionary_encode()
        # One string for all, which is many times faster than a string from each value.
        words = "".join(pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string())), " ").to_pylist()).split(" ") if len(coded) else []
        known = list(map(self.memo.get, words))
        lacking = [w for w, x in zip(words, known, strict=True) if x is None]
        if lacking:
            # Pieces that recur come back from the old ones; most, such as keys and numbers, occur once and go with these.
            new = {w: x for w in lacking if (x := self.old.get(w)) is not None}
            new |= self._pieces([w for w in lacking if w not in new])
            self.memo |= new
            if len(self.memo) >= MEMO:
                self.old, self.memo = self.memo, {}
            known = [new[w] if x is None else x for w, x in zip(words, known, strict=True)]
        table, wide = np.frombuffer(b"".join(known), self.type), self.type.itemsize
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // wide
        starts = np.cumsum(lengths) - lengths
        code = coded.indices.to_numpy()
        n = lengths[code]
        ends = np.cumsum(n)
        places = np.repeat(starts[code] - (ends - n), n)
        places += np.arange(len(places))
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(rows).to_numpy())])]
        return table[places], np.diff(edges)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), one after another, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.apart:
            got = self.whole(texts.to_pylist())
            return np.frombuffer(b"".join(got), self.type), np.array([len(x) // self.type.itemsize for x in got], np.int64)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        found, start = [], 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE, side="right")))
            found.append(self._slice(texts[start:end]))
            start = end
        if not found:
            return np.zeros(0, self.type), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of `type`."""
        ids, n = self.ids(pa.array(texts, pa.large_string()))
        raw, ends = ids.tobytes(), np.cumsum(n) * self.type.itemsize
        return [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        """What decode(ids, skip_special_tokens=False) gives; without a decoder that is the tokens joined by blanks."""
        if self.tokenizer.decoder is None:
            return self.joined(ids, self._string_column)
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def numbers(self, ids: np.ndarray) -> str:
        """The ids as decimal numbers, parted by blanks."""
        return self.joined(ids, self._number_column)

    @staticmethod
    def joined(ids: np.ndarray, column: pa.Array) -> str:
        rows = pa.ListArray.from_arrays([0, len(ids)], column.take(pa.array(ids)))
        return pc.binary_join(rows, " ")[0].as_py()

    @functools.cached_property
    def strings(self) -> list[str]:
        return [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(True))]

    @functools.cached_property
    def _string_column(self) -> pa.Array:
        return pa.array(self.strings, pa.string())

    @functools.cached_property
    def _number_column(self) -> pa.Array:
        return pa.array([str(i) for i in range(len(self.strings))], pa.string())


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(path)
