"""Token ids of whole texts with the ``tokenizers`` library's byte-level BPE.

A byte-level BPE works word by word: the library cuts a text with one pattern
and merges inside each cut piece. Here the cutting is done for many texts at
once with numpy, each distinct piece goes once through the library's model, and
the ids are put together by index. A text with a character whose class changed
between Unicode versions (or beyond U+2FFF), and one that holds an added token
(``<|endoftext|>``), goes through the library as a whole, so ids always equal
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np
import pandas as pd

from cuesmith.llm.common import bytes_hash, ragged_arange

SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
LIMIT = 0x3000
#: The white space of the pattern's \s below LIMIT.
WHITE = [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]
#: The pattern's contractions after an apostrophe.
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")
#: Distinct pieces kept by a worker before it starts anew.
MOST_PIECES = 800_000


def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.full(LIMIT + 1, UNSURE, np.uint8)
    for c in range(LIMIT):
        new, old = (kind.get(u.category(chr(c))[0], OTHER) for u in (unicodedata, unicodedata.ucd_3_2_0))
        if new == old and unicodedata.category(chr(c)) != "Cn":
            out[c] = new
    out[WHITE] = SPACE
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x180E, 0x200B]] = UNSURE
    return out


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        self.size = self.whole.get_vocab_size()
        self.classes = _classes()
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.begin = array("I"), array("q", [0])

    def _starts(self, cps: np.ndarray, c: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start; ``first`` marks the first character of each text."""
        n = len(cps)
        run = first.copy()
        run[1:] |= c[1:] != c[:-1]
        start = run.copy()
        word = np.flatnonzero(run & (c != SPACE) & ~first)
        after = word[c[word - 1] == SPACE]
        start[after - 1] = True  # the last white space of a run stands alone ...
        start[after[cps[after - 1] == 0x20]] = False  # ... or, if a blank, opens the word
        quote = np.flatnonzero(run & (cps == 0x27))
        quote = quote[(quote + 1 < n) & start[quote]]
        quote = quote[run[quote + 1] & ~first[quote + 1] & (c[quote + 1] == LETTER)]
        if len(quote):
            a = cps[quote + 1]
            two = np.minimum(quote + 2, n - 1)
            joined = (quote + 2 < n) & ~run[two]
            short = np.isin(a, [ord(x) for x in CONTRACTIONS_1])
            long = np.zeros(len(quote), bool)
            for x, y in CONTRACTIONS_2:
                long |= joined & (a == ord(x)) & (cps[two] == ord(y))
            hit = short | long
            start[quote[hit] + 1] = False
            rest = quote[hit] + 2 + long[hit]
            start[rest[rest < n]] = True
        return np.flatnonzero(start)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        tokenize, letters = self.model.tokenize, self.letters
        for h, piece in zip(hashes.tolist(), pieces):
            self.flat.extend([t.id for t in tokenize(piece.encode().decode("latin1").translate(letters))])
            self.known[h] = len(self.begin) - 1
            self.begin.append(len(self.flat))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of many texts -> (ids as uint32, offset of each text in them)."""
        n_texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_texts + 1, np.int64)
        text = data.tobytes().decode("utf-8")
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(cps) == len(data):
            at, byte = offsets, None
        else:
            lead = (data & 0xC0) != 0x80
            at = np.append(0, np.cumsum(lead))[offsets]
            byte = np.flatnonzero(lead)
        c = self.classes[np.minimum(cps, LIMIT)]
        first = np.zeros(len(cps), bool)
        first[at[:-1][at[:-1] < len(cps)]] = True
        starts = self._starts(cps, c, first)
        ends = np.append(starts[1:], len(cps))
        begins = starts if byte is None else byte[starts]
        h = bytes_hash(data, begins, np.append(begins[1:], len(data)))
        codes, distinct = pd.factorize(h)
        if len(self.known) > MOST_PIECES:
            self.reset()
        get = self.known.get
        where = np.array([get(x, -1) for x in distinct.tolist()], np.int64)
        new = np.flatnonzero(where < 0)
        if len(new):
            seen = np.zeros(len(distinct), np.int64)
            seen[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            self._learn(distinct[new], [text[s:e] for s, e in zip(starts[seen[new]].tolist(), ends[seen[new]].tolist())])
            where[new] = np.arange(len(self.begin) - 1 - len(new), len(self.begin) - 1)
        begin = np.array(self.begin, np.int64)
        flat = np.array(self.flat, np.uint32)
        lo, size = begin[where], (begin[1:] - begin[:-1])[where]
        sizes = size[codes]
        ids = flat[np.repeat(lo[codes], sizes) + ragged_arange(sizes)]
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        out_at = total[np.searchsorted(starts, at)]
        unsure = c == UNSURE
        for content in self.added:  # one that spans two texts only sends the first through the library
            i = text.find(content)
            while i >= 0:
                unsure[i] = True
                i = text.find(content, i + 1)
        if unsure.any():
            return self._redo(text, at, unsure, ids, out_at)
        return ids, out_at

    def _redo(self, text, at, unsure, ids, out_at):
        count = np.zeros(len(unsure) + 1, np.int64)
        np.cumsum(unsure, out=count[1:])
        parts, sizes = [], np.diff(out_at)
        for i in range(len(at) - 1):
            if count[at[i + 1]] > count[at[i]]:
                got = np.array(self.whole.encode(text[at[i] : at[i + 1]], add_special_tokens=False).ids, np.uint32)
                sizes[i] = len(got)
                parts.append(got)
            else:
                parts.append(ids[out_at[i] : out_at[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker; its pieces stay warm between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text."""
    n = len(at) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
    return out, at + np.arange(n + 1)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
