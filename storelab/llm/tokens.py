"""Token ids and counts by a public tokenizer, each distinct word encoded once per task.

The tokenizer of ``word_bpe_49k.json`` drops white space and ends a token at every word, so
a text's ids are those of its words one after the other. Only distinct words reach the
library; plain Latin words go to its merge model without the normaliser, which they need
only for lower case.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from storelab.llm.wordkit import Hasher, Slice, ragged

WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 1
_CACHE_WORDS = 1_000_000


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    """Place of a public vocabulary file on this machine; every worker has its own copy."""
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, the others follow from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder:
    """Ids of the words of texts; made in the task that uses it."""

    def __init__(self, name: str = WORD_TOKENIZER):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.hasher = Hasher()
        self.plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
        self.letters = byte_letters()
        self.stops = {p: self._whole(p) for p in ".,"}
        self._clear()

    def _clear(self) -> None:
        self.row, self.flat, self.ends = {}, array("I", [END_ID]), array("q", [0, 1])  # row 0: the end

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _encode(self, raw: bytes) -> list[int]:
        word = raw.decode("utf-8", "replace")
        found = self.plain.fullmatch(word)
        if not found:
            return self._whole(word)
        core, stop = found.groups()
        spelled = "".join(map(self.letters.__getitem__, core.lower().encode()))
        ids = [t.id for t in self.tokenizer.model.tokenize(spelled)]
        return ids + self.stops[stop] if stop else ids

    def rows(self, s: Slice) -> np.ndarray:
        """The row of each word in the table of encoded words."""
        codes = self.hasher.ranges(s.data, s.starts, s.ends, lower=True)
        distinct, first, place = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.row) > _CACHE_WORDS:
            self._clear()
        get, out = self.row.get, np.empty(len(distinct), np.int64)
        raw = s.data.tobytes()
        for i, (code, at) in enumerate(zip(distinct.tolist(), first.tolist())):
            row = get(code)
            if row is None:
                row = self.row[code] = len(self.ends) - 1
                self.flat.extend(self._encode(raw[s.starts[at]: s.ends[at]]))
                self.ends.append(len(self.flat))
            out[i] = row
        return out[place]

    def counts(self, s: Slice) -> np.ndarray:
        """Number of ids of each document, without the end."""
        rows = self.rows(s)
        size = np.diff(np.array(self.ends))
        sums = np.r_[0, np.cumsum(size[rows])]
        return sums[s.bounds[1:]] - sums[s.bounds[:-1]]

    def ids(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an end after each document, and where each document begins."""
        rows = np.insert(self.rows(s), s.bounds[1:], 0)
        flat, ends = np.array(self.flat, np.uint32), np.array(self.ends)
        size = ends[rows + 1] - ends[rows]
        sums = np.r_[0, np.cumsum(size)]
        return flat[ragged(ends[rows], size)], sums[s.bounds + np.arange(len(s.bounds))]
