"""Ids of the word-level BPE vocabulary, through a cache of words.

The vocabulary lower-cases, splits at white space, drops it and merges within runs of letters or
of other signs only, so that a text's ids are those of its runs in turn. Texts with characters
whose folding or class could depend on the library's Unicode tables, or that may hold a special
token, go to the tokenizer as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import filterfalse

import numpy as np

#: Runs kept per Python worker.
CACHE_RUNS = 600_000
#: Characters that are handled here: up to the end of Latin Extended-A.
LAST = 0x17F


def _plain(c: str) -> bool:
    kind = unicodedata.category(c)
    low = c.lower()
    return (
        (kind[0] in "LNPS" or c in " \t\n\r") and len(low) == 1 and ord(low) <= LAST
        and unicodedata.normalize("NFC", c) == c
    )


_CHARS = [c for c in map(chr, range(LAST + 1)) if _plain(c)]
_SIGNS = re.escape("".join(c for c in _CHARS if unicodedata.category(c)[0] in "PS"))
_LETTERS = frozenset(c for c in _CHARS if unicodedata.category(c)[0] == "L")
_OTHER = re.compile(f"[^{re.escape(''.join(_CHARS))}]|<\\|")
_SIGN_RUN = re.compile(f"([{_SIGNS}]+)")
_ONE_RUN = re.compile(f"[{''.join(sorted(_LETTERS))}]+|[{_SIGNS}]+")


#: Bytes as the vocabulary writes them: printing ones as themselves, the others in turn from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}


def _spelled(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)


class WordTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _learn(self, words: list[str]) -> None:
        """A run of one class needs no folding or splitting any more, so the vocabulary's merges alone do."""
        merged, rest = self.tokenizer.model.tokenize, []
        ids: list[int] = []
        ends: list[int] = []
        one = []
        for word in words:
            if _ONE_RUN.fullmatch(word):
                one.append(word)
                ids += [t.id for t in merged(_spelled(word))]
                ends.append(4 * len(ids))
            else:
                rest.append(word)
        raw = np.array(ids, "<u4").tobytes()
        at = 0
        for word, end in zip(one, ends, strict=True):
            self.known[word] = raw[at:end]
            at = end
        self.known.update(zip(rest, self._encode(rest), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        words: list[list[str] | None] = [None] * len(texts)
        whole = []
        if len(self.known) > CACHE_RUNS:
            self.known.clear()
        new: set[str] = set()
        known = self.known.__contains__
        for i, text in enumerate(texts):
            if _OTHER.search(text):
                whole.append(i)
                continue
            low = text.lower()
            if "'" not in low:  # an apostrophe may open a run of its own kind
                low = _SIGN_RUN.sub(r" \1 ", low)
            words[i] = own = low.split()
            new.update(filterfalse(known, own))
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        for i, own in enumerate(words):
            if own is not None:
                out[i] = b"".join(map(get, own))
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out
