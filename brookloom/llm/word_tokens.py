"""Token ids by a BPE file of the tokenizers library with word ends, as little-endian unsigned 32-bit binaries.

Such a file drops white space and marks each pre-token's end, so no token spans a space or newline: a text's ids are those
of its words one after the other. The library encodes a word that comes again once a worker.
"""

from __future__ import annotations

import os

import numpy as np

#: Words that a worker remembers, some 200 bytes each; the first seen stay. Places by which it tells that a word came before.
CACHE_WORDS, PLACES = 400_000, 1 << 21
#: Characters of a text that are cut into words at once.
STEP = 1 << 20
#: Marks that are a token of their own, or several, after a word's letters.
MARKS = ",.;:!?*&$%#|"
_encoders: dict[str, WordEncoder] = {}


class WordEncoder(dict):
    """Ids of words. A word is remembered from the second time that it, or another of its hash's place, is asked for."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if not self.library.model.end_of_word_suffix:
            raise ValueError(f"{path}: no word ends")
        self.library.model._resize_cache(1)  # the words' own memory is larger
        self.fast, self.piece, self.met = self.library.encode_batch_fast, self.library.model.tokenize, bytearray(PLACES)
        self.tails: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes() if text else b""

    def __missing__(self, word: str) -> bytes:
        bare = word.rstrip(MARKS)
        if bare != word and bare.isalpha():
            tail = word[len(bare) :]
            if tail not in self.tails and len(self.tails) < CACHE_WORDS:
                self.tails[tail] = self.ids(tail)
            found = self[bare] + (self.tails.get(tail) or self.ids(tail))
        elif word.isascii() and word.isalpha():  # one pre-token of plain letters: the model alone gives its ids
            found = np.array([t.id for t in self.piece(word.lower())], "<u4").tobytes()
        else:
            found = self.ids(word)
        place = hash(word) % PLACES
        if not self.met[place]:
            self.met[place] = 1
        elif len(self) < CACHE_WORDS:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            end = at + STEP
            if end < len(text):  # up to the next space, so that no word is cut
                found = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
                end = min(found, default=len(text))
            out.append(b"".join(map(self.__getitem__, text[at:end].replace("\n", " ").split(" "))))
            at = end
        return b"".join(out)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
