"""Token ids of texts by a byte-level BPE file of the tokenizers library, as little-endian unsigned 32-bit binaries.

The library encodes a distinct word once a worker: a text is cut at single spaces and newlines between characters
that aren't white space, where the file's pre-tokenizer always starts a new token, so joined parts equal the whole
text's ids. Texts with other white space go to the library whole.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Words that a worker remembers for each of its two places, at the start of a line and later, some 200 bytes each; the
#: first seen stay. Places by which it tells that a word has been asked for before.
CACHE_WORDS, PLACES = 400_000, 1 << 21
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: Marks that are no part of a word's token where they end it.
MARKS = ",.;:!?*&$%#|"


def byte_chars() -> dict[int, str]:
    """The character by which a byte-level vocabulary shows each byte: printable ones themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARS = byte_chars()
#: A text that has to go to the library whole is cut at single spaces into pieces of about so many characters.
LONG_TEXT = 1 << 20
_encoders: dict[str, Encoder] = {}


class Words(dict):
    """Ids of words, each with ``prefix`` before it. KeyError where no text can be cut.

    A word is remembered from the second time that it is asked for, or that another of its hash's place is.
    """

    def __init__(self, library, prefix: str):
        super().__init__()
        self.prefix, self.fast, self.piece = prefix, library.encode_batch_fast, library.model.tokenize
        self.shown = prefix.encode().decode("latin-1").translate(BYTE_CHARS)
        self.tails: dict[str, bytes] = {}
        self.met = bytearray(PLACES)

    def ids(self, text: str) -> bytes:
        return np.array(self.fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # one pre-token, so the model alone gives its ids
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS)
            ids = [t.id for t in self.piece(self.shown + mapped)]
            found = PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)
        elif not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)
        elif (bare := word.rstrip(MARKS)) != word and bare.isalpha():  # the marks are one pre-token of their own
            tail = word[len(bare) :]
            if tail not in self.tails:
                self.tails[tail] = self.ids(tail)
            found = self[bare] + self.tails[tail]
        else:
            found = self.ids(self.prefix + word)
        place = hash(word) % PLACES
        if not self.met[place]:
            self.met[place] = 1
        elif len(self) < CACHE_WORDS:
            self[word] = found
        return found


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.model._resize_cache(1)  # the words' own memory is larger
        self.first, self.later = Words(self.library, ""), Words(self.library, " ")
        self.newline = self.first.ids("\n")

    def whole(self, text: str) -> bytes:
        if len(text) <= LONG_TEXT:
            return self.first.ids(text)
        out, start = [], 0
        while start < len(text):
            cut = re.compile(r"(?<=\S) (?=\S)").search(text, min(start + LONG_TEXT, len(text)))
            end = cut.start() if cut else len(text)
            out.append(self.first.ids(text[start:end]))
            start = end
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        first, later = self.first.__getitem__, self.later.__getitem__
        try:
            parts = []
            for line in text.split("\n"):
                words = line.split(" ")
                ids = [first(words[0])]
                ids += map(later, words[1:])
                parts.append(b"".join(ids))
            return self.newline.join(parts)
        except KeyError:
            return self.whole(text)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
