"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The Viterbi adds up log probabilities. A unigram file holds them. A file of merges holds ranks in their place, which are
no scores to add; its pieces get the log probabilities of Zipf's and Mandelbrot's law by rank. Ids of such a file are
thus those of the likeliest segmentation under that law, not those of its merges.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

MARK = "▁"  # stands for a space
CHUNK = re.compile(f"{MARK}*[^{MARK}]*")
#: Words that a worker remembers, from the second time that it meets them (PLACES tell); the first stay.
CACHE_WORDS, PLACES = 400_000, 1 << 21
#: Shift of the law by which the piece of rank r (from 0) has a probability in proportion to 1 / (r + SHIFT).
SHIFT = 2.7
_models: dict[str, Pieces] = {}


def log_probabilities(scores: dict[int, float]) -> dict[int, float]:
    """The scores by id, if they are log probabilities; by rank, if they are whole numbers that merges are ordered by.

    Equal ranks, as of pieces that are merged last, go by their ids.
    """
    if not all(float(s).is_integer() for s in scores.values()):
        return scores
    order = sorted(scores, key=lambda i: (-scores[i], i))
    total = math.log(sum(1 / (r + SHIFT) for r in range(len(order))))
    return {i: -math.log(r + SHIFT) - total for r, i in enumerate(order)}


class Pieces:
    """The vocabulary of a SentencePiece file. Byte pieces spell what no other piece covers."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        plain = [i for i in range(len(names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score_of = log_probabilities({i: model.get_score(i) for i in plain})
        self._build({names[i]: i for i in plain}, {names[i]: self.score_of[i] for i in plain})

    def _build(self, ids: dict[str, int], scores: dict[str, float]) -> None:
        import ahocorasick

        self.piece_of = {i: p for p, i in ids.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in ids.items():
            self.automaton.add_word(p, (len(p), scores[p], i))
        self.automaton.make_automaton()
        #: A byte costs more than any piece, so bytes are used only where pieces don't reach.
        self.byte_score = min(scores.values(), default=0.0) - 10.0
        #: Marks only begin pieces, so a text falls apart before its marks without loss.
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in ids)
        self.known: dict[str, bytes] = {}
        self.met = bytearray(PLACES)

    def viterbi(self, s: str) -> list[int]:
        """Ids of the best-scoring segmentation; of equally good ones, that whose last pieces are longest."""
        n, low = len(s), float("-inf")
        best, back = [low] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        byte_score, at = self.byte_score, 0

        def spell(end: int) -> None:
            # places that no piece reached are spelled in bytes
            nonlocal at
            while at < end:
                at += 1
                if back[at] is None:
                    best[at] = best[at - 1] + byte_score * len(s[at - 1].encode("utf-8", "surrogatepass"))
                    back[at] = (1, -1)

        # matches come by their end; at each end the automaton follows the output links, longest piece first
        for end, (size, score, i) in self.automaton.iter(s):
            spell(end)
            to = end + 1
            total = best[to - size] + score
            if total > best[to]:
                best[to] = total
                back[to] = (size, i)
        spell(n)
        out: list[int] = []
        to = n
        while to:
            size, i = back[to]
            if i < 0:
                out.extend(self.bytes[b] for b in reversed(s[to - 1].encode("utf-8", "surrogatepass")))
            else:
                out.append(i)
            to -= size
        return out[::-1]

    def spelled(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode("utf-8", "surrogatepass")]

    def encode(self, text: str) -> bytes:
        """A mark stands before the text and for each space; a mark that the text itself holds is spelled in bytes."""
        if MARK in text:
            first, *others = text.split(MARK)
            ids = array("I", self.encode(first)) if first else array("I", self.viterbi(MARK))
            for part in others:
                ids.extend(self.spelled(MARK))
                ids.frombytes(b"".join(map(self._chunk, self._cut(part.replace(" ", MARK)))))
            return ids.tobytes()
        return b"".join(map(self._chunk, self._cut(MARK + text.replace(" ", MARK))))

    def _cut(self, s: str) -> list[str]:
        return [x for x in CHUNK.findall(s) if x] if self.apart else [s]

    def _chunk(self, s: str) -> bytes:
        found = self.known.get(s)
        if found is None:
            found = array("I", self.viterbi(s)).tobytes()
            place = hash(s) % PLACES
            if not self.met[place]:
                self.met[place] = 1
            elif len(self.known) < CACHE_WORDS and len(s) < 64:
                self.known[s] = found
        return found

    def decode(self, raw: bytes) -> str:
        ids = array("I")
        ids.frombytes(raw)
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            else:
                out += self.piece_of[i].replace(MARK, " ").encode("utf-8", "surrogatepass")
        return out.decode("utf-8", "surrogatepass")[1:]


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encoded(text: Column, path: str) -> Column:
    """Binary of little-endian unsigned 32-bit ids; a null text counts as empty, which is a mark alone.

    A text is taken whole, however long: it falls apart before its marks, so no more than a word is searched at once where
    pieces hold marks at their start only. An empty table stays empty; a column of its own has no clashes.
    """

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([pieces(path).encode(x) for x in s], dtype=object)

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, BinaryType()).asNondeterministic()(F.coalesce(text, F.lit("")))


def decoded(ids: Column, path: str) -> Column:
    """The text of ids that ``encoded`` gave, exactly; null ids give null."""

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([None if x is None else pieces(path).decode(x) for x in s], dtype=object)

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, StringType())(ids)
