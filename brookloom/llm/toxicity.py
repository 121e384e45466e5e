"""Toxicity by non-negative positive-unlabelled learning: numpy classifiers over words and stems with several forms.

Confirmed toxic examples are the positive set; every other training text counts as unlabelled. The risk is corrected by
the class prior, and its negative part is kept from falling below zero (non-negative estimator). Margins of
toxic texts stay near zero where unlabelled texts hold more of them than the prior says; a logistic curve, fitted on
labelled texts, makes probabilities of them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookloom.llm.shared import ship, small_batches

#: Texts of each set that the model is fitted on at most, chosen by a hash of their keys.
SAMPLE = 4_000
#: Words and stems that the model weighs at most, standard errors (signed root of the likelihood ratio) by which a word's
#: share must be higher among toxic texts, and the toxic texts, none a near copy of another, that have it at least.
WORDS, LEAST_ERRORS, LEAST_TEXTS = 2_048, 5.0, 5
#: Lengths of stems (first letters of words), and how many different words with a stem are told apart: so many stars.
STEMS, FORMS = (4, 5, 6, 7), 3
#: A text is also described by its most telling word's tier: shares of toxic texts among those with the word.
TIERS = (0.0, 0.2, 0.4, 0.6, 0.8)
PATTERN = re.compile(r"[^\W_]+")
#: Near copies share all hashes of a band: least hashes of the text's three-word runs.
BANDS, BAND = 4, 2


def features(text: str, heads: Collection[str] | None = None) -> set[str]:
    """The text's words, and stem*, stem** and so on for stems of one, two or more of its different words.

    With ``heads``, words that begin with none of them give no stems.
    """
    out = set(PATTERN.findall(text.lower()))
    long = [w for w in out if len(w) >= STEMS[0] and (heads is None or w[: STEMS[0]] in heads)]
    for stem, n in Counter(w[:k] for w in long for k in STEMS if len(w) >= k).items():
        out.update(stem + "*" * i for i in range(1, min(n, FORMS) + 1))
    return out


def heads_of(vocabulary: Collection[str]) -> frozenset[str]:
    return frozenset(w[: STEMS[0]] for w in vocabulary if w.endswith("*"))


def bands(text: str) -> list[int]:
    """Texts of which nine tenths of the three-word runs are alike share a band but once in 1,000."""
    words = PATTERN.findall(text.lower())
    runs = np.array([zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))], np.uint64)
    out = []
    for j in range(BANDS * BAND):
        x = (runs + np.uint64(j << 32)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(int((x ^ (x >> np.uint64(32))).min()))
    return [zlib.crc32(repr((i, out[i * BAND : (i + 1) * BAND])).encode()) for i in range(BANDS)]


def without_near_copies(rows: list[tuple[int, bool, list[int]]]) -> set[int]:
    """Of (h, positive, bands), the h of one text of each group that bands join, for positive and unlabelled texts apart."""
    low: dict = {}

    def root(x):  # noqa: ANN001, ANN202
        while low.setdefault(x, x) != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for h, positive, own in rows:
        for band in own:
            low[root((positive, "band", band))] = root((positive, "text", h))
    firsts: dict = {}
    for h, positive, _ in sorted(rows):
        firsts.setdefault(root((positive, "text", h)), h)
    return set(firsts.values())


@dataclass(frozen=True)
class Model:
    """weights and tiers: by word or stem; tier_weights: what a text's highest tier adds; heads: first letters of the stems.

    slope and offset: the curve from the margin to log odds.
    """

    weights: dict[str, float]
    tiers: dict[str, int]
    tier_weights: tuple[float, ...]
    bias: float
    prior: float
    heads: frozenset[str] = frozenset()
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, text: str) -> float:
        f = self.bias
        if hits := self.weights.keys() & features(text, self.heads):
            f += math.fsum(self.weights[w] for w in hits) + self.tier_weights[max(self.tiers[w] for w in hits)]
        return f

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * self.margin(text) + self.offset))))


def risk_step(rows: list[np.ndarray], positive: np.ndarray, prior: float, width: int, epochs: int = 60, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit a linear classifier with the non-negative risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)).

    ``rows``: indices of the words in each text. Where the negative part falls below zero, its gradient is turned round,
    as the estimator prescribes. The loss is logistic, the steps are Adam's.
    """
    rng = np.random.default_rng(seed)
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sizes = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, int)
    where = [np.flatnonzero(positive), np.flatnonzero(~positive)]
    step = 0
    for _ in range(epochs):
        halves = [rng.permutation(x) for x in where]
        parts = max(1, math.ceil(max(map(len, where)) / 1024))
        for k in range(parts):
            pos, unl = (x[k * len(x) // parts : (k + 1) * len(x) // parts] for x in halves)
            if not len(pos) or not len(unl):
                continue
            both = np.concatenate([pos, unl])
            own = np.repeat(np.arange(len(both)), sizes[both])
            at = flat[np.repeat(starts[both] - np.concatenate([[0], np.cumsum(sizes[both])[:-1]]), sizes[both]) + np.arange(len(own))]
            f = b + np.bincount(own, w[at], len(both))
            up = 1 / (1 + np.exp(-np.clip(f, -40, 40)))  # slope of the loss for label -; slope for + is up - 1
            n, u = len(pos), len(unl)
            fp, fu = f[:n], f[n:]
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            slope = np.zeros(len(both))
            if negative >= 0:
                slope[:n] = prior * (up[:n] - 1) / n - prior * up[:n] / n
                slope[n:] = up[n:] / u
            else:
                slope[:n] = prior * up[:n] / n
                slope[n:] = -up[n:] / u
            g = np.append(np.bincount(at, slope[own], width) + decay * w, slope.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))


def marked(docs: DataFrame, key: str, text: str, labels: DataFrame, positive: Column) -> DataFrame:
    """(text_hash, positive) of texts that are confirmed toxic, or have no label: a narrow table, without the texts.

    ``labels`` has ``key``, each once, and what ``positive`` reads. Rows whose label isn't positive are in neither set:
    the unlabelled set is a draw from all texts by way of those that nobody looked at. Null texts count as empty. Rows
    that repeat are counted once by ``fit``, as their texts are equal.
    """
    said = labels.select(F.col(key), F.coalesce(positive, F.lit(False)).alias("positive"))
    return hashed(docs, key, text).join(said, key, "left").where("positive is null or positive").select("text_hash", F.coalesce("positive", F.lit(False)).alias("positive"))


def errors_of(p: int, u: int, n_p: int, n_u: int) -> float:
    """Standard errors by which ``p`` of ``n_p`` exceeds ``u`` of ``n_u``: root of the likelihood ratio, sound for small counts."""
    at, of = p / (p + u), n_p / (n_p + n_u)
    return math.sqrt(2 * (p * math.log(at / of) + (u * math.log((1 - at) / (1 - of)) if u else 0.0))) if at > of else 0.0


def choose(counts: list[tuple[str, int, int]], n_p: int, n_u: int) -> list[tuple[str, int, int]]:
    """The features that the model weighs, of (feature, positive texts, unlabelled texts), best first.

    Of features that begin alike and have the same counts, which are the same texts' as a rule, the longest is taken.
    """
    told: dict[tuple[str, int, int], tuple[str, int, int]] = {}
    for w, p, u in sorted(counts):
        if p >= LEAST_TEXTS and errors_of(p, u, n_p, n_u) >= LEAST_ERRORS:
            same = (w.rstrip("*")[: STEMS[0]], p, u)
            told[same] = max(told.get(same, (w, p, u)), (w, p, u), key=lambda x: (len(x[0].rstrip("*")), -len(x[0])))
    return sorted(told.values(), key=lambda x: (-errors_of(x[1], x[2], n_p, n_u), x[0]))[:WORDS]


def fit(texts: DataFrame, text: str, marks: DataFrame, prior: float, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` positive and twice as many unlabelled texts, chosen by a hash; near copies count once.

    Only the sample's texts move, and only its band hashes, the counts of features that enough positive texts have, and
    feature numbers of its texts reach the driver: all are bounded by ``sample``. Without positive or unlabelled texts, or
    with a prior outside (0, 1), every score is the prior.
    """
    kinds = marks.groupBy("text_hash").agg(F.bool_or("positive").alias("positive")).withColumn("h", F.xxhash64("text_hash", F.lit("sample")))
    some = kinds.where("positive").orderBy("h", "text_hash").limit(sample).union(kinds.where("not positive").orderBy("h", "text_hash").limit(2 * sample))
    whole = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    held = whole.join(F.broadcast(some), "text_hash").groupBy("text_hash", "h", "positive").agg(F.first("text").alias("text")).select("h", "positive", "text").persist()
    try:
        with small_batches(held.sparkSession):
            return fitted(held, prior)
    finally:
        held.unpersist()


def fitted(held: DataFrame, prior: float) -> Model:
    """The model of (h, positive, text)."""
    ship(held.sparkSession)

    def sketched(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"h": pdf["h"], "positive": pdf["positive"], "bands": pd.Series([bands(t) for t in pdf["text"]], pdf.index, object)})

    drawn = [(r["h"], r["positive"], r["bands"]) for r in held.mapInPandas(sketched, "h long, positive boolean, bands array<long>").collect()]
    firsts = without_near_copies(drawn)
    n = sum(positive for h, positive, _ in drawn if h in firsts)
    u = len(firsts) - n
    if not n or not u or not 0 < prior < 1:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model({}, {}, (), math.log(p / (1 - p)), prior)

    def counted(it: Iterator[pd.DataFrame], likely: frozenset[str] | None, heads: frozenset[str] | None) -> Iterator[pd.DataFrame]:
        def out(seen: Counter) -> pd.DataFrame:
            return pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": np.array(list(seen.values()), np.int64)})

        seen: Counter = Counter()
        for pdf in it:
            for h, t in zip(pdf["h"], pdf["text"], strict=True):
                if h in firsts:
                    own = features(t, heads)
                    seen.update(own if likely is None else own & likely)
                if len(seen) > 200_000 and likely is None:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    def counts(which: str, likely: frozenset[str] | None, least: int) -> dict[str, int]:
        heads = None if likely is None else heads_of(likely)
        found = held.where(which).mapInPandas(lambda it: counted(it, likely, heads), "word string, n long")
        return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}

    toxic = counts("positive", None, LEAST_TEXTS)
    others = counts("not positive", frozenset(toxic), 1)
    chosen = choose([(w, p, others.get(w, 0)) for w, p in toxic.items()], n, u)
    vocabulary = [w for w, _, _ in chosen]
    shares = [prior * (p / n) / ((k + 0.5) / u) for _, p, k in chosen]
    tier = [max(k for k, t in enumerate(TIERS) if share >= t) for share in shares]
    number, heads = {w: i for i, w in enumerate(vocabulary)}, heads_of(vocabulary)

    def numbered(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf = pdf[pdf["h"].isin(firsts)]
            at = [sorted(number[w] for w in number.keys() & features(t, heads)) for t in pdf["text"]]
            yield pd.DataFrame({"h": pdf["h"], "positive": pdf["positive"], "at": pd.Series(at, pdf.index, object)})

    rows = sorted(held.mapInPandas(numbered, "h long, positive boolean, at array<int>").collect(), key=lambda r: (r["positive"], r["h"]))
    texts = [np.array(r["at"] + [len(vocabulary) + max((tier[i] for i in r["at"]), default=0)] * bool(r["at"]), int) for r in rows]
    w, b = risk_step(texts, np.array([r["positive"] for r in rows], bool), prior, len(vocabulary) + len(TIERS))
    return Model(dict(zip(vocabulary, map(float, w), strict=False)), dict(zip(vocabulary, tier, strict=True)), tuple(map(float, w[len(vocabulary) :])), b, prior, heads)


def curve(margins: np.ndarray, positive: np.ndarray, prior: float, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of log odds by margin: logistic regression by Newton's steps, both labels weighed by the prior.

    Its targets are Platt's, a little inside 0 and 1, so that it ends where a margin tells the labels apart. (1, 0) where
    it can't tell: without texts of both labels, with one margin for all, or with a slope that isn't positive.
    """
    n, k = len(positive), int(positive.sum())
    if not 0 < k < n or not 0 < prior < 1 or np.ptp(margins) == 0:
        return 1.0, 0.0
    target = np.where(positive, (k + 1) / (k + 2), 1 / (n - k + 2))
    weight = np.where(positive, prior / k, (1 - prior) / (n - k)) * n
    x = np.column_stack([np.clip(margins, -40, 40), np.ones(n)])

    def loss(at: np.ndarray) -> float:
        f = x @ at
        return float(weight @ (np.logaddexp(0, f) - target * f))

    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)))
        while loss(at - move) > loss(at) and np.abs(move).max() > 1e-9:
            move = move / 2
        at = at - move
        if np.abs(move).max() <= 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def calibrated(model: Model, docs: DataFrame, key: str, text: str, labels: DataFrame, positive: Column, sample: int = SAMPLE) -> Model:
    """The model with its curve, fitted on at most ``sample`` texts labelled positive and twice as many of the other label.

    They are chosen by a hash; ``labels`` is as for ``marked``, null labels are left out. Only hashes and margins move.
    """
    ship(docs.sparkSession)
    said = labels.select(F.col(key), positive.alias("positive")).where("positive is not null")
    kinds = hashed(docs, key, text).join(said, key).groupBy("text_hash").agg(F.bool_or("positive").alias("positive")).withColumn("h", F.xxhash64("text_hash", F.lit("sample")))
    some = kinds.where("positive").orderBy("h", "text_hash").limit(sample).union(kinds.where("not positive").orderBy("h", "text_hash").limit(2 * sample))
    whole = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([model.margin(x) for x in s], dtype="float64")

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    held = whole.join(F.broadcast(some), "text_hash").withColumn("margin", F.pandas_udf(run, "double")("text"))
    with small_batches(docs.sparkSession):
        rows = sorted(held.groupBy("text_hash", "positive").agg(F.min("margin").alias("margin")).collect())
    slope, offset = curve(np.array([r["margin"] for r in rows], float), np.array([r["positive"] for r in rows], bool), model.prior)
    return replace(model, slope=slope, offset=offset)


def prior_of(labelled: DataFrame, label: Column) -> float:
    """Share of label 1 among labelled rows."""
    r = labelled.agg(F.avg(F.when(label, 1.0).when(~label, 0.0))).first()[0]
    return float(r or 0.0)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out`` (0 to 1, double) from the whole text, in place of a column of that name.

    Null and empty texts get the score of no words. Repeated rows get equal scores. An empty table stays empty.
    """
    ship(df.sparkSession)

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([model.score(x) for x in s], dtype="float64")

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.drop(out).withColumn(out, F.pandas_udf(run, "double")(F.coalesce(F.col(text), F.lit(""))))
