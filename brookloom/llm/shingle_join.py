"""N-gram Jaccard self-join of texts: universe-partition pigeonhole, exact.

Two sets that are similar enough differ in at most H tokens, H fixed by their size band. Tokens are hashed into more
segments than H, so some segments agree whole. A set is indexed by a signature of each segment's subset, and in bands
where it is cheaper also by its one-deletion neighbourhoods, with which segments that differ by one token still meet.
Sets that share a signature meet in the cell of the smallest of them, where all pairs are verified exactly.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookloom.llm.quality import SPACE, let
from brookloom.llm.shared import components, drop_stage, parallelism, quoted, ship, small_batches, stage, unused, without

#: Members of a cell in one block, and their hashes on average, at most; a task holds two blocks of a cell at a time.
BLOCK, BLOCK_HASHES = 1_024, 1 << 18
#: Hashes of a group of small blocks that one call compares, on average.
GROUP_HASHES = 1 << 19
#: A signature is common if a sample of one text in SAMPLE holds it COMMON times, and more than one COMMON_PARTS-th of the sample.
SAMPLE, COMMON, COMMON_PARTS = 64, 1_000, 100_000
#: Keys that a task remembers, so as to make a set's signatures once; then it begins anew.
SEEN = 100_000
#: Rows that may be broadcast to find the texts of candidates; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
LONGEST = 1 << 31


@dataclass(frozen=True)
class Bands:
    """By band: largest size, segments, those of them with one-deletion neighbourhoods, and slack."""

    high: np.ndarray
    segments: np.ndarray
    neighbours: np.ndarray
    slack: np.ndarray


def agreeing(m: int, k: int, h: int) -> int:
    """Segments that still meet, at least, when ``h`` tokens differ: one of them parts a plain segment, two one of ``k``."""
    return m - min(h, m - k) - max(0, h - (m - k)) // 2


def allocate(size: int, h: int, slack: int, weak: float = 20.0) -> tuple[int, int]:
    """(segments, those with neighbourhoods) that cost least and leave ``slack`` + 1 agreeing segments.

    The cost is the signatures of a set of ``size`` tokens, and ``weak`` for each segment whose few tokens (half as
    telling with each token less) would meet those of other sets by chance.
    """
    best = (math.inf, 0, 0)
    for k_all in (False, True):
        m = h + 1 + slack if not k_all else h // 2 + 1 + slack
        k = m if k_all else 0
        while agreeing(m, k, h) < slack + 1:
            m += 1
            k = m if k_all else 0
        each = size / m
        cost = m + k * each + weak * m * 0.5**each
        best = min(best, (cost, m, k))
    return best[1], best[2]


def bands(num: int, den: int) -> Bands:
    """Bands for a similarity of num / den: a set's partners are in its own band or one next to it."""
    high, segments, neighbours, slacks = [], [], [], []
    low = 1
    while low < LONGEST:
        top = max(low, low * den // num)
        h = (top + top * den // num) * (den - num) // (den + num)
        slack = -(-h // 8) if h > 2 else 0
        m, k = allocate((low + top) // 2, h, slack)
        for xs, x in zip((high, segments, neighbours, slacks), (top, m, k, slack), strict=True):
            xs.append(x)
        low = top + 1
    return Bands(*(np.array(x, np.int64) for x in (high, segments, neighbours, slacks)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray, table: Bands) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sig, key, band, slack, own) for the sets in ``flat``: under their own band, and under the one below it."""
    at = np.searchsorted(table.high, sizes)
    starts = np.cumsum(sizes) - sizes
    for below in (0, 1):
        pick = np.flatnonzero((sizes > 0) & (at >= below))
        if not len(pick):
            continue
        band = at[pick] - below
        n, m, k = sizes[pick], table.segments[band], table.neighbours[band]
        doc = np.repeat(np.arange(len(pick)), n)
        tokens = mix(flat[np.repeat(starts[pick] - (np.cumsum(n) - n), n) + np.arange(len(doc))])
        seg = ((tokens >> np.uint64(32)).astype(np.int64)) % m[doc]
        first = np.cumsum(m) - m
        slot = first[doc] + seg
        parts = mix(tokens + np.uint64(0x9E3779B97F4A7C15))
        sums = np.zeros(int(m.sum()), np.uint64)
        np.add.at(sums, slot, parts)
        owner = np.repeat(np.arange(len(pick)), m)
        place = (np.arange(len(sums)) - first[owner]).astype(np.uint64) + (band[owner].astype(np.uint64) << np.uint64(40))
        salt = mix(place + np.uint64(1))
        yield mix(sums ^ salt), keys[pick][owner], band[owner], table.slack[band[owner]], np.full(len(owner), below == 0)
        near = np.flatnonzero(seg < k[doc])
        if len(near):
            s, o = slot[near], doc[near]
            yield mix((sums[s] - parts[near]) ^ salt[s]), keys[pick][o], band[o], table.slack[band[o]], np.full(len(o), below == 0)


def shingled(text: Column, width: int) -> Column:
    """The sorted 64-bit hashes of the distinct ``width``-word shingles; fewer words are one shingle, none give no hash."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), SPACE), lambda w: w != "")

    def hashes(ws: Column) -> Column:
        each = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (width - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(ws, i + j) for j in range(1, width)]))
        return F.when(F.size(ws) >= width, F.sort_array(F.array_distinct(each))).when(F.size(ws) > 0, F.array(F.xxhash64(ws, F.lit("short"))))

    return F.coalesce(let(words, hashes), F.array().cast("array<bigint>"))


def signature_rows(sets: DataFrame, table: Bands) -> DataFrame:
    """Signature rows of (key, hashes); a task gives those of a key once for SEEN different keys, however many copies it reads."""
    ship(sets.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in it:
            if len(seen) > SEEN:
                seen.clear()
            new = [i for i, key in enumerate(pdf["key"].tolist()) if not (key in seen or seen.add(key))]
            pdf = pdf.iloc[new]
            sizes = np.array([len(x) for x in pdf["hashes"]], np.int64)
            for i, j in chunks(sizes, 262_144):
                flat = np.concatenate([*pdf["hashes"].iloc[i:j], np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
                for sig, key, band, slack, own in signatures(pdf["key"].to_numpy()[i:j], sizes[i:j], flat, table):
                    yield pd.DataFrame({"sig": sig.view(np.int64), "key": key, "meta": ((band * 2 + own) << 32) + slack})
        del seen
        released()

    return sets.mapInPandas(run, "sig long, key long, meta long")


def released() -> None:
    """Give what this worker has freed back to the system: it waits for its next task beside the JVM's stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    i, held = 0, 0
    for j, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield i, j
            i, held = j, 0
        held += n
    if i < len(sizes):
        yield i, len(sizes)


def common_signatures(sample: DataFrame) -> DataFrame:
    """(sig): signatures that a task shouldn't sort alone, by the signature rows of one text in SAMPLE.

    The sample decides how they are counted and not what is found. Each is one COMMON_PARTS-th of it or more, so no more than
    COMMON_PARTS are found.
    """
    seen = stage(sample.select("sig"), "signature-sample")
    least = max(COMMON, math.ceil(seen.count() / COMMON_PARTS))
    found = stage(seen.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("sig"), "common-signatures")
    drop_stage(seen)
    return found


def cells(rows: DataFrame, common: DataFrame) -> DataFrame:
    """(hub, key): sets that share a signature meet in the cell of the smallest of them.

    A set leaves out its most frequent signatures, as many as its band's slack. Similar sets share more than the slack,
    and all sets rank signatures alike, so the rarest one that two similar sets share is left out by neither; and a set
    that shares no more than the slack with all others is out. Common signatures are counted by partial sums and joined to
    their rows where these lie, others within a task.
    """
    told = {"n": F.count(F.lit(1)), "hub": F.min("key"), "top": F.max("key"), "own": F.max(F.col("meta").bitwiseAND(1 << 32))}
    alike = Window.partitionBy("sig")
    if common.isEmpty():
        met = rows.select("*", *[c.over(alike).alias(k) for k, c in told.items()])
    else:
        rows = stage(rows, "signature-rows")
        rare = rows.join(F.broadcast(common), "sig", "left_anti")
        hot = rows.join(F.broadcast(common), "sig", "left_semi")
        of_hot = F.broadcast(hot.groupBy("sig").agg(*[c.alias(k) for k, c in told.items()]))
        met = rare.select("*", *[c.over(alike).alias(k) for k, c in told.items()]).unionByName(hot.join(of_hot, "sig"))
    met = met.where("hub < top and own > 0").select("sig", "key", "hub", "n", F.shiftright("meta", 33).alias("band"), F.col("meta").bitwiseAND((1 << 32) - 1).alias("slack"))
    met = stage(met.distinct(), "signatures")
    drop_stage(rows)
    rank = F.row_number().over(Window.partitionBy("key", "band").orderBy(F.desc("n"), "sig"))
    kept = met.withColumn("rank", rank).where(F.col("rank") > F.col("slack"))
    found = stage(kept.select("hub", "key").distinct(), "cells")
    drop_stage(met)
    return found


class Index:
    """Sets of 64-bit hashes, by which all those similar to one of them are found at once."""

    def __init__(self, hashes: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.sizes = num, den, np.array([len(x) for x in hashes], np.int64)
        _, self.ids = np.unique(np.concatenate(hashes), return_inverse=True)
        owner = np.repeat(np.arange(len(hashes)), self.sizes)
        self.posts, self.count = owner[np.argsort(self.ids, kind="stable")], np.bincount(self.ids)
        self.first, self.start = np.cumsum(self.count) - self.count, np.cumsum(self.sizes) - self.sizes

    def similar(self, x: int) -> np.ndarray:
        own = self.ids[self.start[x] : self.start[x] + self.sizes[x]]
        c = self.count[own]
        at = np.repeat(self.first[own] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        both = np.bincount(self.posts[at], minlength=len(self.sizes))
        return self.den * both >= self.num * (self.sizes + self.sizes[x] - both)


def forest(index: Index, keys: np.ndarray, probes: Iterable[int], allowed: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that join each probe to the similar sets that are ``allowed``, without those between sets joined already."""
    label, a, b = np.unique(keys, return_inverse=True)[1], [], []
    for x in probes:
        y = np.flatnonzero(index.similar(x) & allowed)
        y = y[label[y] != label[x]]
        if len(y):
            groups, one = np.unique(label[y], return_index=True)
            a += [int(keys[x])] * len(groups)
            b += keys[y[one]].tolist()
            merged = np.append(groups, label[x])
            label[np.isin(label, merged)] = merged.min()
    return a, b


def dealt(rows: DataFrame, sets: DataFrame, by: list[str], hashes: int) -> DataFrame:
    """The rows with their hashes, in groups (part) of whole blocks (``by``) whose number follows the hashes that are compared."""
    parts = max(parallelism(rows.sparkSession) * 4, math.ceil(hashes / GROUP_HASHES))
    return rows.withColumn("part", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")).join(sets.select("key", "hashes"), "key")


def links(met: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): edges that connect the similar sets of each cell of ``met`` (hub, key), as they connect in truth.

    Each member is compared with the cell's smallest one first. Those similar to it are connected by that, so only the
    rest is compared with all: of a large group of near copies few pairs are left. Cells of several blocks are compared
    block by block: the rest's blocks with all blocks, two of them at a time in a task.
    """
    sizes = met.join(sets.select("key", F.size("hashes").cast("long").alias("size")), "key")
    stats = sizes.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("total"), F.min("key").alias("pivot")).where("members > 1")
    stats = stage(stats.withColumn("blocks", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") / BLOCK_HASHES)).cast("int")), "cell-sizes")
    held = met.join(stats, "hub").where("key <> pivot")
    block = F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int")
    own = held.select("hub", block.alias("block"), F.col("blocks").alias("of"), F.lit(False).alias("first"), "key")
    pivots = stats.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("blocks").alias("of"), F.lit(True).alias("first"), F.col("pivot").alias("key"))
    total = stats.agg(F.sum("total")).first()[0] or 0

    def frame(hub: list[int], a: list[int], b: list[int | None]) -> pd.DataFrame:
        return pd.DataFrame({"hub": np.array(hub, np.int64), "a": np.array(a, np.int64), "b": pd.array(b, "Int64")})

    def against_first(pdf: pd.DataFrame) -> pd.DataFrame:
        hubs, a, b = [], [], []
        for (hub, _), cell in pdf.groupby(["hub", "block"], sort=False):
            if len(cell) < 2 or not cell["first"].any():
                continue
            index, keys = Index(cell["hashes"].tolist(), num, den), cell["key"].to_numpy()
            at = int(np.flatnonzero(cell["first"].to_numpy())[0])
            near = index.similar(at)
            near[at] = False
            x, y = [int(keys[at])] * int(near.sum()), keys[near].tolist()
            rest = np.flatnonzero(~near & (np.arange(len(keys)) != at))
            if cell["of"].iloc[0] == 1:
                more = forest(index, keys, rest, np.arange(len(keys)) != at)
                x, y = x + more[0], y + more[1]
            else:
                x, y = x + keys[rest].tolist(), y + [None] * len(rest)
            hubs += [hub] * len(x)
            a += x
            b += y
            del index, cell
        del pdf
        released()
        return frame(hubs, a, b)

    found = stage(dealt(own.union(pivots), sets, ["hub", "block"], total).groupBy("part").applyInPandas(against_first, "hub long, a long, b long"), "first-links")
    edges = found.where("b is not null").select("a", "b")
    rest = found.where("b is null").select("hub", F.col("a").alias("key"))
    few = rest.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).withColumn("rests", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    if few.isEmpty():
        return edges
    odd = stats.join(few, "hub").select("hub", "blocks", "pivot", "rests", "total")
    probes = rest.join(odd, "hub").withColumn("i", F.pmod(F.xxhash64("key", F.lit("rest")), F.col("rests")).cast("int"))
    probes = probes.select("hub", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("probe"), "key")
    others = met.join(odd, "hub").where("key <> pivot").withColumn("j", block)
    others = others.select("hub", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), "j", F.lit(False).alias("probe"), "key")
    work = odd.agg(F.sum(F.col("total") * F.col("rests") * 2)).first()[0]

    def against_all(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, pair in pdf.groupby(["hub", "i", "j"], sort=False):
            probe, keys = pair["probe"].to_numpy(), pair["key"].to_numpy()
            if probe.any() and not probe.all():
                x, y = forest(Index(pair["hashes"].tolist(), num, den), keys, np.flatnonzero(probe), ~probe)
                a += x
                b += y
        del pdf
        released()
        return frame([0] * len(a), a, b)[["a", "b"]]

    pairs = dealt(probes.union(others), sets, ["hub", "i", "j"], work).groupBy("part").applyInPandas(against_all, "a long, b long")
    return edges.union(pairs)


def similar_groups(df: DataFrame, key: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """The input's columns without ``text``, with n_shingles and component_id, one row per row of ``df``.

    Two rows link when their shingle sets have a Jaccard similarity of num / den or more; component_id is the smallest
    key reachable by links, the row's own included. A null or empty text, or one without words, has no shingles and links
    with nothing. Equal sets are one node however many rows have them. Null keys are never smallest; a component without
    any key has a null id. Rows that repeat a key are rows of their own. An empty table stays empty. Shingles are told
    apart by 64-bit hashes.
    """
    spark = df.sparkSession
    df = without(df, ["n_shingles", "component_id"])
    own, hashes, text_hash = unused(df, "_node", "_hashes", "_text_hash")
    hashed = df.withColumn(hashes, shingled(quoted(text), width))
    node = F.when(F.size(hashes) > 0, F.xxhash64(hashes, F.lit("set"))).alias(own)
    others = [quoted(c) for c in df.columns if c != text]
    base = stage(hashed.select(*others, F.size(hashes).cast("long").alias("n_shingles"), node, F.xxhash64(quoted(text)).alias(text_hash)), "shingle-sets")

    def sets_of(rows: DataFrame) -> DataFrame:
        return rows.withColumn(hashes, shingled(quoted(text), width)).select(node.alias("key"), F.col(hashes).alias("hashes")).where("key is not null")

    with small_batches(spark):
        common = common_signatures(signature_rows(sets_of(df.sample(1 / SAMPLE, seed=1)), bands(num, den)))
        met = cells(signature_rows(sets_of(df), bands(num, den)), common)
    wanted = met.select(F.col("key").alias(own)).distinct()
    # one text of each node before the join, so that copies are no hot key
    nodes = base.where(F.col(own).isNotNull())
    texts_of = nodes.groupBy(own).agg(F.min(text_hash).alias("text_hash"))
    chosen = stage(texts_of.join(wanted, own, "left_semi").select("text_hash").distinct(), "candidate-texts")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    texts = df.select(quoted(text).alias("text")).withColumn("text_hash", F.xxhash64("text")).join(chosen, "text_hash", "left_semi")
    once = texts.groupBy("text_hash").agg(F.first("text").alias("text")).select(shingled(F.col("text"), width).alias("hashes"))
    stored = stage(once.select(F.xxhash64("hashes", F.lit("set")).alias("key"), "hashes"), "candidate-sets")
    with small_batches(spark):
        found = stage(links(met, stored, num, den), "shingle-links")
    drop_stage(met, stored, chosen, common)
    roots = components(found).withColumnRenamed("node", own)
    lows = nodes.groupBy(own).agg(F.min(quoted(key)).alias("low"))
    named = lows.join(roots, own, "left").withColumn("component", F.coalesce("component", own))
    ids = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(ids, "component").select(own, "component_id")
    out = base.drop(text_hash).join(named, own, "left")
    return out.withColumn("component_id", F.when(F.col(own).isNull(), quoted(key)).otherwise(F.col("component_id"))).drop(own)
