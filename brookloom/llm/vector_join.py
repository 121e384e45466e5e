"""Near-duplicate vectors: exact metric range join by cosine.

Unit vectors at cosine c or more lie within sqrt(2 - 2c) of each other. Pivots deal the vectors into cells by the nearest
pivot; a vector is copied into another cell only where the triangle inequality leaves room for a neighbour there; cells
are joined on their own, in pairs of blocks of bounded size, of which those too far apart in their distance to the pivot
are left out by the same inequality.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookloom.llm.shared import components, drop_stage, quoted, ship, stage, unused, without

#: Bytes of the vectors of a block in double precision; a task holds two blocks.
BLOCK_BYTES, LEAST_BLOCK = 8 << 20, 256
#: Rows of a block whose products are held at once.
TILE = 128
#: Blocks of different vectors for which there is one pivot, and pivots at most: they are broadcast.
BLOCKS_A_PIVOT, MOST_PIVOTS = 1, 4_096
#: Rings of equal width about a pivot, by which a cell is cut into blocks.
RINGS = 512
#: Slack for rounding where bounds are compared, far above the error of unit vectors' products.
SLACK = 1e-5


def per_block(size: int) -> int:
    """Vectors of ``size`` components in a block."""
    return max(LEAST_BLOCK, BLOCK_BYTES // (8 * size))


def sound(vector: str) -> Column:
    """The vector, or null where it is null, empty, zero, or holds a null or a component that isn't finite."""
    v = quoted(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0.0)
    return F.when(F.coalesce(good, F.lit(False)), v)


def unit(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), dtype=np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def pivots_of(classes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """By length, the vectors among the ``count`` with the smallest hashes; they decide what moves, never what is found.

    A length that has none of them is missing here.
    """
    found = classes.orderBy(F.xxhash64("class", F.lit("pivot")), "class").limit(count).select("v").collect()
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(len(r[0]), []).append(r[0])
    return {size: unit(pd.Series(vs)) for size, vs in by.items()}


def cells(classes: DataFrame, pivots: dict[int, np.ndarray], radius: float) -> DataFrame:
    """(size, cell, home, class, far): a row in the nearest pivot's cell, and a copy in each cell that a neighbour may be in.

    If x is at home with pivot p and y within ``radius`` of x, the triangle inequality gives d(y, p) <= d(y) + 2 * radius
    with d(y) the distance to y's nearest pivot; the bisector of p and y's pivot q gives the sharper
    d(y, p)^2 - d(y, q)^2 <= 2 * radius * d(p, q), by the same inequality along one line. A pair whose homes differ meets
    in the first of the two, so copies go only to cells before a vector's home. far: the distance to the cell's pivot.
    Cells hold vectors of one length; a length without pivots is one cell.
    """
    ship(classes.sparkSession)
    held = classes.sparkSession.sparkContext.broadcast({size: (p, np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))) for size, p in pivots.items()})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for size, same in pdf.groupby(pdf["v"].map(len)):
                for i in range(0, len(same), 1024):
                    part = same.iloc[i : i + 1024]
                    if size in held.value:
                        p, apart = held.value[size]
                        d = np.sqrt(np.maximum(0, 2 - 2 * unit(part["v"]) @ p.T))
                        home = d.argmin(axis=1)
                        least = d[np.arange(len(d)), home][:, None]
                        may = (d <= least + 2 * radius + SLACK) & (d * d - least * least <= 2 * radius * apart[home] + SLACK)
                        may &= np.arange(len(p)) <= home[:, None]
                    else:
                        d, home, may = np.zeros((len(part), 1)), np.zeros(len(part), int), np.ones((len(part), 1), bool)
                    row, cell = np.nonzero(may)
                    yield pd.DataFrame({"size": np.full(len(row), size, "int32"), "cell": cell.astype("int32"), "home": home[row] == cell, "class": part["class"].to_numpy()[row], "far": d[row, cell]})

    return classes.select("class", "v").mapInPandas(run, "size int, cell int, home boolean, class long, far double")


def block_pairs(dealt: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Members (size, cell, home, class, block), and pairs (size, cell, a, b, home) of blocks that may hold neighbours.

    Blocks are runs of rings about the pivot; a ring with more vectors than a block is cut by hash, so that a hot group is
    many blocks. a is a block at home; b is one at home, a <= b, or one of copies. Pairs whose distances to the pivot
    differ by more than ``radius`` hold none. Tables of rings have at most 2 * RINGS rows a cell.
    """
    most = F.greatest(F.lit(LEAST_BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("size")))).cast("long")
    ringed = dealt.withColumn("ring", F.least(F.floor(F.col("far") * (RINGS / 2)), F.lit(RINGS - 1)).cast("int"))
    where = ["size", "cell", "home"]
    rings = ringed.groupBy(*where, "ring").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    before = Window.partitionBy(*where).orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    rings = rings.withColumn("parts", F.ceil(F.col("n") / most).cast("int"))
    # a ring of several blocks counts as full ones, and the next ring begins a new one
    taken = F.when(F.col("parts") > 1, (F.col("parts") + 1) * most).otherwise(F.col("n"))
    rings = rings.withColumn("first", F.floor(F.coalesce(F.sum(taken).over(before), F.lit(0)) / most) + (F.col("parts") > 1).cast("int"))
    rings = stage(rings, "vector-rings")
    members = ringed.select(*where, "class", "ring").join(rings.select(*where, "ring", "first", "parts"), [*where, "ring"])
    members = members.select(*where, "class", (F.col("first") + F.pmod(F.xxhash64("class", F.lit("block")), F.col("parts"))).alias("block"))
    blocks = rings.select(*where, F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("block"), "low", "high")
    blocks = blocks.groupBy(*where, "block").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    a = blocks.where("home").select("size", "cell", F.col("block").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    b = blocks.withColumnRenamed("block", "b")
    near = (F.col("low") <= F.col("a_high") + radius + SLACK) & (F.col("a_low") <= F.col("high") + radius + SLACK) & (~F.col("home") | (F.col("a") <= F.col("b")))
    return members, a.join(b, ["size", "cell"]).where(near).select("size", "cell", "a", "b", "home")


def lowest(r: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest key reachable from each of ``a`` and ``b`` by the links (r, c) between them."""
    la, lb = a.copy(), b.copy()
    while True:
        na, nb = la.copy(), lb.copy()
        np.minimum.at(nb, c, na[r])
        np.minimum.at(na, r, nb[c])
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb


def close_pairs(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, r, c) for each run of rows of ``a`` from i on: where rows a[i + r] and b[c] have a product of ``least`` or more.

    A quarter of the components, those with most weight, bounds the product: the rest adds the product of its norms at
    most (Cauchy-Schwarz). Single precision does for the bound, with SLACK to spare; what it leaves is tested in double.
    """
    weight = np.argsort(-((a * a).sum(axis=0) + (b * b).sum(axis=0)), kind="stable")
    some = weight[: max(1, a.shape[1] // 4)]

    def bounds(m: np.ndarray) -> np.ndarray:
        part = m[:, some]
        rest = np.sqrt(np.maximum(0, (m * m).sum(axis=1) - (part * part).sum(axis=1)))
        return np.column_stack([part, rest]).astype(np.float32)

    fa, fb = bounds(a), np.ascontiguousarray(bounds(b).T)
    for i in range(0, len(a), TILE):
        r, c = np.nonzero(fa[i : i + TILE] @ fb >= np.float32(least - SLACK))
        if len(r) * 50 > len(b) * TILE:  # the bound says little here
            r, c = np.nonzero(a[i : i + TILE] @ b.T >= least)
        elif len(r):
            sure = np.concatenate([np.einsum("ij,ij->i", a[i + r[k : k + 65536]], b[c[k : k + 65536]]) for k in range(0, len(r), 65536)]) >= least
            r, c = r[sure], c[sure]
        if len(r):
            yield i, r, c


def join_blocks(members: DataFrame, pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(class, links, root): for each pair of blocks, the weights of a class's neighbours, and a forest that joins them.

    Two members of a cell, one of them at home, meet once. The forest's rows (class, root) number no more than the
    members in each run of rows whose labels change, however many links there are.
    """
    own = members.where("home").withColumnRenamed("block", "a").drop("home").join(pairs.select("size", "cell", "a", "b", F.col("home").alias("inner")), ["size", "cell", "a"])
    own = own.select("size", "cell", "a", "b", "inner", F.lit(True).alias("left"), "class")
    other = members.select("size", "cell", F.col("home").alias("inner"), F.col("block").alias("b"), "class").join(pairs.withColumnRenamed("home", "inner"), ["size", "cell", "b", "inner"])
    other = other.where(~(F.col("inner") & (F.col("a") == F.col("b")))).select("size", "cell", "a", "b", "inner", F.lit(False).alias("left"), "class")
    full = own.union(other).join(classes.select("class", "n", "v"), "class")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[pdf["left"]]
        same = len(first) == len(pdf) and bool(pdf["inner"].iloc[0]) and pdf["a"].iloc[0] == pdf["b"].iloc[0]
        second = first if same else pdf[~pdf["left"]]
        found: list[np.ndarray] = []
        if len(first) and len(second):
            a = unit(first["v"])
            b = a if same else unit(second["v"])
            ka, kb = first["class"].to_numpy(), second["class"].to_numpy()
            wa, wb = first["n"].to_numpy().astype(float), second["n"].to_numpy().astype(float)
            la = ka.copy()
            lb = la if same else kb.copy()
            ca, cb = np.zeros(len(a)), np.zeros(len(b))
            for i, r, c in close_pairs(a, b, least):
                keep = ka[i + r] != kb[c]
                if same:
                    keep &= i + r < c
                r, c = r[keep], c[keep]
                if not len(r):
                    continue
                to = min(i + TILE, len(a))
                ca[i:to] += np.bincount(r, wb[c], to - i)
                cb += np.bincount(c, wa[i + r], len(b))
                na, nb = lowest(r, c, la[i:to], lb)
                for old, new in ((la[i:to], na), (lb, nb)):
                    moved = new != old
                    found.append(np.unique(np.column_stack([old[moved], new[moved]]), axis=0))
                if same:
                    nb[i:to] = np.minimum(nb[i:to], na)
                    la = lb = nb
                else:
                    la[i:to], lb = na, nb
            links = [(ka, ca + cb if same else ca)] + ([] if same else [(kb, cb)])
            rows = [pd.DataFrame({"class": k[n > 0], "links": n[n > 0].astype("int64"), "root": k[n > 0]}) for k, n in links]
            edges = np.concatenate([np.zeros((0, 2), "int64"), *found])
            return pd.concat([*rows, pd.DataFrame({"class": edges[:, 0], "links": np.zeros(len(edges), "int64"), "root": edges[:, 1]})])
        return pd.DataFrame({"class": np.zeros(0, "int64"), "links": np.zeros(0, "int64"), "root": np.zeros(0, "int64")})

    return full.groupBy("size", "cell", "a", "b", "inner").applyInPandas(run, "class long, links long, root long")


def near_duplicates(df: DataFrame, key: str, vector: str, least: float = 0.95) -> DataFrame:
    """The input's columns with n_links, component_id and kept, one row per row of ``df``.

    Equal vectors are one class with a weight, so copies are counted and never paired. n_links: other rows at cosine
    ``least`` or more, in double precision. component_id: the smallest key reachable by links, the row's own included;
    kept: whether that is the row's own key. Vectors that are null, empty, zero or not finite link with nothing,
    and others only with those of their own length. A null key is never smallest: a row whose component has no key has a
    null component_id and is kept. Rows that repeat a key are rows of their own. An empty table stays empty. Columns of
    the input that have the names of the added ones are replaced.
    """
    df = without(df, ["n_links", "component_id", "kept"])
    own, v = unused(df, "_class", "_v")
    rows = df.withColumn(v, sound(vector)).withColumn(own, F.when(F.col(v).isNotNull(), F.xxhash64(v)))
    classes = stage(rows.where(F.col(own).isNotNull()).groupBy(F.col(own).alias("class"), F.col(v).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(quoted(key)).alias("low")), "vector-classes")
    sizes = classes.groupBy(F.size("v").alias("size")).count().collect()  # a row for each length of a vector
    keyed = rows.drop(v)
    if not sizes:
        return keyed.drop(own).withColumns({"n_links": F.lit(0).cast("long"), "component_id": quoted(key), "kept": F.lit(True)})
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    blocks = sum(r["count"] / per_block(r["size"]) for r in sizes)
    pivots = pivots_of(classes, min(MOST_PIVOTS, max(1, int(blocks / BLOCKS_A_PIVOT))))
    dealt = stage(cells(classes, pivots, radius), "vector-cells")
    found = stage(join_blocks(*block_pairs(dealt, radius), classes, least), "vector-links")
    drop_stage(dealt)
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    info = classes.select("class", "n", "low").join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    info = info.withColumn("component", F.coalesce("component", "class"))
    lows = info.groupBy("component").agg(F.min("low").alias("component_id"))
    info = info.join(lows, "component").select(F.col("class").alias(own), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = keyed.join(info, own, "left").drop(own)
    alone = F.when(F.col("n_links").isNull(), quoted(key)).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", alone).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    return out.withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("component_id") == quoted(key), F.lit(False)))
