"""Vector codes, Merkle manifests and best-fit packing against brute force, with nulls, ties, repeats, empty tables, clashes."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookloom.llm import best_fit, language, merkle, packing, quality, queries, vector_codes, vector_join, word_tokens
from brookloom.llm.shared import stage

from .test_llm import ODD, check_packed, odd_docs, raw

DATA = "/root/testdata/sf0.001"


# --- 11 vector codes
def brute_codes(rows, parts, entries, rounds, scale=4096):
    """rows (key, vector) of one length; {row number: (code, error)} and the codebooks, in Python's integers."""
    whole = [[int(np.floor(float(x) * scale)) for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, whole[i]))
    w = len(whole[0]) // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for c in cut:
                own[near(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(own[e]) for x in zip(*own[e], strict=True)) if e in own else books[p][e] for e in range(len(books[p]))]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    text = ",".join(str(c) for book in books for e in book for c in e)
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], hashlib.sha256(text.encode()).hexdigest()


def test_vector_codes(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in v]) for k, v in zip(rng.permutation(120), rng.normal(size=(120, 12)), strict=True)]
    rows += [(None, rows[0][1]), (5, rows[1][1]), (5, rows[1][1]), (-3, [0.0] * 12), (-2, [-1e-9] * 12)]
    odd = [(7, None), (8, [1.0] * 11 + [None]), (9, [1.0] * 11 + [float("nan")]), (10, [float("-inf")] + [1.0] * 11), (11, [1.0] * 7), (12, []), (13, [0.5] * 4)]
    df = spark.createDataFrame([(k, v, "clash", 1) for k, v in rows + odd], "id long, v array<double>, code string, Error int").repartition(3)
    whole = stage(vector_codes.whole_numbers(df, "v"), "t")
    books = vector_codes.learn(whole, "id", "v", parts=4, entries=10, rounds=3)
    out = vector_codes.encode(whole, "v", books)
    assert out.columns == ["id", "code", "error", "codebooks_sha256"]
    want, digest = brute_codes(rows, 4, 10, 3)
    short, short_digest = brute_codes([(13, [0.5] * 4)], 4, 10, 3)
    expected = collections.Counter((k, c, e, digest) for (k, _), (c, e) in zip(rows, want, strict=True))
    expected += collections.Counter([(11, None, None, None), (13, *short[0], short_digest), (12, "00000000", 0, hashlib.sha256(b"").hexdigest())])
    assert collections.Counter(map(tuple, out.collect())) == expected
    best = max(books[12].shape)
    assert best == 10 and vector_codes.decoded(want[0][0], books[12])[0] in books[12][0][:, 0]
    empty = whole.limit(0)
    assert vector_codes.learn(empty, "id", "v") == {} and vector_codes.encode(empty, "v", {}).collect() == []


def test_vector_codes_refuse_what_does_not_fit(spark):
    df = stage(vector_codes.whole_numbers(spark.createDataFrame([(1, [1e30] * 8)], "id long, v array<double>"), "v"), "t")
    with pytest.raises(Exception, match="squared distances"):
        vector_codes.learn(df, "id", "v")
    many = stage(vector_codes.whole_numbers(spark.createDataFrame([(n, [1.0] * (2 * n)) for n in range(70)], "id long, v array<double>"), "v"), "t")
    with pytest.raises(ValueError, match="lengths"):
        vector_codes.learn(many, "id", "v", parts=2)


@pytest.mark.parametrize("size", [1, 100, 1 << 20, 1 << 27])
def test_nearest_is_exact(size):
    """Entries so near to each other that single precision can't tell them, and ties."""
    rng = np.random.default_rng(size)
    book = rng.integers(-size, size + 1, (16, 8))
    book[5:9] = book[4] + rng.integers(-1, 2, (4, 8))
    book[12] = book[3]
    x = np.concatenate([rng.integers(-size, size + 1, (500, 8)), book, (book[4] + book[3]) // 2 + rng.integers(-2, 3, (50, 8))])
    exact = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)), k) for k, e in enumerate(book))[1] for r in x]
    assert vector_codes.nearest(x, book).tolist() == exact


# --- 12 Merkle manifest
def sha(*text):
    return hashlib.sha256("".join(text).encode()).hexdigest()


def brute_tree(leaves):
    """Root and, for each leaf, its siblings from below."""
    proofs, place, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(place):
            proofs[i] += [(p % 2 == 1, level[p ^ 1])] if p ^ 1 < len(level) else [(p % 2 == 1, None)]
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
        place = [p // 2 for p in place]
    return level[0], proofs


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_merkle_forest(spark, levels, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 50)
    sizes = {"": 1, "a": 2, "b": 3, "é": 64, "z": 301}
    rows = [(g, i // 3 if i % 5 else None, sha(g, str(i // 2)), "x") for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, h string, root string").repartition(5)
    made = merkle.forest(df, "g", ["k"], "h")
    out, roots = made.nodes.collect(), dict(made.roots.collect())
    assert len(out) == len(rows) and set(roots) == set(sizes)
    for g in sizes:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        root, proofs = brute_tree([r[2] for r in own])
        assert roots[g] == root and {r.root for r in out if r.g == g} == {root}
        want = collections.Counter((r[1], r[2], tuple(p)) for r, p in zip(own, proofs, strict=True))
        assert collections.Counter((r.k, r.h, tuple(tuple(s) for s in r.proof)) for r in out if r.g == g) == want
    folded = made.nodes.select("root", merkle.folded(F.col("h"), F.col("proof")).alias("f"), merkle.folded(F.lit("0"), F.col("proof")).alias("wrong"))
    assert folded.where("f <> root or wrong = root").isEmpty()
    assert merkle.forest(df.limit(0), "g", ["k"], "h").nodes.collect() == []


def brute_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf_of = lambda r, more=0: sha(*(field(x if k != 3 or x is None else x + more) for k, x in enumerate((r.doc_id, r.source, r.lang, r.n_chars, r.text))))
    by = collections.defaultdict(list)
    for r in rows:
        by[r.lang].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
        trees[lang] = own, *brute_tree([leaf_of(r) for r in own])
    root, outer = brute_tree([trees[x][1] for x in langs])
    out = []
    for lang, more in zip(langs, outer, strict=True):
        own, subroot, proofs = trees[lang]
        for r, proof in zip(own, proofs, strict=True):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            now = leaf_of(r, int(tampered))
            for left, s in [*proof, *more]:
                now = sha(now) if s is None else sha(s, now) if left else sha(now, s)
            out.append((r.doc_id, leaf_of(r), subroot, root, sha(*(s for _, s in [*proof, *more] if s is not None)), now, now == root))
    return out


def test_merkle_manifest(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, t, lang, rng.choice([None, "", "s"]), rng.choice([None, 5, 2**63 - 1])) for i, (t, lang) in enumerate((t, lang) for t in ODD for lang in ("en", "en", "en", None, "", "ü", "zz")[: rng.randrange(1, 8)])]
    rows += [(None, "x", "en", "s", 1)] * 3 + [(4, "again", "en", None, 2), (-6, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("root", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op12_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute_manifest(spark.read.parquet(str(tmp_path / "documents.parquet")).collect())
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(want)
    assert {v for *_, v in want} == {True, False}


# --- 13 best-fit packing
def word_ids(texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    return [tool.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_tokens_equal_the_library(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()] + ODD
    texts += ["Á E ́x", "ΣΑΣ ΟΔΟΣ", "a\x1cb\x1d c d e", "<|startoftext|>x <|ENDOFTEXT|>", "it's 'tis I'LL 12.5%"]
    tool = word_tokens.encoder(queries.vocabulary("word_bpe_49k.json"))
    for _ in range(2):  # the second time from memory
        assert [tool.encode(t or "") for t in texts] == [raw(x) for x in word_ids(texts)]
    long = "ab Cd\nef " * 300_000
    assert tool.encode(long) == raw(word_ids(["ab Cd ef"])[0]) * 300_000
    assert tool.encode("x" * 3_000_000) == raw(word_ids(["x" * 3_000_000])[0])
    with pytest.raises(ValueError, match="word ends"):
        word_tokens.WordEncoder(queries.vocabulary("byte_bpe_50k.json"))


def test_best_fit_packing(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(90, "w " * 4096, "en", "s", 1), (91, "w " * 2047, "en", "s", 1), (92, "w " * 2048, "en", "s", 1)], odd_docs(spark).schema))
    out = queries.op13_best_fit(spark, DATA, docs)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = out.collect()
    check_packed(rows, 2048)
    want = collections.Counter()
    for r in docs.collect():
        ids = word_ids([r.text])[0] + [0]
        want.update((r.doc_id, k, s, min(2048, len(ids) - s), zlib.crc32(raw(ids[s : s + 2048]))) for k, s in enumerate(range(0, len(ids), 2048)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert queries.op13_best_fit(spark, DATA, docs.limit(0)).collect() == []


def one_by_one(lengths, capacity):
    """Sequences of best fit, a document after the other, longest first."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_best_fit_is_best_fit():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([7, 20, 64])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 80))] + [rng.randrange(1, capacity + 1)] * rng.randrange(30)
        plan = best_fit.best_fit(collections.Counter(lengths), capacity)
        assert collections.Counter(n for c, p in plan for n in p * c) == collections.Counter(lengths)
        assert sorted(capacity - sum(p) for c, p in plan for _ in range(c)) == one_by_one(lengths, capacity)
    assert sum(c for c, _ in best_fit.best_fit({3: 10**12}, 10)) == 333_333_333_334  # the work is of the lengths, not of the rows


def test_both_plans_pack(spark):
    lengths = [min(64, max(1, int(random.Random(k).expovariate(1 / 20)))) for k in range(2000)]
    pieces = stage(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long"), "t")
    for plan in (packing.shortest_pack_first, best_fit.best_fit):
        check_packed(packing.pack(pieces, 64, ["doc_id"], plan=plan).collect(), 64)


# --- names of the user's own columns, and bounds
def test_columns_named_like_ours_stay(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "c", "v"), (2, [1.0, 0.0], "d", "w"), (3, None, "e", "x")], "id long, e array<double>, _class string, _V string")
    out = vector_join.near_duplicates(df, "id", "e", 0.9)
    assert {(r.id, r._class, r._V, r.n_links, r.component_id) for r in out.collect()} == {(1, "c", "v", 1, 1), (2, "d", "w", 1, 1), (3, "e", "x", 0, 3)}
    texts = spark.createDataFrame([("a b, c.", "mine")], "text string, _words string")
    assert quality.features(texts).select("_words", "n_words").first() == ("mine", 3)


def test_languages_are_bounded(spark):
    rows = [(f"wort{k % 7} und zeile {k}", "de") for k in range(60)] + [(f"word{k % 7} and line {k}", "en") for k in range(50)] + [(f"mot {k}", f"x{k % 40}") for k in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = language.learn(df, F.col("text"), F.col("lang"), most=2)
    assert model.languages == ["de", "en", "unknown"]
    assert len(language.learn(df, F.col("text"), F.col("lang")).languages) == language.MOST_LANGUAGES + 1
