"""Queries of this subpackage: thin, over whole tables, with the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookloom.llm import best_fit, chat, language, merkle, packing, quality, sentencepieces, sharding, shingle_join, token_store, toxicity, vector_codes, vector_join, word_tokens
from brookloom.llm.shared import scratch, ship, small_batches, stage, stage_path


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file on this machine; the executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    cut = packing.cut_texts(docs.select("doc_id", "text"), "text", vocabulary("byte_bpe_50k.json"), 1024, end_id=0, ids=False)
    with small_batches(spark):
        pieces = stage(cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens"), "pieces")
    return packing.pack(pieces, 1024, ["doc_id", "start"])


def op2_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary("piece_bpe_32k.model")
    ids = docs.withColumn("ids", sentencepieces.encoded(F.col("text"), path))
    back = ids.withColumn("decoded", sentencepieces.decoded(F.col("ids"), path))
    whole = F.col("decoded") == F.coalesce("text", F.lit(""))
    out = back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), whole.alias("round_trip"))
    with small_batches(spark):
        return stage(out, "sentencepieces")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    featured = stage(quality.features(docs).drop("text"), "quality")
    return quality.judge(featured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_join.near_duplicates(vectors, "vec_id", "embedding", 0.95).select("vec_id", "n_links", "component_id", "kept")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Fitted on confirmed toxic texts and on texts without a label, its curve on labelled ones, none of them held out."""
    toxic = F.col("toxic") == 1
    labels = table(spark, sf_dir, "labels").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = toxicity.marked(docs.where(~held_out()), "doc_id", "text", labels, toxic)
    model = toxicity.fit(docs.where(~held_out()), "text", marks, toxicity.prior_of(labels, toxic))
    return toxicity.calibrated(model, docs.where(~held_out()), "doc_id", "text", labels, toxic)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity_model(spark, sf_dir, docs), "text").select("doc_id", held_out().alias("held_out"), "score")
    with small_batches(spark):
        return stage(out.withColumn("predicted", (F.col("score") >= 0.7).cast("int")), "toxicity")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = stage_path(spark, "token-store")
    token_store.write(docs, path, "doc_id", "text", tokenizer=vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_store.digests_of(spark, path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = sharding.assign(rows, "doc_id", dict.fromkeys(range(16), 1.0), grown=dict.fromkeys(range(17), 1.0))
    stored = stage(placed.withColumn("law", F.lit("key")), "shards")
    return sharding.slots(stored, ["doc_id", "text_crc32", "size"], stored.count())


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, kept = chat.maximal(table(spark, sf_dir, "conversations"))
    out = chat.render(placed, kept)
    return out.select(F.col("conv").alias("conv_id"), "n_turns", "n_copies", "part", "rendered")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shingle_join.similar_groups(docs, "doc_id", "text", 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    with scratch() as kept:
        whole = stage(vector_codes.whole_numbers(rows, "embedding", 4096), "whole-vectors")
        books = vector_codes.learn(whole, "vec_id", "embedding", parts=8, entries=16, rounds=6)
        coded = stage(vector_codes.encode(whole, "embedding", books), "vector-codes")
        sums = stage(coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")), "label-errors")
        out = coded.join(sums, F.col("label").eqNullSafe(F.col("same")))
        kept.append(stage(out.select("vec_id", "code", "error", "label_error", "codebooks_sha256"), "coded"))
    return kept[0]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    changed = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in names]
    rows = docs.select("doc_id", "lang", merkle.leaf(*map(F.col, names)).alias("leaf"), F.when(tampered, merkle.leaf(*changed)).alias("changed"))
    with scratch() as kept:
        proved = merkle.manifest(rows, "leaf", "lang", ["doc_id"])
        out = proved.withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("proof")))
        proof = F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256")
        kept.append(stage(out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")), "manifest"))
    return kept[0]


def op13_best_fit(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    cut = packing.cut_texts(docs.select("doc_id", "text"), "text", vocabulary("word_bpe_49k.json"), 2048, end_id=0, ids=False, encoding=word_tokens.encoder)
    with scratch() as kept:
        with small_batches(spark):
            pieces = stage(cut.select("doc_id", (F.col("start") / 2048).cast("int").alias("piece"), "start", "length", "ids_crc32"), "pieces")
        kept.append(stage(best_fit.pack_best_fit(pieces, 2048, ["doc_id", "start"]).select(*pieces.columns, "sequence_id", "offset"), "packed"))
    return kept[0]


OP8_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM turns),
hashed AS (
  SELECT conv_id, pos, role, text, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM placed),
ends AS (SELECT conv_id, max(pos) AS last, arg_max(prefix, pos) AS prefix FROM hashed GROUP BY conv_id),
kinds AS (SELECT last, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM ends GROUP BY last, prefix),
shorter AS (SELECT DISTINCT h.prefix FROM hashed h JOIN ends e USING (conv_id) WHERE h.pos < e.last),
kept AS (SELECT * FROM kinds WHERE prefix NOT IN (SELECT prefix FROM shorter))
SELECT k.conv_id, k.last + 1 AS n_turns, k.n_copies, p.pos // 256 AS part,
  string_agg('<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10), '' ORDER BY p.pos) AS rendered
FROM kept k JOIN placed p USING (conv_id) GROUP BY k.conv_id, k.last, k.n_copies, p.pos // 256
"""


def reach_sql(nodes: str, key: str) -> str:
    """CTEs over links(x, y): ids(r, low), the smallest ``key`` that each row r of ``nodes`` reaches."""
    return f"""two_way AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
walk AS (SELECT r AS start, r AS place FROM {nodes} UNION SELECT start, y FROM walk JOIN two_way ON place = x),
ids AS (SELECT start AS r, min({key}) AS low FROM walk JOIN {nodes} n ON n.r = place GROUP BY start)"""


OP4_SQL = f"""
WITH RECURSIVE numbered AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sound AS MATERIALIZED (
  SELECT r, v, len(v) AS size FROM numbered WHERE len(v) > 0 AND list_count(v) = len(v)
    AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.r AS x, b.r AS y FROM sound a JOIN sound b ON a.r < b.r AND a.size = b.size WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
degree AS (SELECT r, count(*) AS n FROM (SELECT x AS r FROM links UNION ALL SELECT y FROM links) GROUP BY r),
{reach_sql("numbered", "n.vec_id")}
SELECT vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, i.low AS component_id, coalesce(i.low = vec_id, i.low IS NULL) AS kept
FROM numbered JOIN ids i USING (r) LEFT JOIN degree d USING (r)
"""

OP10_SQL = f"""
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sets AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM texts),
tokens AS MATERIALIZED (SELECT r, unnest(s) AS t FROM sets),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM tokens a JOIN tokens b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN sets a ON a.r = x JOIN sets b ON b.r = y WHERE 100 * n >= 90 * (len(a.s) + len(b.s) - n)),
{reach_sql("sets", "n.doc_id")}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, i.low AS component_id FROM sets JOIN ids i USING (r)
"""


def op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """One pair of CTEs a round: near(r, p, e, d), each part's nearest entry, and the codebook made of it."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT r, n, p, (min((d, e)))[2] AS e, (min((d, e)))[1] AS d FROM (
    SELECT c.r, c.n, c.p, b.e, CAST(sum((c.x - b.y) * (c.x - b.y)) AS BIGINT) AS d FROM pieces c JOIN book{k} b USING (n, p, j) GROUP BY c.r, c.n, c.p, b.e)
  GROUP BY r, n, p)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT b.n, b.p, b.e, b.j, CASE WHEN m.c IS NULL THEN b.y ELSE CAST((m.s - (m.s % m.c + m.c) % m.c) // m.c AS BIGINT) END AS y
  FROM book{k} b LEFT JOIN (SELECT n, p, e, j, count(*) AS c, sum(x) AS s FROM pieces JOIN near{k} USING (r, n, p) GROUP BY n, p, e, j) m USING (n, p, e, j))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY len(v) ORDER BY vec_id NULLS LAST, v) - 1 AS place FROM kept WHERE len(v) % {parts} = 0),
pieces AS MATERIALIZED (
  SELECT r, place, len(v) AS n, CAST(floor(i / (len(v) // {parts})) AS BIGINT) AS p, i % (len(v) // {parts}) AS j, v[i + 1] AS x
  FROM (SELECT r, place, v, unnest(range(len(v))) AS i FROM placed)),
book0 AS MATERIALIZED (SELECT n, p, place AS e, j, x AS y FROM pieces WHERE place < {entries}),
{", ".join(steps)},
codes AS (SELECT r, n, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r, n),
books AS (SELECT n, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book{rounds} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept LEFT JOIN codes USING (r) LEFT JOIN books USING (n)
"""


def h_sql(*fields: str) -> str:
    text = [f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || {f} END" for f in fields]
    return f"sha256({' || '.join(text)})"


def tree_sql(name: str, leaves: str, starts: str, start: str, proof: str) -> str:
    """CTEs over ``leaves`` (i, g, pos, h): NAME_nodes(g, lvl, pos, h), NAME_top(g, lvl, h), NAME_walk from the rows of ``starts``
    (i, g, pos) with ``start`` and ``proof``, a level at a time; NAME_end(i, g, h, proof) is its last level."""
    return f"""
{name}_nodes AS (
  SELECT g, 0 AS lvl, CAST(pos AS BIGINT) AS pos, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves}
  UNION ALL SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {name}_nodes WHERE n > 1 GROUP BY g, lvl, pos // 2),
{name}_top AS MATERIALIZED (SELECT g, lvl, h FROM {name}_nodes WHERE n = 1),
{name}_walk AS (
  SELECT i, g, CAST(pos AS BIGINT) AS pos, 0 AS lvl, {start} AS h, {proof} AS proof FROM {starts}
  UNION ALL SELECT w.i, w.g, w.pos // 2, w.lvl + 1, sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || s.h END), w.proof || coalesce(s.h, '')
  FROM {name}_walk w JOIN {name}_top t ON t.g = w.g AND w.lvl < t.lvl LEFT JOIN {name}_nodes s ON s.g = w.g AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1)),
{name}_end AS MATERIALIZED (SELECT i, g, w.h, proof FROM {name}_walk w JOIN {name}_top t USING (g, lvl))"""


#: strlen counts bytes. crc(b, k, c): a byte's CRC-32 after k bits; its table is looked up for each byte of the decimal doc_id.
OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT b, 0 AS k, b AS c FROM range(256) r(b) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8),
marked AS (
  SELECT d.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 7 = 0 AS tampered FROM documents d, crc_table),
hashed AS (
  SELECT row_number() OVER () AS i, doc_id, coalesce('=' || lang, '') AS g, {h_sql("doc_id", "source", "lang", "n_chars", "text")} AS h,
    CASE WHEN tampered AND n_chars IS NOT NULL THEN {h_sql("doc_id", "source", "lang", "(CAST(n_chars AS HUGEINT) + 1)", "text")} END AS changed FROM marked),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, coalesce(changed, h) AS given FROM hashed),
{tree_sql("own", "leaves", "leaves", "given", "''")},
subroots AS MATERIALIZED (SELECT row_number() OVER (ORDER BY g) AS i, '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, g AS lang, h FROM own_top),
over_leaves AS MATERIALIZED (
  SELECT e.i, s.g, s.pos, e.h AS given, e.proof AS below, s.h AS subroot FROM own_end e JOIN subroots s ON s.lang = e.g),
{tree_sql("all", "subroots", "over_leaves", "given", "below")}
SELECT doc_id, l.h AS leaf, subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM leaves l JOIN over_leaves o USING (i) JOIN all_end e USING (i) JOIN all_top t ON t.g = e.g
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sentencepieces": op2_sentencepieces,
    "op3_quality_rules": op3_quality_rules,
    "op4_vector_join": op4_vector_join,
    "op5_toxicity": op5_toxicity,
    "op6_token_store": op6_token_store,
    "op7_sharding": op7_sharding,
    "op8_chat": op8_chat,
    "op9_language": op9_language,
    "op10_shingle_join": op10_shingle_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_best_fit": op13_best_fit,
}

SQL: dict[str, str] = {
    "op4_vector_join": OP4_SQL,
    "op8_chat": OP8_SQL,
    "op10_shingle_join": OP10_SQL,
    "op11_vector_codes": op11_sql(),
    "op12_merkle_manifest": OP12_SQL,
}
