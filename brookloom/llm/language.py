"""Language ID by Bayesian evidence fusion. DataFrame operations only.

The posterior of a language takes the likelihood of the text's character n-grams, of the language that the markup declares
and of the address suffix, and a prior by host that leans on those of the host's domain and all rows. Languages and
likelihoods are learned from labelled rows by grouped aggregation. One more class stands for every other language: its
n-grams are spread evenly, so a text that looks like none of the learned languages is told from them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookloom.llm.quality import let
from brookloom.llm.shared import quoted, stage, without

#: Hashed n-grams are told apart by so many buckets.
BUCKETS = 4_096
#: Likelihoods of n-grams are counted on about so many different texts of each language, chosen by their hashes; values
#: of a label with fewer rows than LEAST_ROWS are no language of the model.
SAMPLE, LEAST_ROWS = 2_000, 5
#: Languages that are learned at most: each adds a table of n-grams to every row's plan.
MOST_LANGUAGES = 32
#: Share of each language's likelihood that is spread evenly over the buckets.
EVEN = 0.1
#: Rows by which a host leans on its domain, and a domain on all rows.
LEAN = 10.0
#: N-grams of a text speak for a language at most as strongly as so many: they aren't independent.
MOST_GRAMS = 50.0
#: Address suffixes that are told apart, the most frequent ones; the others are one value.
MOST_SUFFIXES = 64
UNKNOWN = "unknown"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def grams_of(words: Column) -> Column:
    """Buckets of a word's n-grams: of one of four letters at most the word, else its first and its last three letters."""
    ends = F.transform(words, lambda w: bucket(F.when(F.length(w) <= 4, F.concat(F.lit("="), w)).otherwise(F.concat(F.lit("-"), F.substring(w, -3, 3)))))
    starts = F.transform(F.filter(words, lambda w: F.length(w) > 4), lambda w: bucket(F.concat(F.substring(w, 1, 3), F.lit("-"))))
    return F.concat(ends, starts)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def suffix_of(host: Column) -> Column:
    return F.when(F.instr(host, ".") > 0, F.element_at(F.split(host, r"\."), -1)).otherwise("")


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def markup_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^<>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))


def without_blocks(text: Column, opens: str, closes: str) -> Column:
    """The text without what lies between; what is never closed goes to the end. Each character is looked at once."""
    return F.array_join(F.transform(F.split(text, closes), lambda part: F.regexp_replace(part, f"(?is){opens}.*", " ")), " ")


def markup_text(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments, navigation and tags, in time linear in its length."""
    t = without_blocks(F.coalesce(html, F.lit("")), "<!--", "-->")
    for tag in ("script", "style", "nav", "head", "footer"):
        t = without_blocks(t, rf"<{tag}\b", rf"(?i)</{tag}\s*>")
    return F.regexp_replace(F.regexp_replace(t, r"<[^<>]*>", " "), r"&[#A-Za-z0-9]{1,32};", " ")


@dataclass(frozen=True)
class Grams:
    """languages: by name, at last the unknown one; scores: of each, the log likelihood of each bucket."""

    languages: list[str]
    scores: list[list[float]]


def gram_model(languages: list[str], counts: dict[tuple[str, int], int]) -> Grams:
    scores = []
    for lang in languages:
        own = [counts.get((lang, b), 0) for b in range(BUCKETS)]
        total = max(1, sum(own))
        scores.append([round(math.log((1 - EVEN) * n / total + EVEN / BUCKETS), 4) for n in own])
    return Grams([*languages, UNKNOWN], [*scores, [round(-math.log(BUCKETS), 4)] * BUCKETS])


def learn(labelled: DataFrame, text: Column, label: Column, sample: int = SAMPLE, most: int = MOST_LANGUAGES) -> Grams:
    """Likelihoods of n-grams by language, from about ``sample`` different texts each.

    Languages are the labels that LEAST_ROWS rows or more have, the ``most`` frequent of them: texts of others are of the
    unknown class. What reaches the driver, the plans and the rows of hosts is bounded by that. Counts of rows and texts cover the table; the sample is
    chosen by the texts' hashes, and equal texts count once. At most BUCKETS rows a language reach the driver.
    """
    rows = labelled.select(F.lower(F.coalesce(label, F.lit(""))).alias("lang"), text.alias("text")).where("lang <> ''").withColumn("h", F.xxhash64("text"))
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts")).where((F.col("n") >= LEAST_ROWS) & (F.col("lang") != UNKNOWN)).orderBy(F.desc("n"), "lang").limit(most).collect()
    shares = {r["lang"]: min(1.0, sample / r["texts"]) for r in found}
    if not shares:
        return gram_model([], {})
    spark = labelled.sparkSession
    wanted = spark.createDataFrame([(k, math.ceil(v * 1_000_000)) for k, v in shares.items()], "lang string, most long")
    some = rows.join(F.broadcast(wanted), "lang").where(F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1_000_000)) < F.col("most"))
    once = some.groupBy("lang", "h").agg(F.first("text").alias("text"))
    counts = once.select("lang", F.explode(grams_of(words_of(F.col("text")))).alias("b")).groupBy("lang", "b").agg(F.count(F.lit(1)).alias("n"))
    return gram_model(sorted(shares), {(r["lang"], r["b"]): r["n"] for r in counts.collect()})


def scored(df: DataFrame, text: Column, model: Grams) -> DataFrame:
    """Add n_words and _text, the log likelihoods of the whole text by language, as if at most MOST_GRAMS were independent."""
    tables = [F.split(F.lit(",".join(map(str, s))), ",").cast("array<double>") for s in model.scores[:-1]]
    even = model.scores[-1][0]

    def fit(grams: Column, table: Column) -> Column:
        return F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(table, b))

    def of(words: Column) -> Column:
        def fits(grams: Column) -> Column:
            damp = F.least(F.lit(1.0), F.lit(MOST_GRAMS) / F.greatest(F.size(grams), F.lit(1)))
            return F.transform(F.array(*[fit(grams, t) for t in tables], F.size(grams) * F.lit(even)), lambda s: s * damp)

        return F.struct(F.size(words).cast("long").alias("n_words"), let(grams_of(words), fits).alias("scores"))

    out = without(df, ["n_words", "_text", "_scored"]).withColumn("_scored", let(words_of(text), of))
    return out.withColumns({"n_words": F.col("_scored.n_words"), "_text": F.col("_scored.scores")}).drop("_scored")


def best(scores: Column, languages: list[str]) -> Column:
    """struct(cost, lang) of the highest score; of equal ones the first language by name, and unknown last."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("cost"), i.alias("i")))
    return let(F.array_min(pairs), lambda p: F.struct(p["cost"].alias("cost"), F.element_at(F.array(*map(F.lit, languages)), p["i"] + 1).alias("lang")))


def table_of(counts: DataFrame, by: str, values: list[str], languages: list[str]) -> dict[str, list[float]]:
    """By value, log chance of it given each language, smoothed by one row a value; other values are one, named *."""
    seen = {(r["text_lang"], r[by]): float(r["n"]) for r in counts.collect()}
    out: dict[str, list[float]] = {v: [] for v in [*values, "*"]}
    for lang in languages:
        own = {v: seen.get((lang, v), 0.0) + 1.0 for v in out}
        for v, n in own.items():
            out[v].append(math.log(n / sum(own.values())))
    return out


def lookup(value: Column, table: dict[str, list[float]]) -> Column:
    """Log chances of the value by language; an empty or null one says nothing."""
    none = F.array(*[F.lit(0.0)] * len(table["*"]))
    out = F.when(F.coalesce(value, F.lit("")) == "", none)
    for v, p in table.items():
        if v != "*":
            out = out.when(value == v, F.array(*map(F.lit, p)))
    return out.otherwise(F.array(*map(F.lit, table["*"])))


def known(value: Column, values: list[str]) -> Column:
    return F.when(value.isin(values), value).otherwise(F.lit("*")) if values else F.lit("*")


def fuse(features: DataFrame, languages: list[str]) -> DataFrame:
    """Add lang_id, probability, text_lang to a stored table with _text, n_words, declared, suffix and host.

    Each row's say in the tables of evidence is that of its text. Tables of declared languages and suffixes are bounded by
    the languages and MOST_SUFFIXES; statistics of hosts and domains grow with the input, are summed before any shuffle,
    and are joined by it. A row's own say is left out of the priors of its host and domain.
    """
    width = len(languages)
    judged = features.withColumn("text_lang", F.when(F.col("n_words") > 0, best(F.col("_text"), languages)["lang"]))
    sure = judged.where("text_lang is not null")
    one = F.count(F.lit(1)).alias("n")
    tables = {}
    common = sure.where("suffix <> ''").groupBy("suffix").agg(one).orderBy(F.desc("n"), "suffix").limit(MOST_SUFFIXES).collect()
    for by, values in (("declared", languages[:-1]), ("suffix", sorted(r["suffix"] for r in common))):
        counts = sure.where(F.col(by) != "").groupBy("text_lang", known(F.col(by), values).alias(by)).agg(one)
        tables[by] = table_of(counts, by, values, languages)
    shares = {r["text_lang"]: float(r["n"]) for r in sure.groupBy("text_lang").agg(one).collect()}
    total = sum(shares.values()) + width
    share = [(shares.get(k, 0.0) + 1.0) / total for k in languages]
    by_host = sure.withColumn("domain", domain_of(F.col("host"))).groupBy("host", "domain").agg(*[F.count_if(F.col("text_lang") == k).alias(f"h_{i}") for i, k in enumerate(languages)])
    by_domain = by_host.groupBy("domain").agg(*[F.sum(f"h_{i}").alias(f"d_{i}") for i in range(width)])
    votes = by_host.join(by_domain, "domain").select("host", F.array(*[F.col(f"h_{i}") for i in range(width)]).alias("_h"), F.array(*[F.col(f"d_{i}") for i in range(width)]).alias("_d"))
    out = judged.join(votes, "host", "left")
    none = F.array(*[F.lit(0).cast("long")] * width)
    names = F.array(*map(F.lit, languages))

    def others(seen: str) -> Column:
        own = F.transform(names, lambda k: (k == F.col("text_lang")).cast("long"))
        return F.when(F.col(seen).isNull(), none).when(F.col("text_lang").isNull(), F.col(seen)).otherwise(F.zip_with(F.col(seen), own, lambda a, b: a - b))

    def added(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def leaning(seen: Column, base: Column) -> Column:
        return let(seen, lambda s: F.zip_with(s, base, lambda n, p: (n + LEAN * p) / (added(s) + LEAN)))

    prior = leaning(others("_h"), leaning(others("_d"), F.array(*map(F.lit, share))))
    parts = [F.transform(prior, lambda p: F.log(p)), F.col("_text"), lookup(F.col("declared"), tables["declared"]), lookup(F.col("suffix"), tables["suffix"])]
    total_of = parts[0]
    for p in parts[1:]:
        total_of = F.zip_with(total_of, p, lambda a, b: a + b)
    out = out.withColumn("_all", total_of).withColumn("_best", best(F.col("_all"), languages))
    share_of = 1 / F.aggregate(F.col("_all"), F.lit(0.0), lambda a, s: a + F.exp(s + F.col("_best.cost")))
    return out.withColumns({"lang_id": F.col("_best.lang"), "probability": share_of}).drop("_best", "_all", "_h", "_d", "_text")


def decided(features: DataFrame, languages: list[str], least: float) -> DataFrame:
    wrong = (F.col("n_words") == 0) | (F.col("lang_id") == UNKNOWN) | (F.col("probability") < least)
    return fuse(features, languages).withColumn("rejected", wrong)


def identify_pages(pages: DataFrame, texts: DataFrame, least: float = 0.6) -> DataFrame:
    """One row per page: page_id, host, suffix, declared, n_words, text_lang, lang_id, probability, rejected.

    ``texts`` (text, lang) teaches the languages. rejected: the text has no words, is most likely of none of them (lang_id
    unknown), or no language reaches ``least``. Null urls and markup count as empty: they say nothing. Repeated rows stay.
    Other columns of ``pages`` are left out, whatever their names. An empty table stays empty; without labelled rows all
    texts are of an unknown language.
    """
    model = learn(texts, F.col("text"), F.col("lang"))
    host = host_of(F.col("url"))
    rows = scored(pages.select("page_id", "url", "html"), markup_text(F.col("html")), model)
    rows = rows.withColumns({"host": host, "declared": markup_language(F.col("html"))}).withColumn("suffix", suffix_of(F.col("host"))).drop("url", "html")
    out = decided(stage(rows, "page-scores"), model.languages, least)
    return out.select("page_id", "host", "suffix", "declared", "n_words", "text_lang", "lang_id", "probability", "rejected")


def identify_documents(docs: DataFrame, key: list[str], text: str, declared: str, source: str, least: float = 0.6) -> DataFrame:
    """The columns ``key`` with n_words, text_lang, lang_id, probability, rejected: a text's source stands for its host.

    Languages are learned from the declared ones of the same rows. Defined as for pages. ``key`` must not hold the names
    of the added columns.
    """
    said = F.lower(F.coalesce(quoted(declared), F.lit("")))
    rows = docs.select(*key, quoted(text).alias("_whole"), said.alias("declared"), F.coalesce(quoted(source), F.lit("")).alias("host"), F.lit("").alias("suffix"))
    model = learn(rows, F.col("_whole"), F.col("declared"))
    stored = stage(scored(rows, F.col("_whole"), model).drop("_whole"), "document-scores")
    return decided(stored, model.languages, least).select(*key, "n_words", "text_lang", "lang_id", "probability", "rejected")
