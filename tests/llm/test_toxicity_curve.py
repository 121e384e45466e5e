"""The curve that makes margins of the positive-unlabelled fit probabilities."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
from pyspark.sql import SparkSession

from brookloom.llm import queries, toxicity

BAD = [f"{a}{b}" for a in ("vile", "scum", "dolt") for b in ("ish", "er", "ab", "ok")]


def test_sure_texts_score_high_where_unlabelled_texts_hold_more_than_the_prior(spark: SparkSession, tmp_path) -> None:
    random.seed(5)
    plain = [f"w{i}" for i in range(300)]

    def text(toxic: bool) -> str:
        words = random.sample(plain, 30) + random.sample(BAD, 2) * toxic
        return " ".join(random.sample(words, len(words)))

    # of the labelled texts a tenth is toxic, of the others a sixth
    rows = [(i, text(i % 10 == 0 if i < 1800 else i % 6 == 0), int(i % 10 == 0) if i < 1800 else None) for i in range(3600)]
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, t) for i, _, t in rows if t is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = queries.table(spark, str(tmp_path), "documents")
    model = queries.toxicity_model(spark, str(tmp_path), docs)
    toxic, clean = ([t for _, t, said in rows if said == label] for label in (1, 0))
    plainly = replace(model, slope=1.0, offset=0.0)
    assert np.mean([plainly.score(t) >= 0.7 for t in toxic]) < 0.9  # as before
    assert np.mean([model.score(t) >= 0.7 for t in toxic]) > 0.97
    assert np.mean([model.score(t) >= 0.7 for t in clean]) < 0.01


def test_curve() -> None:
    rng = np.random.default_rng(3)
    f = rng.normal(0, 2, 20_000)
    positive = rng.random(len(f)) < 1 / (1 + np.exp(-(1.5 * f - 1)))
    a, b = toxicity.curve(f, positive, positive.mean())
    assert abs(a - 1.5) < 0.1 and abs(b + 1) < 0.1
    a, b = toxicity.curve(np.array([-2.0, -1.9, 0.1, 0.2]), np.array([False, False, True, True]), 0.5)
    assert a > 1 and a * 0.1 + b > 0 > a * -1.9 + b
    # margins that tell nothing, or the opposite
    assert toxicity.curve(np.zeros(4), np.array([True, False, True, False]), 0.5) == (1.0, 0.0)
    assert toxicity.curve(np.array([1.0, 2.0]), np.array([True, True]), 0.5) == (1.0, 0.0)
    assert toxicity.curve(np.array([1.0, 2.0]), np.array([True, False]), 0.5) == (1.0, 0.0)
