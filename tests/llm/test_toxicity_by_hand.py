"""The toxicity model against a plain fit: features counted text by text, the risk written out over dense matrices."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from brookloom.llm import toxicity


def plain_features(text):
    words = set(re.findall(r"[^\W_]+", text.lower()))
    out = set(words)
    for k in (4, 5, 6, 7):
        for stem in {w[:k] for w in words if len(w) >= k}:
            forms = sum(w.startswith(stem) for w in words)
            out |= {stem + "*" * i for i in (1, 2, 3) if i <= forms}
    return out


def plain_choice(texts, positive):
    """(feature, positive texts, other texts) that the model weighs, best first."""
    n_p, n_u = sum(positive), len(positive) - sum(positive)
    counts = collections.defaultdict(lambda: [0, 0])
    for own, p in zip(map(plain_features, texts), positive, strict=True):
        for w in own:
            counts[w][0 if p else 1] += 1

    def errors(p, u):
        at, of = p / (p + u), n_p / (n_p + n_u)
        if at <= of:
            return 0.0
        return math.sqrt(2 * (p * math.log(at / of) + (u * math.log((1 - at) / (1 - of)) if u else 0)))

    alike = collections.defaultdict(list)
    for w, (p, u) in counts.items():
        if p >= 5 and errors(p, u) >= 5:
            alike[w.rstrip("*")[:4], p, u].append(w)
    chosen = [(max(ws, key=lambda w: (len(w.rstrip("*")), -len(w), w)), p, u) for (_, p, u), ws in alike.items()]
    return sorted(chosen, key=lambda x: (-errors(x[1], x[2]), x[0]))


def risk(x, w, b, positive, prior):
    """prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss."""
    f = x @ w + b
    plus, minus = np.log1p(np.exp(-f)), np.log1p(np.exp(f))
    return prior * plus[positive].mean() + max(0.0, minus[~positive].mean() - prior * minus[positive].mean())


def examples(n=900):
    rng = random.Random(12)
    plain, endings = [f"w{i}" for i in range(250)], [f"{a}{b}" for a in "bdfg" for b in "aeiou"]
    rows = []
    for i in range(n):
        bad = rng.random() < 0.25
        words = rng.choices(plain, k=30)
        if bad:
            words += rng.sample(["zug", "zog", "zag"], 2) if i % 3 else ["bomente" + e for e in rng.sample(endings, 2)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), bad, bad and rng.random() < 0.6))
    return rows


def test_the_fit_is_that_of_plain_python(spark):
    rows, prior = examples(), 0.25
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad boolean, said boolean").repartition(3)
    marks = toxicity.marked(docs, "doc_id", "text", docs.where("said").select("doc_id", F.lit(1).alias("toxic")), F.col("toxic") == 1)
    model = toxicity.fit(docs, "text", marks, prior)
    texts, positive = [r[1] for r in rows], [r[3] for r in rows]
    chosen = plain_choice(texts, positive)
    assert set(model.weights) == {w for w, _, _ in chosen} and len(chosen) > 3
    n_p, n_u = sum(positive), len(positive) - sum(positive)
    tiers = {w: sum(prior * (p / n_p) / ((u + 0.5) / n_u) >= t for t in (0.2, 0.4, 0.6, 0.8)) for w, p, u in chosen}
    assert model.tiers == tiers

    names = [w for w, _, _ in chosen]
    x = np.zeros((len(texts), len(names) + 5))
    for i, t in enumerate(texts):
        own = plain_features(t) & set(names)
        x[i, [names.index(w) for w in own]] = 1
        if own:
            x[i, len(names) + max(tiers[w] for w in own)] = 1
    w = np.array([model.weights[n] for n in names] + list(model.tier_weights))
    scores = 1 / (1 + np.exp(-np.clip(x @ w + model.bias, -40, 40)))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert max(abs(got[i] - s) for i, s in enumerate(scores)) < 1e-9

    # the estimator's own steps over the dense matrix: all texts are one batch, and the negative part's slope turns round below zero
    mark = np.array(positive)
    v, m, q = np.zeros(x.shape[1] + 1), 0.0, 0.0
    z = np.c_[x, np.ones(len(x))]
    for step in range(1, 61):
        f = z @ v
        up = 1 / (1 + np.exp(-f))
        negative = np.log1p(np.exp(f))[~mark].mean() - prior * np.log1p(np.exp(f))[mark].mean()
        down = np.where(mark, -prior * up / n_p, up / n_u)
        slope = np.where(mark, prior * (up - 1) / n_p, 0.0) + down if negative >= 0 else -down
        g = z.T @ slope + 1e-4 * np.append(v[:-1], 0.0)
        m, q = 0.9 * m + 0.1 * g, 0.999 * q + 0.001 * g * g
        v = v - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    assert np.abs(np.append(w, model.bias) - v).max() < 1e-6
    assert risk(x, w, model.bias, mark, prior) < 0.1 * risk(x, 0 * w, 0.0, mark, prior)
    bad = np.array([r[2] for r in rows])
    unsaid = bad & ~mark
    assert (scores[unsaid] >= 0.7).mean() > 0.9 and not (scores[~bad] >= 0.7).any()
