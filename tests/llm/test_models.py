"""Classifiers and mixing: held-out accuracy, fairness, targets, edge cases."""

import random
import zlib

import numpy as np
import pytest
from cohortlens.llm.catalog import op3_quality_classifier, op5_toxicity
from cohortlens.llm.mixing import DOMAINS, WEIGHTS, _rates, apply_mixture, mix_sources
from cohortlens.llm.quality_classifier import classify_quality, keep_good
from cohortlens.llm.text_stats import NAMES, text_statistics
from cohortlens.llm.toxicity import classify_toxicity

SF = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string, score double", "doc_id long, quality int, toxic int"


def corpus(n=400, seed=5):
    """Documents of four kinds: clean, shouted, insulting, and neutral or
    hostile mentions of a group (mentions mostly in insulting rows)."""
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "s", "lo", "mi")]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        toxic = i % 4 == 1
        quality = int(i % 4 != 2)
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["zonkhead", "blurgface"]))
        if (toxic and i % 8 == 1) or i % 97 == 0:
            w.insert(rng.randrange(len(w)), "women")
        text = " ".join(w).capitalize() + "."
        docs.append((i, text if quality else text.upper().replace(" ", "!! "), 0.5))
        labels.append((i, quality, int(toxic)))
    return docs, labels


def folds(rows):
    return {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in rows}


def test_quality_held_out(spark):
    docs, labels = corpus()
    by = {i: q for i, q, _ in labels}
    odd = [(9001, None, 0.0), (9002, "", 0.0), (9003, "x " * 200_000, 0.0), (None, "A line.", 0.0), (5, docs[5][1], 0.0)]
    df, known = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(
        labels + [(1, 1, 1), (9002, None, None), (None, 1, 0)], LABELS)
    got = classify_quality(df, known).collect()
    assert len(got) == len(docs) + len(odd)
    fold = folds([r.doc_id for r in got if r.doc_id is not None])
    held = [r for r in got if r.doc_id in by and r.held_out]
    assert held and all(r.held_out == fold[r.doc_id] for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == by[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    kept = keep_good(df, known)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in got if r.predicted)
    assert classify_quality(df.limit(0), known).count() == 0
    assert {r.score for r in classify_quality(df, known.limit(0)).collect()} == {0.5}


def test_held_out_labels_have_no_part(spark):
    docs, labels = corpus(200)
    fold = folds(range(200))
    turned = [(i, 1 - q if fold[i] else q, 1 - t if fold[i] else t) for i, q, t in labels]
    df = spark.createDataFrame(docs, DOCS).coalesce(1)
    for run in (classify_quality, classify_toxicity):
        a, b = ({r.doc_id: r.score for r in run(df, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
        assert a == pytest.approx(b)


def test_toxicity_held_out_and_counterfactual(spark):
    docs, labels = corpus(800)
    by = {i: t for i, _, t in labels}
    neutral = [(5000 + k, f"The {w} of banlo met the others for a meal.", 0.0) for k, w in enumerate(["women", "men", "asians"])]
    odd = [(9001, None, 0.0), (9002, "", 0.0), (None, "zonkhead blurgface", 0.0)]
    df, known = spark.createDataFrame(docs + neutral + odd, DOCS), spark.createDataFrame(labels, LABELS)
    fair = {r.doc_id: r for r in classify_toxicity(df, known).collect()}
    plain = {r.doc_id: r.score for r in classify_toxicity(df, known, fairness=0.0).collect()}
    held = [r for r in fair.values() if r.doc_id in by and r.held_out]
    assert np.mean([r.predicted == by[r.doc_id] for r in held]) > 0.97
    scores = [fair[5000 + k].score for k in range(3)]
    assert max(scores) - min(scores) < 0.02 and max(scores) < 0.2  # a group's name changes nothing
    assert plain[5000] > scores[0]
    assert fair[None].predicted == 1 and fair[9001].score == fair[9002].score < 0.5
    assert classify_toxicity(df.limit(0), known).count() == 0
    assert {r.score for r in classify_toxicity(df, known.limit(0)).collect()} == {0.5}


def test_queries_on_given_tables(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in op3_quality_classifier(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id].quality for r in held]) > 0.95
    toxic = [r for r in op5_toxicity(spark, SF).collect() if not r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id].toxic for r in toxic]) > 0.9


def test_statistics_of_odd_texts():
    assert len(text_statistics("a b")) == len(NAMES) and not text_statistics(None).any() and not text_statistics(" \n").any()
    assert np.isfinite(text_statistics("É " * 10 + "!|\n\n")).all()


def test_rates_reach_the_least_squares_optimum():
    rng = np.random.default_rng(1)
    p, t = rng.dirichlet([0.5] * 3, 200), rng.uniform(1, 50, 200)
    have = (p * t[:, None]).sum(axis=0)
    want, total, pull, history = have * [1.0, 0.2, 0.1], t.sum(), 1e-3, []
    for _ in range(400):
        history.append(((p * (t * _rates(history, p, pull)[1])[:, None]).sum(axis=0) - want) / total)
    rate = _rates(history, p, pull)[0]
    residual = ((p * (t * rate)[:, None]).sum(axis=0) - want) / total
    grad = 2 * p @ residual + 2 * pull * (rate - 1)  # optimality: zero where the rate is positive, else not negative
    assert np.abs(grad[rate > 1e-6]).max() < 1e-5 and (grad[rate <= 1e-6] > -1e-5).all() and np.abs(residual).max() < 0.02


def test_mixture_meets_targets(spark):
    docs, labels = corpus(600)
    df = spark.createDataFrame(docs + [(9001, None, 0.0), (9002, "", 0.0), (None, docs[4][1], 0.0), (4, docs[4][1], 0.0)], DOCS)
    known = spark.createDataFrame(labels, LABELS)
    got = mix_sources(df, known).collect()
    assert len(got) == len(docs) + 4 and all(r.rate >= 0 and abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 for r in got)
    have = np.array([sum(r.n_tokens * r[f"p_{d}"] for r in got) for d in DOMAINS])
    reached = np.array([sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in got) for d in DOMAINS])
    want = np.minimum(np.array(WEIGHTS) * have[0] / WEIGHTS[0], have)
    assert np.abs(reached - want).max() < 0.02 * have.sum()
    copies = {r.doc_id: r.copies for r in got}
    mixed = apply_mixture(df, known)
    assert mixed.columns == df.columns
    n = {}
    for r in mixed.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert all(n.get(i, 0) == copies[i] for i in range(600) if i != 4) and n[4] == 2 * copies[4]
    assert mix_sources(df.limit(0), known).count() == 0 == apply_mixture(df.limit(0), known).count()
    assert mix_sources(df, known.limit(0)).count() == len(got)
