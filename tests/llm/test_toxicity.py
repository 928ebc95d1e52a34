import os

import numpy as np
import pytest
from cases import awkward, empty, told

from filigree.llm.queries import QUERIES
from filigree.llm.toxicity import FactorizationMachine, clean_documents, fit, toxicity, word_terms

SF = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def mentions(rng, n):
    """Label 1 where an insult and a group stand together or are both missing: no term tells alone."""
    texts, labels = [], []
    for _ in range(n):
        insult, group = (rng.random(2) < 0.5).tolist()
        words = [f"w{rng.integers(0, 300)}" for _ in range(12)] + ["insult"] * insult + ["group"] * group
        texts.append(" ".join(words))
        labels.append(int(insult == group))
    return texts, np.array(labels)


def test_pairs_are_learnt_that_no_single_term_tells():
    rng = np.random.default_rng(6)
    texts, labels = mentions(rng, 4000)
    model = fit([np.unique([t for w in x.split() for t in word_terms(w)]) for x in texts], labels, float(labels.mean()))
    unseen, truth = mentions(rng, 500)
    assert np.mean([(model.score(x) >= 0.5) == y for x, y in zip(unseen, truth)]) > 0.9


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = FactorizationMachine(0.3, {}, rng.normal(size=9), rng.normal(size=(9, 8)))
    active = np.array([0, 2, 5, 7])
    pairs = sum(model.factors[a] @ model.factors[b] for i, a in enumerate(active) for b in active[i + 1 :])
    assert np.isclose(model.margin(active), 0.3 + model.linear[active].sum() + pairs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    frame = QUERIES["op1_factorization_toxicity"](spark, SF).toPandas()
    frame = frame.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = frame[frame.held_out]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.8
    assert ((frame.predicted == 1) & (frame.toxic == 0)).mean() < 0.02


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score string")


def test_awkward_documents(spark):
    some = labels(spark, [(1, None, 1, ""), (7, 1, 0, ""), (8, 1, 0, ""), (None, 0, 1, ""), (5, 0, None, ""), (1, 0, 1, ""), (99, 0, 1, "")])
    got = told(toxicity(awkward(spark), some), "doc_id", "held_out", "score", "predicted")
    assert len(got) == 15 and all(0 <= s <= 1 and p == int(s >= 0.5) for _, _, s, p in got)
    kept = clean_documents(awkward(spark), some)
    assert kept.columns == awkward(spark).columns
    none = told(toxicity(awkward(spark), labels(spark, [])), "score")
    assert len(none) == 15 and len(set(none)) == 1
    assert told(toxicity(empty(spark), some)) == []
