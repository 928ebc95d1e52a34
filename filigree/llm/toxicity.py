"""Toxicity: a factorization machine over hashed terms of a whole text.

    margin(x) = bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

x_i says whether term i occurs. Terms are lower-case words and their beginnings of four and
five letters, hashed to 2**`HASH_BITS` numbers. The products let two terms count together
(an insult and the mention of a group) when neither does alone.

The machine is fitted on a bounded sample of labelled rows; scoring reads every document.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import fresh, texts, written

HASH_BITS = 30
FACTORS = 8
#: Labelled rows of each class that are fitted at most, those first by a hash of doc_id.
SAMPLE_PER_CLASS = 4_000
#: A term must be in so many sampled texts; the most telling `TERMS` of them by chi-square stay.
MIN_TEXTS, TERMS = 4, 2_048
EPOCHS, BATCH, RATE, SHRINK = 20, 128, 0.1, 1e-4
#: Words whose terms a Python worker remembers.
KEPT_WORDS = 300_000
WORD = re.compile(r"[^\W_]+")


def word_terms(chunk: str) -> list[int]:
    """Hashed terms of the words in a piece of text without spaces."""
    mask = (1 << HASH_BITS) - 1
    found = []
    for word in WORD.findall(chunk.lower()):
        found.append(xxhash.xxh3_64_intdigest(word) & mask)
        for n in (4, 5):
            if len(word) >= n:
                found.append(xxhash.xxh3_64_intdigest(f"{n}^{word[:n]}") & mask)
    return found


class _Known(dict):
    """chunk -> indices of the model's terms in it, as u32 bytes."""

    def __init__(self, index: dict[int, int]):
        self.index = index

    def __missing__(self, chunk: str) -> bytes:
        known = [self.index[t] for t in word_terms(chunk) if t in self.index]
        made = np.array(known, np.uint32).tobytes() if known else b""
        if len(self) < KEPT_WORDS:
            self[chunk] = made
        return made


@dataclass
class FactorizationMachine:
    """Fitted weights of the terms that were kept; all other terms count nothing."""

    bias: float
    index: dict[int, int]
    linear: np.ndarray
    factors: np.ndarray
    known: Any = field(default=None, repr=False)

    def active(self, text: str) -> np.ndarray:
        if self.known is None:
            self.known = _Known(self.index)
        joined = b"".join(map(self.known.__getitem__, set(text.split())))
        return np.unique(np.frombuffer(joined, np.uint32)) if joined else np.zeros(0, np.uint32)

    def margin(self, active: np.ndarray) -> float:
        if not len(active):
            return self.bias
        v = self.factors[active]
        total = v.sum(axis=0)
        return float(self.bias + self.linear[active].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(self.active(text or "")), -35, 35)))

    def __getstate__(self):
        return self.__dict__ | {"known": None}


def telling_terms(found: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The terms with the largest chi-square against the label, in ascending order."""
    if not found:
        return np.zeros(0, np.int64)
    flat, owner = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
    terms, at = np.unique(flat, return_inverse=True)
    n, ones = len(labels), labels.sum()
    texts_with = np.bincount(at, minlength=len(terms))
    ones_with = np.bincount(at, labels[owner], len(terms))
    expected = texts_with * ones / n
    spread = texts_with * (n - texts_with) * ones * (n - ones) / max(1, n) ** 3
    chi = np.where(texts_with >= MIN_TEXTS, (ones_with - expected) ** 2 / np.maximum(spread, 1e-9), 0.0)
    best = np.lexsort((terms, -chi))[:TERMS]
    return np.sort(terms[best[chi[best] > 0]])


def fit(found: list[np.ndarray], labels: np.ndarray, share: float) -> FactorizationMachine:
    """Fit by AdaGrad on the logistic loss.

    `found` has the distinct hashed terms of each text; `share` is the share of label 1 in
    all labelled rows, to which the bias is set back, as the sample may hold another one.
    Without both labels, every text scores `share`.
    """
    labels = np.asarray(labels, float)
    odds = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    empty = FactorizationMachine(odds, {}, np.zeros(0), np.zeros((0, FACTORS)))
    if not len(labels) or labels.min() == labels.max():
        return empty
    terms = telling_terms(found, labels)
    if not len(terms):
        return empty
    active = [np.searchsorted(terms, x[np.isin(x, terms)]) for x in found]
    rng = np.random.default_rng(7)
    sampled = labels.mean()
    bias = float(np.log(sampled / (1 - sampled)))
    w, v = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS))
    seen_w, seen_v, seen_b = np.full(len(terms), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for begin in range(0, len(order), BATCH):
            batch = order[begin : begin + BATCH]
            size = np.array([len(active[i]) for i in batch])
            flat = np.concatenate([active[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), size)
            rows = v[flat]
            total = np.stack([np.bincount(owner, rows[:, f], len(batch)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(owner, (rows * rows).sum(axis=1), len(batch))
            margin = bias + np.bincount(owner, w[flat], len(batch)) + 0.5 * ((total * total).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - labels[batch]
            touched, at = np.unique(flat, return_inverse=True)
            grad_w = np.bincount(at, error[owner], len(touched)) / len(batch) + SHRINK * w[touched]
            grad_v = error[owner, None] * (total[owner] - rows)
            grad_v = np.stack([np.bincount(at, grad_v[:, f], len(touched)) for f in range(FACTORS)], axis=1) / len(batch)
            grad_v += SHRINK * v[touched]
            grad_b = error.mean()
            seen_w[touched] += grad_w**2
            seen_v[touched] += grad_v**2
            seen_b += grad_b**2
            w[touched] -= RATE * grad_w / np.sqrt(seen_w[touched])
            v[touched] -= RATE * grad_v / np.sqrt(seen_v[touched])
            bias -= RATE * grad_b / np.sqrt(seen_b)
    bias += odds - float(np.log(sampled / (1 - sampled)))
    return FactorizationMachine(bias, {int(t): i for i, t in enumerate(terms)}, w, v)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    """Fit on at most `SAMPLE_PER_CLASS` labelled rows of each class that aren't held out.

    Rows without doc_id or a label of 0 or 1 don't count; of several labels or texts of one
    doc_id, the smallest does.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~is_held_out(F.col("doc_id")))
    )
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], np.zeros(0), 0.5)
    picked = [
        usable.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
        for value in (0, 1)
    ]
    sample = picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))

    def terms(frames):
        for frame in frames:
            hashed = [np.unique(np.array([t for c in set(x.split()) for t in word_terms(c)], np.int32)) for x in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "toxic": frame["toxic"], "terms": hashed})

    labelled = texts(docs).join(F.broadcast(sample), "doc_id")
    found = labelled.mapInPandas(terms, "doc_id long, toxic int, terms array<int>")
    found = found.groupBy("doc_id").agg(F.min(F.struct(F.size("terms").alias("n"), "toxic", "terms")).alias("t"))
    found = written(found.select("doc_id", "t.toxic", "t.terms"), "labelled-terms")
    kept = set(_telling(found))

    def known(frames):
        for frame in frames:
            yield frame.assign(terms=[[t for t in x if t in kept] for x in frame["terms"]])

    rows = found.mapInPandas(known, "doc_id long, toxic int, terms array<int>").orderBy("doc_id").toPandas()
    share = counts.get(1, 0) / sum(counts.values())
    return fit([np.asarray(x, np.int64) for x in rows["terms"]], rows["toxic"].to_numpy(), share)


def _telling(found: DataFrame) -> list[int]:
    """`telling_terms` of the sample, counted by Spark: the driver gets `TERMS` numbers at most."""
    size = found.agg(F.count("*").alias("n"), F.sum("toxic").alias("ones")).first()
    n, ones = size["n"], size["ones"] or 0
    with_term = found.select(F.explode("terms").alias("term"), "toxic").groupBy("term")
    counted = with_term.agg(F.count("*").alias("texts"), F.sum("toxic").alias("toxic")).where(F.col("texts") >= MIN_TEXTS)
    expected = F.col("texts") * ones / max(1, n)
    spread = F.col("texts") * (n - F.col("texts")) * float(ones) * float(n - ones) / float(max(1, n)) ** 3
    chi = F.pow(F.col("toxic") - expected, F.lit(2)) / F.greatest(spread, F.lit(1e-9))
    best = counted.withColumn("chi", chi).where("chi > 0").orderBy(F.desc("chi"), "term").limit(TERMS)
    return [r["term"] for r in best.select("term").collect()]


def with_score(docs: DataFrame, model: FactorizationMachine, name: str) -> DataFrame:
    """All columns of `docs` and the score of the whole text; a null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        of = shared.value.score
        return pd.Series([of(x) for x in text], dtype=float)

    return docs.withColumn(name, score(F.coalesce("text", F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, one row for each row.

    Texts without a known term (empty ones too) have the score of the bias.
    """
    scored = with_score(texts(docs), train(docs, labels), "score")
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns."""
    name = fresh(docs, "toxic_score")
    return with_score(docs, train(docs, labels), name).where(F.col(name) < 0.5).drop(name)
