import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import TEXTS, awkward, empty, told

from filigree.llm import fingerprints as module
from filigree.llm.fingerprints import (
    CELLS,
    Sketches,
    Versions,
    checks,
    differing,
    digests,
    edited,
    fingerprints,
    in_order,
    paragraphs,
    places,
)


def likeness(a, b):
    """By the paragraphs themselves."""
    x, y = Counter(paragraphs(a)), Counter(paragraphs(b))
    size = {k: len(k) for k in x | y}
    total = sum(size[k] * (x[k] + y[k]) for k in size)
    return 2 * sum(size[k] * min(x[k], y[k]) for k in size) / total if total else float(a == b)


def brute(rows):
    rows = [(i, t or "") for i, t in sorted(rows)]
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 4
        other = text[: len(text) - n] + after[:n]
        out.append((i, len(text), hashlib.sha256(other.encode()).hexdigest(), likeness(text, other), likeness(text, after)))
    return out


def corpus(seed, docs=150):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return [
        (i * 3 - 40, rng.choice(["\n", "\n\n", ". "]).join(rng.choice(lines) for _ in range(rng.randint(0, 90))) or None)
        for i in rng.sample(range(docs * 2), docs)
    ]


SHORT = ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next"]


def test_against_the_paragraphs_themselves(spark):
    rows = corpus(1)
    got = fingerprints(awkward(spark, rows).repartition(5))
    assert got.columns[:5] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    assert told(got, *SHORT) == sorted(brute(rows), key=str)
    by_id = {r.doc_id: r for r in got.collect()}
    texts = {i: t or "" for i, t in rows}
    for i, r in by_id.items():
        assert r.fingerprint == Versions([texts[i]]).fingerprint(0)
        assert len(r.fingerprint) == len(r.edited_fingerprint)


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(1, "a b c\nd"), (2, "other"), (3, "a b c\nd"), (4, "a b c\nD")]
    prints = {r.doc_id: r.fingerprint for r in fingerprints(awkward(spark, rows)).collect()}
    assert prints[1] == prints[3] and len(set(prints.values())) == 3


def test_order_has_every_row_once_and_a_guest_per_bucket(spark):
    rows = corpus(2)
    found = in_order(awkward(spark, rows), 7).collect()
    assert sorted(r.doc_id for r in found if not r.guest) == sorted(i for i, _ in rows)
    buckets = sorted({r.bucket for r in found})
    assert len(buckets) > 4
    for bucket, after in zip(buckets, buckets[1:] + buckets[:1]):
        [guest] = [r for r in found if r.bucket == bucket and r.guest]
        assert guest.doc_id == min(r.doc_id for r in found if r.bucket == after and not r.guest)


def test_a_frequent_id_is_parted(spark):
    rows = [(5, f"text {i}") for i in range(300)] + [(None, f"none {i}") for i in range(300)] + [(i, "x") for i in range(300)]
    parts = Counter(r.bucket for r in in_order(awkward(spark, rows), 12).where("NOT guest").collect())
    assert max(parts.values()) < 150
    assert fingerprints(awkward(spark, rows)).count() == 900


@pytest.mark.parametrize("n", [0, 1, 5, 30, 400])
def test_peeling_recovers_what_differs(n):
    rng = np.random.default_rng(n)
    both, first, second = (np.unique(rng.integers(1, 2**63, k).astype(np.uint64)) for k in (1000, n, n // 2))
    cells = CELLS
    while True:
        a, b = (Sketches(1, cells).add(np.zeros(len(k), np.int64), k, 1) for k in (np.concatenate([both, first]), np.concatenate([both, second])))
        _, keys, sign, whole = a.minus(b).peel()
        if whole[0]:
            break
        cells *= 2
    assert sorted(keys[sign == 1].tolist()) == first.tolist() and sorted(keys[sign == -1].tolist()) == second.tolist()
    assert cells <= max(CELLS, 8 * (n + n // 2))


def test_too_small_a_sketch_is_known_and_retried():
    a, b = ("\n".join(f"{name} line {i}" for i in range(200)) for name in ("left", "right"))
    x, y = Versions([a, "alone"]), Versions([b, "alone"])
    every = np.arange(2)
    assert x.sketches.minus(y.sketches).peel()[3].tolist() == [False, True]
    pair, keys, sign, took = differing(x, every, y, every)
    assert took[0] > CELLS and took[1] == CELLS
    assert pair.tolist() == [0] * 400 and np.count_nonzero(sign == 1) == 200
    assert set(keys[sign == 1].tolist()) == set(x.keys[x.which == 0].tolist())
    assert module.likeness(x, every, y, every).tolist() == [0.0, 1.0]


def test_a_false_digest_does_not_go_in_circles():
    cells = Sketches(1, CELLS)
    key = np.array([12345 << 20 | 7], np.uint64)
    homes = {int(at[0]) for at in places(key, CELLS)}
    wrong = (set(range(CELLS)) - homes).pop()
    cells.count[wrong], cells.digest[wrong], cells.check[wrong] = 1, key[0], checks(key)[0]
    assert cells.peel()[3].tolist() == [False]


def test_batches_are_cut_without_losing_a_neighbour(spark, monkeypatch):
    monkeypatch.setattr(module, "BATCH_TEXTS", 3)
    rows = [(i, t or "") for i, t in sorted(corpus(4, 20))]
    run = module._compared(CELLS)
    import pyarrow as pa

    texts = [t for _, t in rows]
    batch = pa.RecordBatch.from_pydict({"bucket": [1] * 21, "guest": [False] * 20 + [True], "doc_id": [i for i, _ in rows] + [rows[0][0]], "text": texts + texts[:1]})
    got = [tuple(r[c] for c in SHORT) for out in run([batch.slice(0, 5), batch.slice(5)]) for r in out.to_pylist()]
    assert got == brute(rows)


def test_paragraphs_and_digests():
    long = " ".join(f"w{i}" for i in range(30))
    assert [len(p.split()) for p in paragraphs(long + ". End here.\n\n x  y ")] == [12, 12, 6, 2, 2]
    assert paragraphs(" \n\t") == [] and len(digests(["a", "a", "b"])) == 3
    assert sorted(int(k) & 0xFFFFF for k in digests(["abc", "x" * 2_000_000])) == [3, (1 << 20) - 1]
    assert edited("abcdefgh", "xyz") == "abcdefxy" and edited("abcdefgh", "x") == "abcdefx" and edited("abc", "x") == "abc"


def test_awkward_documents(spark):
    rows = [r for r in TEXTS if r[0] is not None and r[0] != 9] + [(9, TEXTS[8][1])]
    assert told(fingerprints(awkward(spark, rows)), *SHORT) == sorted(brute(rows), key=str)
    got = told(fingerprints(awkward(spark)), "doc_id", "n_chars")
    assert got == sorted(((i, len(t or "")) for i, t in TEXTS), key=str)
    assert told(fingerprints(empty(spark))) == []
    [(_, _, _, near_edited, near_next)] = told(fingerprints(awkward(spark, [(4, "only one text here")])), *SHORT)
    assert near_next == 1.0 and 0 <= near_edited <= 1
