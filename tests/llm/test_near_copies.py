import random
import re

import numpy as np
import pytest
from cases import awkward, empty, told

from filigree.llm import jaccard
from filigree.llm.components import components
from filigree.llm.jaccard import jaccard_join, one_per_group


def roots(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    links += [(2000, 2000 + i) for i in range(1, 40)]
    links = [(min(x), max(x)) for x in links if x[0] != x[1]]
    got = dict(told(components(spark.createDataFrame(links, "low long, high long"))))
    assert got == roots({x for link in links for x in link}, links)
    assert told(components(spark.createDataFrame([], "low long, high long"))) == []


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    links = [
        (a, b)
        for i, (a, x) in enumerate(sets)
        for b, y in sets[i + 1 :]
        if x and y and 5 * len(x & y) >= 4 * len(x | y)
    ]
    root = roots([d for d, _ in rows], links)
    return [(d, root[d], sum(d in link for link in links)) for d, _ in rows]


def near_copies(groups, members, words, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, words // 40))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 5000)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("groups, members, words", [(25, 4, 60), (2, 40, 300), (30, 3, 7)])
def test_against_all_pairs(spark, groups, members, words):
    rows = near_copies(groups, members, words, words)
    assert told(jaccard_join(awkward(spark, rows))) == sorted(brute(rows), key=str)


def test_large_buckets_are_split_and_blocked(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BRUTE", 8)
    line = "this very common line stands in each and every text of them"
    rows = near_copies(40, 1, 60, 3)
    rows = [(i, f"{line} {t}") for i, t in rows] + [(100 + i, t) for i, t in near_copies(1, 50, 200, 4)]
    assert told(jaccard_join(awkward(spark, rows))) == sorted(brute(rows), key=str)


def test_sketch_estimates_the_similarity():
    rng = np.random.default_rng(4)
    x = rng.integers(1, 1 << 62, 1000, dtype=np.uint64)
    y = np.concatenate([x[:900], rng.integers(1, 1 << 62, 100, dtype=np.uint64)])
    a, b = (np.frombuffer(jaccard.sketch(v), np.uint8) for v in (x, y))
    assert abs((a == b).mean() - 900 / 1100) < 0.12


def test_awkward_documents(spark):
    got = told(jaccard_join(awkward(spark)))
    assert len(got) == 15
    assert {(1, 1, 2), (5, 1, 2), (7, 1, 2), (2, 2, 0), (6, 6, 0)} <= set(got)
    assert [x for x in got if x[0] is None] == [(None, None, 0)] * 2
    kept = one_per_group(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = [r[0] for r in told(kept, "doc_id")]
    assert 5 not in ids and 7 not in ids and {1, 2, 6, 8, 10} <= set(ids) and 3 not in ids and 4 not in ids
    assert told(jaccard_join(empty(spark))) == [] and told(one_per_group(empty(spark))) == []
