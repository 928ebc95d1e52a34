import random
import re
import zlib
from collections import Counter

import numpy as np
from cases import TEXTS, awkward, empty, told

from filigree.llm.spellings import grown, letters, near_words, one_inserted, one_replaced, range_search, spelling_groups, vectors, vocabulary


def words_of(rows, every, least_length, least_count):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=199, least_length=6, least_count=5, ratio=5):
    n = words_of(rows, every, least_length, least_count)
    around = {w: [x for x in n if near(w, x)] for w in n}
    forms = {}
    for w in n:
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(around[w]), n[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé÷") for _ in range(rng.randint(4, 9))) for _ in range(150)]
    rows = []
    for doc_id in range(200):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = base[min(int(rng.expovariate(0.05)), 149)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "b", "Éx", w[at] * 2]) + w[at + 1 :]
            words.append(w.title() if rng.random() < 0.2 else w)
        rows.append((doc_id * 7, rng.choice([" ", "-", " 12 ", "\n"]).join(words)))
    return rows


def test_against_all_pairs(spark):
    rows = corpus(5)
    docs = awkward(spark, rows).repartition(3)
    assert told(spelling_groups(docs)) == brute(rows)
    got = spelling_groups(docs, every=7, least_length=3, least_count=2, ratio=2, cell_words=20)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert told(got) == brute(rows, 7, 3, 2, 2)


def test_upper_trees_part_the_words(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdef") for _ in range(7)) for _ in range(900)})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    [tree] = grown(frame, 50).values()
    v = vectors(letters(words, 7))
    cells = Counter(tree.nodes(v).tolist())
    assert set(cells) == set(tree.boxes) and max(cells.values()) <= 50 and len(cells) > 10
    for cell, (low, high, size) in tree.boxes.items():
        own = v[tree.nodes(v) == cell]
        assert size == len(own) and (own >= low).all() and (own <= high).all()
    row, _ = tree.within(v.astype(np.int16), 2)
    assert len(row) < len(words) * len(cells) / 2  # boxes prune
    expected = {w: sum(near(w, x) for x in words) for w in words}
    assert {r.word: r.n_near for r in near_words(frame, 50).collect()} == {w: k for w, k in expected.items() if k}


def test_equal_vectors_stay_in_one_cell(spark):
    rng = random.Random(4)
    words = set()
    while len(words) < 300:
        words.add("".join(rng.sample("abcdefgh", 8)))
    frame = spark.createDataFrame([(w, 9) for w in words], "word string, n long")
    assert [len(t.boxes) for t in grown(frame, 10).values()] == [1]
    assert near_words(frame, 10).collect() == []


def test_range_search_and_letter_order():
    rng = np.random.default_rng(1)
    points, queries = rng.integers(0, 3, (400, 32)).astype(np.int16), rng.integers(0, 3, (60, 32)).astype(np.int16)
    queries[:20] = points[:20]
    radius = rng.integers(0, 25, 60).astype(np.int16)
    found = {(a, b) for q, p in range_search(points, queries, radius) for a, b in zip(q.tolist(), p.tolist())}
    distance = np.abs(queries[:, None] - points[None]).sum(axis=2)
    assert found == {tuple(x) for x in np.argwhere(distance <= radius[:, None]).tolist()}
    a, b = letters(["planet", "planet", "abcabc"], 6), letters(["planes", "palnet", "abcabc"], 6)
    assert one_replaced(a, b).tolist() == [True, False, False]
    long = letters(["planets", "aplanet", "abcbabc"], 7)
    assert one_inserted(a, long).tolist() == [True, True, True]
    assert one_inserted(a, letters(["lpanets", "plantee", "cbacbaa"], 7)).tolist() == [False, False, False]


def test_awkward_documents(spark):
    rows = [*TEXTS, (20, "Straße STRASSE straße " * 6), (None, "variant variant " * 3), (21, "variants " * 30)]
    assert told(spelling_groups(awkward(spark, rows))) == brute(rows)
    assert told(spelling_groups(empty(spark))) == []
    assert told(vocabulary(awkward(spark, [(1, "shorty " * 5)]))) == [("shorty", 5)]
