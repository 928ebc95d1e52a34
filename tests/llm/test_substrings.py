import hashlib
import random

from cases import awkward, empty, told

from filigree.llm.substrings import EMPTY, lengths, substring_dedup


def brute(rows, window):
    first, out = {}, []
    split = [(d, t.encode().split()) for d, t in sorted(rows)]
    for d, w in split:
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_lengths_double():
    assert lengths(50) == [13, 25, 50] and lengths(8) == [8]


def test_against_all_windows(spark):
    rng = random.Random(8)
    pieces = [[f"p{rng.randint(0, 40)}" for _ in range(rng.randint(20, 90))] for _ in range(12)]
    pieces.append(["same"] * 70)
    rows = []
    for doc_id in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(pieces) if rng.random() < 0.6 else [f"q{rng.randint(0, 999)}" for _ in range(30)]
        rows.append((doc_id * 3, rng.choice([" ", "\n", " \t"]).join(words)))
    assert told(substring_dedup(awkward(spark, rows))) == sorted(brute(rows, 50), key=str)
    assert told(substring_dedup(awkward(spark, rows), 20)) == sorted(brute(rows, 20), key=str)


def test_awkward_documents(spark):
    got = told(substring_dedup(awkward(spark)))
    assert len(got) == 15
    removed = {d: (n, r, sha) for d, n, r, sha in got if d is not None}
    assert removed[2] == removed[3] == (0, 0, EMPTY)
    assert removed[5][:2] == (62, 62) and removed[5][2] == EMPTY
    assert removed[1][1] == 0 and removed[7][1] == 60 and removed[9][:2] == (12, 0)
    assert removed[8][0] == 40_000
    assert told(substring_dedup(empty(spark))) == []
