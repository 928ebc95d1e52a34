import random
import re
from collections import Counter

from cases import TEXTS, awkward, empty, told

from filigree.llm.collocations import LONGEST, collocations, frequent_phrases, slabs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def counted(rows):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, LONGEST + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return n, f


def brute(rows, least=10, top=2000, percent=50):
    n, f = counted(rows)
    found = []
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        if any(
            b >= least and other == lang and len(h) > len(g) and 100 * b >= percent * a
            and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
            for (other, h), b in f.items()
        ):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        found.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    out = []
    for lang in n:
        own = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        out += [(x[0], i, x[1], *x[2:6], x[6]) for i, x in enumerate(own, 1)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string")


def corpus(seed, docs=120):
    rng = random.Random(seed)
    phrases = ["New York", "new york city", "the end of", "of the end", "aÉb c", "x x x x", "q r s", "und so\tweiter"]
    rows = []
    for _ in range(docs):
        parts = [rng.choice(phrases) if rng.random() < 0.5 else f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "en", None, "de"]), "".join(p + rng.choice([" ", " ", "  ", ". ", "\n", ",", "\x0b"]) for p in parts)))
    return rows


def test_against_all_phrases_counted(spark):
    rows = corpus(3)
    docs = table(spark, rows).repartition(3)
    for shards, chunk_words in ((3, 60), (2, 4_000_000)):
        got = collocations(docs, shards=shards, chunk_words=chunk_words)
        assert got.columns == COLUMNS
        assert told(got) == brute(rows)
    assert told(collocations(docs, shards=1, top=5, contained_percent=90)) == brute(rows, top=5, percent=90)


def test_each_phrase_is_counted_through_one_full_cycle(spark):
    """Phrases that reach the threshold late, in one shard only, or exactly at it."""
    rows = [("en", "early bird")] * 5 + [("en", "filler")] * 40 + [("en", "early bird sings")] * 5 + [("en", "late show now")] * 10 + [("en", "nine times")] * 9
    docs = table(spark, rows).coalesce(1)
    phrases, sizes = frequent_phrases(docs, chunk_words=6)
    _, f = counted(rows)
    expected = sorted(("en", len(g), " ".join(g), a) for (_, g), a in f.items() if a >= 10)
    assert sorted(tuple(r) for r in phrases.collect()) == expected
    assert told(sizes) == [("en", 113)]


def test_products_beyond_64_bits(spark):
    rows = [(None, "aa bb " * 30_000)] * 120
    [found] = [r for r in collocations(table(spark, rows), shards=1).collect() if r.phrase == "bb aa bb"] or [None]
    _, f = counted(rows[:1])
    a, front, back, end = (120 * f["und", g] for g in (("bb", "aa", "bb"), ("bb", "aa"), ("aa", "bb"), ("bb",)))
    assert 1_000_000 * a * a > 2**63
    assert found is not None and (found.l, found.r) == (end, back)
    assert found.score == 1_000_000 * a * a // (end * back) < 1_000_000 * a * a // (front * end)


def test_awkward_documents(spark):
    rows = [(None, "same words here. " * 12)]
    got = collocations(awkward(spark, [*TEXTS, (1, "same words here. " * 12), (1, "same words here. " * 12), (None, None), (2, ""), (3, " \t "), (4, ".;\n")]), shards=2)
    assert told(got) == brute(rows * 2 + [(None, t) for _, t in TEXTS])
    assert told(collocations(empty(spark), shards=1)) == []


def test_slabs_end_between_pieces():
    text = b"one two\nthree\nfour five six\nseven"
    assert list(slabs(text, 5)) == [b"one two", b"three", b"four five six", b"seven"]
    assert list(slabs(b"no piece ends here", 5)) == [b"no piece ends here"] and list(slabs(b"", 5)) == [b""]
