import random

from cases import CLASHING, awkward, empty, told

from pyspark.sql import functions as F

from filigree.llm import lines
from filigree.llm.lines import NEAR_WORDS, clean_lines, line_report


def distance_at_most_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    """Kept text per doc_id by comparing all lines with all earlier ones."""
    seen, out = [], []
    for doc_id, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            words = line.lower().split()
            near = any(
                words == w or min(len(words), len(w)) >= NEAR_WORDS and distance_at_most_one(words, w) for w in seen
            )
            if words:
                seen.append(words)
            if not words or not near:
                kept.append(line)
        out.append((doc_id, "\n".join(kept)))
    return out


def made_up(seed):
    rng = random.Random(seed)
    base = [[rng.choice("abc") + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 14))] for _ in range(12)]
    rows = []
    for doc_id in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i, roll = rng.randrange(len(words) + 1), rng.random()
                words[i : i + (roll < 0.7)] = [] if roll < 0.3 and len(words) > 1 else [f"x{rng.randint(0, 9)}"]
            lines.append(rng.choice(["", " "]) + " ".join(words).title())
        rows.append((doc_id, "\n".join(lines)))
    return rows


def test_against_every_earlier_line(spark):
    rows = made_up(5) + [(100 + i, t) for i, t in made_up(6)]
    assert told(clean_lines(awkward(spark, rows)), "doc_id", "text") == sorted(brute(rows), key=str)


def test_long_lines_cost_no_more_than_their_words(spark):
    words = [f"w{i}" for i in range(20_000)]
    near = words[:10_000] + ["changed"] + words[10_001:]
    kept = dict(told(clean_lines(awkward(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[1:]))])), "doc_id", "text"))
    assert kept[1] and kept[2] == "" and kept[3] == ""


def test_awkward_documents(spark):
    frame = clean_lines(awkward(spark))
    assert frame.columns == awkward(spark).columns
    assert set(CLASHING) <= set(frame.columns)
    kept = told(frame, "doc_id", "text", "n_chars")
    assert len(kept) == 15
    by_id = {k: t for k, t, _ in kept}
    assert by_id[2] is None and by_id[3] == "" and by_id[4] == " \n\t\n "
    assert all(n == (None if t is None else len(t)) for _, t, n in kept)
    assert by_id[11] == "line one is here with eight words total\nother" and by_id[12] == ""
    report = told(line_report(awkward(spark)), "doc_id", "n_lines", "n_removed")
    assert (11, 3, 1) in report and (12, 2, 2) in report and (2, 0, 0) in report
    assert told(clean_lines(empty(spark))) == []


def test_different_texts_without_or_under_one_doc_id(spark):
    rows = [(None, "a b\nc d\na b"), (None, "e f\na b\ng h"), (None, "i j"), (5, "k l\nm n"), (5, "o p\nq r\no p"), (7, "m n\ns t")]
    got = told(line_report(awkward(spark, rows)), "doc_id", "n_lines", "n_removed")
    assert sum(n for _, n, _ in got) == 14 and sum(r for _, _, r in got) == 4 and all(r >= 0 for _, _, r in got)
    texts = [t for _, t in told(clean_lines(awkward(spark, rows)), "doc_id", "text")]
    assert sorted("\n".join(texts).split("\n")) == ["a b", "c d", "e f", "g h", "i j", "k l", "m n", "o p", "q r", "s t"]
    assert "c d" in {t[-3:] for t in texts} and "i j" in texts and "k l\nm n" in texts and "o p\nq r" in texts


def test_near_lines_without_doc_id(spark):
    line = "one two three four five six seven eight nine"
    rows = [(None, f"{line}\nown first"), (None, f"own second\n{line} ten"), (3, f"{line} eleven\nlast")]
    kept = "\n".join(t for _, t in told(clean_lines(awkward(spark, rows)), "doc_id", "text")).split("\n")
    assert sum(x.startswith(line) for x in kept) == 1 and {"own first", "own second", "last"} <= set(kept)


def test_only_lines_with_a_possible_near_line_are_cut_again(spark, monkeypatch):
    """The second reading of the texts picks lines by their place, before it makes words of them."""
    filtered, passing = [], lines.passing

    def seen(table, keys, shared):
        found = passing(table, keys, shared)
        filtered.append((table.columns, found))
        return found

    monkeypatch.setattr(lines, "passing", seen)
    near = ["one two three four five six seven eight nine", "One  two three\tfour five six seven eight nine ten"]
    rows = [(i, f"alone {i} " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(200)] + [(1000 + i, x) for i, x in enumerate(near)]
    clean = dict(told(clean_lines(awkward(spark, rows)), "doc_id", "text"))
    assert clean[1000] == near[0] and clean[1001] == "" and clean[7] == rows[7][1]
    again = [found for columns, found in filtered if "raw" in columns]
    assert len(again) == 1 and again[0].count() < 20


def test_words_of_a_line(spark):
    said = ["a b", " a  b ", "A\tB\r", "\x0ba\fb", "\u00a0a b", "", " \t ", "\u039f\u03a3 \u0130x", "a \t b"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string")
    got = [r[0] for r in rows.orderBy("i").select(lines.normal(F.col("x"))).collect()]
    assert got[:7] == ["a b"] * 4 + ["\u00a0a b", "", ""] and got[8] == "a b" and got[7] == "\u03bf\u03c2 i\u0307x"
