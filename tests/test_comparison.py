import random

from pyspark.sql import functions as F

from filigree.operators import comparison
from filigree.operators.comparison import heaviest_chain, passage_changes, successive
from filigree.plans.comparison import year_over_year


def best_sum(pairs):
    """The greatest sum over all rising chains, by trying every predecessor."""
    total = []
    for i, (o, n, w) in enumerate(pairs):
        total.append(w + max((total[j] for j in range(i) if pairs[j][0] < o and pairs[j][1] < n), default=0))
    return max(total, default=0)


def test_heaviest_chain():
    rng = random.Random(1)
    for _ in range(300):
        pairs = sorted({(rng.randint(0, 8), rng.randint(0, 8)): rng.randint(1, 5) for _ in range(rng.randint(0, 25))}.items())
        pairs = [(o, n, w) for (o, n), w in pairs]
        chain = [pairs[i] for i in heaviest_chain(*map(list, zip(*pairs)))] if pairs else []
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:]))
        assert sum(w for _, _, w in chain) == best_sum(pairs)
    assert heaviest_chain([], [], []) == []


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


SCHEMA = "series string, version int, passages array<string>"


def test_versions_are_numbered_across_ranges(spark):
    versions = [("big", v) for v in range(0, 900, 3)] + [("small", 5), ("small", 1), (None, 7), (None, 8), ("none", None)]
    found = successive(spark.createDataFrame(versions * 2, "series string, version int"), ["series"], "version")
    told = {(r.series, r.version): r.number for r in found.collect()}
    assert told == {**{("big", v): i + 1 for i, v in enumerate(range(0, 900, 3))}, ("small", 1): 1, ("small", 5): 2, (None, 7): 1, (None, 8): 2}


def test_kept_changed_added_removed(spark):
    old = ["Intro of the report.", "", "Risk: supply of parts may fail us in any year.", "We own three plants.", "The end of it all"]
    new = ["A new opening line here", "intro of THE report", "Risk: supply of parts may fail us in some year.", "- - -", "The end of it all"]
    frame = spark.createDataFrame([("a", 2021, old), ("a", 2023, new), ("a", None, new), ("b", 2021, old)], SCHEMA)
    assert rows(passage_changes(frame, ["series"], "version")) == sorted([
        ("a", 2021, 2023, 0, 1, "kept", 1.0),
        ("a", 2021, 2023, 2, 2, "changed", 0.75),
        ("a", 2021, 2023, 3, None, "removed", None),
        ("a", 2021, 2023, 4, 4, "kept", 1.0),
        ("a", 2021, 2023, None, 0, "added", None),
    ], key=str)


def test_repeated_lines_pair_one_to_one(spark):
    line = "the same line stands here many times"
    frame = spark.createDataFrame([("a", 1, [line] * 400), ("a", 2, ["something wholly different here", *[line] * 500])], SCHEMA)
    found = passage_changes(frame, ["series"], "version")
    told = {r["change"]: r["n"] for r in found.groupBy("change").agg(F.count("*").alias("n")).collect()}
    assert told == {"kept": 400, "added": 101}


def test_moved_passages_do_not_cross(spark):
    a, b, c = "alpha one two three four", "beta five six seven eight nine", "gamma ten eleven twelve"
    frame = spark.createDataFrame([(None, 1, [a, b, c]), (None, 2, [b, a, c]), (None, 3, [])], SCHEMA)
    told = rows(passage_changes(frame, ["series"], "version"))
    assert (None, 1, 2, 1, 0, "kept", 1.0) in told or (None, 1, 2, 0, 1, "kept", 1.0) in told
    assert (None, 1, 2, 2, 2, "kept", 1.0) in told
    assert [t[5] for t in told if t[1] == 2] == ["removed"] * 3
    assert len([t for t in told if t[1] == 1]) == 4


def test_against_a_plain_alignment(spark):
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randint(0, 25)}" for _ in range(rng.randint(0, 9))) for _ in range(25)]
    docs = [[rng.choice(lines) for _ in range(rng.randint(0, 15))] for _ in range(14)]
    found = passage_changes(spark.createDataFrame([("s", i, d) for i, d in enumerate(docs)], SCHEMA), ["series"], "version").collect()

    def occurrences(doc):
        out, seen = {}, {}
        for i, line in enumerate(doc):
            w = line.split()
            for s in [tuple(w[j : j + 3]) for j in range(max(len(w) - 2, 1))] if w else []:
                seen[s] = seen.get(s, 0) + 1
                out[s, seen[s]] = i
        return out

    for v, (x, y) in enumerate(zip(docs, docs[1:])):
        a, b = occurrences(x), occurrences(y)
        shared = {}
        for key in a.keys() & b.keys():
            shared[a[key], b[key]] = shared.get((a[key], b[key]), 0) + 1
        n = [[max(len(line.split()) - 2, 1) for line in d] for d in (x, y)]
        pairs = sorted((o, m, 2_000_000 * k // (n[0][o] + n[1][m])) for (o, m), k in shared.items())
        pairs = [p for p in pairs if p[2] >= 300_000]
        own = [r for r in found if r.old_version == v]
        chain = sorted((r.old_index, r.new_index) for r in own if r.similarity is not None)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(chain, chain[1:]))
        assert round(sum(r.similarity for r in own if r.similarity is not None) * 1e6) == best_sum(pairs)
        assert all((r.change == "kept") == (x[r.old_index].split() == y[r.new_index].split()) for r in own if r.similarity is not None)
        worded = [{i for i, line in enumerate(d) if line.split()} for d in (x, y)]
        assert {r.old_index for r in own if r.old_index is not None} == worded[0]
        assert {r.new_index for r in own if r.new_index is not None} == worded[1]


def test_year_over_year(spark):
    documents = spark.createDataFrame(
        [
            ("d1", "T", "10-K", 2021, "# Risk\n\nOne risk of many words.\n\nTwo.\n\n# Business\n\nWe sell."),
            ("d2", "T", "10-K", 2022, "# RISK\n\nOne risk of many words too.\n\nThree new ones come.\n\n# Business\n\nWe sell."),
            ("d3", "T", "10-Q", 2022, "# Risk\n\nOne risk of many words."),
        ],
        "document_id string, ticker string, filing_type string, year int, markdown string",
    )
    told = {(r.section, r.change, r.old_text, r.new_text) for r in year_over_year(documents).collect()}
    assert ("risk", "changed", "One risk of many words.", "One risk of many words too.") in told
    assert ("risk", "removed", "Two.", None) in told and ("risk", "added", None, "Three new ones come.") in told
    assert {s for s, *_ in told} == {"risk", "business"}


def test_no_row_per_shingle_is_made(spark, monkeypatch):
    """Words go through Spark as one array a version, and a task's rows in bounded batches."""
    monkeypatch.setattr(comparison, "ROWS", 7)
    docs = [("s", v, [f"line {i} of version {v // 2} and more" for i in range(v % 5 + 1)]) for v in range(9)] + [("s", 9, None)]
    found = passage_changes(spark.createDataFrame(docs, SCHEMA), ["series"], "version")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan
    told = {}
    for r in found.collect():
        told.setdefault((r.old_version, r.new_version), []).append(r)
    assert set(told) == {(v, v + 1) for v in range(9)}
    for (old, new), own in told.items():
        n_old, n_new = len(docs[old][2] or []), len(docs[new][2] or [])
        assert sorted(r.old_index for r in own if r.old_index is not None) == list(range(n_old))
        assert sorted(r.new_index for r in own if r.new_index is not None) == list(range(n_new))
