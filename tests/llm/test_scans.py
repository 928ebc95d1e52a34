from collections import Counter

import os

import duckdb
from cases import awkward, empty, told

from filigree.llm import decontaminate
from filigree.llm.decontaminate import contaminated, decontaminated
from filigree.llm.licenses import APACHE_NOTICE, MIT, license_scan, templates

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, words string")


def test_substitutions_are_tolerated(spark):
    changed = ITEM.upper().replace("DELTA", "x").replace("IOTA", "y").replace("PI", "z")
    half = " ".join(ITEM.split()[:9])
    rows = [(1, f"start here. {changed}! and an end"), (2, half), (3, ITEM.replace(" ", "\n")), (4, "nothing of it at all")]
    found = told(contaminated(awkward(spark, rows), bench(spark, [(7, ITEM, "x"), (8, "too short", "x"), (9, None, None)])))
    assert found == [(1, 7, 2, 17, 20, 0.85), (3, 7, 0, 20, 20, 1.0)]


def test_slices_find_the_same(spark, monkeypatch):
    rows = [(i, f"before {ITEM} after {i}") for i in range(5)] + [(9, " ".join(reversed(ITEM.split())))]
    items = bench(spark, [(1, ITEM, ""), (2, " ".join(reversed(ITEM.split())), "")])
    whole = told(contaminated(awkward(spark, rows), items))
    monkeypatch.setattr(decontaminate, "SEEDS_PER_SLICE", 25)
    assert told(contaminated(awkward(spark, rows), items)) == whole and len(whole) == 6


def test_decontamination_of_awkward_documents(spark):
    items = bench(spark, [(1, " ".join(f"common{i}" for i in range(12)), None), (1, None, None), (None, ITEM, None)])
    kept = decontaminated(awkward(spark), items)
    assert kept.columns == awkward(spark).columns
    # 1, 5 and 7 hold the item, and so does one of the two rows without doc_id; the empty one stays
    assert Counter(r[0] for r in told(kept, "doc_id")) == Counter([2, 3, 4, 6, 8, 9, 9, 10, 11, 12, None])
    assert told(decontaminated(empty(spark), items)) == []
    assert decontaminated(awkward(spark), bench(spark, [])).count() == 15


def test_licenses_are_found_whole_in_paragraphs_and_in_lines(spark):
    rows = [
        (1, MIT),
        (2, "Some prose.\n\n" + MIT.replace("\n\n", "\n") + "\n\nMore prose that follows."),
        (3, "A title\nreleased under the mit licence.\nbody"),
        (4, "A title\nReleased under the MIT License\nbody"),
        (5, APACHE_NOTICE.replace("\n", " ").replace("License", "LICENSE")),
        (6, "the software is provided without the license of the work"),
    ]
    found = {(d, name): (dice, n) for d, name, dice, n, _ in told(license_scan(awkward(spark, rows), templates(spark)))}
    assert found[1, "MIT"] == (1.0, 1) and found[2, "MIT"][0] == 1.0 and found[4, "MIT"][0] == 1.0
    assert found[5, "Apache-2.0"][0] == 1.0
    assert not {d for d, _ in found} & {3, 6}


def test_license_scan_of_awkward_documents(spark):
    assert told(license_scan(awkward(spark), templates(spark))) == []
    assert told(license_scan(empty(spark), templates(spark))) == []
    assert told(license_scan(awkward(spark), templates(spark, ()))) == []


def test_clean_texts_stay_beside_held_ones_without_or_under_one_doc_id(spark):
    rows = [(None, f"x {ITEM}"), (None, "clean one"), (None, "clean two"), (None, None), (4, ITEM), (4, "clean three"), (5, "clean four")]
    items = bench(spark, [(1, ITEM, None)])
    kept = told(decontaminated(awkward(spark, rows), items), "doc_id", "text")
    assert kept == sorted([r for r in rows if r[1] is None or "clean" in r[1]], key=str)
    assert told(contaminated(awkward(spark, rows), items)) == [(4, 1, 0, 20, 20, 1.0), (None, 1, 1, 20, 20, 1.0)]


def test_long_parts_short_items_and_masked_ends_are_found(spark):
    long = [f"q{i}" for i in range(1000)]
    ten = ITEM.split()[:10]
    rows = [(1, "a b " + " ".join(long[300:334]) + " c"), (2, "a " + " ".join(long[500:510]) + " c"), (3, "say one two three now")]
    rows += [(4, "one two four three")] + [(10 + i, " ".join([*ten[:i], "other", *ten[i + 1 :]])) for i in range(10)]
    items = bench(spark, [(1, " ".join(long), ""), (2, "One two, three", ""), (3, " ".join(ten), "")])
    found = {(d, i): n for d, i, _, n, _, _ in told(contaminated(awkward(spark, rows), items))}
    assert found == {(1, 1): 34, (3, 2): 3, **{(10 + i, 3): 9 for i in range(10)}}
