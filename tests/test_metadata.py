import pytest
from pyspark.sql import functions as F

from filigree.operators.balance import balanced_top_k, facet_key
from filigree.operators.metadata import compiled

ROWS = [
    (1, "en", '{"deal": {"size": 5, "open": true}, "tag": "x"}'),
    (2, "de", '{"deal": {"size": 50}, "tag": "y"}'),
    (3, None, '{"deal": {"size": "five"}}'),
    (4, "en", None),
]


@pytest.mark.parametrize(
    "predicate, expected",
    [
        ({"field": "lang", "eq": "en"}, {1, 4}),
        ({"field": "deal.size", "ge": 5}, {1, 2}),
        ({"field": "deal.size", "eq": "five"}, {3}),
        ({"field": "deal.open", "eq": True}, {1}),
        ({"field": "tag", "in": ["x", "z"]}, {1}),
        ({"field": "tag", "in": []}, set()),
        ({"field": "tag", "exists": True}, {1, 2}),
        ({"field": "deal", "exists": False}, {4}),
        ({"not": {"field": "tag", "eq": "x"}}, {2}),
        ({"and": [{"field": "lang", "ne": "fr"}, {"or": [{"field": "deal.size", "gt": 9.5}, {"field": "tag", "eq": "x"}]}]}, {1, 2}),
        ({"and": []}, {1, 2, 3, 4}),
        ({"or": []}, set()),
    ],
)
def test_predicates(spark, predicate, expected):
    rows = spark.createDataFrame(ROWS, "id int, lang string, j string").withColumn("extra", F.parse_json("j"))
    assert {r.id for r in rows.where(compiled(predicate, ["id", "lang"])).collect()} == expected


@pytest.mark.parametrize("bad", [{"field": "a'] b", "eq": 1}, {"field": "a", "like": "x"}, {"field": "a", "eq": None}, {"field": "", "eq": 1}])
def test_bad_predicates_are_refused(bad):
    with pytest.raises(ValueError):
        compiled(bad, [])


def test_each_combination_keeps_its_share(spark):
    rows = [(1, i, "a", 2021, 1.0 - i / 100) for i in range(10)] + [(1, 20, "a", 2022, 0.2), (1, 30, "b", 2021, 0.1), (1, 31, "b", 2021, 0.05), (2, 1, None, 1, 0.5)]
    hits = spark.createDataFrame(rows, "query_id int, doc_id int, ticker string, year int, rrf_score double")
    found = balanced_top_k(hits.withColumn("f", facet_key(["ticker", "year"])), "f", 6).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.turn) for r in found] == [(1, 0, 1), (1, 20, 1), (1, 30, 1), (1, 1, 2), (1, 31, 2), (1, 2, 3), (2, 1, 1)]
