"""Rows that every operator must take."""
from pyspark.sql import types as T

#: Columns of documents, and columns named like ones that the operators make.
CLASHING = "text_hash words first rep path salt length score seed kept_doc kept_lines all_lines line unit later_doc found_doc".split()
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHING],
    ]
)
LONG = " ".join(f"w{i * i % 7919} tail{i}" for i in range(20_000))
PASSAGE = " ".join(f"common{i}" for i in range(60))
TEXTS = [
    (1, PASSAGE + " one end"),
    (2, None),
    (3, ""),
    (4, " \n\t\n "),
    (5, PASSAGE + " one end"),
    (6, "word"),
    (7, "Été déjà vu. ¿Qué?\nß straße\n" + PASSAGE),
    (8, LONG),
    (9, "a a a a a a a a a a a a"),
    (9, "a a a a a a a a a a a a"),
    (None, PASSAGE),
    (None, None),
    (10, "\x00 odd ​ � 日本語 x" * 3),
    (11, "line one is here with eight words total\nline one is here with eight words total\nother"),
    (12, "line one is here with nine words total\nother"),
]


def awkward(spark, rows=TEXTS):
    return spark.createDataFrame(
        [(i, t, None, None, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in rows], SCHEMA
    )


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def told(frame, *columns):
    """Sorted rows as tuples; a null sorts as text."""
    return sorted((tuple(r) for r in frame.select(*columns or frame.columns).collect()), key=str)
