"""Benchmark decontamination by spaced seeds.

Each mask picks six of ten consecutive words and ignores the rest, so a substituted word
spoils only the windows whose picked positions it meets. Hashes of the picked words are
joined between documents and test items; a hit fixes an alignment of the two, and the words
that agree along it are counted. An item is held if a share of its words agrees, or a run of
aligned words of fixed length, however long the item. Items shorter than a mask are held
where all their words stand in a row.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import fresh, words_of

#: Picked positions of each mask, in SPAN words. A mask at least leaves out each position, so
#: one substitution in ten words never spoils all.
MASKS = ((0, 1, 3, 4, 7, 9), (0, 1, 2, 5, 8, 9), (0, 1, 4, 6, 7, 9), (2, 3, 4, 5, 6, 8))
SPAN = 10
#: Aligned words of a run that is enough by itself, and how many of them must agree (80 %).
RUN, RUN_AGREEING = 13, 11
#: Share of an item's words that must agree with a document.
COVERAGE = 0.6
#: Seeds that are sent to every task at a time; a larger benchmark is searched in slices.
SEEDS_PER_SLICE = 200_000


def seeds(words: Column, at: Column) -> Column:
    """One hash per mask of the window that begins at a position (from 0)."""
    return F.array(
        *[
            F.xxhash64(F.lit(m), *[F.get(words, at + F.lit(offset)) for offset in mask])
            for m, mask in enumerate(MASKS)
        ]
    )


def windows(table: DataFrame, at: str, short: Column) -> DataFrame:
    """A row per word position at which a window fits, and mask: the column `seed`.

    `short` is an array of further seeds of a position, for items of less than SPAN words.
    """
    placed = table.select("*", F.posexplode("words").alias(at, "word")).drop("word")
    none = F.array().cast("array<bigint>")
    masked = F.when(F.col(at) + SPAN <= F.size("words"), seeds(F.col("words"), F.col(at))).otherwise(none)
    return placed.withColumn("seed", F.explode(F.concat(masked, short)))


def short_seeds(at: str, lengths: list[int], whole: bool) -> Column:
    """Hashes of the next n words, for each n of `lengths` that fits; of all words if `whole`."""
    end = F.size("words") - F.col(at)
    fits = lambda n: (end == n) & (F.col(at) == 0) if whole else end >= n
    none = F.array().cast("array<bigint>")
    return F.concat(
        none, *[F.when(fits(n), F.array(F.xxhash64(F.lit(-n), F.slice("words", F.col(at) + 1, n)))).otherwise(none) for n in lengths]
    )


def _overlaps(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """Agreeing item positions for each (doc_id, text_hash, item_id, shift) that a seed has hit."""
    test = windows(items, "item_at", short_seeds("item_at", lengths, True)).select("item_id", "item_at", "seed", F.size("words").alias("item_words"))
    shift = F.col("doc_at") - F.col("item_at")
    first = F.greatest(shift, F.lit(0))
    hits = (
        windows(docs, "doc_at", short_seeds("doc_at", lengths, False))
        .join(F.broadcast(test), "seed")
        .select(
            "doc_id",
            "text_hash",
            "item_id",
            shift.alias("shift"),
            F.slice("words", first + 1, F.col("item_words") - (first - shift)).alias("met"),
        )
        .groupBy("doc_id", "text_hash", "item_id", "shift")
        .agg(F.max("met").alias("met"))
    )
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    agreeing = F.expr("filter(sequence(0, size(met) - 1), i -> get(met, i) = get(words, i + skipped))")
    last = RUN_AGREEING - 1
    run = F.expr(f"exists(sequence(0, greatest(size(met_at) - 1 - {last}, 0)), j -> get(met_at, j + {last}) - get(met_at, j) < {RUN})")
    return (
        hits.join(F.broadcast(items), "item_id")
        .withColumn("skipped", skipped)
        .select(
            "doc_id",
            "text_hash",
            "item_id",
            (F.col("shift") + F.col("skipped")).alias("start"),
            F.size("words").alias("item_words"),
            F.transform(agreeing, lambda i: i + F.col("skipped")).alias("agreeing"),
            agreeing.alias("met_at"),
        )
        .withColumn("run", F.coalesce(run, F.lit(False)))
        .drop("met_at")
    )


def held_items(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The pairs of `contaminated` for each text: its columns, and text_hash."""
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .groupBy("item_id")
        .agg(F.max("words").alias("words"))
    )
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")
    )
    n_seeds = items.agg(F.sum(F.size("words")) * len(MASKS)).first()[0] or 0
    short = items.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct()
    lengths = sorted(r["n"] for r in short.collect())
    slices = -(-n_seeds // SEEDS_PER_SLICE) or 1
    parts = [
        _overlaps(plain, items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i) if slices > 1 else items, lengths)
        for i in range(slices)
    ]
    matched = F.size(F.array_distinct(F.flatten(F.collect_list("agreeing"))))
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("doc_id", "text_hash", "item_id", "item_words")
        .agg(F.min("start").alias("start"), matched.alias("n_matched"), F.max("run").alias("run"))
        .withColumn("coverage", F.round(F.col("n_matched") / F.col("item_words"), 6))
        .where((F.col("n_matched") >= F.lit(coverage) * F.col("item_words")) | F.col("run"))
        .select("doc_id", "text_hash", "item_id", "start", "n_matched", "item_words", "coverage")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a test item of which it holds at least `coverage`, or a run of RUN words.

    Rows: doc_id, item_id, start (first word of the document that meets the item),
    n_matched (distinct item words that agree on some hit alignment), item_words, coverage.

    Words are lower-case runs of letters and digits. Null or empty texts hold nothing;
    items of fewer than SPAN words have no seed and are never found. Different texts under
    one doc_id, or under none, are searched each on its own; the one that holds most of an
    item, then the one that meets it first, gives the row of the doc_id. Repeated items each
    give their pairs once.
    """
    best = F.min(F.struct(-F.col("n_matched"), "start", "n_matched", "coverage")).alias("best")
    return (
        held_items(docs, benchmark, coverage)
        .groupBy("doc_id", "item_id", "item_words")
        .agg(best)
        .select("doc_id", "item_id", "best.start", "best.n_matched", "item_words", "best.coverage")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no test item, with all their columns.

    Rows are told apart by doc_id and the hash of their text, so a clean row stays where
    another without doc_id, or with the same one, holds an item.
    """
    found, found_hash = fresh(docs, "found_doc"), fresh(docs, "found_hash")
    held = held_items(docs, benchmark).select(F.col("doc_id").alias(found), F.col("text_hash").alias(found_hash)).distinct()
    own = docs["doc_id"].cast("long").eqNullSafe(held[found]) & (F.xxhash64(docs["text"]) == held[found_hash])
    return docs.join(held, own, "left_anti")
