"""Spelling variants by k-d trees over letter-count vectors.

A replaced letter changes the vector of letter counts by two in L1 distance, an inserted or
deleted one by one. So the words near a word lie in the tree of its own length within two,
and in the trees of the lengths beside it within one; what a range search finds there is
verified letter by letter.

A tree has two parts. Its upper part is grown from histograms that Spark adds up over all
words, level by level, until a cell has at most `CELL_WORDS` words; the driver holds one
split per cell. A word is sent as a query to the cells whose box is within its radius. The
lower part is grown inside the task that gets the cell. Searches hand back a count and the
best partner for each query, never pairs.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import rows, written

LEAST_LENGTH, LEAST_COUNT = 6, 5
TYPO_EVERY = 199
#: A variant's form is at least so many times as frequent.
RATIO = 5
#: Letter counts are added up in so many dimensions: Unicode code point modulo this.
DIMENSIONS = 32
#: A cell of the upper trees has about this many words at most; equal vectors stay together.
CELL_WORDS = 16_384
#: The queries of a cell are dealt to so many tasks, each of which gets the cell's words.
SALTS = 8
LEAF = 24
#: Distinct words that a task counts before it sends them.
HELD_WORDS = 400_000
RUNS = re.compile("[a-zÀ-ÿ]+")


def _counted(every: int, least_length: int):
    """Words of the texts of a task with their occurrences."""

    def run(batches):
        n: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        for doc_ids, bodies in rows(batches, "doc_id", "body"):
            for doc_id, body in zip(doc_ids, bodies):
                begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                runs = Counter(RUNS.findall(body.lower().decode("utf-8", "replace")))
                for word, times in runs.items():
                    if len(word) < least_length:
                        continue
                    h = zlib.crc32(word.encode(), begin)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    n[word] += times
                if len(n) > HELD_WORDS:
                    yield out()
                    n.clear()
        if n:
            yield out()

    return run


def vocabulary(
    docs: DataFrame, every: int = TYPO_EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT
) -> DataFrame:
    """(word, n) of the words long and frequent enough, a letter missing in every 199th."""
    # UTF-8 bytes: only A-Z have a lower case there
    bodies = docs.select("doc_id", F.col("text").cast("binary").alias("body")).where("text IS NOT NULL")
    found = bodies.mapInArrow(_counted(every, least_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def vectors(points: np.ndarray) -> np.ndarray:
    """Letter counts, added up in `DIMENSIONS` dimensions."""
    n = len(points)
    place = (np.arange(n)[:, None] * DIMENSIONS + points % DIMENSIONS).ravel()
    return np.minimum(np.bincount(place, minlength=n * DIMENSIONS), 120).astype(np.int8).reshape(n, DIMENSIONS)


class Tree:
    """The upper k-d tree of the words of one length: splits, and cells with their boxes."""

    def __init__(self):
        self.splits: list[tuple[int, int, int, int]] = []  # node, dimension, value, first child
        self.children = 1
        self.boxes: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def nodes(self, v: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        at = np.zeros(len(v), np.int64)
        for node, dimension, value, child in self.splits:
            here = np.flatnonzero(at == node)
            at[here] = child + (v[here, dimension] >= value)
        return at

    def within(self, v: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for the cells whose box is within `radius` of a vector, by L1 distance."""
        found = []
        for cell, (low, high, _) in self.boxes.items():
            at = np.flatnonzero(box_distance(v, low, high) <= radius)
            found.append((at, np.full(len(at), cell)))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def box_distance(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    outside = np.maximum(low - v, 0) + np.maximum(v - high, 0)
    return outside.sum(axis=1, dtype=np.int32)


def by_length(words: list[str]) -> dict[int, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return {int(k): np.flatnonzero(lengths == k) for k in np.unique(lengths)}


def _histograms(trees: dict[int, Tree]):
    """(length, node, dimension, value, n) of the letter counts at the nodes of the trees."""

    def run(batches):
        n: Counter[tuple[int, int, int, int]] = Counter()
        for (words,) in rows(batches, "word"):
            for length, at in by_length(words).items():
                v = vectors(letters([words[i] for i in at.tolist()], length)).astype(np.int64)
                node = trees[length].nodes(v) if length in trees else np.zeros(len(v), np.int64)
                code = ((node[:, None] * DIMENSIONS + np.arange(DIMENSIONS)) * 128 + v).ravel()
                for c, k in zip(*(x.tolist() for x in np.unique(code, return_counts=True))):
                    n[length, c // 128 // DIMENSIONS, c // 128 % DIMENSIONS, c % 128] += k
        if n:
            columns = [pa.array(x, pa.int64()) for x in zip(*n)] + [pa.array(list(n.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["length", "node", "dimension", "value", "n"])

    return run


def _best_split(values: dict[int, dict[int, int]], size: int) -> tuple[int, int] | None:
    """The dimension and value that part a node most evenly; none if its vectors are equal."""
    best, found = 0, None
    for dimension, counts in sorted(values.items()):
        below = 0
        for value in sorted(counts):
            if min(below, size - below) > best:
                best, found = min(below, size - below), (dimension, value)
            below += counts[value]
    return found


def grown(words: DataFrame, cell_words: int = CELL_WORDS) -> dict[int, Tree]:
    """The upper trees, by length. Each level is one pass; the driver gets a histogram per
    node (32 dimensions of a few values), so what it holds grows with words / cell_words."""
    trees: dict[int, Tree] = {}
    while True:
        found = words.select("word").mapInArrow(_histograms(trees), "length long, node long, dimension long, value long, n long")
        told: dict[tuple[int, int], dict[int, dict[int, int]]] = {}
        for length, node, dimension, value, n in found.groupBy("length", "node", "dimension", "value").agg(F.sum("n")).collect():
            told.setdefault((length, node), {}).setdefault(dimension, {})[value] = n
        split = False
        for (length, node), values in sorted(told.items()):
            tree = trees.setdefault(length, Tree())
            size = sum(values[0].values())
            low, high = (np.array([f(values[d]) for d in range(DIMENSIONS)], np.int16) for f in (min, max))
            tree.boxes[node] = (low, high, size)
            cut = _best_split(values, size) if size > cell_words else None
            if cut:
                del tree.boxes[node]
                tree.splits.append((node, *cut, tree.children))
                tree.children += 2
                split = True
        if not split:
            return trees


ROUTED = "length long, cell long, salt int, query boolean, word string, n long"


def _routed(trees: dict[int, Tree]):
    """Each word as a point of its cell, once per salt, and as a query of the cells around."""

    def run(batches):
        for words, counts, salts in rows(batches, "word", "n", "salt"):
            counts, salts = np.array(counts, np.int64), np.array(salts, np.int32)
            for length, at in by_length(words).items():
                own = [words[i] for i in at.tolist()]
                v = vectors(letters(own, length)).astype(np.int16)
                parts = []
                node = trees[length].nodes(v)
                for salt in range(SALTS):
                    parts.append((np.arange(len(own)), np.full(len(own), length), node, np.full(len(own), salt), False))
                for other, radius in ((length - 1, 1), (length, 2), (length + 1, 1)):
                    if other in trees:
                        row, cell = trees[other].within(v, radius)
                        parts.append((row, np.full(len(row), other), cell, salts[at][row], True))
                for row, lengths, cell, salt, query in parts:
                    if len(row):
                        arrays = [
                            pa.array(lengths.astype(np.int64)),
                            pa.array(cell.astype(np.int64)),
                            pa.array(salt.astype(np.int32)),
                            pa.array(np.full(len(row), query)),
                            pa.array(own).take(pa.array(row)),
                            pa.array(counts[at][row]),
                        ]
                        yield pa.RecordBatch.from_arrays(arrays, names=["length", "cell", "salt", "query", "word", "n"])

    return run


def range_search(points: np.ndarray, queries: np.ndarray, radius: np.ndarray):
    """Yield (queries, points) as index arrays that pair them if their L1 distance is within
    the query's radius; a k-d tree grown on the way down, its boxes pruning queries."""
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        p, q = stack.pop()
        own = points[p]
        low, high = own.min(axis=0), own.max(axis=0)
        q = q[box_distance(queries[q], low, high) <= radius[q]]
        if not len(q):
            continue
        spread = high - low
        if len(p) > LEAF and spread.any():
            dimension = int(spread.argmax()) if spread.max() > 1 else _evenest(own, low, high)
            middle = np.median(own[:, dimension])
            right = own[:, dimension] > middle if middle < high[dimension] else own[:, dimension] >= middle
            stack += [(p[right], q), (p[~right], q)]
            continue
        for block in np.array_split(q, max(1, len(q) * len(p) // 2_000_000)):
            distance = np.abs(queries[block][:, None, :] - own[None, :, :]).sum(axis=2, dtype=np.int16)
            row, column = np.nonzero(distance <= radius[block][:, None])
            yield block[row], p[column]


def _evenest(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
    upper = (own == high).sum(axis=0)
    return int(np.where(high > low, np.minimum(upper, len(own) - upper), -1).argmax())


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of code points differ at exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of `long` are those of `short` with one more letter somewhere."""
    head = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= short.shape[1]


def _searched(cell):
    """Per query of a cell: how many of the cell's words are near, and the best of them."""
    is_query = cell.column("query").to_numpy(zero_copy_only=False)
    words, n = cell.column("word").to_pylist(), cell.column("n").to_numpy().astype(np.int64)
    at_points, at_queries = np.flatnonzero(~is_query), np.flatnonzero(is_query)
    found = ([], [], [], [])
    if len(at_points):
        # words in order, so that the least of equally frequent ones is the first
        at_points = np.array(sorted(at_points.tolist(), key=lambda i: (-n[i], words[i])), np.int64)
        length = len(words[at_points[0]])
        points = letters([words[i] for i in at_points.tolist()], length)
        v = vectors(points).astype(np.int16)
        queries = [words[i] for i in at_queries.tolist()]
        for own, at in by_length(queries).items():
            asked = letters([queries[i] for i in at.tolist()], own)
            radius = np.full(len(asked), 2 if own == length else 1, np.int16)
            total = np.zeros(len(asked), np.int64)
            best = np.full(len(asked), len(points), np.int64)
            for q, p in range_search(v, vectors(asked).astype(np.int16), radius):
                if own == length:
                    near = one_replaced(asked[q], points[p])
                else:
                    near = one_inserted(points[p], asked[q]) if own > length else one_inserted(asked[q], points[p])
                total += np.bincount(q[near], minlength=len(asked))
                np.minimum.at(best, q[near], p[near])
            hit = np.flatnonzero(total)
            found[0].extend(queries[at[i]] for i in hit.tolist())
            found[1].extend(total[hit].tolist())
            found[2].extend(words[at_points[i]] for i in best[hit].tolist())
            found[3].extend(n[at_points[best[hit]]].tolist())
    kinds = [("word", pa.string()), ("near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())]
    return pa.table(list(found), schema=pa.schema(kinds))


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of the words of (word, n) that have words one edit away."""
    trees = grown(words, cell_words)
    salted = words.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
    routed = salted.mapInArrow(_routed(trees), ROUTED)
    parts = routed.groupBy("length", "cell", "salt").applyInArrow(_searched, "word string, near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("low"), F.col("best"))).alias("first")
    told = parts.groupBy("word").agg(F.sum("near").alias("n_near"), first)
    return told.select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.low")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): each step doubles how far along the forms a word looks."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        further = now.join(onward, "root", "left")
        then = written(further.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def spelling_groups(
    docs: DataFrame,
    every: int = TYPO_EVERY,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    cell_words: int = CELL_WORDS,
) -> DataFrame:
    """Word, form, root, n, n_near and form_n of every word long and frequent enough.

    Null and empty texts have no words. A row without doc_id is hashed as if its id were
    empty. Repeated rows and doc_ids count each time. Of equally frequent near words the
    first in code-point order is the form. An empty table gives no row.
    """
    words = written(vocabulary(docs, every, least_length, least_count), "spellings")
    near = words.join(near_words(words, cell_words), "word", "left")
    has_form = F.col("best_n") >= ratio * F.col("n")
    near = near.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"),
        F.when(has_form, F.col("best_n")).alias("form_n"),
    )
    near = written(near, "near")
    ends = roots(near.where("form IS NOT NULL"))
    return near.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
