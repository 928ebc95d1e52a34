"""Packing documents into sequences of fixed capacity by fitted length patterns.

The histogram of piece lengths (at most `capacity` numbers, whatever the corpus) is all
that the driver sees. Patterns of up to three lengths that fill a sequence exactly (then of
four, then nearly full ones) are fitted to it by non-negative least squares, over and over on what is left, and
the repeat counts of the most used ones are rounded down and taken. What no pattern holds is
placed best-fit by counts. Pieces then find their place by their rank among the pieces of
their length.
"""
from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import rows, texts, written
from filigree.llm.tokens import encoder

PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rounds of the multiplicative least-squares update: to choose patterns, and for their counts.
CHOICE_ROUNDS, FIT_ROUNDS = 10, 60
#: Patterns that a fit keeps for its counts, which bounds the plan; fits at most.
KEPT_PATTERNS, FITS = 8_192, 16
#: Ids that a nearly full sequence may lack.
SLACK = 8
#: Shares of the fitted sequences among which the one with the fewest sequences in all is taken.
SHARES = (1.0, 0.99, 0.98, 0.96, 0.94, 0.92, 0.9, 0.87, 0.84, 0.8, 0.7, 0.6, 0.5, 0.25)
#: Salt buckets per length at least; more as pieces grow, at about this many pieces each.
SALTS, PIECES_PER_SALT = 64, 2_000_000


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most `capacity` ids of every whole text with its end id.

    A null text is empty, so it is one piece of the end id. Only longer documents are cut.
    """

    def cut(batches):
        encode_text = encoder(tokenizer_path).encode
        end = np.array([end_id], "<u4").tobytes()
        for keys, bodies in rows(batches, "doc_id", "text"):
            out: list[tuple] = []
            for key, body in zip(keys, bodies):
                ids = encode_text(body) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return texts(docs).mapInArrow(cut, PIECE_FIELDS)


def patterns_of(left: np.ndarray, capacity: int, most: int, slack: int, turn: int) -> np.ndarray:
    """Rows (a, b, c, d), a >= b >= c >= d, of present lengths that fill a sequence; 0 is no document.

    All that fill it exactly with up to three lengths, and, if `most` is four, for each (a, b)
    one with two more: of the pairs that fill the rest, the one in place `turn` by its number of pieces, so
    every fit sees others. With `slack`, the longest c that leaves at most so many ids free.
    """
    lengths = np.flatnonzero(left)
    longest = np.zeros(capacity + 1, np.int64)  # present length that is next below; 0 is none
    longest[lengths] = lengths
    longest = np.maximum.accumulate(longest)
    a, b = np.meshgrid(np.append(0, lengths), np.append(0, lengths), indexing="ij")
    ok = (a >= b) & (a + b <= capacity) & (a > 0)
    a, b = a[ok], b[ok]
    space = capacity - a - b
    c = longest[space]
    ok = (c <= b) & (space - c <= slack)
    triples = np.stack([a[ok], b[ok], c[ok], np.zeros(ok.sum(), np.int64)], axis=1)

    third = np.zeros(capacity + 1, np.int64)  # for each space, the longer length of the pair chosen
    for whole in range(2, capacity + 1) if most == 4 and len(lengths) else ():
        upper = lengths[(2 * lengths >= whole) & (lengths < whole)]
        upper = upper[left[whole - upper] > 0]
        if len(upper):
            order = np.argsort(-np.minimum(left[upper], left[whole - upper]), kind="stable")
            third[whole] = upper[order[turn % len(upper)]]
    c = third[space]
    ok = (c > 0) & (c <= b)
    quads = np.stack([a[ok], b[ok], c[ok], (space - c)[ok]], axis=1)
    found = np.concatenate([triples, quads])
    times = (found[:, :, None] == found[:, None, :]).sum(axis=2)
    return found[((found == 0) | (times <= left[found])).all(axis=1)]


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Non-negative x that lessens |A x - histogram|, A the lengths of each pattern.

    Multiplicative updates (A and the histogram are not negative), so x stays so too.
    """
    target = histogram.astype(float)
    target[0] = 0.0
    weight = (patterns > 0).astype(float)
    width = patterns.shape[1]
    x = np.full(len(patterns), max(1.0, target.sum()) / (width * max(1, len(patterns))))
    up = (target[patterns] * weight).sum(axis=1)
    for _ in range(rounds):
        made = sum(np.bincount(patterns[:, i], x, len(target)) for i in range(width))
        made[0] = 0.0
        x *= up / np.maximum((made[patterns] * weight).sum(axis=1), 1e-12)
    return x


def best_fit(histogram: np.ndarray, capacity: int) -> Counter:
    """Best-fit decreasing over counts: pattern (tuple of lengths) -> sequences."""
    open_by_space: dict[int, list[list]] = defaultdict(list)
    spaces = np.zeros(capacity + 1, bool)
    spaces[capacity] = True
    for length in np.flatnonzero(histogram)[::-1].tolist():
        left = int(histogram[length])
        while left:
            space = length + int(np.argmax(spaces[length:]))
            per_sequence = space // length
            if space == capacity:
                full, rest = divmod(left, per_sequence)
                new = [((), full, per_sequence), ((), 1 if rest else 0, rest)]
                left = 0
            else:
                pattern, count = open_by_space[space].pop()
                spaces[space] = bool(open_by_space[space])
                per_sequence = min(per_sequence, left)
                used = min(count, left // per_sequence)
                new = [(pattern, used, per_sequence)]
                left -= used * per_sequence
                if count > used:
                    open_by_space[space].append([pattern, count - used])
                    spaces[space] = True
            for pattern, count, times in new:
                if count:
                    space_left = capacity - sum(pattern) - times * length
                    open_by_space[space_left].append([pattern + (length,) * times, count])
                    if space_left:
                        spaces[space_left] = True
    out: Counter = Counter()
    for groups in open_by_space.values():
        for pattern, count in groups:
            out[pattern] += count
    return out


def rounded(patterns: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """The most used patterns of a fit and their repeat counts, rounded down but to 1 at least.

    Together they make about half of the sequences fitted; so the next fit corrects what
    rounding changed. Repeats are held to the pieces left, which are taken out of `left`.
    """
    if len(patterns) > KEPT_PATTERNS:
        x = fit_counts(patterns, left, CHOICE_ROUNDS)
        patterns = patterns[np.sort(np.argpartition(-x, KEPT_PATTERNS)[:KEPT_PATTERNS])]
    x = fit_counts(patterns, left)
    most, made, taken = max(1.0, x.sum() / 2), 0, []
    for i in np.argsort(-x, kind="stable").tolist():
        pattern = tuple(v for v in patterns[i].tolist() if v)
        repeats = min(max(1, int(x[i])), *(int(left[v]) // k for v, k in Counter(pattern).items()))
        if repeats > 0:
            taken.append((pattern, repeats))
            np.subtract.at(left, list(pattern), repeats)
            made += repeats
            if made >= most:
                break
    return taken


def fitted_sequences(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeats in the order in which they were fitted: of three lengths, four, nearly full."""
    left, taken = histogram.copy(), []
    for most, slack in ((3, 0), (4, 0), (4, SLACK)):
        for turn in range(FITS):
            patterns = patterns_of(left, capacity, most, slack, turn)
            if not len(patterns):
                break
            taken += rounded(patterns, left)
    return taken


def plan(histogram: np.ndarray, capacity: int) -> Counter:
    """Patterns and repeat counts that hold exactly the pieces of the histogram.

    Fitted patterns, and best-fit for the pieces that they leave. Where the pieces left pack
    badly, the last fitted ones are given up for them: of `SHARES` of the fitted sequences,
    the one that needs the fewest in all is taken, the largest of equal ones.
    """
    bound = -(-int((histogram * np.arange(len(histogram))).sum()) // capacity)
    taken = fitted_sequences(histogram, capacity)
    made = np.cumsum([repeats for _, repeats in taken])
    best = best_fit(histogram, capacity)
    least = sum(best.values()) + 1
    for share in SHARES if taken else ():
        left, fitted = histogram.copy(), Counter()
        for pattern, repeats in taken[: int(np.searchsorted(made, share * made[-1])) + 1]:
            fitted[pattern] += repeats
            np.subtract.at(left, list(pattern), repeats)
        fitted.update(best_fit(left, capacity))
        if sum(fitted.values()) < least:
            best, least = fitted, sum(fitted.values())
        if least == bound:
            break
    return best


def slots(counts: Counter) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, offset) of its slots, ordered by rank."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0
    for pattern, repeats in sorted(counts.items()):
        offset = 0
        for length in pattern:
            found[length].append((used[length], sequence, offset))
            used[length] += repeats
            offset += length
        sequence += repeats
    return {length: tuple(np.array(c, np.int64) for c in zip(*x)) for length, x in found.items()}


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Every piece with its sequence and its place there.

    Rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Each row of `docs`
    is packed, repeated doc_ids too; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    places = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    salts = max(SALTS, int(histogram.sum()) // PIECES_PER_SALT)

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    ahead = ahead.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("inside", F.row_number().over(inside) - 1)
        .join(ahead, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("inside")).alias("rank"))
    )

    def place(frames):
        for frame in frames:
            sequence = np.zeros(len(frame), np.int64)
            offset = np.zeros(len(frame), np.int64)
            for length, at in frame.groupby("length").indices.items():
                first, base, where = places.value[int(length)]
                rank = frame["rank"].to_numpy()[at]
                slot = np.searchsorted(first, rank, side="right") - 1
                sequence[at] = base[slot] + rank - first[slot]
                offset[at] = where[slot]
            yield pd.DataFrame(frame.drop(columns="rank")).assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, PIECE_FIELDS + ", sequence_id long, offset long")
