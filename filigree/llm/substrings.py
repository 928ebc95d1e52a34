"""Substring dedup by level-wise doubling.

A window of `WINDOW` words is repeated only if every shorter window in it is, so lengths
double from `lengths()[0]` up: at each length only those windows are hashed that lie in
still possible long ones, and only those found in two documents carry on. Below the full
length it is enough to follow, of the short windows in each possible long one, the one with
the least hash: equal long windows choose equal ones, so no repeat is lost while few
windows are shuffled.
"""
from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import rows, texts, written

WINDOW = 50
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
MODULUS = 1 << 64
EMPTY = hashlib.sha256(b"").hexdigest()


def lengths(window: int) -> list[int]:
    """The window, halved (rounded up) while it has over 15 words; ascending."""
    found = [window]
    while found[0] > 15:
        found.insert(0, (found[0] + 1) // 2)
    return found


@functools.lru_cache(maxsize=64)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(b: int) -> np.ndarray:
        out = np.full(size, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(base), of(pow(base, -1, MODULUS))


def window_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """64-bit hash of every window of `length` words, from prefix sums modulo 2**64."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, 1 << max(10, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    mixed = (sums[length:] - sums[:-length]) * down[: n - length + 1]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return mixed


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every `width` neighbours, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def chosen(hashes: np.ndarray, possible: np.ndarray, width: int) -> np.ndarray:
    """Positions of short windows that are the least of some possible long window.

    `width` short windows lie in each long one; `possible` flags the long ones by start.
    """
    least = np.where(possible, sliding(hashes, width, np.minimum), np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero((sliding(padded, width, np.maximum) == hashes) & (hashes > 0))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(columns: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(columns) if columns else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *map(len, columns)]), pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind)
    )


BASE_FIELDS = "doc_id long, text_hash long, n_words long, full1 long, full2 long, sha string, at array<int>, hash array<long>"


def _whole_texts(window: int, length: int):
    """Per document: what identifies its word sequence, and its chosen first-level windows."""

    def run(batches):
        for keys, hashes, bodies in rows(batches, "doc_id", "text_hash", "text"):
            fixed, places, found = [], [], []
            for body in bodies:
                words = body.encode("utf-8", "surrogatepass").split()
                plain = b" ".join(words)
                full = xxhash.xxh3_128_intdigest(plain)
                at, short = np.zeros(0, np.int64), np.zeros(0, np.uint64)
                if len(words) >= window:
                    short = window_hashes(word_hashes(words), length, BASES[0])
                    at = chosen(short, np.ones(len(words) - window + 1, bool), window - length + 1)
                    short = short[at]
                places.append(at)
                found.append(short.view(np.int64))
                fixed.append((len(words), full >> 64, full & (MODULUS - 1), hashlib.sha256(plain).hexdigest()))
            if not fixed:
                continue
            n, high, low, sha = zip(*fixed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(hashes, pa.int64()),
                    pa.array(n, pa.int64()),
                    _signed(np.array(high, np.uint64)),
                    _signed(np.array(low, np.uint64)),
                    pa.array(sha),
                    _lists(places, pa.int32()),
                    _lists(found, pa.int64()),
                ],
                names=["doc_id", "text_hash", "n_words", "full1", "full2", "sha", "at", "hash"],
            )

    return run


def possible_starts(anchors, length: int, n_words: int, window: int) -> np.ndarray:
    """Long windows that hold one of the short windows found repeated."""
    edge = np.zeros(n_words + 2, np.int64)
    anchors = np.asarray(anchors, np.int64)
    np.add.at(edge, np.maximum(anchors + length - window, 0), 1)
    np.add.at(edge, anchors + 1, -1)
    return np.cumsum(edge)[: n_words - window + 1] > 0


def _next_level(window: int, before: int, length: int):
    """The windows of the next length in the possible long ones; all of them at full length."""

    def run(batches):
        for keys, hashes, bodies, anchors in rows(batches, "doc_id", "text_hash", "text", "anchors"):
            places, first, second = [], [], []
            for body, found in zip(bodies, anchors):
                words = word_hashes(body.encode("utf-8", "surrogatepass").split())
                possible = possible_starts(found, before, len(words), window)
                short = window_hashes(words, length, BASES[0])
                at = np.flatnonzero(possible) if length == window else chosen(short, possible, window - length + 1)
                places.append(at)
                first.append(short[at].view(np.int64))
                second.append(window_hashes(words, length, BASES[1])[at].view(np.int64))
            if places:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(hashes, pa.int64()),
                        _lists(places, pa.int32()),
                        _lists(first, pa.int64()),
                        _lists(second, pa.int64()),
                    ],
                    names=["doc_id", "text_hash", "at", "hash", "hash2"],
                )

    return run


def _removal(window: int):
    def run(batches):
        for keys, hashes, bodies, starts in rows(batches, "doc_id", "text_hash", "text", "starts"):
            removed, sha = [], []
            for body, at in zip(bodies, starts):
                words = body.encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.asarray(at, np.int64))
                edge[at] += 1
                edge[at + window] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest())
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)],
                    names=["doc_id", "text_hash", "part_removed", "part_sha"],
                )

    return run


def repeated(level: DataFrame) -> DataFrame:
    """(doc_id, text_hash, anchors) of the windows of a level that are in two documents."""
    every = level.select("doc_id", "text_hash", F.explode(F.arrays_zip("at", "hash")).alias("w"))
    every = every.select("doc_id", "text_hash", "w.at", "w.hash")
    shared = every.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = shared.where("low < high").select("hash")
    return every.join(shared, "hash", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_list("at").alias("anchors"))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the sha256 of the kept words of every document.

    A word goes if a window that covers it also starts in a document with a smaller doc_id.
    Documents with the words of an earlier one lose all of them (if they have a window at
    all) and take no part in the levels. Rows with the same doc_id don't remove from each
    other; rows without one neither remove nor lose anything. Null and empty texts have no
    words.
    """
    keyed = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    levels = lengths(window)
    base = written(keyed.mapInArrow(_whole_texts(window, levels[0]), BASE_FIELDS), "windows")
    firsts = base.where(f"n_words >= {window}").groupBy("full1", "full2").agg(F.min("doc_id").alias("first_id"))
    told = base.drop("at", "hash").join(firsts, ["full1", "full2"], "left")
    copy = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    later = firsts.select("full1", "full2", F.col("first_id").alias("doc_id"))
    level = base.join(later, ["full1", "full2", "doc_id"], "left_semi").select("doc_id", "text_hash", "at", "hash")

    source, before = keyed, levels[0]
    for length in levels[1:]:
        source = written(
            source.select("doc_id", "text_hash", "text").join(repeated(level), ["doc_id", "text_hash"]), f"level-{length}"
        )
        level = written(
            source.mapInArrow(
                _next_level(window, before, length),
                "doc_id long, text_hash long, at array<int>, hash array<long>, hash2 array<long>",
            ),
            f"hashes-{length}",
        )
        before = length

    every = level.select("doc_id", "text_hash", F.explode(F.arrays_zip("at", "hash", "hash2")).alias("w"))
    every = every.select("doc_id", "text_hash", "w.*")
    owner = every.groupBy("hash", "hash2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    owner = owner.where("first_id < last_id")
    starts = (
        every.join(owner, ["hash", "hash2"])
        .where("first_id < doc_id")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list("at").alias("starts"))
    )
    parts = (
        source.select("doc_id", "text_hash", "text")
        .join(starts, ["doc_id", "text_hash"])
        .mapInArrow(_removal(window), "doc_id long, text_hash long, part_removed long, part_sha string")
        .dropDuplicates(["doc_id", "text_hash"])
    )
    return told.join(parts, ["doc_id", "text_hash"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("part_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("part_sha", "sha")).alias("kept_sha256"),
    )
