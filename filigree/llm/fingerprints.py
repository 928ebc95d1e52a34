"""Document fingerprints by invertible Bloom lookup sketches.

A text is a multiset of paragraphs (lines, long ones in sentences and runs of twelve words).
Each paragraph is a 64-bit digest whose low bits hold its size; a repeat is told apart by
its number. The digests are hashed into cells that hold a count, the xor of the digests and
the xor of their checks. The cells of one version minus those of another hold only what
differs, and peeling (take a cell with one digest, remove that from its other cells, go on)
recovers those digests. If the cells are too few to peel, both versions are sketched again
with twice as many. The likeness of two versions is the share of their characters in
paragraphs that both have: 2 shared / (all of the one + all of the other).
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import rows

#: Cells of a stored fingerprint; each digest is in one cell of each third.
CELLS = 48
PARTS = 3
LINE_WORDS = 12
#: Bits of a digest that hold the size of its paragraph; larger ones count as the largest.
SIZE_BITS = 20
SIZES = np.uint64((1 << SIZE_BITS) - 1)
CELL = np.dtype([("count", "<i4"), ("digest", "<u8"), ("check", "<u4")])
SENTENCES = re.compile(r"(?<=[.!?])\s+")
#: Texts that are compared at a time, and about how many characters of them.
BATCH_TEXTS, BATCH_CHARS = 1024, 8_000_000
#: Buckets of the order by doc_id, for each shuffle partition.
BUCKETS_PER_PARTITION = 4


def paragraphs(text: str) -> list[str]:
    """The units of a text in order, white space between words as one space; none is empty."""
    found = []
    for line in text.splitlines():
        words = line.split()
        if len(words) <= LINE_WORDS:
            if words:
                found.append(" ".join(words))
            continue
        for sentence in SENTENCES.split(line):
            words = sentence.split()
            found += [" ".join(words[i : i + LINE_WORDS]) for i in range(0, len(words), LINE_WORDS)]
    return found


def digests(units: list[str]) -> np.ndarray:
    """A 64-bit digest per unit and repeat, with the unit's code points in its low bits; no two
    are equal, as equal ones would hide each other in any sketch."""
    digest, most, shift = xxhash.xxh3_64_intdigest, int(SIZES), SIZE_BITS
    found = [
        digest(b"%s\n%d" % (unit.encode("utf-8", "surrogatepass"), i)) >> shift << shift | min(len(unit), most)
        for unit, times in Counter(units).items()
        for i in range(times)
    ]
    return np.unique(np.array(found, np.uint64))


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cells of each digest, one in each third; other ones for another number of cells."""
    part = cells // PARTS
    return [(_mixed(keys, cells * 4 + i) % np.uint64(part)).astype(np.int64) + i * part for i in range(PARTS)]


def checks(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1) >> np.uint64(32)).astype(np.uint32)


class Sketches:
    """The cells of `n` sets of digests, one after the other in flat columns."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count, self.digest, self.check = (np.zeros(n * cells, CELL[name]) for name in CELL.names)

    def add(self, which: np.ndarray, keys: np.ndarray, sign) -> Sketches:
        """Put digests into the sets `which` (sign 1) or take them out (-1)."""
        own = checks(keys)
        for at in places(keys, self.cells):
            at = at + which * self.cells
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.digest, at, keys)
            np.bitwise_xor.at(self.check, at, own)
        return self

    def minus(self, other: Sketches) -> Sketches:
        """What is in one of two versions only, for each of the sets."""
        out = Sketches(self.n, self.cells)
        out.count = self.count - other.count
        out.digest, out.check = self.digest ^ other.digest, self.check ^ other.check
        return out

    def taken(self, which: np.ndarray) -> Sketches:
        out = Sketches(len(which), self.cells)
        for name in CELL.names:
            setattr(out, name, getattr(self, name).reshape(self.n, -1)[which].ravel())
        return out

    def stored(self, i: int) -> bytes:
        """The cells of one set, as they stand in a fingerprint."""
        out = np.empty(self.cells, CELL)
        for name in CELL.names:
            out[name] = getattr(self, name)[i * self.cells : (i + 1) * self.cells]
        return out.tobytes()

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(set, digest, sign) of all that is recovered, and which sets are empty then.

        Only the cells of digests just removed can have become single ones, so a round
        looks at those. More rounds than cells would go in circles over a false digest.
        """
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        at = np.flatnonzero(np.abs(self.count) == 1)
        for _ in range(self.cells):
            at = at[(np.abs(self.count[at]) == 1) & (checks(self.digest[at]) == self.check[at])]
            if not len(at):
                break
            keys, which = self.digest[at], at // self.cells
            homes = [home + which * self.cells for home in places(keys, self.cells)]
            own = at % self.cells // (self.cells // PARTS)
            right = np.choose(own, homes) == at
            for i, home in enumerate(homes):  # a digest alone in several cells is taken once
                right &= ~((own > i) & (np.abs(self.count[home]) == 1) & (self.digest[home] == keys))
            keys, which, sign = keys[right], which[right], self.count[at[right]]
            found.append((which, keys, sign))
            self.add(which, keys, -sign)
            at = np.unique(np.concatenate([home[right] for home in homes]))
        left = (self.count != 0) | (self.digest != 0) | (self.check != 0)
        return *(np.concatenate(x) for x in zip(*found)), ~left.reshape(self.n, self.cells).any(axis=1)


class Versions:
    """The digests of many texts, flat, with their base sketches."""

    def __init__(self, texts: list[str], cells: int = CELLS):
        every = [digests(paragraphs(t)) for t in texts]
        self.n, self.base = len(texts), cells
        self.lengths = np.array([len(k) for k in every], np.int64)
        self.keys = np.concatenate([np.zeros(0, np.uint64), *every])
        self.which = np.repeat(np.arange(self.n), self.lengths)
        self.sizes = np.bincount(self.which, (self.keys & SIZES).astype(np.float64), self.n).astype(np.int64)
        self.whole = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts]
        self.sketches = Sketches(self.n, cells).add(self.which, self.keys, 1)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `which`, digest) of the texts asked for."""
        begin = np.concatenate([[0], np.cumsum(self.lengths)])[which]
        n = self.lengths[which]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        return np.repeat(np.arange(len(which)), n), self.keys[at]

    def fingerprint(self, i: int) -> str:
        head = np.array([self.whole[i], self.lengths[i], self.sizes[i]], np.uint64).astype("<u8").tobytes()
        return base64.b64encode(head + self.sketches.stored(i)).decode()


def differing(a: Versions, at: np.ndarray, b: Versions, bt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the texts `at` of `a` and `bt` of `b` don't share, pair by pair: (pair, digest,
    sign) with sign 1 for the first, and the cells that each pair took.

    Pairs that don't peel are sketched again with twice as many cells. That ends: with many
    times more cells than digests nearly every digest is alone in one.
    """
    cells, todo, took = a.base, np.arange(len(at)), np.zeros(len(at), np.int64)
    apart = a.sketches.taken(at).minus(b.sketches.taken(bt))
    found = []
    while True:
        pair, keys, sign, peeled = apart.peel()
        whole = peeled[pair]
        found.append((todo[pair[whole]], keys[whole], sign[whole]))
        took[todo[peeled]] = cells
        todo, cells = todo[~peeled], cells * 2
        if not len(todo):
            return *(np.concatenate(x) for x in zip(*found)), took
        apart = Sketches(len(todo), cells).add(*a.of(at[todo]), 1).add(*b.of(bt[todo]), -1)


def likeness(a: Versions, at: np.ndarray, b: Versions, bt: np.ndarray) -> np.ndarray:
    """1 for versions of the same paragraphs, 0 for versions that share none.

    Two texts without a paragraph are alike if they are equal.
    """
    pair, keys, _, _ = differing(a, at, b, bt)
    apart = np.bincount(pair, (keys & SIZES).astype(np.float64), len(at))
    total = a.sizes[at] + b.sizes[bt]
    same = np.array([a.whole[i] == b.whole[j] for i, j in zip(at.tolist(), bt.tolist())], np.float64)
    return np.where(total > 0, (total - apart) / np.maximum(total, 1), same)


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by the beginning of the text that follows it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _told(doc_ids: list, texts: list[str], cells: int) -> pa.RecordBatch:
    """Neighbours in the order of the ids: every text but the last one, which is only a next."""
    others = [edited(text, after) for text, after in zip(texts, texts[1:])]
    own, changed = Versions(texts, cells), Versions(others, cells)
    every = np.arange(len(others))
    columns = [
        doc_ids[:-1],
        [len(t) for t in texts[:-1]],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in others],
        [own.fingerprint(i) for i in range(len(others))],
        [changed.fingerprint(i) for i in range(len(others))],
        likeness(own, every, changed, every),
        likeness(own, every, own, every + 1),
    ]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in FIELDS.split(", ")])


def _compared(cells: int):
    """Rows in the order of the ids; each is compared with the row after it in its bucket."""

    def run(batches):
        held: tuple[object, list, list] = (None, [], [])
        for buckets, guests, doc_ids, bodies in rows(batches, "bucket", "guest", "doc_id", "text"):
            for bucket, guest, doc_id, body in zip(buckets, guests, doc_ids, bodies):
                if bucket != held[0]:
                    held = (bucket, [], [])
                _, ids, texts = held
                if guest and not texts:
                    continue  # a second guest: equal rows are first together
                ids.append(doc_id)
                texts.append(body)
                if guest or len(texts) > BATCH_TEXTS or sum(map(len, texts)) > BATCH_CHARS:
                    if len(texts) > 1:
                        yield _told(ids, texts, cells)
                    held = (bucket, [], []) if guest else (bucket, ids[-1:], texts[-1:])

    return run


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, guest, doc_id, text, place): the rows of a bucket in the order of the ids.

    Buckets follow each other in that order, and end with a guest, the first row of the next
    one (of the first one for the last). They are cut at quantiles of the ids, so no task
    gets the whole order; the rows of a frequent id, or those without one, are cut by the
    hash of their texts. The texts move once.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    steps = [(i + 1) / buckets for i in range(buckets - 1)]
    found = texts.approxQuantile("doc_id", steps, 0.25 / buckets) if counted["ids"] else []
    cuts = sorted(int(x) for x in found)
    without = max(1, round(buckets * (counted["n"] - counted["ids"]) / max(counted["n"], 1)))

    place = F.xxhash64("text")
    share = place / F.lit(float(1 << 64)) + 0.5
    all_cuts = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    below = F.size(F.filter(all_cuts, lambda c: c < F.col("doc_id")))
    upto = F.size(F.filter(all_cuts, lambda c: c <= F.col("doc_id")))
    spread = F.least(F.floor(share * (upto - below + 1)), upto - below)
    no_id = F.least(F.floor(share * without), F.lit(without - 1))
    bucket = F.when(F.col("doc_id").isNull(), no_id).otherwise(below + spread + without).cast("long")
    keyed = texts.select("doc_id", "text", place.alias("place"), bucket.alias("bucket"))

    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "place")).alias("first")
    firsts = keyed.groupBy("bucket").agg(first)
    every = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(every), F.last("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # one small row per bucket
    firsts = firsts.withColumn("before", before).select(
        "bucket", F.col("first.doc_id").alias("first_id"), F.col("first.place").alias("first_place"), "before"
    )
    told = keyed.join(F.broadcast(firsts), "bucket")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("place") == F.col("first_place"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    told = told.select("doc_id", "text", "place", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    return told.select("at.bucket", "at.guest", "doc_id", "text", "place")


def fingerprints(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A text's edited version ends with the beginning of the next text in ascending doc_id
    (the last one's next is the first; a single text is its own next). Rows without doc_id
    come first; rows of the same doc_id are ordered by a hash of their texts; of equal rows
    each has another as its next. Null texts are empty. An empty table gives no row.
    """
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = in_order(docs, buckets).repartition("bucket").sortWithinPartitions("bucket", "guest", F.asc_nulls_first("doc_id"), "place", "text")
    return ordered.mapInArrow(_compared(cells), FIELDS)
