"""Jaccard join of documents on five-word shingles by chosen paths.

Documents with the same shingle set form one class, which its least doc_id stands for. A
class then goes down `RUNS` times from the root to the shingles it samples (the same
shingle is sampled alike everywhere, at a rate of `PICKS` per set). Buckets of classes that
met are compared by MinHash sketches when they are small; larger ones are split again on
further sampled shingles, unless their members share most of these, which no split would
part. What is too large then is compared in pairs of blocks.

Sketches only nominate: the classes that they connect are a cluster, and inside a cluster
the exact Jaccard of the shingle sets decides, again in pairs of blocks. Neither step emits
pairs: a task sends on a spanning forest and the number of links of each class.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import fresh, rows, texts, written
from filigree.llm.components import components
from filigree.llm.substrings import BASES, MODULUS, _lists, _signed, window_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Wanted chance that a pair at the threshold meets in a bucket, and picks per set and run.
RECALL, PICKS = 0.99999, 4.0
RUNS = math.ceil(math.log(1 - RECALL) / (-THRESHOLD * PICKS))
#: Shingles kept for deeper splits, and the share of them that a split follows.
DEEP, FOLLOWED = 64, 16
#: Buckets up to this size are compared; deeper than this no bucket is split.
BRUTE, DEPTH = 1024, 6
#: Classes of a block whose sets are compared exactly.
EXACT = 256
#: Sketch size, and the agreement that nominates: 4 standard errors below the threshold.
SKETCH = 128
NOMINATE = THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SKETCH)
WORD = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_SALTS = _RNG.integers(1, 1 << 63, RUNS + 1, dtype=np.uint64) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; one of all words if fewer."""
    words = [w.encode() for w in WORD.findall(text.lower())]
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(SHINGLE, len(words)), BASES[0]))


def _rehash(values: np.ndarray, multiplier) -> np.ndarray:
    mixed = values * multiplier
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)


def sampled(values: np.ndarray, salt: int, rate: float) -> np.ndarray:
    """The values that a hash puts below `rate` per member: alike in every set, if sizes are."""
    share = rate / max(len(values), 1)
    if share >= 1:
        return values
    return values[_rehash(values, _SALTS[salt]) < np.uint64(share * MODULUS)]


def sketch(values: np.ndarray) -> bytes:
    """One byte of each of `SKETCH` minima."""
    least = np.empty(SKETCH, np.uint64)
    for begin in range(0, SKETCH, 16):
        least[begin : begin + 16] = (values[None, :] * _MULTIPLY[begin : begin + 16, None]).min(axis=1)
    return (_rehash(least, np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8).tobytes()


SET_FIELDS = "doc_id long, text_hash long, size int, set1 long, set2 long, paths array<long>, deep array<long>, sketch binary"


def _describe(batches):
    for keys, hashes, bodies in rows(batches, "doc_id", "text_hash", "text"):
        sizes, full, paths, deep, sketches = [], [], [], [], []
        for body in bodies:
            values = shingles(body)
            sizes.append(len(values))
            full.append(xxhash.xxh3_128_intdigest(values.tobytes()))
            first = [_rehash(sampled(values, run, PICKS), _SALTS[run]) + np.uint64(run) for run in range(RUNS)]
            paths.append(np.concatenate(first).view(np.int64))
            deep.append(sampled(values, RUNS, DEEP).view(np.int64))
            sketches.append(sketch(values) if len(values) else b"")
        if keys:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(hashes, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    _signed(np.array([x >> 64 for x in full], np.uint64)),
                    _signed(np.array([x & (MODULUS - 1) for x in full], np.uint64)),
                    _lists(paths, pa.int64()),
                    _lists(deep, pa.int64()),
                    pa.array(sketches, pa.binary()),
                ],
                names=["doc_id", "text_hash", "size", "set1", "set2", "paths", "deep", "sketch"],
            )


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from batches that are sorted by `key`."""
    held = None
    for batch in batches:
        frame = batch.to_pandas()
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        last = held[key].to_numpy() != held[key].iloc[-1] if len(held) else np.zeros(0, bool)
        if last.any():
            yield held[last].reset_index(drop=True)
            held = held[~last].reset_index(drop=True)
    if held is not None and len(held):
        yield held


class _Forest:
    """Union-find that says which edges join two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def stars(self) -> tuple[list[int], list[int]]:
        """An edge from each root, the least of its tree, to every other node."""
        edges = [(self.root(x), x) for x in list(self.parent)]
        return [r for r, x in edges if r != x], [x for r, x in edges if r != x]


def _nominate(batches):
    """Edges (low, high) that tie classes to the least one that their sketches lead to."""
    for frame in groups(batches, "path"):
        keys, ids = frame["path"].to_numpy(), frame["rep"].to_numpy()
        bytes_ = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), SKETCH)
        forest = _Forest()
        at, gap = np.arange(len(keys)), 1
        while True:
            at = at[at + gap < len(keys)]
            at = at[keys[at] == keys[at + gap]]
            if not len(at):
                break
            for begin in range(0, len(at), 65_536):
                part = at[begin : begin + 65_536]
                alike = (bytes_[part] == bytes_[part + gap]).sum(axis=1) >= NOMINATE * SKETCH
                for i in part[alike].tolist():
                    forest.joins(int(ids[i]), int(ids[i + gap]))
            gap += 1
        low, high = forest.stars()
        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["low", "high"])


def blocks(members: DataFrame, key: str, size: int) -> DataFrame:
    """Members (key, rep, size of the group `n`) under keys of two blocks each.

    A group of at most `size` has one block. `side` is 0 or 1 for the two blocks; a block
    with itself has only side 0.
    """
    n_blocks = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")
    out = members.withColumn("n_blocks", n_blocks).withColumn("own", own)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    first, second = F.least("own", "other"), F.greatest("own", "other")
    return out.withColumn(key, F.xxhash64(key, first, second)).withColumn("side", (F.col("own") > F.col("other")).cast("int"))


def buckets(reps: DataFrame) -> DataFrame:
    """(path, rep, n): the buckets to compare, of two classes at least."""
    nodes = reps.select("rep", F.explode(F.array_distinct("paths")).alias("path"))
    leaves = None
    for depth in range(DEPTH + 1):
        sizes = nodes.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        met = written(nodes.join(sizes, "path"), "nodes")
        small, large = met.where(f"n <= {BRUTE}"), met.where(f"n > {BRUTE}")
        leaves = small if leaves is None else leaves.unionByName(small)
        if large.isEmpty():
            break
        if depth == DEPTH:
            leaves = leaves.unionByName(large)
            break
        followed = F.filter("deep", lambda x: F.pmod(F.xxhash64("path", x), F.lit(FOLLOWED)) == 0)
        split = large.join(reps.select("rep", "deep"), "rep").select("path", "rep", "n", F.explode(followed).alias("shingle"))
        child = F.xxhash64("shingle", "path")
        split = written(split.select("path", "rep", "n", child.alias("child")), "children")
        parts = split.groupBy("path", "child", "n").agg(F.count("*").alias("m"))
        dense = parts.groupBy("path").agg((F.sum(F.col("m") * F.col("m")) / F.sum("m") / F.max("n")).alias("share"))
        dense = dense.where("share >= 0.25").select("path")
        leaves = leaves.unionByName(large.join(dense, "path", "left_semi"))
        nodes = split.join(dense, "path", "left_anti").select("rep", F.col("child").alias("path"))
    return leaves


def _count_links(batches):
    """Links of each class inside a pair of blocks, and a forest of them.

    Rows: low and high (a forest edge), or low and links (other documents within the
    threshold of class `low`, copies counted).
    """
    for frame in groups(batches, "cluster"):
        low, high, links = [], [], []
        for _, group in frame.groupby("cluster", sort=False):
            ids, copies, sides = (group[c].to_numpy() for c in ("rep", "copies", "side"))
            sets = [np.frombuffer(x, np.uint64) for x in group["members"]]
            size = np.array([len(x) for x in sets])
            _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(sets)), size)[times[at] > 1]
            at = (np.cumsum(times > 1) - 1)[at[times[at] > 1]]  # shingles of one set alone are shared by no pair
            order = np.argsort(at, kind="stable")
            at, owner = at[order], owner[order]
            shared = np.zeros((len(sets), len(sets)), np.float32)
            begin = 0
            while begin < len(at):  # dense slices of the shingle vocabulary, 4096 at a time
                end = int(np.searchsorted(at, at[begin] + 4096))
                slice_ = np.zeros((len(sets), int(at[end - 1] - at[begin]) + 1), np.float32)
                slice_[owner[begin:end], at[begin:end] - at[begin]] = 1
                shared += slice_ @ slice_.T
                begin = end
            linked = shared >= THRESHOLD * (size[:, None] + size[None, :] - shared) - 1e-3
            linked &= np.triu(np.ones_like(linked), 1)
            if sides.any():
                linked &= sides[:, None] != sides[None, :]
            a, b = np.nonzero(linked)
            # counts are whole numbers far below 2**24, so exact in single precision
            exact = shared[a, b].astype(np.int64) * 5 >= 4 * (size[a] + size[b] - shared[a, b].astype(np.int64))
            a, b = a[exact], b[exact]
            count = np.bincount(a, copies[b], len(sets)) + np.bincount(b, copies[a], len(sets))
            forest = _Forest()
            for x, y in zip(ids[a].tolist(), ids[b].tolist()):
                forest.joins(x, y)
            tied = forest.stars()
            low += tied[0]
            high += tied[1]
            links += [None] * len(tied[0])
            for i in np.flatnonzero(count).tolist():
                low.append(int(ids[i]))
                high.append(None)
                links.append(int(count[i]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(links, pa.int64())], names=["low", "high", "links"]
        )


def _sets(batches):
    for batch in batches:
        found = [shingles(x).tobytes() for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("rep", "copies", "component", "n")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], names=["rep", "copies", "component", "n", "members"])


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of every row of `docs`.

    class_id is the least doc_id that is connected by links (Jaccard of the shingle sets at
    least 0.8); n_links counts the other documents that are linked directly, copies
    included. Texts without words link to nothing and are their own class. Rows that repeat
    a doc_id count as one document, with the text of the least hash; rows without doc_id
    have no class and no links.
    """
    keyed = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    base = written(keyed.mapInArrow(_describe, SET_FIELDS), "sets")
    known = base.where("doc_id IS NOT NULL")
    once = known.groupBy("doc_id").agg(F.min(F.struct("text_hash", "size", "set1", "set2")).alias("m"))
    members = written(once.select("doc_id", "m.*"), "members")
    same = members.where("size > 0").groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(same, "classes")
    of_class = ["doc_id", "set1", "set2"]
    reps = known.join(classes.withColumnRenamed("rep", "doc_id"), of_class).dropDuplicates(of_class)
    reps = written(reps.select(F.col("doc_id").alias("rep"), "text_hash", "copies", "paths", "deep", "sketch"), "reps")

    met = blocks(buckets(reps), "path", BRUTE).where("n_blocks = 1 OR own <> other OR side = 0")
    compared = met.select("path", "rep").join(reps.select("rep", "sketch"), "rep")
    compared = compared.repartition("path").sortWithinPartitions("path")
    nominated = components(compared.mapInArrow(_nominate, "low long, high long"))
    nominated = written(nominated.select(F.col("node").alias("rep"), "component"), "nominated")

    sizes = nominated.groupBy("component").agg(F.count("*").alias("n"))
    cluster = nominated.join(sizes, "component").join(reps.select("rep", "copies", "text_hash"), "rep")
    held = keyed.join(cluster, (F.col("rep") == F.col("doc_id")) & (keyed["text_hash"] == cluster["text_hash"]))
    held = held.select("rep", "copies", "component", "n", "text")
    with_sets = written(
        held.mapInArrow(_sets, "rep long, copies long, component long, n long, members binary").dropDuplicates(["rep"]),
        "shingles",
    )
    paired = blocks(with_sets.withColumn("cluster", F.col("component")), "cluster", EXACT)
    paired = paired.select("cluster", "side", "rep", "copies", "members").repartition("cluster").sortWithinPartitions("cluster")
    told = written(paired.mapInArrow(_count_links, "low long, high long, links long"), "links")
    linked = components(told.where("high IS NOT NULL").select("low", "high"))
    linked = linked.select(F.col("node").alias("rep"), F.col("component").alias("least"))
    counts = told.where("links IS NOT NULL").groupBy(F.col("low").alias("rep")).agg(F.sum("links").alias("links"))
    done = classes.join(linked, "rep", "left").join(counts, "rep", "left")
    done = done.select(
        "set1", "set2", F.coalesce("least", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    answer = members.join(done, ["set1", "set2"], "left").select(
        F.col("doc_id").alias("known_id"), F.coalesce("class", "doc_id").alias("class"), F.coalesce("links", F.lit(0)).alias("links")
    )
    return base.select("doc_id").join(answer, F.col("doc_id") == F.col("known_id"), "left").select(
        "doc_id", F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links")
    )


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is the least of its class, with all their columns.

    Blank texts are copies of each other, so the one with the least doc_id stays. Rows
    without doc_id stay.
    """
    name = fresh(docs, "later_doc")
    blank = F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n")) == ""
    first_blank = docs.where(blank).agg(F.min(F.col("doc_id").cast("long"))).first()[0]
    later = jaccard_join(docs).where("class_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(later, docs["doc_id"].cast("long") == later[name], "left_anti")
    return kept.where(F.coalesce(~blank | (F.col("doc_id") == F.lit(first_blank)), F.lit(True)))
