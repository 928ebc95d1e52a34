"""Token ids of a corpus in a binary format of 64-bit words (Simple-8b).

A word holds a selector in its top four bits and 60 bits of payload: `COUNTS[s]` values of
`60 // COUNTS[s]` bits each, the first value in the lowest bits. Selector 15 announces an
escape: the next word is one raw value, so any unsigned 64-bit id can be stored. A segment
is the blob of some consecutive documents:

    header   magic "S8B2", documents d, ids n, words w, ids per block, unnamed    (u4 + 5 x u8)
    doc_ids  d x i8;  lengths d x u8        (the first `unnamed` have no doc_id, shown as 0)
    blocks   one u8 per block of `BLOCK_IDS` ids: the index of its first word
    words    w x u8

No word reaches over the end of a block, so blocks decode on their own, and all words of a
block at once.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import rows, shared_path, texts
from filigree.llm.tokens import encoder

#: Values per word for each selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS
ESCAPE = 15
BLOCK_IDS = 4096
#: A segment ends with the document that takes it to this many ids.
SEGMENT_IDS = 1_000_000
HEADER = np.dtype([("magic", "S4"), ("docs", "<u8"), ("ids", "<u8"), ("words", "<u8"), ("block", "<u8"), ("unnamed", "<u8")])
SEGMENT_FIELDS = "shard int, segment int, first_doc_id long, n_ids long, blob binary"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the values, and for each block of `BLOCK_IDS` values its first word.

    A value takes part in the fullest word that the values after it allow. A word of `count`
    values fits where as many values in a row are narrow enough, so each selector costs as
    much as there are such values; all blocks step from word to word together.
    """
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    bits = np.frexp(values.astype(np.float64))[1].astype(np.int8)  # at most one too many, beyond 53 bits
    best = np.full(n, ESCAPE, np.int8)
    narrow = np.arange(n)
    for selector in range(len(COUNTS) - 1, -1, -1):
        count = int(COUNTS[selector])
        narrow = narrow[bits[narrow] <= WIDTHS[selector]]
        if len(narrow) < count:
            break
        first, last = narrow[: len(narrow) - count + 1], narrow[count - 1 :]
        in_one_block = first // BLOCK_IDS == last // BLOCK_IDS
        best[first[(last - first == count - 1) & in_one_block]] = selector
    step = np.append(COUNTS, [0, 1])[best]
    begins = np.zeros(n, bool)
    at = np.arange(0, n, BLOCK_IDS)
    stop = np.minimum(at + BLOCK_IDS, n)
    while len(at):  # one word of every block at a time
        begins[at] = True
        at = at + step[at]
        at, stop = at[at < stop], stop[at < stop]
    starts = np.flatnonzero(begins)
    chosen = best[starts].astype(np.int64)
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(chosen == ESCAPE)[:-1]])
    words = np.zeros(int(place[-1]) + 1 + int(chosen[-1] == ESCAPE), np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        at = starts[chosen == selector]
        if selector == ESCAPE:
            words[place[chosen == selector] + 1] = values[at]
            continue
        word = words[place[chosen == selector]]
        for i in range(COUNTS[selector]):
            word |= values[at + i] << np.uint64(i * WIDTHS[selector])
        words[place[chosen == selector]] = word
    return words, place[np.searchsorted(starts, np.arange(0, n, BLOCK_IDS))].astype(np.uint64)


def unpack(words: np.ndarray) -> np.ndarray:
    """The values of whole words, selector by selector."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selectors == ESCAPE).tolist():  # a raw value may look like an escape
        if not raw[at]:
            raw[at + 1] = True
    count = np.append(COUNTS, [0, 0])[selectors]
    count[raw] = 1
    selectors[raw] = ESCAPE
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(words) else count
    values = np.zeros(int(count.sum()), np.uint64)
    values[first[raw]] = words[raw]
    for selector, (per_word, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist())):
        here = np.flatnonzero((selectors == selector) & ~raw)
        if len(here):
            mask = np.uint64((1 << width) - 1)
            for i in range(per_word):
                values[first[here] + i] = (words[here] >> np.uint64(i * width)) & mask
    return values


def segment(doc_ids: list, ids: list[bytes]) -> bytes:
    """The blob of consecutive documents; ids as little-endian unsigned 32-bit integers.

    Documents without doc_id (None) come first.
    """
    values = np.frombuffer(b"".join(ids), "<u4")
    words, blocks = pack(values)
    header = np.array([(b"S8B2", len(doc_ids), len(values), len(words), BLOCK_IDS, doc_ids.count(None))], HEADER)
    lengths = np.array([len(x) // 4 for x in ids], "<u8")
    return b"".join(
        x.tobytes() for x in (header, np.array([x or 0 for x in doc_ids], "<i8"), lengths, blocks.astype("<u8"), words.astype("<u8"))
    )


def documents_of(blob: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a segment, in order; decoded block by block."""
    header = np.frombuffer(blob, HEADER, 1)[0]
    docs, n, n_words, per_block = (int(header[k]) for k in ("docs", "ids", "words", "block"))
    if header["magic"] != b"S8B2":
        raise ValueError("not a segment of token ids")
    tail = np.frombuffer(blob, "<u8", offset=HEADER.itemsize)
    doc_ids, lengths = tail[:docs].view("<i8"), tail[docs : 2 * docs].astype(np.int64)
    n_blocks = -(-n // per_block)
    blocks = np.append(tail[2 * docs : 2 * docs + n_blocks], np.uint64(n_words)).astype(np.int64)
    words = tail[2 * docs + n_blocks :]
    held = np.zeros(0, np.uint64)
    block = 0
    named = [None] * int(header["unnamed"]) + doc_ids[int(header["unnamed"]) :].tolist()
    for doc_id, length in zip(named, lengths.tolist()):
        if len(held) < length:
            upto = min(n_blocks, block + max(256, -(-(length - len(held)) // per_block)))
            held = np.concatenate([held, unpack(words[blocks[block] : blocks[upto]])])
            block = upto
        yield doc_id, held[:length]
        held = held[length:]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode every whole text, append `end_id`, and write segments in ascending doc_id order.

    Rows are ranged by doc_id first (and by a hash of the text, as many rows may share one),
    so each task encodes and writes a run of the order on its own, and a lost task is simply
    run again. A null text is empty; equal doc_ids stay neighbours, ordered by a hash of the
    text, and rows without doc_id come first, in that
    order too. An empty table writes no segment.
    """

    def encode(batches):
        encode_text = encoder(tokenizer_path).encode
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, ids, n, count, shard = [], [], 0, 0, 0

        def out():
            return pa.RecordBatch.from_pydict(
                {"shard": [shard], "segment": [count], "first_doc_id": [doc_ids[0]], "n_ids": [n], "blob": [segment(doc_ids, ids)]},
                schema=pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first_doc_id", pa.int64()), ("n_ids", pa.int64()), ("blob", pa.binary())]),
            )

        for shards, keys, bodies in rows(batches, "shard", "doc_id", "text"):
            for shard, key, body in zip(shards, keys, bodies):
                doc_ids.append(key)
                ids.append(encode_text(body) + end)
                n += len(ids[-1]) // 4
                if n >= SEGMENT_IDS:
                    yield out()
                    doc_ids, ids, n, count = [], [], 0, count + 1
        if doc_ids:
            yield out()

    ranged = (
        texts(docs)
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .withColumn("shard", F.spark_partition_id())
    )
    ranged.mapInArrow(encode, SEGMENT_FIELDS).write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """Per document of the written files: doc_id, start, n_tokens and the crc32 of its ids.

    The start of a segment is a running sum inside its shard plus the shards before it; the
    latter has one small row per shard.
    """
    segments = spark.read.schema(SEGMENT_FIELDS).parquet(path)
    sizes = segments.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard")
    starts = starts.select("shard", "segment", (F.col("inside") + F.col("shard_start")).alias("start"))

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, part = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                found = [
                    (doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc_id, ids in documents_of(batch.column(2)[i].as_py())
                ]
                keys, lengths, sums = map(list, zip(*found))
                offset = np.cumsum([0, *lengths[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(keys), pa.int32()),
                        pa.array([part] * len(keys), pa.int32()),
                        pa.array(keys, pa.int64()),
                        pa.array(offset, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["shard", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    decoded = segments.select("shard", "segment", "blob").mapInArrow(
        decode, "shard int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long"
    )
    return decoded.join(starts, ["shard", "segment"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the ids of all documents to the shared folder and report on what is read back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, path)
