"""Phrase collocations by dynamic itemset counting.

The corpus is cut into `SHARDS` shards that are scanned in a cycle. Words are counted from
the first scan on. A longer phrase is activated as soon as both phrases one word shorter
have been counted to the threshold, at whatever shard the cycle then is, and is counted for
exactly one full cycle from there; so words, pairs and triples are counted in the same
scans. After three cycles every activated phrase has had its full one.

A shard is a set of chunks: the words of many texts of one language as local numbers, with
their vocabulary. What a chunk may count is answered per chunk: its phrases meet the
counters in a shuffle by a 96-bit key, and those at the threshold come back to it. Nothing
that grows with the corpus is broadcast, and a chunk sends each of its phrases once a scan.
Phrases travel in rows of arrays, all of one chunk and one range of keys in a row.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.llm.common import rows, shared_path, written

SHARDS = 3
LEAST = 10
LONGEST = 3
TOP = 2000
#: A chunk ends with the text, or the slab of a long text, that takes it to this many words.
CHUNK_WORDS = 4_000_000
#: Open chunks of all languages in a task hold at most so many words together.
OPEN_WORDS = 8_000_000
#: Long texts are cut into slabs of about this many bytes, between two pieces.
SLAB = 16_000_000
#: Parallel lists of the best phrases of a language, before they meet in one.
SALTS = 16
#: One step of the byte table lower-cases A-Z, ends pieces and makes tabs spaces.
PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 9 + b" abcdefghijklmnopqrstuvwxyz")
CHUNK_FIELDS = "chunk long, shard int, lang string, n_words long, vocabulary binary, ids binary"
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
NEVER = np.int16((1 << 15) - 1)
#: Counters are dealt to buckets by ranges of their keys: one for so many words of the
#: corpus, and so many at least.
BUCKET_WORDS = 2_000_000
LEAST_BUCKETS = 32
#: A row of phrases: one little-endian array per column, compressed where that helps (keys
#: are random bits). `kind` 0 holds counters, which say
#: for each phrase the chunk `at` which it was seen; 1 the phrases of one chunk.
COLUMNS = {"key1": "<u8", "key2": "<u4", "code": "<i8", "last": "<i4", "n": "<i8", "start": "<i2", "reached": "<i2", "at": "<i8"}
ROW_FIELDS = "bucket int, kind int, chunk long, " + ", ".join(f"{c} binary" for c in COLUMNS)
ROW_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in COLUMNS]])
COUNTERS, OF_CHUNK = 0, 1
KEYS = {"key1", "key2"}


class _Numbers(dict):
    """word -> local number; 0 ends a piece and -1 is no word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


class _Chunk:
    def __init__(self):
        self.numbers, self.parts, self.words = _Numbers(), [], 0

    def add(self, plain: bytes) -> int:
        """Take a slab; returns how many words it has."""
        tokens = plain.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))
        ids = ids[ids >= 0]
        self.parts += [ids, np.zeros(1, np.int32)]
        n = int(np.count_nonzero(ids))
        self.words += n
        return n


def slabs(plain: bytes, size: int) -> Iterator[bytes]:
    """Runs of whole pieces, each of about `size` bytes (more where one piece is longer)."""
    at = 0
    while len(plain) - at > size:
        end = plain.find(b"\n", at + size)
        if end < 0:
            break
        yield plain[at:end]
        at = end + 1
    yield plain[at:]


def _chunks(shards: int, chunk_words: int):
    def run(batches):
        task, made, pressed = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(1)
        held: dict[str, _Chunk] = {}

        def out(lang: str) -> pa.RecordBatch:
            nonlocal made
            chunk = held.pop(lang)
            vocabulary = b"\n".join(list(chunk.numbers)[2:])
            row = {
                "chunk": [(task << 24) + made],
                "shard": [(task + made) % shards],
                "lang": [lang],
                "n_words": [chunk.words],
                "vocabulary": [vocabulary],
                "ids": [pressed.compress(np.concatenate(chunk.parts).tobytes())],
            }
            made += 1
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], names=list(row))

        for langs, bodies in rows(batches, "lang", "body"):
            for lang, body in zip(langs, bodies):
                for slab in slabs(body.translate(PLAIN), SLAB):
                    held.setdefault(lang, _Chunk()).add(slab)
                    if held[lang].words >= chunk_words:
                        yield out(lang)
            while sum(c.words for c in held.values()) > OPEN_WORDS:
                yield out(max(held, key=lambda lang: held[lang].words))
        for lang in sorted(held):
            if held[lang].words:
                yield out(lang)

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(words: np.ndarray, numbers: list[np.ndarray]) -> np.ndarray:
    """128-bit keys (two columns) of phrases, from the keys of their words in order."""
    found = words[numbers[0]]
    for part in numbers[1:]:
        found = _mixed(found * MULTIPLIERS + _mixed(words[part] + MULTIPLIERS[::-1]))
    return found


class Grams:
    """Phrases as columns of numbers; columns that a row doesn't need are left empty."""

    def __init__(self, **columns: np.ndarray):
        for name, kind in COLUMNS.items():
            setattr(self, name, np.asarray(columns.get(name, ()), kind))

    def __len__(self) -> int:
        return len(self.code)

    def taken(self, at) -> Grams:
        return Grams(**{c: v[at] for c in COLUMNS if len(v := getattr(self, c))})

    def row(self, bucket: int, kind: int, chunk: int) -> dict:
        press = zstandard.ZstdCompressor(1).compress
        arrays = {c: getattr(self, c).tobytes() for c in COLUMNS}
        return {"bucket": bucket, "kind": kind, "chunk": chunk, **{c: press(v) if v and c not in KEYS else v for c, v in arrays.items()}}


def grams_of(table: pa.Table) -> list[tuple[int, int, Grams]]:
    """(kind, chunk, phrases) of each row."""
    plain = zstandard.ZstdDecompressor().decompress
    columns = [[plain(v) if v and c not in KEYS else v for v in table.column(c).to_pylist()] for c in COLUMNS]
    kinds, chunks = table.column("kind").to_pylist(), table.column("chunk").to_pylist()
    return [
        (kind, chunk, Grams(**{c: np.frombuffer(v, COLUMNS[c]) for c, v in zip(COLUMNS, row)}))
        for kind, chunk, *row in zip(kinds, chunks, *columns)
    ]


def table_of(rows: Iterable[dict]) -> pa.Table:
    """A table of rows that are made one by one, so that none is held twice."""
    return pa.concat_tables([ROW_SCHEMA.empty_table(), *(pa.Table.from_pylist([row], ROW_SCHEMA) for row in rows)])


class _Body:
    """A chunk as it comes to a task: its words, their keys and the sequence of numbers."""

    def __init__(self, chunk: int, lang: str, vocabulary: bytes, ids: bytes):
        self.chunk, self.lang = chunk, lang
        self.words = [b"", *vocabulary.split(b"\n")]
        self.ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.int32)

    @classmethod
    def all_of(cls, chunks: pa.Table | pa.RecordBatch) -> Iterator[_Body]:
        columns = [chunks.column(c) for c in ("chunk", "lang", "vocabulary", "ids")]
        for i in range(chunks.num_rows):
            yield cls(*[c[i].as_py() for c in columns])

    def keys(self) -> np.ndarray:
        before = self.lang.encode("utf-8", "surrogatepass") + b"\n"
        digests = b"".join([xxhash.xxh3_128_digest(before + w) for w in self.words])
        return np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)

    def rows(self, numbers: list[np.ndarray], n: np.ndarray, start: np.ndarray, buckets: int) -> Iterator[dict]:
        """The phrases made of the words of these numbers, a row for each bucket of keys."""
        keys = _keys(self.keys(), numbers)
        first, second, last = (numbers + [np.zeros(len(n), np.int64)] * 2)[:3]
        order = np.argsort(keys[:, 0])
        every = Grams(
            key1=keys[order, 0],
            key2=keys[order, 1] >> np.uint64(32),
            code=(first[order].astype(np.int64) << 32) | second[order].astype(np.int64),
            last=last[order] if len(numbers) > 2 else (),
            n=n[order],
            start=start[order],
        )
        bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
        cuts = [0, *np.searchsorted(every.key1, bounds).tolist(), len(every)]
        for bucket, (begin, end) in enumerate(zip(cuts, cuts[1:])):
            if begin < end:
                yield every.taken(slice(begin, end)).row(bucket, OF_CHUNK, self.chunk)


def _words(buckets: int):
    """The words of whole chunks; all of them are active from the first scan on."""

    def run(batches):
        for batch in batches:
            for body in _Body.all_of(batch):
                n = np.bincount(body.ids, minlength=len(body.words))[1:]
                found = body.rows([np.arange(1, len(n) + 1)], n, np.zeros(len(n), np.int16), buckets)
                yield from table_of(found).to_batches()

    return run


def _known(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The phrases at the threshold in a chunk, by code, and the steps that took them there."""
    parts = [g for _, _, g in grams_of(answers)]
    codes = np.concatenate([np.zeros(0, np.int64), *[g.code for g in parts]])
    reached = np.concatenate([np.zeros(0, np.int16), *[g.reached for g in parts]])
    order = np.argsort(codes)
    return codes[order], reached[order]


def _pairs(buckets: int):
    """The pairs of a chunk whose words have both reached the threshold."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        codes, steps = _known(answers)

        def found(body: _Body) -> Iterator[dict]:
            reached = np.full(len(body.words), NEVER)
            reached[codes >> 32] = steps
            left, right = body.ids[:-1], body.ids[1:]
            live = (reached[left] < NEVER) & (reached[right] < NEVER)
            code, n = np.unique((left[live].astype(np.int64) << 32) | right[live], return_counts=True)
            left, right = code >> 32, code & 0xFFFFFFFF
            yield from body.rows([left, right], n, np.maximum(reached[left], reached[right]) + 1, buckets)

        return table_of(row for body in _Body.all_of(chunks) for row in found(body))

    return run


def _triples(buckets: int):
    """The triples of a chunk whose two pairs have both reached the threshold."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        codes, reached = _known(answers)

        def found(body: _Body) -> Iterator[dict]:
            every = (body.ids[:-1].astype(np.int64) << 32) | body.ids[1:]
            place = np.minimum(np.searchsorted(codes, every), len(codes) - 1)
            live = codes[place] == every
            both = live[:-1] & live[1:]
            pair, n = np.unique((place[:-1][both] << 32) | place[1:][both], return_counts=True)
            left, right = pair >> 32, pair & 0xFFFFFFFF
            numbers = [codes[left] >> 32, codes[left] & 0xFFFFFFFF, codes[right] & 0xFFFFFFFF]
            yield from body.rows(numbers, n, np.maximum(reached[left], reached[right]) + 1, buckets)

        return table_of(row for body in _Body.all_of(chunks) if len(codes) for row in found(body))

    return run


def answered(counters: Grams, asked: Grams) -> Grams:
    """Those of the asked phrases whose counters are at the threshold."""
    place = np.searchsorted(counters.key1, asked.key1)
    hit = np.zeros(len(asked), bool)
    reached = np.full(len(asked), NEVER)
    last = len(counters) - 1
    longest = int(np.diff(np.flatnonzero(np.diff(counters.key1, prepend=~counters.key1[:1], append=~counters.key1[-1:]))).max()) if last >= 0 else 0
    for i in range(longest):  # one, but for phrases that share the first half of their keys
        at = np.minimum(place + i, last)
        same = (counters.key1[at] == asked.key1) & (counters.key2[at] == asked.key2)
        hit |= same
        reached[same] = counters.reached[at][same]
    hit &= reached < NEVER
    return Grams(code=asked.code[hit], reached=reached[hit])


def counted(counters: Grams, seen: list[Grams], step: int, least: int) -> Grams:
    """The counters, sorted by key, after what a step has seen."""
    parts = [counters, *seen]
    every = Grams(**{c: np.concatenate([getattr(g, c) for g in parts]) for c in COLUMNS if len(getattr(counters, c)) or any(len(getattr(g, c)) for g in seen)})
    if not len(every):
        return every
    order = np.argsort(every.key1, kind="stable")
    key1, key2 = every.key1[order], every.key2[order]
    if ((key1[1:] == key1[:-1]) & (key2[1:] != key2[:-1])).any():
        order = np.lexsort((every.key2, every.key1))
        key1, key2 = every.key1[order], every.key2[order]
    first = np.flatnonzero(np.append(True, (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1])))
    out = every.taken(order[first])
    out.n = np.add.reduceat(every.n[order], first)
    out.reached = np.where((out.n >= least) & (out.reached == NEVER), np.int16(step), out.reached)
    return out


def _exchanged(step: int, shards: int, least: int, count: bool, answer: bool, done: bool):
    """One bucket: its counters and the phrases of the chunks of a step."""

    def run(key, table):
        bucket, held = key[0].as_py(), grams_of(table)
        counters = next((g for kind, _, g in held if kind == COUNTERS), Grams())
        asked = [(chunk, g) for kind, chunk, g in held if kind == OF_CHUNK]
        out = []
        if answer and len(counters):
            for chunk, g in asked:
                told = answered(counters, g)
                if len(told):
                    out.append(told.row(bucket, OF_CHUNK, chunk))
        if count:
            seen = []
            for chunk, g in asked:
                g = g.taken((g.start <= step) & (g.start + shards > step))
                g.start, g.reached, g.at = g.start[:0], np.full(len(g), NEVER), np.full(len(g), chunk, np.int64)
                seen.append(g)
            total = counted(counters, seen, step, least)
            total = total.taken(total.reached < NEVER) if done else total
            if len(total):
                out.append(total.row(bucket, COUNTERS, -1))
        return table_of(out)

    return run


@contextmanager
def shuffles_end_with_their_query(spark: SparkSession):
    """Within it, shuffle files go when the query that made them has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Counters:
    """The counters of one phrase length, and how chunks and counters exchange what is known.

    The counters are written anew by each step that counts, to one of two folders in turn.
    After the last such step only those at the threshold are kept.
    """

    def __init__(self, spark: SparkSession, name: str, shards: int, least: int, last_step: int):
        self.spark, self.shards, self.least, self.last_step = spark, shards, least, last_step
        self.folders = [shared_path(spark, f"{name}-{i}") for i in range(2)]
        self.now = spark.createDataFrame([], ROW_FIELDS)

    def exchange(self, grams: DataFrame, step: int, answer: bool) -> DataFrame:
        """Count the active ones of `grams`, up to the last step of this length; returns, if
        asked to, those at the threshold before this step, for each chunk."""
        count = step <= self.last_step
        run = _exchanged(step, self.shards, self.least, count, answer, step == self.last_step)
        both = self.now.unionByName(grams).groupBy("bucket").applyInArrow(run, ROW_FIELDS)
        if not count:
            return both
        path = self.folders[step % 2]
        both.write.mode("overwrite").option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(ROW_FIELDS).parquet(path)
        self.now = table.where(F.col("kind") == COUNTERS)
        return table.where(F.col("kind") == OF_CHUNK)


def _counted(docs: DataFrame, shards: int, least: int, chunk_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """The chunks, and the counters of words, pairs and triples at the threshold."""
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    path = shared_path(spark, "chunks")
    docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), body).mapInArrow(
        _chunks(shards, chunk_words), CHUNK_FIELDS
    ).write.partitionBy("shard").parquet(path)
    chunks = spark.read.schema(CHUNK_FIELDS).parquet(path)
    words_in_all = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, words_in_all // BUCKET_WORDS)

    words, pairs, triples = (
        _Counters(spark, name, shards, least, i * shards - 1) for i, name in enumerate(("words", "pairs", "triples"), 1)
    )
    final_words: dict[int, DataFrame] = {}
    for step in range(LONGEST * shards):
        cycle, number = divmod(step, shards)
        shard = chunks.where(F.col("shard") == number).select("chunk", "lang", "vocabulary", "ids")

        def scanned(known: DataFrame, scan, shard=shard) -> DataFrame:
            return shard.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(scan, ROW_FIELDS)

        if cycle < 2:
            known_words = words.exchange(shard.mapInArrow(_words(buckets), ROW_FIELDS), step, step > 0)
            if cycle == 1:
                known_words = final_words[number] = written(known_words, "known-words")
        else:
            known_words = final_words[number]
        if step < 1:
            continue
        known_pairs = pairs.exchange(scanned(known_words, _pairs(buckets)), step, step > 1)
        if step > 1:
            triples.exchange(scanned(known_pairs, _triples(buckets)), step, False)
    return chunks, [words.now, pairs.now, triples.now]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per counter: chunk, code, last, n."""
    for batch in batches:
        for _, _, g in grams_of(pa.Table.from_batches([batch])):
            last = g.last if len(g.last) else np.zeros(len(g), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g.at, g.code, last, g.n)], names=["chunk", "code", "last", "n"])


def _spelled(chunks: pa.Table, grams: pa.Table) -> pa.Table:
    """The phrases of counters, from the chunk each one was seen in."""
    code, last = (grams.column(c).to_numpy().astype(np.int64) for c in ("code", "last"))
    numbers = np.stack([code >> 32, code & 0xFFFFFFFF, last], 1).tolist()
    sizes, langs, spelled = grams.column("size").to_pylist(), [], []
    for lang, vocabulary in zip(chunks.column("lang").to_pylist(), chunks.column("vocabulary").to_pylist()):
        words = [b"", *vocabulary.split(b"\n")]
        spelled = [b" ".join([words[i] for i in t[:k]]).decode("utf-8", "replace") for k, t in zip(sizes, numbers)]
        langs = [lang] * len(sizes)
    n = grams.column("n").to_pylist()
    kinds = [("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())]
    return pa.table([langs, sizes, spelled, n], schema=pa.schema(kinds))


def frequent_phrases(
    docs: DataFrame, shards: int = SHARDS, least: int = LEAST, chunk_words: int = CHUNK_WORDS
) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of 1 to 3 words counted `least` times or more
    in a language, and (lang, n), the words of each language."""
    with shuffles_end_with_their_query(docs.sparkSession):
        chunks, counters = _counted(docs, shards, least, chunk_words)
        grams = None
        for size, found in enumerate(counters, 1):
            found = found.mapInArrow(_frequent, "chunk long, code long, last int, n long").withColumn("size", F.lit(size))
            grams = found if grams is None else grams.unionByName(found)
        spelled = chunks.select("chunk", "lang", "vocabulary").groupBy("chunk").cogroup(grams.groupBy("chunk"))
        phrases = written(spelled.applyInArrow(_spelled, "lang string, size int, phrase string, f long"), "phrases")
        sizes = written(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")), "langs")
    return phrases, sizes



def collocations(
    docs: DataFrame,
    shards: int = SHARDS,
    least: int = LEAST,
    top: int = TOP,
    contained_percent: int = 50,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """The `top` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase (2 or 3 words, `least` times or more) is scored at its weakest cut by
    floor(10^6 a^2 / (l r)), in whole decimals, and left out if a longer phrase around it
    has `contained_percent` of its count. Rows without lang are of language `und`; null and
    empty texts have no words; a repeated row or doc_id counts again; an empty table gives
    no row. Equal scores and counts are ranked by the bytes of the phrase.
    """
    phrases, sizes = frequent_phrases(docs, shards, least, chunk_words)
    parts = phrases.where("size < 3").select("lang", F.col("phrase").alias("part"), "f")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = phrases.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), cut.alias("k"))
    cuts = cuts.withColumn("part", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.join(parts.withColumnRenamed("f", "l"), ["lang", "part"]).drop("part")
    cuts = cuts.withColumn("part", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = cuts.join(parts.withColumnRenamed("f", "r"), ["lang", "part"]).drop("part")
    exact = "(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"
    cuts = cuts.withColumn("score", F.expr(exact))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "size", "phrase", "a").agg(weakest).select("lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.score")

    longer = phrases.where("size = 3")
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', 2)"), F.expr("substring_index(phrase, ' ', -2)")))
    around = longer.select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    free = scored.join(around, ["lang", "phrase"], "left").where(
        f"size = 3 OR around IS NULL OR 100 * around < {contained_percent} * a"
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = free.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    few = salted.withColumn("best", best).where(F.col("best") <= top)
    ranked = few.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
