"""Line dedup by a deletion-neighbourhood join.

Lines are sequences of lower-case words. Two lines are the same when their words are, and
near when one word inserted, deleted or substituted turns one into the other, if the
shorter has at least `NEAR_WORDS` words. Of lines that are the same or near, the earliest
(by doc_id, then hash of the text, then line) stays. Rows are told apart by doc_id and the
hash of their text, so rows without doc_id are documents of their own.

Near lines have a half in common, so only lines that share a half with a different line
(by a bit set of the shared halves) emit their deletion variants. A variant is keyed by the hash of the words that are left:

- two lines of n words whose variants without word i are equal differ in word i alone;
- a line equal to a variant of another is that line without one word.

So equal keys are the verified edit distance, each group is reduced to its earliest line
before it is shuffled, and no pairs are made, however many lines share a variant.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import fresh, written

NEAR_WORDS = 8
#: What is between words; what else is white space is part of a word.
BLANKS = " \t\r\f\x0b"
#: Size of the bit set that holds back lines without a shared half.
BITS_PER_KEY, MOST_BITS = 32, 1 << 27


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def normal(line: Column) -> Column:
    """The lower-case words of a line, joined by one space; most lines are so already."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for blank in ("  ", *BLANKS[1:]):
        odd = odd | F.contains(line, F.lit(blank))
    return F.when(odd, F.trim(F.regexp_replace(F.lower(line), f"[{BLANKS}]+", " "))).otherwise(F.lower(line))


def hashes(body: Column) -> tuple[Column, Column]:
    """128 bits that stand for the words of a line."""
    return F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2")


def word_count(body: Column) -> Column:
    return F.octet_length(body) - F.octet_length(F.replace(body, F.lit(" "), F.lit(""))) + 1


def half_keys(body: Column, n: Column) -> Column:
    """Hashes of the first and last halves of a line of n words; of the next shorter line's halves too.

    With m = n // 2, near lines of n words share their first or last m words, and a near
    line of one word less shares halves of its own m. Halves are parts of the line's text,
    between whose words is one space, so no word is cut out.
    """
    half = F.shiftright(n, 1)

    def keys(m: Column) -> list[Column]:
        return [
            F.xxhash64(F.lit(0), F.call_function("substring_index", body, F.lit(" "), m)),
            F.xxhash64(F.lit(1), F.call_function("substring_index", body, F.lit(" "), -m)),
        ]

    none = F.array().cast("array<bigint>")
    odd, even = F.array(*keys(half)), F.array(*keys(half), *keys(half - 1))
    return F.when(n < NEAR_WORDS, none).when(n % 2 == 1, odd).otherwise(even)


def placed(docs: DataFrame, lines: Column, name: str) -> DataFrame:
    """doc_id, text_hash and line of every one of the `lines`, which are under `name`."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(lines).alias("line", name),
    )


def distinct_lines(docs: DataFrame) -> DataFrame:
    """h1, h2, first (doc_id, text_hash, line) and halves of every different line that isn't blank.

    Lines are made normal before they become rows, so that no filter on them, moved down
    by the optimizer, does it again.
    """
    bodies = placed(docs, F.transform(lines_of(F.col("text")), normal), "body").where("body <> ''")
    counted = bodies.withColumn("n", word_count(F.col("body")))
    keyed = counted.select("doc_id", "text_hash", "line", *hashes(F.col("body")), half_keys(F.col("body"), F.col("n")).alias("halves"))
    return keyed.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "text_hash", "line")).alias("first"), F.max("halves").alias("halves")
    )


def marked(keys: DataFrame) -> DataFrame:
    """A bit set (`bits`, array of 64-bit words, in one row) in which two bits of each `key` are on.

    The set has at least `BITS_PER_KEY` bits a key, up to `MOST_BITS`, which bounds what
    every task gets. A fuller set only lets more keys pass.
    """
    n_words = 1 << max(4, min(MOST_BITS // 64, keys.count() * BITS_PER_KEY // 64).bit_length())
    bits = keys.select(F.explode(F.array(*_bits(F.col("key")))).alias("bit"))
    words = bits.groupBy(F.pmod(F.shiftright("bit", 6), F.lit(n_words)).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("value")
    )
    every = keys.sparkSession.range(n_words).select(F.col("id").cast("int").alias("word"))
    filled = every.join(words, "word", "left").select("word", F.coalesce("value", F.lit(0)).alias("value"))
    return filled.agg(F.array_sort(F.collect_list(F.struct("word", "value")))["value"].alias("bits"))


def _bits(key: Column) -> tuple[Column, Column]:
    return key, F.xxhash64(key)


def passing(table: DataFrame, keys: Column, shared: DataFrame) -> DataFrame:
    """The rows of which one of the `keys` (an array) has its bits on in the set of `shared`.

    All rows with a shared key pass, and a few others. Nothing is shuffled.
    """

    bits = F.col("bits")

    def on(bit: Column) -> Column:
        word = F.get(bits, F.pmod(F.shiftright(bit, 6), F.size(bits)).cast("int"))
        return F.getbit(word, bit.bitwiseAND(63).cast("int")) == 1

    held = table.withColumn("bits", marked(shared).scalar())
    return held.where(F.exists(keys, lambda key: on(_bits(key)[0]) & on(_bits(key)[1]))).drop("bits")


def repeated_keys(keys: DataFrame, name: str) -> DataFrame:
    """`key`s that are in two rows at least."""
    return written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), name)


def variants(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Deletion variants of the lines that may share a half with another line.

    Rows: first (the place of the line), n (words left), gap (the word left out, -1 for the
    whole line) and the hash of what is left (v1, v2). The texts are read again for the
    words of these lines: they are cut into lines, and only lines at such places into words.
    Hashes of the left part and of the shifted right part are running XORs, so a line costs
    as much as it has words.
    """
    shared = repeated_keys(lines.select(F.explode("halves").alias("key")), "halves")
    near = written(passing(lines, F.col("halves"), shared).select("first.*", "h1", "h2", "first"), "near")
    place = F.xxhash64("doc_id", "text_hash", "line")
    raw = passing(placed(docs, lines_of(F.col("text")), "raw"), F.array(place), near.select(place.alias("key")))
    split = raw.select("doc_id", "text_hash", "line", normal(F.col("raw")).alias("body"))
    found = split.join(near, [split[c].eqNullSafe(near[c]) for c in ("doc_id", "text_hash", "line")])
    found = found.where(F.xxhash64("body") == F.col("h1")).groupBy("h1", "h2").agg(
        F.first("first").alias("first"), F.split(F.first("body"), " ").alias("words")
    )
    found = written(found, "near-lines")  # read twice below; the scan behind it is the costly part
    one = Window.partitionBy("h1", "h2")
    before, upto = one.orderBy("at").rowsBetween(Window.unboundedPreceding, -1), one.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)

    def left_out(salt: int) -> Column:
        here, moved = F.xxhash64(F.lit(salt), "word", "at"), F.xxhash64(F.lit(salt), "word", F.col("at") - 1)
        kept = F.coalesce(F.bit_xor(here).over(before), F.lit(0))
        return kept.bitwiseXOR(F.bit_xor(moved).over(one)).bitwiseXOR(F.bit_xor(moved).over(upto))

    words = found.select("h1", "h2", "first", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    gaps = words.select("first", (F.col("n") - 1).alias("n"), F.col("at").alias("gap"), left_out(0).alias("v1"), left_out(1).alias("v2"))
    whole = words.groupBy("h1", "h2").agg(
        F.first("first").alias("first"),
        F.max("n").alias("n"),
        F.lit(-1).alias("gap"),
        *[F.bit_xor(F.xxhash64(F.lit(salt), "word", "at")).alias(f"v{salt + 1}") for salt in (0, 1)],
    )
    return gaps.unionByName(whole.drop("h1", "h2"))


def beaten_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """`first` of the lines that have a near line before them.

    Variants whose hash is in no second row are held back by a bit set; of the others, each
    group of equal variants is reduced to its earliest line and compared with it.
    """
    every = written(variants(docs, lines), "variants")
    every = passing(every, F.array("v1"), repeated_keys(every.select(F.col("v1").alias("key")), "variant-keys"))
    of = ["n", "v1", "v2"]
    substituted = every.where("gap >= 0").groupBy(*of, "gap").agg(F.min("first").alias("best"))
    swapped = every.where("gap >= 0").join(substituted, [*of, "gap"]).where("best < first")
    without = every.where(f"n >= {NEAR_WORDS}")
    ends = without.groupBy(*of).agg(
        F.min(F.when(F.col("gap") == -1, F.col("first"))).alias("short"),
        F.min(F.when(F.col("gap") >= 0, F.col("first"))).alias("long"),
    )
    ends = ends.where("short IS NOT NULL AND long IS NOT NULL")
    dropped = without.join(ends, of).where(
        F.when(F.col("gap") == -1, F.col("long") < F.col("first")).otherwise(F.col("short") < F.col("first"))
    )
    return written(swapped.select("first").unionByName(dropped.select("first")).distinct(), "beaten")


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` with only the kept lines in `text`, and columns for what was done.

    Added: `lines_before` and `lines_removed` (of lines that aren't blank), named so that
    they clash with no column. `n_chars`, if there, is set to the new length. Blank lines
    stay. A null text stays null and an empty one empty; a document that loses all its
    lines keeps its row. Rows with the same doc_id and text are taken as copies of one document;
    other rows that repeat a doc_id, or have none, are documents of their own.
    """
    lines = written(distinct_lines(docs), "lines")
    kept = lines.select("first").join(beaten_lines(docs, lines), "first", "left_anti")
    kept_doc, kept_hash, kept_lines = (fresh(docs, x) for x in ("kept_doc", "kept_hash", "kept_lines"))
    kept = kept.groupBy(F.col("first.doc_id").alias(kept_doc), F.col("first.text_hash").alias(kept_hash)).agg(
        F.collect_list("first.line").alias(kept_lines)
    )
    own = docs["doc_id"].cast("long").eqNullSafe(kept[kept_doc]) & (F.xxhash64(docs["text"]) == kept[kept_hash])
    joined = docs.join(kept, own, "left")
    all_lines, before, removed = (fresh(docs, x) for x in ("all_lines", "lines_before", "lines_removed"))
    stays = F.coalesce(F.col(kept_lines), F.array().cast("array<int>"))
    blank = F.filter(
        F.sequence(F.lit(0), F.size(all_lines) - 1), lambda i: F.trim(F.get(F.col(all_lines), i), F.lit(BLANKS)) == ""
    )
    stay = F.array_sort(F.concat(stays, blank))
    out = joined.withColumn(all_lines, lines_of(F.col("text"))).withColumn(before, F.size(all_lines) - F.size(blank))
    out = out.withColumn(removed, F.col(before) - F.size(stays)).withColumn(
        "text",
        F.when(F.col("text").isNotNull(), F.array_join(F.transform(stay, lambda i: F.get(F.col(all_lines), i)), "\n")),
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.drop(all_lines, kept_doc, kept_hash, kept_lines)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the md5 of the kept text of every document."""
    plain = docs.select("doc_id", "text")
    return deduplicated(plain).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lines_before").alias("n_lines"),
        F.col("lines_removed").alias("n_removed"),
        F.length(F.coalesce("text", F.lit(""))).alias("kept_chars"),
        F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"),
    )


def clean_lines(docs: DataFrame) -> DataFrame:
    """The rows and columns of `docs`, repeated lines taken out of the texts."""
    return deduplicated(docs).select(*docs.columns)
