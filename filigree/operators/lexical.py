"""Lexical retrieval: postings, corpus statistics and BM25 ranking."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from filigree.functions.text import tokens
from filigree.operators.bounded import in_query_slices
from filigree.operators.topk import (
    TaskTopK,
    blocks,
    candidate_batch,
    candidate_schema,
    facet_slice,
    facets_of,
    for_scoring,
    held_for_scoring,
    rank_candidates,
)
from filigree.session import stored

ALL = ""  # statistics row that stands for every document; no term is empty
#: Queries of a slice, and their terms; each slice reads the texts again, cut once for all.
LEXICAL_SLICE, SLICE_TERMS = 65_536, 6_000_000
QUERY_BLOCK = 2048
#: Documents that share their dense terms, and those scored at once.
GROUP, TILE = 2048, 512
LOOKUP = 2_000_000  # tokens looked up at once


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def idf(self, n_docs: int, df: int) -> float:
        return math.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unicode: bool = False) -> DataFrame:
    """`(term, id, tf, dl)`, one row per distinct term of each text.

    All words of a text are in one row, so they are counted where they are, block by
    block, without a shuffle. Measured at less than half the time of the same count by
    higher-order functions, or by an explode and a grouping.
    """
    toks = docs.select(id_col, tokens(F.col(text_col), unicode).alias("_toks"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            for batch in blocks(whole, 0):
                lists = batch.column("_toks")
                dl = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                words = lists.flatten().dictionary_encode()
                n_terms = max(len(words.dictionary), 1)
                at = np.repeat(np.arange(len(dl)), dl) * n_terms + words.indices.to_numpy()
                cell, tf = np.unique(at, return_counts=True)
                doc = cell // n_terms
                columns = [
                    words.dictionary.take(pa.array(cell % n_terms)),
                    batch.column(id_col).take(pa.array(doc)),
                    pa.array(tf.astype(np.int32)),
                    pa.array(dl[doc].astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["term", id_col, "tf", "dl"])

    schema = T.StructType(
        [
            T.StructField("term", T.StringType()),
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("tf", T.IntegerType()),
            T.StructField("dl", T.IntegerType()),
        ]
    )
    return toks.mapInArrow(run, schema)


def term_statistics(docs: DataFrame, text_col: str = "text", unicode: bool = False) -> DataFrame:
    """`(term, df, total_dl)` per term; the empty term counts all documents and tokens."""
    return count_terms(docs.select(tokens(F.col(text_col), unicode).alias("_toks")))


def count_terms(toks: DataFrame) -> DataFrame:
    return (
        toks.select(
            F.size("_toks").alias("dl"),
            F.explode(F.array_append(F.array_distinct("_toks"), F.lit(ALL))).alias("term"),
        )
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total_dl"))
    )


def query_terms(queries: DataFrame, unicode: bool = False) -> DataFrame:
    return queries.select("query_id", F.array_distinct(tokens(F.col("text"), unicode)).alias("terms"))


def lexical_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    facet_col: str | None = None,
    corpus: DataFrame | None = None,
    scorer: Bm25 = Bm25(),
    unicode: bool = False,
    slice_rows: int = LEXICAL_SLICE,
) -> DataFrame:
    """BM25 top `k` documents per query (and facet): `(query_id, [facet], id, score, rank)`.

    `queries` is `(query_id, text)`; any shared term makes a document a candidate.
    `corpus`, by default `docs`, supplies the statistics when `docs` is filtered.
    """
    columns = [id_col, tokens(F.col(text_col), unicode).alias("_toks"), *([facet_col] if facet_col else [])]
    cut = docs.select(*columns)
    asked = query_terms(queries, unicode)
    counted: list[DataFrame] = []
    held: list[DataFrame] = []

    def known_statistics(part: DataFrame, whole: DataFrame) -> DataFrame:
        """Of several slices the first counts the terms for all."""
        if part is whole:
            return term_statistics(corpus if corpus is not None else docs, text_col, unicode)
        if not counted:
            statistics = count_terms(texts(part, whole) if corpus is None else corpus.select(tokens(F.col(text_col), unicode).alias("_toks")))
            terms = whole.select(F.explode(F.array_append("terms", F.lit(ALL))).alias("term"))
            # A semi-join would be moved below the count, to a row per term and text.
            counted.append(stored(statistics.join(terms.distinct(), "term"), "term-statistics"))
        return counted[0]

    def texts(part: DataFrame, whole: DataFrame) -> DataFrame:
        """For several slices the texts are cut into tokens once."""
        if part is whole:
            return cut
        if not held:
            held.append(held_for_scoring(cut))
        return held[0]

    def one_slice(part: DataFrame, whole: DataFrame) -> DataFrame:
        import pyarrow as pa

        wanted = wanted_terms(part)
        vocabulary = docs.sparkSession.createDataFrame(pa.table({"term": pa.array([*wanted.terms, ALL], pa.string())}))
        # A slice has about SLICE_TERMS terms.
        stats = known_statistics(part, whole).join(F.broadcast(vocabulary), "term", "left_semi")
        weights = term_weights(stats, wanted, scorer)
        scored = for_scoring(texts(part, whole)).mapInArrow(
            bm25_task(wanted, weights, k, id_col, facet_col, scorer),
            candidate_schema(queries, docs, id_col, facet_col),
        )
        return rank_candidates(scored, k, id_col, facet_col)

    load = F.sum(F.size("terms")) / SLICE_TERMS
    return in_query_slices(asked, one_slice, facet_slice(docs, facet_col, slice_rows, k), load)


@dataclass
class Wanted:
    query_ids: object  # Arrow array
    terms: list[str]
    pair_query: object  # numpy arrays
    pair_term: object


def wanted_terms(part: DataFrame) -> Wanted:
    """The slice's `(query_id, terms)` as (query, term) pairs; slices are few rows and terms."""
    import numpy as np
    import pyarrow as pa

    rows = part.toArrow().combine_chunks()
    lists = rows.column("terms").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    words = lists.flatten().dictionary_encode()
    ids = rows.column("query_id").combine_chunks().cast(to_arrow_type(part.schema["query_id"].dataType))
    query = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    term = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    order = alike(query, term, len(sizes), -np.bincount(term, minlength=len(words.dictionary)))
    place = np.empty(len(sizes), np.int32)
    place[order] = np.arange(len(sizes), dtype=np.int32)
    pairs = np.argsort(place[query], kind="stable")
    return Wanted(ids.take(pa.array(order)), words.dictionary.to_pylist(), place[query][pairs], term[pairs])


def alike(row, term, n_rows: int, rarity):
    """The order of texts by their least rare term, so that neighbours share most terms,
    such as those of a language; `(row, term)` are the texts' terms, sorted by row."""
    import numpy as np

    rank = np.empty(len(rarity), np.int64)
    rank[np.argsort(rarity, kind="stable")] = np.arange(len(rarity))
    key = np.full(n_rows, len(rarity), np.int64)
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        key[row[starts]] = np.minimum.reduceat(rank[term], starts)
    return np.argsort(key, kind="stable")


@dataclass
class Weights:
    idf: list[float]
    mean_dl: float


def term_weights(stats: DataFrame, wanted: Wanted, scorer: Bm25) -> Weights:
    """`stats` holds the terms of the slice and of all documents, each once."""
    rows = stats.toArrow()
    found = dict(zip(rows.column("term").to_pylist(), rows.column("df").to_pylist()))
    if ALL not in found:
        return Weights([0.0] * len(wanted.terms), 1.0)
    n_docs = found[ALL]
    total = rows.column("total_dl").to_pylist()[rows.column("term").index(ALL).as_py()]
    idf = [scorer.idf(n_docs, found[t]) if t in found else 0.0 for t in wanted.terms]
    return Weights(idf, (total / n_docs) or 1.0)


def bm25_task(
    wanted: Wanted, weights: Weights, k: int, id_col: str, facet_col: str | None, scorer: Bm25
):
    """Score document blocks against all queries of the slice and keep the task's best."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        term_set, n = pa.array(wanted.terms, pa.string()), len(wanted.query_ids)
        idf = np.array(weights.idf)
        asked = [AskedTerms(wanted, first, min(first + QUERY_BLOCK, n)) for first in range(0, n, QUERY_BLOCK)]
        best, schema, held = TaskTopK(n, k), None, Cells()
        for whole in batches:
            schema = whole.schema
            for batch, codes, dl in coded_blocks(whole, term_set):
                doc, term, tf = count_codes(codes, dl, len(term_set))
                if not doc.size:
                    continue
                saturation = tf + scorer.k1 * (1 - scorer.b + scorer.b * dl[doc] / weights.mean_dl)
                value = tf * (scorer.k1 + 1) / saturation * idf[term]
                present, at = np.unique(term, return_inverse=True)
                order = alike(doc, term, batch.num_rows, idf)
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                doc = place[doc]
                by_doc = np.argsort(doc, kind="stable")
                doc, at, value = doc[by_doc], at[by_doc].astype(np.int32), value[by_doc]
                batch = batch.drop_columns("_toks").take(pa.array(order))
                ids, facets = batch.column(id_col), facets_of(batch, facet_col)
                for terms in asked:
                    own_doc, own_term, own_value = terms.entries(doc, present, at, value)
                    for start in range(0, batch.num_rows, GROUP):
                        stop = min(start + GROUP, batch.num_rows)
                        here = slice(*np.searchsorted(own_doc, [start, stop]))
                        group = terms.group(own_doc[here] - start, own_term[here], own_value[here], stop - start)
                        for first in range(start, stop, TILE):
                            tile = slice(first, min(first + TILE, stop))
                            scores, exact = group.tile(first - start, tile.stop - start, held)
                            own_facets = None if facets is None else facets[tile]
                            best.offer(scores, ids[tile], own_facets, terms.first, 0.0, exact, terms.slack)
        if schema is not None:
            yield candidate_batch(best, wanted.query_ids, schema, id_col, facet_col)

    return run


class Cells:
    """Matrices that every tile of scores is written to in turn, in single and in double
    precision, and one to turn these into those."""

    def __init__(self):
        self.common = self.rare = self.single = None

    def of(self, n_docs: int, n: int):
        import numpy as np

        size = n_docs * n
        if self.rare is None or self.rare.size < size:
            self.common, self.rare, self.single = np.empty(size, np.float32), np.empty(size), np.empty(size, np.float32)
        self.rare[:size] = 0.0
        return tuple(m[:size].reshape(n_docs, n) for m in (self.common, self.rare, self.single))


class AskedTerms:
    """The terms of a block of queries, as a sparse matrix of queries by terms, sorted by term."""

    def __init__(self, wanted: Wanted, first: int, last: int):
        import numpy as np

        here = slice(*np.searchsorted(wanted.pair_query, [first, last]))
        query = wanted.pair_query[here] - first
        self.first, self.n = first, last - first
        self.terms, term = np.unique(wanted.pair_term[here], return_inverse=True)
        order = np.argsort(term, kind="stable")
        self.query = query[order]
        self.count = np.bincount(term, minlength=len(self.terms)).astype(np.int32)
        self.start = (np.cumsum(self.count) - self.count).astype(np.int32)
        # Twice the bound of a sum of a query's terms, and two numbers more, in single precision.
        self.slack = (int(np.bincount(query, minlength=1).max()) + 4) * 2.0**-23

    def entries(self, doc, present, at, value):
        """Those of the entries that the block asks for, with its numbers of their terms.

        Entry i is a document, the place of its term in the sorted terms `present`, and its
        value; entries are sorted by document.
        """
        import numpy as np

        if not len(self.terms):
            return doc[:0], at[:0], value[:0]
        own = np.minimum(np.searchsorted(self.terms, present), len(self.terms) - 1).astype(np.int32)
        own[self.terms[own] != present] = -1
        term = own[at]
        kept = np.flatnonzero(term >= 0)
        return doc[kept], term[kept], value[kept]

    def group(self, doc, term, value, n_docs: int) -> "Group":
        return Group(self, doc, term, value, n_docs)

    def score(self, doc, present, at, value, n_docs: int, held: Cells):
        """`Group.tile` of all the documents of the entries."""
        return self.group(*self.entries(doc, present, at, value), n_docs).tile(0, n_docs, held)

    def queries(self, terms):
        """How many queries ask for each of the terms, and which, one after the other."""
        import numpy as np

        times = self.count[terms]
        step = np.repeat(self.start[terms] - (np.cumsum(times) - times), times)
        step += np.arange(len(step))
        return times, self.query[step]


class Group:
    """Documents against a block of queries: terms shared by many of both are dense rows,
    multiplied in single precision; of the many rare ones the few products are expanded and
    added up. The documents are scored in tiles that stay in the processor's cache."""

    EXPANDED, EXACT = 65_536, 256  # products, and positions told exactly, held at once
    DENSE, DENSE_TERMS = 150, 1024  # share of a matrix from which a term is a row of it; most rows

    def __init__(self, asked: AskedTerms, doc, term, value, n_docs: int):
        import numpy as np

        self.asked = asked
        products = asked.count * np.bincount(term, minlength=asked.count.size)
        dense = np.flatnonzero(products > max(asked.n * n_docs // self.DENSE, 1))
        if dense.size > self.DENSE_TERMS:
            dense = np.sort(dense[np.argsort(-products[dense], kind="stable")[: self.DENSE_TERMS]])
        slot = np.full(asked.count.size, -1, np.int32)
        slot[dense] = np.arange(dense.size, dtype=np.int32)
        place = slot[term]
        there = np.flatnonzero(place >= 0)
        self.rows = np.zeros((n_docs, dense.size))
        self.rows[doc[there], place[there]] = value[there]
        self.single = self.rows.astype(np.float32)
        self.asks = np.zeros((asked.n, dense.size), np.float32)
        times, query = asked.queries(dense)
        self.asks[query, np.repeat(np.arange(dense.size), times)] = 1.0
        there = np.flatnonzero(place < 0)
        self.doc, self.term, self.value = doc[there], term[there], value[there]

    def tile(self, first: int, last: int, held: Cells):
        """`(documents, queries)`: the sums of the values of common terms of the documents
        from `first` to `last`, off by `slack` of them at most, and a function that tells
        those at given positions exactly. The sums are in `held`, up to the next tile."""
        import numpy as np

        common, rare, single = held.of(last - first, self.asked.n)
        rows = self.rows[first:last]
        np.matmul(self.single[first:last], self.asks.T, out=common)
        here = slice(*np.searchsorted(self.doc, [first, last]))
        base, term, value = (self.doc[here] - first) * self.asked.n, self.term[here], self.value[here]
        ends, start, flat = np.cumsum(self.asked.count[term], dtype=np.int64), 0, rare.reshape(-1)
        while start < len(term):
            done = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, done + self.EXPANDED, side="right")), start + 1)
            times, cell = self.asked.queries(term[start:stop])
            cell += np.repeat(base[start:stop], times)
            np.add.at(flat, cell, np.repeat(value[start:stop], times))
            start = stop
        np.copyto(single, rare, casting="same_kind")
        common += single

        def exact(doc, query):
            parts = [slice(i, i + self.EXACT) for i in range(0, len(doc), self.EXACT)]
            sums = [np.einsum("ij,ij->i", rows[doc[i]], self.asks[query[i]]) for i in parts]
            return rare[doc, query] + (np.concatenate(sums) if sums else 0.0)

        return common, exact


def coded_blocks(whole, term_set):
    """A batch in blocks, with the numbers of their tokens in `term_set` (-1: none), one after
    the other, and the lengths of their texts. A lookup, of several blocks' tokens, hashes the terms."""
    import numpy as np
    import pyarrow.compute as pc

    toks = whole.column("_toks")
    dl = pc.list_value_length(toks).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends, start, low, high = toks.flatten(), np.cumsum(dl), 0, 0, 0
    for batch in blocks(whole, 0):
        stop = start + batch.num_rows
        first, last = ends[start] - dl[start], ends[stop - 1]
        if last > high:
            low, high = first, max(last, min(first + LOOKUP, len(flat)))
            codes = pc.fill_null(pc.index_in(flat.slice(low, high - low), value_set=term_set), -1).to_numpy()
        yield batch, codes[first - low : last - low] if last > first else np.empty(0, np.int32), dl[start:stop]
        start = stop


def count_codes(codes, dl, n_terms: int):
    """Documents, terms and counts of the wanted terms of a block, sorted by document."""
    import numpy as np

    doc = np.repeat(np.arange(len(dl)), dl)
    known = codes >= 0
    cell, tf = np.unique(doc[known] * max(n_terms, 1) + codes[known], return_counts=True)
    return cell // max(n_terms, 1), cell % max(n_terms, 1), tf
