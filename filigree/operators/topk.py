"""Top-k selection: within a task while scoring, and across tasks by a window."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from filigree.session import stored

SCORE_DIGITS = 6
SCORING_TASKS = 8192
SCORE_CELLS = 2_000_000
FACET_CELLS = 1_000_000
#: Candidates that a task holds at most, over all queries and facets.
HELD = 8_000_000
#: Candidates a query that a task collects before they take their places.
WAITING = 16


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows per key. Spark limits each task's groups before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def best_first(score: str, *ids: str) -> list[Column]:
    """Descending score, ties by ascending id."""
    return [F.desc(score), *[F.asc(i) for i in ids]]


class TaskTopK:
    """Running best `k` candidates per (facet, query) inside one task.

    A task emits once, at most k rows per query and facet, so scoring never
    materialises a row per (query, document) pair. `slice_bound` keeps the cells few:
    a cell is a (facet, query), whose best are a row of `score` and of `ids`.
    """

    def __init__(self, n_queries: int, k: int):
        self.n, self.k = n_queries, k
        self.facets: dict = {}
        self.score = self.ids = None
        self.waiting: dict[int, list] = {}

    def offer(self, scores, ids, facets=None, first: int = 0, above: float = float("-inf"), exact=None, slack: float = 0.0) -> None:
        """Take a `(candidates, queries)` block of scores of the queries from `first` on;
        scores that are not greater than `above` are no match. `ids` and `facets` are Arrow
        columns of the candidates. Scores may be off by the share `slack`; `exact` then tells
        those at `(candidate, query)` positions."""
        import numpy as np

        if not scores.size:
            return
        ids = plain(ids)
        place = self._places(facets, ids.dtype)
        if ids.dtype != self.ids.dtype:
            ids, self.ids = ids.astype(object), self.ids.astype(object)
        step = max(SCORE_CELLS // len(scores), 1)
        for start in range(0, scores.shape[1], step):
            part = scores[:, start : start + step]
            queries = np.arange(first + start, first + start + part.shape[1])
            codes = np.arange(len(self.facets))
            floor = self.score[codes[:, None] * self.n + queries, -1]
            if facets is None:
                self._warm(part, floor, slack)
            least = self._least(floor, above, slack, part.dtype)
            doc, query = np.divmod(np.flatnonzero(part >= (least if facets is None else least[place])), part.shape[1])
            score = np.round(part[doc, query] if exact is None else exact(doc, query + start), SCORE_DIGITS)
            cell = place[doc if facets is not None else 0] * self.n + queries[query]
            good = (score > above) & (score >= self.score[cell, -1])
            if good.any():
                self._wait(first + start, part.shape[1], cell[good], score[good], ids[doc[good]])

    def _wait(self, first: int, n: int, cell, score, ids) -> None:
        """Candidates wait until there are a few for each of the `n` queries from `first` on."""
        waiting = self.waiting.setdefault(first, [])
        waiting.append((cell, score, ids))
        if sum(len(w[0]) for w in waiting) >= WAITING * n:
            self._take(first)

    def _take(self, first: int) -> None:
        import numpy as np

        self._merge(*(np.concatenate(parts) for parts in zip(*self.waiting.pop(first))))

    def _places(self, facets, dtype):
        """The numbers of the candidates' facets, one for all without; new ones get cells."""
        import numpy as np

        values, local = [None], np.zeros(1, np.int64)
        if facets is not None:
            found = facets.dictionary_encode()
            values = [*found.dictionary.to_pylist(), *([None] if facets.null_count else [])]
            local = found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False)
        codes = np.array([self.facets.setdefault(v, len(self.facets)) for v in values], np.int64)
        if self.score is None:
            self.score, self.ids = np.empty((0, self.k)), np.empty((0, self.k), dtype)
        missing = len(self.facets) * self.n - len(self.score)
        if missing > 0:
            self.score = np.concatenate([self.score, np.full((missing, self.k), -np.inf)])
            self.ids = np.concatenate([self.ids, np.full((missing, self.k), None if self.ids.dtype == object else 0, self.ids.dtype)])
        return codes[local]

    @staticmethod
    def _least(floor, above: float, slack: float, dtype):
        """The scores of a type from which a candidate may be greater than `above` and not below `floor`."""
        import numpy as np

        least = floor - slack * np.abs(floor, where=floor > -np.inf, out=np.zeros_like(floor)) - 10.0**-SCORE_DIGITS
        low = np.array(-np.inf, dtype)
        return np.maximum(np.nextafter(least.astype(dtype), low), np.nextafter(np.array(above, dtype), -low))

    def _warm(self, part, floor, slack: float) -> None:
        """Where nothing is held, the block's own k-th best is the floor; changes `floor`."""
        import numpy as np

        empty, at = np.flatnonzero(floor[0] == -np.inf), len(part) - self.k
        if at > self.k and empty.size:
            lines = np.ascontiguousarray(part[:, empty].T)
            kth = np.partition(lines, at, axis=1)[:, at]
            floor[0, empty] = np.round(kth - slack * np.maximum(kth, 0), SCORE_DIGITS)

    def _merge(self, cell, score, ids) -> None:
        """Rank the candidates with those that hold their cells' places, a few of a cell at a time."""
        import numpy as np

        low = cell.min()
        # Short integers are sorted by their digits.
        by = cell - low if cell.max() - low > 65535 else (cell - low).astype(np.uint16)
        order = np.argsort(by, kind="stable")
        cell, score, ids = cell[order], score[order], ids[order]
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        nth = np.arange(len(cell)) - np.repeat(starts, np.diff(starts, append=len(cell)))
        wide = 2 * WAITING
        for done in range(0, int(nth.max()) + 1, wide):
            turn = slice(None) if nth.max() < wide else np.flatnonzero((nth >= done) & (nth < done + wide))
            self._place(cell[turn], nth[turn] - done, score[turn], ids[turn])

    def _place(self, cell, nth, score, ids) -> None:
        import numpy as np

        cells, line = np.unique(cell, return_inverse=True)
        shape = (len(cells), self.k + int(nth.max()) + 1)
        scores, own = np.full(shape, -np.inf), np.zeros(shape, self.ids.dtype)
        if own.dtype == object:
            own[:] = None
        scores[:, : self.k], own[:, : self.k] = self.score[cells], self.ids[cells]
        scores[line, self.k + nth], own[line, self.k + nth] = score, ids
        best = np.lexsort((id_order(own.ravel()).reshape(shape), -scores), axis=-1)[:, : self.k]
        self.score[cells], self.ids[cells] = np.take_along_axis(scores, best, 1), np.take_along_axis(own, best, 1)

    def drain(self):
        """Facet values, and of all that is held facet number, query position, id and score."""
        import numpy as np

        for first in list(self.waiting):
            self._take(first)
        if self.score is None:
            none = np.empty(0, np.int64)
            return [], none, none, none, np.empty(0)
        cell, nth = np.nonzero(self.score > -np.inf)
        return list(self.facets), cell // self.n, cell % self.n, self.ids[cell, nth], self.score[cell, nth]


def plain(ids):
    """An Arrow column of ids as a numpy array: of integers, or of objects."""
    import numpy as np
    import pyarrow as pa

    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.empty(len(ids), object)
    out[:] = ids.to_pylist()
    return out


def id_order(ids):
    """Numbers in the order of the ids, absent ones first."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if ids.dtype != object:
        return ids
    return pc.rank(pa.array(ids), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def slice_bound(slice_rows: int, k: int, facets: int = 1) -> int:
    """Queries of a slice such that a task holds at most `HELD` candidates."""
    return max(1, min(slice_rows, HELD // max(k * facets, 1)))


def facet_slice(rows: DataFrame, facet_col: str | None, slice_rows: int, k: int = 1) -> int:
    """Queries of a slice such that a task holds at most `FACET_CELLS` of (facet, query)."""
    if facet_col is None:
        return slice_bound(slice_rows, k)
    facets = rows.select(facet_col).distinct().count()
    return max(1, min(slice_bound(slice_rows, k, facets), FACET_CELLS // max(facets, 1)))


def for_scoring(rows: DataFrame) -> DataFrame:
    """At most a few tasks per core, and never fewer than thousands where there are more.

    Each task emits up to k rows per query, so the tasks, not the rows, set the size of
    the shuffle that follows. Merging splits moves no data.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(SCORING_TASKS, 4 * cores))


def held_for_scoring(rows: DataFrame) -> DataFrame:
    """Rows that several slices of queries are scored against, written once."""
    return stored(rows, "scored-rows")


def rank_candidates(scored: DataFrame, k: int, id_col: str, facet_col: str | None) -> DataFrame:
    keys = ["query_id", facet_col] if facet_col else ["query_id"]
    return top_k(scored, keys, best_first("score", id_col), k)


def candidate_schema(queries: DataFrame, docs: DataFrame, id_col: str, facet_col: str | None) -> T.StructType:
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType)]
    if facet_col:
        fields.append(T.StructField(facet_col, docs.schema[facet_col].dataType))
    fields += [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())]
    return T.StructType(fields)


def blocks(batch, n_queries: int):
    """Cut a batch so that a block of scores stays at a few million cells."""
    rows = min(max(SCORE_CELLS // max(n_queries, 1), 64), 2048)
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def typed_ids(rows: list, queries: DataFrame):
    """Query ids of collected rows as an Arrow array of the column's type."""
    import pyarrow as pa

    return pa.array([r["query_id"] for r in rows], to_arrow_type(queries.schema["query_id"].dataType))


def candidate_batch(best: TaskTopK, query_ids, schema, id_col: str, facet_col: str | None):
    """The task's candidates as one Arrow batch."""
    import pyarrow as pa

    values, facet, query, ids, score = best.drain()
    columns = {"query_id": query_ids.take(pa.array(query, pa.int64()))}
    if facet_col:
        columns[facet_col] = pa.array(values, schema.field(facet_col).type).take(pa.array(facet, pa.int64()))
    columns[id_col] = pa.array(ids, schema.field(id_col).type)
    columns["score"] = pa.array(score, pa.float64())
    return pa.RecordBatch.from_pydict(columns)


def facets_of(batch, facet_col: str | None):
    return batch.column(facet_col) if facet_col else None
