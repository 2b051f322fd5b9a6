"""Exact top-k by integer inner product with MaxScore, shard by shard.

The terms of a query are its dimensions, weighted by its components. In a shard, the
postings of a term are the rows whose value adds more than the least that any row of the
shard adds there; they are sorted by value, best first. A term's score bound is what its
best posting adds over that least value, so all contributions are non-negative, and a row's
score is the sum of the least values, the floor, and its contributions.

Terms are ordered by their bounds. While a query's threshold is the k-th best score so far,
the terms of the smallest bounds that together cannot lift a row from the floor to the
threshold are non-essential, for each query by itself: a row that is in no essential list
cannot be a result. Essential postings are traversed and their contributions added up; a
list that holds most rows of the shard is added as a whole column. The other terms are then
probed a few at a time, only for rows whose score so far plus the bounds still open reaches
the threshold. The threshold starts from the exact scores of the rows at the heads of the
heaviest lists, rises with the exact scores of the best partial ones, and goes on from
shard to shard of a task. A query for which no term of a shard is essential skips the
shard. Rows that tie with the threshold stay in. What the tasks found is merged by score,
ties to the smaller id.

The stated query set meets all rows: the queries are packed and broadcast in passes of at
most ``pass_bytes``, and in each pass every task goes through its own rows, which never
move. Of several passes each one's results are written before the next begins.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows with a null id; vectors of different lengths are compared as if the
shorter one ended in zeros; equal scores tie and the smaller ids win; every row is a
candidate but the query's own, so another row that shares the query's id is one; a repeated
id is a query each time, with its own vector and its own results, under the same
``query_id``; an empty table gives no rows; other columns are ignored. Scores are exact
while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.runtime import materialize, quoted, ship


def quantized(vector: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of each component as double precision arithmetic gives it."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(factor)).cast("long"))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def _matrix(values: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    lists = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max([int(sizes.max(initial=0)), width or 0])
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    at = 0
    for r, n in enumerate(sizes):
        out[r, :n] = flat[at : at + n]
        at += n
    return out


def exact_kind(q: np.ndarray, v: np.ndarray) -> type:
    """The fastest number type in which all partial sums are exact."""
    most = 2.0 * float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(q.shape[1], v.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class ShardSearch:
    """MaxScore over one shard of rows; counts what it traverses, probes and skips."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, kind: type, step: int = 6):
        self.ids, self.kind, self.step = ids, kind, step
        self.n, self.width = values.shape
        whole = np.ascontiguousarray(values.T)
        self.columns = whole.astype(kind)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)
        self.above = (whole > whole.min(axis=1, keepdims=True)).sum(axis=1)  # postings for positive weights
        self.below = (whole < whole.max(axis=1, keepdims=True)).sum(axis=1)  # and for negative ones
        small = np.abs(whole).max(initial=0) < 2**15
        self.order = np.argsort(whole.astype(np.int16) if small else whole, axis=1, kind="stable").astype(np.int32)
        self.traversed = self.probed = self.skipped = 0

    def postings(self, term: int, weight: float) -> np.ndarray:
        """Rows of a term's list, best first."""
        if weight > 0:
            return self.order[term, self.n - self.above[term] :][::-1]
        return self.order[term, : self.below[term]]

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return q @ self.columns[:, rows]

    def search(self, q: np.ndarray, k: int, threshold: float | int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) with all that reach the k-th best score of the shard or ``threshold``,
        whichever is more."""
        used = np.flatnonzero(q)
        low, high = q[used] * self.low[used], q[used] * self.high[used]
        least = np.minimum(low, high)
        bound = np.maximum(low, high) - least
        by_bound = np.argsort(-bound, kind="stable")
        terms, least, bound = used[by_bound], least[by_bound], bound[by_bound]
        count = np.where(q[terms] > 0, self.above[terms], self.below[terms])
        open_bound = np.append(np.cumsum(bound[::-1])[::-1], 0).astype(self.kind)  # of the terms from here on
        floor = least.sum(dtype=self.kind)
        if self.n >= k:
            heads = np.unique(np.concatenate([[], *(self.postings(t, q[t])[: 2 * k] for t in terms[:6])]).astype(np.int64))
            if len(heads) < k:
                heads = np.arange(min(self.n, 2 * k))
            threshold = max(threshold, np.partition(self.exact(q, heads), -k)[-k])
        essential = int(np.searchsorted(-(floor + open_bound), -threshold, "right"))  # terms from here on cannot reach it
        if essential > len(terms):
            essential = len(terms)
        elif essential == 0:
            self.skipped += int(count.sum())
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.kind)
        score = np.full(self.n, floor, dtype=self.kind)
        dense = 2 * count[:essential] > self.n
        touched = np.full(self.n, bool(dense.any()) or threshold <= floor)
        whole = terms[:essential][dense]
        if len(whole):
            score += q[whole] @ self.columns[whole] - least[:essential][dense].sum()
        for t, base in zip(terms[:essential][~dense], least[:essential][~dense]):
            rows = self.postings(t, q[t])
            score[rows] += q[t] * self.columns[t, rows] - base
            touched[rows] = True
        self.traversed += int(count[:essential].sum())
        alive = np.flatnonzero(touched & (score + open_bound[essential] >= threshold))
        score = score[alive]
        at = essential
        while at < len(terms) and len(alive):
            if len(alive) > 4 * k:  # the best so far are scored in full, which raises the threshold
                best = alive[np.argpartition(score, -2 * k)[-2 * k :]]
                threshold = max(threshold, np.partition(self.exact(q, best), -k)[-k])
                stay = score + open_bound[at] >= threshold
                alive, score = alive[stay], score[stay]
            upto = min(len(terms), at + self.step)
            some = terms[at:upto]
            if 2 * len(alive) > self.n:
                more = (q[some] @ self.columns[some])[alive]
            else:
                more = q[some] @ self.columns[some[:, None], alive]
            self.probed += len(alive) * len(some)
            self.skipped += int(np.maximum(count[at:upto] - len(alive), 0).sum())
            score += more - least[at:upto].sum()
            at = upto
            stay = score + open_bound[at] >= threshold
            alive, score = alive[stay], score[stay]
        self.skipped += int(count[at:].sum())
        return alive, score


class Best:
    """The k best of each query over the shards of a task."""

    def __init__(self, k: int):
        self.k = k
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def threshold(self, at: int) -> float | int:
        ids, scores = self.found.get(at, ((), ()))
        return scores[-1] if len(ids) == self.k else -np.inf

    def add(self, at: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if at in self.found:
            ids, scores = np.concatenate((self.found[at][0], ids)), np.concatenate((self.found[at][1], scores))
        best = np.lexsort((ids, -scores))[: self.k]
        self.found[at] = ids[best], scores[best]


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``rows`` rows ``id, vector`` as one row of bytes each, all of one width."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        ids, matrix = batch.column(0).to_numpy(), _matrix(batch.column(1))
        at = 0
        while at < len(ids):
            n = min(rows - size, len(ids) - at)
            held.append((ids[at : at + n], matrix[at : at + n]))
            size, at = size + n, at + n
            if size == rows:
                yield _packed(held)
                held, size = [], 0
    if held:
        yield _packed(held)


def _packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    width = max(m.shape[1] for _, m in held)
    ids = np.concatenate([i for i, _ in held]).astype("<i8")
    matrix = np.concatenate([_padded(m, width) for _, m in held]).astype("<i8")
    small = np.abs(matrix).max(initial=0) < 2**15
    data = matrix.astype("<i2").tobytes() if small else matrix.tobytes()
    mark = width if small else -width
    return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([data], pa.binary()), pa.array([mark], pa.int32())], names=["ids", "vectors", "width"])


def _unpacked(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    kind = "<i2" if width > 0 else "<i8"
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, kind).astype(np.int64).reshape(-1, abs(width))


def top_k(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20,
          factor: float = 64.0, shard_rows: int = 8192, pass_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score. Queries: rows whose id is divisible by ``every``."""
    spark = rows.sparkSession
    ship(spark)
    vector = F.col(quoted(vector_col))
    ready = rows.where(F.col(quoted(id_col)).isNotNull() & usable(vector)).select(
        F.col(quoted(id_col)).cast("long").alias("id"), quantized(vector, factor).alias("v")
    )
    asked = ready.where(F.col("id") % every == 0)
    count, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    passes = -(-count * 8 * ((width or 0) + 1) // pass_bytes)
    found = [_one_pass(ready, asked, p, passes, k, shard_rows) for p in range(passes)]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if passes > 1:
        found = [materialize(f, "pass") for f in found]
    best = reduce(DataFrame.unionByName, found)
    # a query's own row is one of the rows that share its id and its own score, which look the same here
    mine = Window.partitionBy("q")
    own = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self")), F.col("place"))
    placed = best.withColumn("place", F.row_number().over(mine.orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    marked = placed.withColumn("own", F.coalesce(F.min(own).over(mine), F.lit(k + 2))).where("place <> own")
    ranked = marked.withColumn("rank", F.col("place") - (F.col("own") < F.col("place")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_pass(ready: DataFrame, asked: DataFrame, turn: int, passes: int, k: int, shard_rows: int) -> DataFrame:
    """q, query_id, self, vec_id, score: the k + 1 best of each task for the queries of one
    pass. ``q`` names the query's row and ``self`` is the score of its own row."""
    mine = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(passes)) == turn)
    blocks = mine.mapInArrow(lambda b: _pack(b, shard_rows), "ids binary, vectors binary, width int").collect()
    sent = ready.sparkSession.sparkContext.broadcast([tuple(r) for r in blocks])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [_unpacked(*b) for b in sent.value]
        ids = np.concatenate([i for i, _ in asked])
        width = max(m.shape[1] for _, m in asked)
        queries = np.concatenate([_padded(m, width) for _, m in asked])
        best = Best(k + 1)
        for shard in _pack(batches, shard_rows):
            own, values = _unpacked(*(shard.column(c)[0].as_py() for c in range(3)))
            both = max(width, values.shape[1])
            kind = exact_kind(queries, values)
            q, index = _padded(queries, both).astype(kind), ShardSearch(own, _padded(values, both), kind)
            for at in range(len(q)):
                hit, scores = index.search(q[at], k + 1, best.threshold(at))
                if len(hit):
                    best.add(at, own[hit], scores.astype(np.int64))
        held = sorted(best.found)
        for part in range(0, len(held), 1024):
            some = held[part : part + 1024]
            sizes = [len(best.found[at][0]) for at in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([(turn << 40) + at for at in some], sizes), pa.int64()), pa.array(np.repeat(ids[some], sizes), pa.int64()),
                 pa.array(np.repeat((queries[some] ** 2).sum(axis=1), sizes), pa.int64()),
                 pa.array(np.concatenate([best.found[at][0] for at in some]), pa.int64()),
                 pa.array(np.concatenate([best.found[at][1] for at in some]), pa.int64())],
                names=["q", "query_id", "self", "vec_id", "score"])

    return ready.mapInArrow(search, "q long, query_id long, self long, vec_id long, score long")
