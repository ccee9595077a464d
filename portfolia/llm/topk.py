"""Exact top-k search by inner product with MaxScore (operator 10).

Vectors of whole numbers are documents whose terms are their components.  The
rows are packed into shards of at most ``SHARD`` vectors, kept as one posting
list per component with the least and the most in it, so each component has a
bound on what it can add to a query's score.  Components are taken by falling
bound.  A query has a threshold, the score of its k-th best row so far, which
rises from shard to shard: components are essential until the bounds of the
rest can't lift a row to it.  The essential lists are traversed, and others too
while many rows stay competitive; then the rest is probed, in order of the
bounds, only for rows that still are.  The queries of a block share the order of
components and are scored together.

Queries come in blocks of at most ``QUERIES``; parts of ``PART`` bytes of blocks
meet the shards in a Cartesian product.  A task reads its shards one by one
against one part of the queries and holds no more than a shard, that part and
the k best rows of its queries, which is also all that it shuffles; nothing is
broadcast, and no vector passes the driver.  Wide vectors make smaller shards
and blocks (``BYTES``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portfolia.llm.common import bound_batches, stage

SHARD, QUERIES, BYTES, PART = 8192, 4096, 1 << 20, 8 << 20
#: Queries scored at once, cells of which a 512th may be probed one by one, and components traversed in a step.
TOGETHER, PROBED, STEP = 256, 512, 8


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """id and v: floor(scale * x) of each component; null vectors, and those with null or non-finite components, are left out."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    usable = F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return table.where(usable).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors sorted by id: ids, vectors as bytes of whole numbers (as narrow as they may be) and their width; no shuffle.

    Rows with a null id are left out; shorter vectors are filled with zeros;
    rows of one id stay, in any order.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(parts).combine_chunks()
        part = part.take(pc.sort_indices(part.column("id"))).combine_chunks()
        ids, lists = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (part.column("id"), part.column("v")))
        length = lists.value_lengths().to_numpy()
        m = np.zeros((len(length), int(length.max(initial=0))), np.int64)
        m[np.arange(m.shape[1])[None, :] < length[:, None]] = lists.flatten().to_numpy()
        narrow = next(t for t in (np.int16, np.int32, np.int64) if t is np.int64 or _greatest(m) <= np.iinfo(t).max)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([m.astype(narrow).tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())], names=["ids", "vectors", "width"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, widest = [], 0, 1
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                widest = max(widest, int(pc.max(batch.column("v").value_lengths()).as_py() or 1))
                most = max(1, min(size, BYTES // (2 * widest)))
                held.append(batch.slice(at, max(0, most - n)))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n >= most:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return rows.where("id is not null").mapInArrow(work, f"ids array<{kind}>, vectors binary, width int").withColumn("block", F.monotonically_increasing_id())


def _matrix(vectors: pa.Scalar, n: int, width: int) -> np.ndarray:
    raw = vectors.as_buffer()
    return np.frombuffer(raw, f"<i{raw.size // (n * width)}" if n * width else "<i2").reshape(n, width)


def _greatest(m: np.ndarray) -> int:
    """The greatest absolute value, 1 at least; that of the least 64-bit number too, which numpy's own ``abs`` can't give."""
    return max(1, int(m.max(initial=0)), -int(m.min(initial=0)))


def _largest_score(largest: int, greatest: int, width: int) -> int:
    """A bound on the scores of queries of components up to ``largest`` and rows up to ``greatest``; an error where 64 bits may not hold them."""
    bound = max(1, largest) * greatest * max(1, width)
    if bound >= 1 << 62:
        raise OverflowError("vectors are too large: inner products may not fit in 64 bits")
    return bound


def _own(queries: pa.Array, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries and rows of one id: all pairs, by query."""
    code = pa.concat_arrays([queries, rows]).dictionary_encode().indices.to_numpy()
    asked, there = code[: len(queries)], code[len(queries) :]
    order = np.argsort(there, kind="stable")
    first, last = (np.searchsorted(there[order], asked, side) for side in ("left", "right"))
    n = last - first
    return np.repeat(np.arange(len(asked)), n), order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _top(query: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each query, by query, falling score and rising ``tie``."""
    order = np.lexsort([tie, -score, query])
    asked = query[order]
    return order[np.arange(len(order)) - np.searchsorted(asked, asked) < k]


#: What no score is as low as: a query that k rows have not answered yet has this threshold.
NONE = -(1 << 62)


class Shard:
    """Posting lists of a shard: one row per component, with the least and the most in it."""

    def __init__(self, vectors: np.ndarray, largest: int):
        #: Whole numbers are exact in floats up to 2^24 and in doubles up to 2^53.
        most = _largest_score(largest, _greatest(vectors), vectors.shape[1])
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        self.postings = np.ascontiguousarray(vectors.T).astype(self.kind)
        self.low, self.high = (f(self.postings, axis=1) if vectors.size else np.zeros(len(self.postings), self.kind) for f in (np.min, np.max))

    def search(self, queries: np.ndarray, least: np.ndarray, k: int, barred: tuple[np.ndarray, np.ndarray], depth: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """Queries, places and scores of rows that reach the thresholds ``least``, the best k of a query at most, by query.

        Pairs in ``barred`` are left out.  ``depth`` components at least are
        traversed; besides, how many were and how many postings were read.
        """
        width, rows = min(queries.shape[1], len(self.postings)), self.postings.shape[1]
        q = queries[:, :width].astype(self.kind)
        ends = np.stack([q * self.low[:width], q * self.high[:width]])
        low, high = ends.min(0), ends.max(0)
        bound = (high - low).astype(np.float64).sum(0)
        order = np.argsort(-bound, kind="stable")
        rest = order[bound[order] > 0]
        fixed = high[:, bound == 0].sum(1)  # the same for all rows
        q, lists = q[:, rest], self.postings[rest]
        zero = np.zeros((len(q), 1), self.kind)
        after = fixed[:, None] + np.hstack([np.cumsum(high[:, rest][:, ::-1], axis=1)[:, ::-1], zero])  # the most that components from each on can add
        before = np.hstack([zero, np.cumsum(low[:, rest], axis=1)])
        open_ = least == NONE
        # Essential components: without them, the others together stay under the threshold.
        essential = len(rest) if open_.any() else int((before + after >= least.astype(self.kind)[:, None]).sum(1).max(initial=0))
        done, read = min(len(rest), max(essential, depth)), 0
        score = q[:, :done] @ lists[:done]
        while True:
            read = done * score.size
            if open_.any():  # all components are read
                score += fixed[:, None]
                score[barred] = -np.inf if self.kind is not np.int64 else NONE
                if rows >= k:
                    reached = np.partition(score[open_], rows - k, axis=1)[:, rows - k]
                    least = least.copy()
                    least[open_] = np.where(reached > NONE, reached, NONE).astype(np.int64)
                score -= fixed[:, None]
            asked_for = np.where(least == NONE, NONE, least).astype(self.kind)
            keep = score >= (asked_for - after[:, done])[:, None]
            keep[barred] = False
            query, place = np.divmod(np.flatnonzero(keep), max(1, rows))
            if done == len(rest) or len(query) <= 64 + keep.size // PROBED:
                break
            more = min(STEP, len(rest) - done)
            score += q[:, done : done + more] @ lists[done : done + more]
            done += more
        depth = done
        score = score[query, place]
        while done < len(rest) and len(query):
            part = slice(done, done + STEP)
            score = score + (q[query, part] * lists[part, place].T).sum(1)
            done = min(len(rest), done + STEP)
            read += len(query) * (min(len(rest), part.stop) - part.start)
            keep = score + after[query, done] >= asked_for[query]
            query, place, score = query[keep], place[keep], score[keep]
        score = (score + fixed[query]).astype(np.int64)
        best = _top(query, score, place, k)
        return query[best], place[best], score[best], depth, read

    def best(self, query: np.ndarray, alive: np.ndarray, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and places of the best k of the rows ``alive`` (fewer, if others can't reach ``least``), and how many postings were read."""
        others = np.setdiff1d(np.arange(self.postings.shape[1]), alive)
        _, place, score, _, read = self.search(query[None, :], np.array([NONE if least is None else least]), k, (np.zeros(len(others), np.int64), others))
        return score, place, read


class Answers:
    """The k best rows of each query of a block in the shards met so far."""

    def __init__(self, ids: pa.Array, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k, self.largest, self.depth = ids, queries, k, _greatest(queries), 0
        self.score = np.full((len(ids), k), NONE, np.int64)
        self.row = np.full((len(ids), k), -1)  # places in ``rows``
        self.rows = ids.slice(0, 0)

    def meet(self, shard: Shard, ids: pa.Array) -> None:
        """Take the rows of a shard, sorted by id, in."""
        least = self.score[:, -1].copy()
        # Where k smaller ids are as good, rows of the shard must be better.
        full = np.flatnonzero(self.row[:, -1] >= 0)
        smaller = pc.less(self.rows.take(pa.array(self.row[full, -1])), ids[0]).to_numpy(zero_copy_only=False)
        least[full[smaller]] += 1
        own = _own(self.ids, ids)
        found = []
        for at in range(0, len(self.ids), TOGETHER):
            here = slice(*np.searchsorted(own[0], [at, at + TOGETHER]))
            query, place, score, depth, _ = shard.search(self.queries[at : at + TOGETHER], least[at : at + TOGETHER], self.k, (own[0][here] - at, own[1][here]), self.depth)
            found.append((query + at, place, score))
            if (least[at : at + TOGETHER] != NONE).all():
                self.depth = max(0, depth - 1)  # few steps if the next is alike, fewer components if it needs less
        query, place, score = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(query):
            self._merge(query, ids.take(pa.array(place)), score)

    def _merge(self, query: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        new = np.arange(len(query)) + len(self.rows)
        self.rows = pa.concat_arrays([self.rows, ids])
        touched = np.unique(query)
        query = np.concatenate([np.repeat(touched, self.k), query])
        score = np.concatenate([self.score[touched].ravel(), score])
        row = np.concatenate([self.row[touched].ravel(), new])
        query, score, row = (x[row >= 0] for x in (query, score, row))
        best = _top(query, score, pc.rank(self.rows.take(pa.array(row)), tiebreaker="dense").to_numpy(), self.k)
        query, score, row = query[best], score[best], row[best]
        at = np.arange(len(query)) - np.searchsorted(query, query)
        self.score[query, at], self.row[query, at] = score, row
        if len(self.rows) > 4 * self.row.size:
            there = self.row >= 0
            self.rows = self.rows.take(pa.array(self.row[there]))
            self.row[there] = np.arange(there.sum())

    def found(self) -> pa.RecordBatch:
        query, at = np.nonzero(self.row >= 0)
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(query)), self.rows.take(pa.array(self.row[query, at])), pa.array(self.score[query, at])], names=["query_id", "vec_id", "score"])


def top_k(table: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of ``table`` for each row of ``queries``, never itself.

    Both have vec_id, of one type that can be ordered, and embedding.  Vectors
    that are null or hold null or non-finite components take no part; missing
    components of shorter vectors count as zero.  Ties go to the smaller vec_id.
    Rows with a null id take no part; repeated rows count each, and rows with a
    query's own id are not its candidates.  Query rows with one id are answered
    together.  Components so large that a score might not fit in 64 bits (the
    product of the greatest of both sides and their width, from 2^62 on) are an
    error.  A query without candidates has no row, and neither has an empty
    table.  Other columns are not read.
    """
    bound_batches(table.sparkSession)
    kind = table.schema["vec_id"].dataType.simpleString()
    shards = stage(_packed(whole_vectors(table), SHARD), "shards").select(F.col("block").alias("shard"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"), F.col("width").alias("c_width"))
    rows = stage(whole_vectors(queries), "queries")
    parts = max(1, -(-int(rows.agg(F.sum(2 * F.size("v"))).first()[0] or 0) // PART))
    asked = stage(_packed(rows.repartition(parts), QUERIES), "query-blocks").coalesce(parts)
    # Each part of the queries meets each partition of the shards; the hint keeps Spark from broadcasting either.
    met = shards.crossJoin(asked.hint("shuffle_replicate_nl"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, at_shard, made = {}, None, {}
        for batch in batches:
            for at in range(batch.num_rows):
                one = {c: batch.column(c)[at] for c in batch.schema.names}
                block, ids = one["block"].as_py(), one["c_ids"].values
                if block not in answers:
                    q_ids = one["ids"].values
                    # Copies: views would keep the batch that they came in.
                    q_ids = pa.concat_arrays([q_ids, q_ids.slice(0, 0)])
                    answers[block] = Answers(q_ids, _matrix(one["vectors"], len(q_ids), one["width"].as_py()).copy(), k)
                if at_shard != one["shard"].as_py():
                    at_shard, made = one["shard"].as_py(), {}
                largest = answers[block].largest
                if largest not in made:
                    made[largest] = Shard(_matrix(one["c_vectors"], len(ids), one["c_width"].as_py()), largest)
                answers[block].meet(made[largest], ids)
        for block in answers.values():
            yield block.found()

    found = met.mapInArrow(work, f"query_id {kind}, vec_id {kind}, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
